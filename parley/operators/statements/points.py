"""Time-series points of the first generation (V1)."""

STATEMENTS = {
    "v101_conversation_stats": ("m", "select conversation_id, sender, count(*) n, cast(sum(count(*)) over (partition by conversation_id) as bigint) total from {m} group by conversation_id, sender"),
    "v103_message_metrics": ("m x", "select m.message_id, m.word_count, m.emoji_count, m.url_count, case when m.has_photos then 1 else 0 end photos, case when m.has_videos then 1 else 0 end videos, coalesce(r.n, 0) reaction_count from {m} m left join (select message_id, count(*) n from {x} group by message_id) r on r.message_id = m.message_id"),
    "v105_sentiment_points": ("m", "select message_id, sender, compound, case when compound >= 5e-2 then 'positive' when compound <= -5e-2 then 'negative' else 'neutral' end mood from {m} where content is not null"),
    "v107_response_metrics": ("m", "select prev_sender, sender, count(*) n, round(avg(gap), 4) avg_ms, min(gap) fastest, max(gap) slowest from (select sender, lag(sender) over (partition by conversation_id order by timestamp_ms, message_id) prev_sender, timestamp_ms - lag(timestamp_ms) over (partition by conversation_id order by timestamp_ms, message_id) gap from {m}) where sender <> prev_sender group by prev_sender, sender"),
    "v109_word_metrics": ("w", "select sender, word, count(*) n from {w} group by sender, word"),
    "v110_deduplicated": ("m", "select least_id from (select min(message_id) least_id from (select message_id, timestamp_ms, sender, content from {m} union all select message_id + 1000000, timestamp_ms, sender, content from {m} where message_id % 5 = 0) group by timestamp_ms, sender, content)"),
    "v111_length_buckets": ("m", "select case when word_count = 0 then '0' when word_count <= 5 then '1-5' when word_count <= 10 then '6-10' when word_count <= 20 then '11-20' else '20+' end bucket, count(*) n from {m} group by case when word_count = 0 then '0' when word_count <= 5 then '1-5' when word_count <= 10 then '6-10' when word_count <= 20 then '11-20' else '20+' end"),
    "v112_report": ("m", "select min(timestamp_ms) first_ms, max(timestamp_ms) last_ms, count(*) messages, count(distinct sender) participants, count(case when has_photos then 1 end) photos, count(case when has_videos then 1 end) videos from {m}"),
}
