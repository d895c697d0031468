"""Text functions and text summaries (FN, AGG-01 to AGG-12)."""

#: Worded as a reaction, or exactly one emoji in ten characters or fewer.
_REACTION = "(regexp_like(lower(content), 'reacted .+ to your message|reacted .+ to a message|liked your message|loved your message|laughed at your message|disliked your message|emphasized your message|questioned your message') or length(content) <= 10 and emoji_count = 1)"
_TYPE = f"""case when {_REACTION} then 'reaction' when has_photos or has_videos or contains(content, 'sent an attachment') then 'media_notification'
    when contains(content, 'started a call') or contains(content, 'ended the call') or contains(content, 'missed call') then 'call_event' when contains(content, 'You are now connected on Messenger') or contains(content, 'joined the group') then 'system_event'
    when contains(content, 'http://') or contains(content, 'https://') then 'link_share' when emoji_count > 0 and word_count = 0 then 'emoji_only' when trim(content) <> '' and translate(trim(content), '!@#$%^&*()_+-=[]{{{{}}}}|;:''"<>?,./', '') = '' then 'symbols_only'
    when word_count = 1 then 'single_word' when word_count <= 5 then 'short_text' when word_count <= 20 then 'medium_text' else 'long_text' end"""
_KIND = """case when has_photos then 'image' when has_videos then 'video' when has_audio then 'audio' when has_share then 'link' when contains(content, 'sent a gif') then 'gif' when contains(content, 'sent a sticker') then 'sticker'
    when contains(content, 'sent a file') or contains(content, 'sent an attachment') then 'document' else 'other' end"""
TYPE = _TYPE
_TYPED = f"(select *, {_TYPE} type from {{m}} where content is not null and not sys)"
#: An attachment's example names its sender alone.
_ATTACHED = f"(select *, {_KIND} type from {{m}} where has_photos or has_videos or has_audio or has_share or content ilike '%sent an attachment%' or content ilike '%sent a gif%' or content ilike '%sent a sticker%' or content ilike '%sent a file%')"

# Words of events, places and memories that make a message a fact of a shared life.
_PLACES = ("melbourne", "sydney", "brisbane", "perth", "bali", "japan", "thailand", "london", "airport", "uni", "campus", "gym", "work", "home", "cafe")
_EVENTS = "trip|flew|flight|birthday|wedding|graduat|moved|moving|started|job|interview|concert|festival|holiday|vacation|hospital|surgery|pregnant|engaged|married|break.?up|broke up|new place|apartment|house"
_MEMORIES = "remember|that time|when we|last year|years ago"
_whole = lambda words: f"regexp_like(lower(content), '(^|[^a-z0-9_])({words})([^a-z0-9_]|$)')"
TIMELINE = f"""(case when {_whole(_EVENTS)} then 3e0 else 0e0 end + {" + ".join(f"(case when contains(lower(content), '{p}') then 12e-1 else 0e0 end)" for p in _PLACES)} + case when {_whole(_MEMORIES)} then 2e0 else 0e0 end
    + case when word_count between 8 and 60 then 1e0 when word_count < 4 then -2e0 else 0e0 end - case when regexp_like(lower(content), 'sent [0-9]+ photo|shared a link') then 5e0 else 0e0 end)"""

STATEMENTS = {
    "agg01_text_totals": ("m", "select count(*) total_messages, round(avg(word_count), 6) avg_words, round(avg(emoji_count), 6) avg_emojis, round(avg(url_count), 6) avg_urls, cast(sum(emoji_count) as bigint) total_emojis, cast(sum(url_count) as bigint) total_urls from {m} where content is not null"),
    "agg04_emoji_summary": ("em", """select total, unique_emojis, senders, emoji top_emoji, sender top_sender from (select count(*) total, count(distinct emoji) unique_emojis, count(distinct sender) senders from {em}),
        (select emoji from {em} group by emoji order by count(*) desc, emoji limit 1), (select sender from {em} group by sender order by count(*) desc, sender limit 1)"""),
    "agg03_top_emojis_by_conversation": ("em", "select conversation_id, sender, emoji, n, rank from (select *, row_number() over (partition by conversation_id, sender order by n desc, emoji) rank from (select conversation_id, sender, emoji, count(*) n from {em} group by conversation_id, sender, emoji)) where rank <= 5"),
    "agg06_words_without_stop_words": ("w", "select word, sender, conversation_id, count(*) n from {w} group by word, sender, conversation_id having count(*) > 1 order by n desc, word, sender, conversation_id limit 1000"),
    "agg07_top_words": ("w", "select word, cast(sum(n) as bigint) n from (select word, sender, conversation_id, count(*) n from {w} group by word, sender, conversation_id having count(*) > 1 order by n desc, word, sender, conversation_id limit 1000) group by word"),
    "agg08_word_examples": ("w", """select word, message_id from (select word, message_id, row_number() over (partition by word order by (message_id * 7919) % 10007, message_id) n from (select distinct word, message_id from {w})) where n <= 3
        and word in (select word from {w} group by word order by count(*) desc, word limit 300)"""),
    "agg10_content_types": ("m", f"""select a.conversation_id, a.type, n, round(100e0 * n / sum(n) over (partition by a.conversation_id), 6) percentage, avg_length, unique_senders, ex.examples, ex.representative from
        (select conversation_id, type, count(*) n, cast(floor(avg(length(content)) + 5e-1) as bigint) avg_length, count(distinct sender) unique_senders from {_TYPED} group by conversation_id, type) a
        join (select conversation_id, type, concat(max(case when rn = 1 then shown else '' end), max(case when rn = 2 then concat(' | ', shown) else '' end), max(case when rn = 3 then concat(' | ', shown) else '' end)) examples,
        max(case when rn = 1 and type not in ('reaction', 'media_notification', 'call_event', 'system_event') then concat(sender, ': ', case when length(content) > 120 then concat(substr(content, 1, 119), '…') else content end) end) representative from
        (select *, case when length(content) > 100 then concat(substr(content, 1, 100), '...') else content end shown from (select conversation_id, type, sender, trim(content) content, row_number() over (partition by conversation_id, type order by message_id desc) rn from {_TYPED}) where rn <= 3) group by conversation_id, type) ex on ex.conversation_id = a.conversation_id and ex.type = a.type"""),
    # the length is of all rows with a text, the number of the rows that are no notices
    "agg11_content_summary": ("m", f"select total, types, cast(floor(chars / cast(total as double) + 5e-1) as bigint) avg_length from (select count(*) total, count(distinct type) types from {_TYPED}), (select cast(sum(length(content)) as bigint) chars from {{m}} where content is not null)"),
    "agg12_attachment_types": ("m", f"""select a.conversation_id, a.type, n, round(100e0 * n / sum(n) over (partition by a.conversation_id), 6) percentage, examples from (select conversation_id, type, count(*) n from {_ATTACHED} group by conversation_id, type) a
        join (select conversation_id, type, concat(max(case when rn = 1 then concat(sender, ' shared ', type) else '' end), max(case when rn = 2 then concat(' | ', sender, ' shared ', type) else '' end), max(case when rn = 3 then concat(' | ', sender, ' shared ', type) else '' end)) examples from
        (select *, row_number() over (partition by conversation_id, type order by sender) rn from (select distinct conversation_id, type, sender from {_ATTACHED})) where rn <= 3 group by conversation_id, type) ex on ex.conversation_id = a.conversation_id and ex.type = a.type"""),
    "fn05_reaction_detector": ("m", f"select message_id from {{m}} where {_REACTION}"),
    "fn10_content_class": ("m", f"select message_id, {_TYPE} type from {{m}} where content is not null"),
    "fn11_attachment_class": ("m", f"select message_id, {_KIND} type from {{m}}"),
    "fn14_words": ("w", "select message_id, word, count(*) n from {w} group by message_id, word"),
    "fn15_name_blocklist": ("nb", "select conversation_id, word from {nb}"),
    "fn17_topic_keywords": ("tp", "select message_id, word, count(*) n from {tp} group by message_id, word"),
    "fn20_starter_tier": ("s", "select sender, case when n >= 20 then 'prolific' when n >= 10 then 'active' when n >= 5 then 'occasional' else 'rare' end tier from (select sender, count(*) n from {s} group by sender)"),
    "fn23_platform_label": ("m", "select source, case source when 'instagram' then 'Instagram' when 'messenger' then 'Messenger' when 'whatsapp' then 'WhatsApp' when 'imessage' then 'iMessage' else 'Meta' end label, count(*) n from {m} group by source"),
    "fn31_timeline_score": ("m", f"select message_id, round({TIMELINE}, 6) score from {{m}} where content is not null"),
    "fn32_reaction_time": ("x m", "select x.message_id, case when x.reaction_ts > 1000000000000 then x.reaction_ts when x.reaction_ts > 0 then x.reaction_ts * 1000 else m.timestamp_ms end ms from {x} x join {m} m on m.message_id = x.message_id"),
    "fn37_keys": ("m", "select message_id, sha2(concat(cast(timestamp_ms as string), '-', sender, '-', substr(content, 1, 256)), 256) k from {m}"),
    "fn38_duration": ("r", "select to_message_id, case when latency_ms < 60000 then concat(cast(floor(latency_ms / 1000) as bigint), 's') when latency_ms < 3600000 then concat(cast(floor(latency_ms / 60000) as bigint), 'm') else concat(cast(floor(latency_ms / 3600000) as bigint), 'h') end label from {r}"),
    "fn13_importance_factors": ("m", """select message_id, substr(concat(case when length(content) > 200 then ', Long Message' when length(content) > 100 then ', Medium Message' when length(content) > 50 then ', Short Message' else '' end,
        case when compound > 5e-1 then ', Very Positive' when compound < -5e-1 then ', Very Negative' when compound > 3e-1 then ', Positive' when compound < -3e-1 then ', Negative' when abs(compound) > 1e-1 then ', Mild Sentiment' else '' end, case when media then ', Contains Media' else '' end,
        case when contains(content, '?') or regexp_like(lower(content), '(^|[^a-z0-9_])(what|how|why|when|where|who)([^a-z0-9_]|$)') then ', Question' else '' end, case when contains(content, '!') then ', Exclamation' else '' end, case when regexp_like(lower(content), 'https?://') or contains(lower(content), 'www.') then ', Link Sharing' else '' end,
        case when contains(content, '@') then ', Mentions' else '' end, case when regexp_like(lower(content), 'love|hate|amazing|terrible|fantastic|awful|excited|worried|happy|sad|angry|surprised') then ', Emotional Content' else '' end, case when caps_count between 1 and 4 then ', Emphasis' else '' end,
        case when hour < 6 or hour > 22 then ', Late Night Message' else '' end, case when length(content) > 500 then ', Very Long Message' else '' end), 3) factors from {m} where content is not null"""),
}
