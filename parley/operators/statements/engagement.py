"""Turns, engagement, bursts, starters and importance (AGG-15, AGG-23, AGG-49 to AGG-60)."""

_PAUSES = "(select *, lag(participant) over (partition by conversation_id order by turn_no) prev, start_ms - lag(end_ms) over (partition by conversation_id order by turn_no) pause from {t})"
_KEPT = "(select conversation_id from {t} group by conversation_id having sum(message_count) >= 3 and count(distinct participant) >= 2)"
_SHARES = "(select conversation_id, participant, count(*) n, sum(message_count) msgs from {t} group by conversation_id, participant)"
_TYPE = """case when contains(c, '?') or c like 'what%' or c like 'how%' or c like 'when%' or c like 'where%' or c like 'why%' or c like 'who%' or c like 'can you%' or c like 'do you%' or c like 'did you%' or c like 'have you%' or c like 'are you%' or c like 'will you%' then 'question'
    when contains(c, 'hello') or contains(c, 'hi ') or contains(c, 'hey') or contains(c, 'good morning') or contains(c, 'good afternoon') or contains(c, 'good evening') or c like 'hi%' then 'greeting'
    when contains(c, 'photo') or contains(c, 'image') or contains(c, 'video') or contains(c, 'attachment') or contains(c, 'shared') or contains(c, 'sent') or contains(c, '📷') or contains(c, '🎥') or contains(c, '📎') then 'media'
    when contains(c, 'everyone') or contains(c, 'announcement') or contains(c, 'news') or contains(c, 'update') or contains(c, 'fyi') or contains(c, 'btw') or c like 'just wanted to%' or c like 'wanted to let%' then 'announcement' else 'other' end"""
#: Session starters with the answers of others in the next day.
_STARTS = f"""(select message_id, conversation_id, sender, hour, content, type, responses, avg_ms, least(least(responses, 50) + case when avg_ms < 300000 then 30 when avg_ms < 1800000 then 20 when avg_ms < 7200000 then 10 else 5 end + 20, 100) score from
    (select s.message_id, s.conversation_id, s.sender, s.hour, content, {_TYPE} type, coalesce(responses, 0) responses, coalesce(avg_ms, 0) avg_ms from (select s.*, m.hour, m.content, lower(m.content) c from {{s}} s join {{m}} m on m.message_id = s.message_id) s
    left join (select message_id, count(*) responses, avg(after_ms) avg_ms from {{sa}} group by message_id) b on b.message_id = s.message_id))"""
STARTS = _STARTS
_SCORE = """(case when length(content) > 200 then 3e-1 when length(content) > 100 then 2e-1 when length(content) > 50 then 1e-1 else 5e-2 end) + (case when abs(compound) > 5e-1 then 25e-2 when abs(compound) > 3e-1 then 15e-2 when abs(compound) > 1e-1 then 1e-1 else 0e0 end)
    + (case when media then 15e-2 else 0e0 end) + (case when contains(content, '?') or regexp_like(lower(content), '(^|[^a-z0-9_])(what|how|why|when|where|who)([^a-z0-9_]|$)') then 1e-1 else 0e0 end) + least(5e-2 * (length(content) - length(replace(content, '!', ''))), 15e-2)
    + (case when regexp_like(lower(content), 'https?://') or contains(lower(content), 'www.') then 1e-1 else 0e0 end) + (case when contains(content, '@') then 8e-2 else 0e0 end)
    + (case when regexp_like(lower(content), 'love|hate|amazing|terrible|fantastic|awful|excited|worried|happy|sad|angry|surprised') then 1e-1 else 0e0 end) + (case when hour < 6 or hour > 22 then 5e-2 else 0e0 end) + (case when length(content) > 500 then 1e-1 else 0e0 end)
    + (case when caps_count between 1 and 4 then 8e-2 else 0e0 end)"""

STATEMENTS = {
    "agg15_corpus_summary": ("m", "select count(*) conversations, cast(sum(n) as bigint) messages, round(avg(n - 1), 6) avg_turns, round(avg(duration), 4) avg_duration_ms, round(avg(people), 6) avg_participants, max(everyone) unique_participants from (select conversation_id, cast(count(*) as double) n, cast(max(timestamp_ms) - min(timestamp_ms) as double) duration, cast(count(distinct sender) as double) people from {m} group by conversation_id), (select count(distinct sender) everyone from {m})"),
    "agg23_peak_grains": ("m", """select kind, k, n, rank from (select kind, k, n, row_number() over (partition by kind order by n desc, k) rank from (select 'hour' kind, cast(hour as string) k, count(*) n from {m} group by hour union all select 'day', cast(dow as string), count(*) from {m} group by dow union all select 'month', month, count(*) from {m} group by month)) where rank <= 3"""),
    "agg23_parts_of_day": ("m", "select max(case when hour between 6 and 11 then n end) morning_peak, max(case when hour between 12 and 17 then n end) afternoon_peak, max(case when hour between 18 and 23 then n end) evening_peak, cast(sum(case when hour < 6 then n end) as bigint) night_sum, max_by(hour, n * 100 - hour) most_active, min_by(hour, n * 100 + hour) least_active, count(*) active_hours from (select hour, count(*) n from {m} group by hour)"),
    "agg49_burst_distribution": ("b", "select depth, bursts, round(100e0 * bursts / whole, 6) percentage from (select message_count depth, count(*) bursts from {b} group by message_count), (select count(*) whole from {b})"),
    "agg49_burst_conversations": ("b", "select conversation_id, count(*) bursts, round(avg(message_count), 6) avg_depth, max(message_count) max_depth, round(avg(n_senders), 6) avg_participants from {b} group by conversation_id"),
    "agg50_turn_health": ("t", f"""select conversation_id, pattern, case pattern when 'balanced' then 9e-1 when 'responsive' then 8e-1 when 'sporadic' then 6e-1 else 4e-1 end health, round(turn_ratio, 2) turn_ratio from (select a.conversation_id, most / least turn_ratio,
        case when share > 7e-1 then 'dominant' when most <= 2 * least then 'balanced' when most > 7e-1 * turns then 'dominant' when pause < 300000 and turns > 10 then 'responsive' else 'sporadic' end pattern from
        (select conversation_id, cast(max(n) as double) most, min(n) least, sum(n) turns, cast(max(msgs) as double) / sum(msgs) share from {_SHARES} where conversation_id in {_KEPT} group by conversation_id) a
        join (select conversation_id, coalesce(avg(case when pause > 0 and pause < 86400000 then pause end), 0) pause from {_PAUSES} group by conversation_id) p on p.conversation_id = a.conversation_id)"""),
    "agg51_turn_responses": ("t", f"""select conversation_id, participant, count(*) turn_count, round(avg(message_count), 6) avg_length, round(coalesce(avg(case when prev <> participant and pause > 0 and pause < 86400000 then pause end), 0), 4) avg_response_ms,
        round(100e0 * count(case when prev <> participant and message_count = 1 and turn_no > first_turn then 1 end) / count(*), 6) interruption_rate from (select *, min(turn_no) over (partition by conversation_id, participant) first_turn from {_PAUSES}) where conversation_id in {_KEPT} group by conversation_id, participant"""),
    "agg52_turn_participants": ("t", f"""select participant, count(distinct conversation_id) conversations, count(*) turns, round(avg(message_count), 6) avg_length, round(avg(case when prev <> participant and pause > 0 and pause < 86400000 then 1000000e0 / pause end), 6) responsiveness from {_PAUSES} where conversation_id in {_KEPT} group by participant"""),
    "agg54_engagement_inputs": ("m", "select a.sender, conversations, messages, round(avg_len, 6) avg_len, n_days, first_ms, last_ms, coalesce(starts, 0) starts from (select sender, count(distinct conversation_id) conversations, count(*) messages, avg(length(content)) avg_len, count(distinct day) n_days, min(timestamp_ms) first_ms, max(timestamp_ms) last_ms from {m} group by sender) a left join (select sender, count(*) starts from (select sender, row_number() over (partition by conversation_id order by timestamp_ms, message_id) n from {m}) where n = 1 group by sender) s on s.sender = a.sender"),
    "agg56_starters": ("s m sa", f"select message_id, conversation_id, sender, type, responses, round(avg_ms, 4) avg_ms, score from {_STARTS}"),
    # the mean answer time of a starter in whole microseconds, so that half a millisecond does not hang on the order of addition
    "agg57_starter_patterns": ("s m sa", f"select sender, count(*) sessions, round(100e0 * count(case when responses > 0 then 1 end) / count(*), 6) success, round(avg(score), 6) avg_score, cast(floor(sum(cast(floor(avg_ms * 1000 + 5e-1) as bigint)) / (1e3 * count(*)) + 5e-1) as bigint) avg_response_ms, case when count(*) >= 20 then 'prolific' when count(*) >= 10 then 'active' when count(*) >= 5 then 'occasional' else 'rare' end tier from {_STARTS} group by sender"),
    "agg57_starter_types": ("s m sa", f"select sender, type, n, rank from (select *, row_number() over (partition by sender order by n desc, type) rank from (select sender, type, count(*) n from {_STARTS} group by sender, type)) where rank <= 3"),
    "agg57_starter_topics": ("s tp", "select sender, word, n, rank from (select *, row_number() over (partition by sender order by n desc, word) rank from (select s.sender, t.word, count(*) n from {s} s join {tp} t on t.message_id = s.message_id group by s.sender, t.word)) where rank <= 5"),
    "agg57_starter_times": ("s m", "select s.sender, m.hour, count(*) n from {s} s join {m} m on m.message_id = s.message_id group by s.sender, m.hour"),
    "agg56_starter_keywords": ("s tp", "select t.message_id, t.word, count(*) n from {s} s join {tp} t on t.message_id = s.message_id group by t.message_id, t.word"),
    "agg58_topics": ("s m tp sa", f"""select a.word, frequency, avg_engagement, success, top_starters from (select w.word, count(*) frequency, floor(avg(a.score) * 10 + 5e-1) / 10 avg_engagement, floor(1000e0 * count(case when responses > 0 then 1 end) / count(*) + 5e-1) / 10 success from {{tp}} w join {_STARTS} a on a.message_id = w.message_id group by w.word having count(*) >= 3) a
        join (select word, concat(max(case when rn = 1 then sender else '' end), max(case when rn = 2 then concat(',', sender) else '' end), max(case when rn = 3 then concat(',', sender) else '' end)) top_starters from (select word, sender, row_number() over (partition by word order by count(*) desc, sender) rn from (select w.word, s.sender from {{s}} s join {{tp}} w on w.message_id = s.message_id) group by word, sender) where rn <= 3 group by word) t on t.word = a.word
        order by frequency desc, a.word limit 20"""),
    "agg59_starter_hours": ("s m sa", f"select hour, count(*) n, round(avg(responses), 6) avg_responses, min(case when rn = 1 then sender end) top_starter from (select hour, responses, sender, dense_rank() over (partition by hour order by c desc, sender) rn from (select *, count(*) over (partition by hour, sender) c from {_STARTS})) group by hour"),
    "agg60_importance": ("m", f"select message_id, sender, conversation_id, score from (select *, round(greatest(1e-1, least(1e0, {_SCORE})), 3) score from (select * from {{m}} where content is not null order by timestamp_ms desc, message_id desc limit 50000) where not sys) order by score desc, message_id limit 1000"),
    "win18_first_per_key": ("m", "select k, message_id, score from (select substr(lower(content), 1, 20) k, message_id, abs(compound) score, row_number() over (partition by substr(lower(content), 1, 20) order by abs(compound) desc, message_id) n from {m}) where n = 1"),
    "win16_percent_of_total": ("m", "select conversation_id, sender, round(100e0 * n / sum(n) over (partition by conversation_id), 6) percentage from (select conversation_id, sender, count(*) n from {m} group by conversation_id, sender)"),
    "win10_turn_habits": ("m", """select sender, count(case when prev = sender and gap <= 90000 then 1 end) double_texts, count(case when prev <> sender and chars > 115e-2 * prev_chars then 1 end) expansions, count(case when prev <> sender and chars < 7e-1 * prev_chars then 1 end) compressions, round(avg(case when prev <> sender and gap > 0 and gap < 86400000 then gap end), 4) avg_latency_ms from
        (select sender, length(content) chars, lag(sender) over (partition by conversation_id order by timestamp_ms, message_id) prev, lag(length(content)) over (partition by conversation_id order by timestamp_ms, message_id) prev_chars, timestamp_ms - lag(timestamp_ms) over (partition by conversation_id order by timestamp_ms, message_id) gap from {m} where not sys) group by sender"""),
    "srt01_by_count": ("m", "select conversation_id, n from (select conversation_id, count(*) n from {m} group by conversation_id) order by n desc, conversation_id"),
    "srt03_top_senders": ("m", "select conversation_id, sender, n, rank from (select conversation_id, sender, n, row_number() over (partition by conversation_id order by n desc, sender) rank from (select conversation_id, sender, count(*) n from {m} group by conversation_id, sender)) where rank <= 5"),
    "srt02_top_words": ("w", "select word, count(*) n from {w} group by word order by n desc, word limit 50"),
    "srt04_latest": ("m", "select sender, message_id from (select sender, message_id, row_number() over (partition by sender order by timestamp_ms desc, message_id desc) n from {m}) where n <= 30"),
    "srt06_latest_in_order": ("m", "select message_id, timestamp_ms from (select message_id, timestamp_ms from {m} order by timestamp_ms desc, message_id desc limit 40) order by timestamp_ms, message_id"),
    "srt07_top_hours": ("m", "select hour, count(*) n from {m} group by hour order by n desc, hour limit 5"),
}
