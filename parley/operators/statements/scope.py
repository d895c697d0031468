"""Scoped re-aggregation (DSH): every statement reads ``sm``, the messages of selected conversations by their participants."""

from parley.operators.statements.engagement import STARTS as _STARTS
from parley.operators.statements.peaks import BEST as _BEST, SAID as _SAID, SHARES as _SHARES
from parley.operators.statements.text import TYPE
from parley.operators.texts import TOP_WORD_STOPS

_BUCKETS = """(select '0-10s' bucket, 5000e0 mid union all select '10-30s', 20000e0 union all select '30-60s', 45000e0 union all select '1-5m', 180000e0 union all select '5-15m', 600000e0 union all select '15-60m', 2250000e0 union all select '>1h', 10800000e0)"""
_LATENCY = "(select r.conversation_id, r.responder, case when latency_ms < 10000 then '0-10s' when latency_ms < 30000 then '10-30s' when latency_ms < 60000 then '30-60s' when latency_ms < 300000 then '1-5m' when latency_ms < 900000 then '5-15m' when latency_ms < 3600000 then '15-60m' else '>1h' end bucket, latency_ms from {r} r join (select distinct conversation_id from {sm}) c on c.conversation_id = r.conversation_id)"
_LENGTH = "(select case when word_count <= 2 then '1-2' when word_count <= 5 then '3-5' when word_count <= 10 then '6-10' when word_count <= 20 then '11-20' when word_count <= 50 then '21-50' else '50+' end bucket from {sm} where word_count > 0)"
_HOURS = "(select explode(sequence(0, 23)) as h)"
_DAYS = "(select explode(sequence(0, 6)) as d)"
_STOPS = ", ".join(f"'{w}'" for w in TOP_WORD_STOPS)
#: The events whose message is of a selected conversation, and how often each has which first cause, the earliest first among equals.
_EVENTS = f"(select b.day, b.type, b.v, b.cause, m.conversation_id from {_BEST} b join {{ev}} e on e.day = b.day join {{m}} m on m.message_id = e.message_id where m.conversation_id in (select conversation_id from {{sm}}))"
_CAUSES = f"(select cause, n, impact, row_number() over (order by n desc, first_day) rank from (select cause, count(*) n, avg(abs(v)) impact, min(day) first_day from {_EVENTS} group by cause))"

STATEMENTS = {
    # links have no counts by conversation, so there are 0 of a selection
    "dsh01_overview": ("sm", """select messages, conversations, participants, words, emojis, 0 urls, photos, videos, attachments, media_messages, round(100e0 * media_messages / greatest(messages, 1), 6) media_percentage, round(avg_turns, 6) avg_turns, round(avg_duration, 4) avg_duration_ms, round(avg_people, 6) avg_participants, round(avg_sentiment, 6) avg_sentiment, first_ms, last_ms from
        (select count(*) messages, count(distinct conversation_id) conversations, count(distinct sender) participants, cast(sum(word_count) as bigint) words, cast(sum(emoji_count) as bigint) emojis, avg(compound) avg_sentiment, min(timestamp_ms) first_ms, max(timestamp_ms) last_ms from {sm}),
        (select cast(sum(p) as bigint) photos, cast(sum(v) as bigint) videos, cast(sum(a) as bigint) attachments, cast(sum(least(p + v + a, n)) as bigint) media_messages, avg(n - 1e0) avg_turns, avg(cast(span as double)) avg_duration, avg(cast(people as double)) avg_people from (select count(*) n, max(timestamp_ms) - min(timestamp_ms) span, count(distinct sender) people, count(case when has_photos then 1 end) p, count(case when has_videos then 1 end) v, count(case when content ilike '%sent an attachment%' then 1 end) a from {sm} group by conversation_id))"""),
    "dsh02_peaks": ("sm", "select kind, k, n, rank from (select *, row_number() over (partition by kind order by n desc, k) rank from (select 'hour' kind, hour k, count(*) n from {sm} group by hour union all select 'day', dow, count(*) from {sm} group by dow)) where rank <= 3"),
    "dsh03_emoji_champions": ("sm", "select sender, cast(sum(emoji_count) as bigint) n from {sm} group by sender having sum(emoji_count) > 0 order by n desc, sender limit 5"),
    "dsh04_participants": ("sm r", "select a.sender, n, emojis, media_messages, round(avg_ms, 4) avg_ms from (select sender, count(*) n, cast(sum(emoji_count) as bigint) emojis, count(case when media then 1 end) media_messages from {sm} group by sender) a left join (select responder, avg(latency_ms) avg_ms from {r} where conversation_id in (select conversation_id from {sm}) group by responder) b on b.responder = a.sender"),
    "dsh05_average_response": ("r sm", f"select round(sum(n * mid) / sum(n), 4) avg_ms from (select bucket, count(*) n from {_LATENCY} group by bucket) a join {_BUCKETS} b on b.bucket = a.bucket"),
    "dsh06_daily_timeline": ("sm", "select day, round(sum(compound_sum) / sum(n), 6) avg_compound, cast(sum(n) as bigint) n from (select conversation_id, day, sum(compound) compound_sum, count(*) n from {sm} group by conversation_id, day) group by day"),
    "dsh08_reactions": ("x sm", "select replace(x.emoji, '️', '') emoji_key, count(*) n, count(distinct x.actor) reactors from {x} x join (select message_id from {sm}) s on s.message_id = x.message_id group by replace(x.emoji, '️', '')"),
    "dsh10_turn_taking": ("t sm", "select participant, count(*) turns, round(avg(message_count), 6) avg_length, round(avg(1000e0 / greatest(pause, 1)), 9) responsiveness from (select *, start_ms - lag(end_ms) over (partition by conversation_id order by turn_no) pause from {t} where conversation_id in (select conversation_id from {sm})) group by participant"),
    "dsh11_threads": ("b sm", "select count(*) conversations, cast(sum(n) as bigint) bursts, floor(avg(depth) * 10 + 5e-1) / 10 mean_of_means, max(deepest) deepest from (select conversation_id, count(*) n, avg(message_count) depth, max(message_count) deepest from {b} where conversation_id in (select conversation_id from {sm}) group by conversation_id)"),
    "dsh11_thread_depths": ("b sm", "select depth, n, round(100e0 * n / whole, 6) percentage from (select message_count depth, count(*) n from {b} where conversation_id in (select conversation_id from {sm}) group by message_count), (select count(*) whole from {b} where conversation_id in (select conversation_id from {sm}))"),
    "dsh11_thread_starters": ("b sm k", "select starter, cast(sum(n) as bigint) threads_started, round(avg(depth), 6) avg_thread_depth from (select b.conversation_id, starter, count(*) n, avg(message_count) depth from {b} b join {k} k on k.conversation_id = b.conversation_id and k.participant = b.starter where b.conversation_id in (select conversation_id from {sm}) group by b.conversation_id, starter) group by starter"),
    "dsh12_peak_days": ("sm", "select day, v, rank from (select day, round(v, 6) v, row_number() over (order by abs(round(v, 6)) desc, day) rank from (select day, avg(compound) v from {sm} where abs(compound) >= 1e-1 group by day)) where rank <= 10"),
    # the recovery that a selection reads isn't among an event's fields, so its mean is 0
    "dsh12_summary": ("ev m sm tk", f"""select n_peaks, n_valleys, extreme_events, avg_peak_intensity, avg_valley_intensity, 0e0 avg_recovery_time, coalesce(c.cause, 'N/A') dominant_pattern from (select count(case when type = 'peak' then 1 end) n_peaks, count(case when type = 'valley' then 1 end) n_valleys, count(case when abs(v) > 25e-2 then 1 end) extreme_events,
        round(coalesce(avg(case when type = 'peak' then abs(v) end), 0e0), 6) avg_peak_intensity, round(coalesce(avg(case when type = 'valley' then abs(v) end), 0e0), 6) avg_valley_intensity from {_EVENTS}) a left join {_CAUSES} c on c.rank = 1"""),
    "dsh12_patterns": ("ev m sm tk", f"""select case when p > q then 'volatility' when q > p then 'gradual_decline' else 'stability' end pattern_type, case when q > p then q else p + q end frequency, round(intensity, 6) avg_intensity, case when p > q then 'More emotional peaks than valleys in this period' when q > p then 'More emotional valleys than peaks in this period' else 'Balanced peaks and valleys' end description
        from (select count(case when type = 'peak' then 1 end) p, count(case when type = 'valley' then 1 end) q, avg(abs(v)) intensity from {_EVENTS}) where p + q > 0
        union all select 'cyclical', c.n, round(a.intensity, 6), concat('Most common trigger: ', replace(c.cause, '_', ' ')) from {_CAUSES} c join (select avg(abs(v)) intensity from {_EVENTS}) a on c.rank = 1"""),
    "dsh12_triggers": ("ev m sm tk k", f"""select c.cause, c.n frequency, round(c.impact, 6) avg_impact, c.rank, coalesce(w.keywords, '') keywords, coalesce(p.senders, '') senders from {_CAUSES} c
        left join (select cause, array_join(array_sort(collect_set(keyword)), ',') keywords from (select cause, keyword, row_number() over (partition by cause order by keyword) rn from (select distinct e.cause, s.keyword from {_EVENTS} e join {_SAID} s on s.day = e.day)) where rn <= 10 group by cause) w on w.cause = c.cause
        left join (select cause, array_join(array_sort(collect_set(sender)), ',') senders from (select cause, sender, row_number() over (partition by cause order by sender) rn from (select distinct e.cause, s.sender from {_EVENTS} e join {_SHARES} s on s.day = e.day join {{k}} k on k.conversation_id = e.conversation_id and k.participant = s.sender)) where rn <= 5 group by cause) p on p.cause = c.cause"""),
    "dsh13_starters": ("s m sm sa", f"select sender, count(*) sessions, cast(floor(avg(score) + 5e-1) as bigint) avg_score, case when count(*) >= 10 then 'prolific' when count(*) >= 5 then 'active' when count(*) >= 2 then 'occasional' else 'rare' end tier from {_STARTS} where message_id in (select message_id from {{sm}}) group by sender"),
    "dsh13_starter_types": ("s m sm sa", f"select sender, type, count(*) n from {_STARTS} where message_id in (select message_id from {{sm}}) group by sender, type"),
    "dsh13_starter_topics": ("s sm tp", "select sender, word, n, rank from (select *, row_number() over (partition by sender order by n desc, word) rank from (select s.sender, t.word, count(*) n from {s} s join {tp} t on t.message_id = s.message_id where s.message_id in (select message_id from {sm}) group by s.sender, t.word)) where rank <= 5"),
    # from the thousand most frequent rows of word, sender and conversation, as they are kept
    "dsh14_top_words": ("w sm", f"""select a.word, cast(sum(a.n) as bigint) n, count(distinct a.sender) senders, count(distinct a.conversation_id) conversations from (select word, sender, conversation_id, count(*) n from {{w}} group by word, sender, conversation_id having count(*) > 1 order by n desc, word, sender, conversation_id limit 1000) a
        join (select distinct conversation_id, sender from {{sm}}) s on s.conversation_id = a.conversation_id and s.sender = a.sender where length(a.word) >= 3 and a.word not in ({_STOPS}) group by a.word order by n desc, a.word limit 50"""),
    "dsh15_domains": ("u sm", "select domain, count(*) n, count(distinct u.sender) senders, count(distinct u.conversation_id) conversations, min(u.timestamp_ms) first_seen, max(u.timestamp_ms) last_seen from {u} u join (select message_id from {sm}) s on s.message_id = u.message_id group by domain order by n desc, domain limit 12"),
    "dsh16_content_types": ("sm", f"select type, count(*) n, cast(floor(avg(length(content)) + 5e-1) as bigint) avg_length, count(distinct sender) senders from (select *, {TYPE} type from {{sm}} where content is not null and not sys) group by type"),
    "dsh17_lengths": ("sm", f"select bucket, n, round(sum(n * mid) over () / sum(n) over (), 6) mean_words from (select a.bucket, n, mid from (select bucket, count(*) n from {_LENGTH} group by bucket) a join (select '1-2' bucket, 15e-1 mid union all select '3-5', 4e0 union all select '6-10', 8e0 union all select '11-20', 155e-1 union all select '21-50', 355e-1 union all select '50+', 75e0) b on b.bucket = a.bucket)"),
    "dsh18_latencies": ("r sm", f"select bucket, count(*) n from {_LATENCY} group by bucket"),
    "dsh19_heatmap": ("sm", f"select t.sender, h.h as hour, coalesce(a.n, 0) n, round(coalesce(a.n, 0) / cast(max(coalesce(a.n, 0)) over () as double), 6) intensity from (select sender from {{sm}} group by sender order by count(*) desc, sender limit 10) t cross join {_HOURS} h left join (select sender, hour, count(*) n from {{sm}} group by sender, hour) a on a.sender = t.sender and a.hour = h.h"),
    "dsh20_dense_hours": ("sm", f"select h.h as hour, coalesce(a.n, 0) n from {_HOURS} h left join (select hour, count(*) n from {{sm}} group by hour) a on a.hour = h.h"),
    "dsh20_dense_days": ("sm", f"select d.d dow, coalesce(a.n, 0) n from {_DAYS} d left join (select dow, count(*) n from {{sm}} group by dow) a on a.dow = d.d"),
    "dsh21_daily_patterns": ("sm", f"select dow, n, peak_hour, case when n > 8e-1 * most then 'peak' when n > 6e-1 * most then 'high' when n > 3e-1 * most then 'medium' else 'low' end level from (select dow, n, peak_hour, max(n) over () most from (select d.d dow, coalesce(cast(sum(a.n) as bigint), 0) n, coalesce(max_by(a.hour, a.n * 100 - a.hour), 0) peak_hour from {_DAYS} d left join (select dow, hour, count(*) n from {{sm}} group by dow, hour) a on a.dow = d.d group by d.d))"),
    "dsh21_summary": ("sm", f"""select messages, cast(floor(messages / 7e0 + 5e-1) as bigint) avg_daily, most_active_day, most_active_hour, case when night >= morning and night >= afternoon and night >= evening then 'night' when morning >= afternoon and morning >= evening then 'morning' when afternoon >= evening then 'afternoon' else 'evening' end peak_period, cast(floor(sd + 5e-1) as bigint) activity_variance from
        (select sum(n) messages, max_by(dow, n * 10 - dow) most_active_day, stddev_pop(n) sd from (select d.d dow, count(a.message_id) n from {_DAYS} d left join {{sm}} a on a.dow = d.d group by d.d)),
        (select max_by(hour, n * 100 - hour) most_active_hour, coalesce(sum(case when hour between 6 and 11 then n end), 0) morning, coalesce(sum(case when hour between 12 and 17 then n end), 0) afternoon, coalesce(sum(case when hour between 18 and 21 then n end), 0) evening, coalesce(sum(case when hour < 6 or hour >= 22 then n end), 0) night from (select hour, count(*) n from {{sm}} group by hour))"""),
    "dsh22_frequency": ("sm", "select sender, n, cast(floor(n / cast(months as double) + 5e-1) as bigint) avg_monthly, case when n / cast(months as double) > 500 then 'very_high' when n / cast(months as double) > 200 then 'high' when n / cast(months as double) > 50 then 'medium' else 'low' end level from (select sender, count(*) n from {sm} group by sender), (select count(distinct month) as months from {sm})"),
    "dsh22_summary": ("sm", """select messages, avg_monthly, peak, cast(floor(score + 5e-1) as bigint) consistency, case when later - earlier > 15e-2 * earlier then 'increasing' when later - earlier < -15e-2 * earlier then 'decreasing' else 'stable' end trend, case when score > 80 and avg_monthly > 1000 then 'excellent' when score > 60 and avg_monthly > 500 then 'good' when score > 40 and avg_monthly > 200 then 'moderate' else 'low' end health from
        (select cast(sum(n) as bigint) messages, cast(floor(avg(n) + 5e-1) as bigint) avg_monthly, cast(max(n) as bigint) peak, greatest(0e0, least(100e0, (1 - stddev_pop(n) / avg(n)) * 100)) score, coalesce(avg(case when i <= floor(months / 2e0) then n end), 0e0) earlier, coalesce(avg(case when i > floor(months / 2e0) then n end), 0e0) later from
        (select *, row_number() over (order by month) i, count(*) over () as months from (select month, cast(count(*) as double) n from {sm} group by month)))"""),
    "dsh23_patterns": ("r sm", f"""select messages, quick_share, delayed_share, burst_share, 100 - burst_share steady_share, cast(floor(avg_ms / 1000 + 5e-1) as bigint) avg_response_s, case when quick > 7e-1 and messages > 1000 then 'excellent' when quick > 5e-1 and messages > 500 then 'good' when quick > 3e-1 and messages > 100 then 'moderate' else 'needs_attention' end health,
        case when quick > 6e-1 then 'casual' when quick < 3e-1 then 'formal' else 'mixed' end style, case when messages > 1000 and quick > 5e-1 then 'high' when messages > 300 and quick > 3e-1 then 'medium' else 'low' end engagement from
        (select count(case when latency_ms < 30000 then 1 end) / cast(count(*) as double) quick, cast(floor(100e0 * count(case when latency_ms < 30000 then 1 end) / count(*) + 5e-1) as bigint) quick_share, cast(floor(100e0 * count(case when latency_ms >= 900000 then 1 end) / count(*) + 5e-1) as bigint) delayed_share,
        avg(case when latency_ms < 10000 then 5000e0 when latency_ms < 30000 then 20000e0 when latency_ms < 60000 then 45000e0 when latency_ms < 300000 then 180000e0 when latency_ms < 900000 then 600000e0 when latency_ms < 3600000 then 2250000e0 else 7200000e0 end) avg_ms from {_LATENCY}),
        (select cast(sum(n) as bigint) messages, least(100, cast(floor(100 * stddev_pop(n) / avg(n) + 5e-1) as bigint)) burst_share from (select month, cast(count(*) as double) n from {{sm}} group by month))"""),
    # in whole hundredths, rounded half away from zero to six digits by integers, so that ties are the same everywhere
    "dsh24_sentiment_by_sender": ("sm", "select sender, sign(s) * floor((abs(s) * 20000e0 + n) / (2e0 * n)) / 1e6 sentiment, n from (select sender, cast(sum(s) as bigint) s, cast(sum(n) as bigint) n from (select sender, conversation_id, sum(cast(round(compound * 100) as bigint)) s, count(*) n from {sm} group by sender, conversation_id having count(*) >= 10) group by sender)"),
    "dsh25_media_senders": ("sm", "select sender, count(case when has_photos then 1 end) photos, count(case when has_videos then 1 end) videos, count(case when media then 1 end) n, case when count(case when has_photos then 1 end) >= count(case when has_videos then 1 end) then 'photos' else 'videos' end preferred from {sm} group by sender order by n desc, sender limit 10"),
    "dsh25_media_insights": ("sm x", """select round(100e0 * (photos + videos + attachments) / greatest(messages, 1), 6) share_rate, top_sharer, case when photos + videos + attachments = 0 then '—' when photos >= videos and photos >= attachments then 'Photos' when videos >= attachments then 'Videos' else 'Files' end preferred, round(100e0 * reactions / greatest(messages, 1), 6) reaction_rate from
        (select count(*) messages, count(case when has_photos then 1 end) photos, count(case when has_videos then 1 end) videos, count(case when content ilike '%sent an attachment%' then 1 end) attachments from {sm}),
        (select min(case when rn = 1 then sender end) top_sharer from (select sender, row_number() over (order by count(*) desc, sender) rn from {sm} where media group by sender)), (select count(*) reactions from {x} where message_id in (select message_id from {sm}))"""),
    "dsh26_monthly_trend": ("sm", "select month, count(*) n, count(case when has_photos then 1 end) photos, count(case when has_videos then 1 end) videos, count(case when has_share then 1 end) links from {sm} group by month"),
    "dsh27_parts_of_day": ("sm", "select count(case when hour between 6 and 11 then 1 end) morning, count(case when hour between 12 and 17 then 1 end) afternoon, count(case when hour between 18 and 22 then 1 end) evening, count(case when hour >= 23 or hour < 6 then 1 end) night from {sm}"),
}
