"""The queries of the library, by operator, each with the SQL that gives the same rows.

Names start with the operator's id.  Messages come from the ``events`` table, see the adapters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import clean, sentiment
from parley.functions import compat as C
from parley.operators import likeness, moods, ordered, summaries, texts
from parley.operators.statements import STATEMENTS, apply
from parley.plans import tables
from parley.plans.registry import register
from parley.sources.adapters import EVENTS_SQL, messages_from_conversations, messages_from_events

W = "over (partition by conversation_id order by timestamp_ms, message_id)"
ORDERED = f"o as (select *, lag(message_id) {W} prev_id, lag(sender) {W} prev_sender, timestamp_ms - lag(timestamp_ms) {W} gap_ms from m)"
REPLIES = f"{ORDERED}, r as (select conversation_id, prev_id from_message_id, message_id to_message_id, sender responder, gap_ms latency_ms from o where sender != prev_sender and gap_ms between 1000 and 86400000)"
TURNS = f"""{ORDERED}, i as (select *, sum(case when prev_id is null or sender != prev_sender then 1 else 0 end) {W} turn_no from o),
t as (select conversation_id, turn_no::bigint turn_no, first(sender) participant, count(*) message_count, min(timestamp_ms) start_ms, max(timestamp_ms) end_ms from i group by all)"""
MEDIA = "(has_photos or has_videos or content ilike '%sent an attachment%')"


def _islands(gap: int, least: int) -> str:
    return f"""{ORDERED}, i as (select *, sum(case when prev_id is null or gap_ms > {gap} then 1 else 0 end) {W} island_no from o),
b as (select conversation_id, island_no::bigint island_no, arg_min(sender, (timestamp_ms, message_id)) starter, count(*) message_count, count(distinct sender) n_senders, min(timestamp_ms) start_ms, max(timestamp_ms) end_ms from i group by conversation_id, island_no having count(*) >= {least})"""


def events(name: str, sql: str | None, ctes: str = "") -> Callable:
    """Register a function of messages; ``sql`` selects from m and the given CTEs."""
    whole = None if sql is None else f"with {EVENTS_SQL}{', ' + ctes if ctes else ''} {sql}"

    def wrap(query: Callable[[DataFrame], DataFrame]):
        register(name, whole)(lambda spark, sf_dir: query(messages_from_events(spark, sf_dir)))
        return query

    return wrap


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- ordered rows
events("win01_responses", "select * from r", REPLIES)(ordered.responses)
events("win02_turns", "select * from t", TURNS)(ordered.turns)
events("win03_bursts", "select * from b", _islands(300_000, 2))(lambda m: ordered.gap_islands(m, 300_000, 2))
events("win04_session_starters", "select conversation_id, message_id, sender, timestamp_ms from o where prev_id is null or gap_ms >= 14400000", ORDERED)(ordered.session_starters)
events("win05_threads", "select * from b", _islands(3_600_000, 1))(lambda m: ordered.gap_islands(m, 3_600_000))
events("v106_gaps", "select conversation_id, message_id, sender, gap_ms from o where gap_ms > 86400000", ORDERED)(lambda m: ordered.with_previous(m.select(*ordered.NARROW)).filter("gap_ms > 86400000").select("conversation_id", "message_id", "sender", "gap_ms"))
_BUBBLES = f"""k as (select *, is_system or coalesce(trim(content), '') = '' or regexp_matches(lower(content), 'sent [0-9]+ photo|sent a voice message|shared a link') breaks from m),
o as (select *, coalesce(lag(breaks) {W}, true) aft, lag(sender) {W} prev_sender, timestamp_ms - lag(timestamp_ms) {W} gap_ms from k),
i as (select *, sum(case when aft or breaks or sender != prev_sender or gap_ms > 90000 then 1 else 0 end) {W} island from o)"""
events("win06_reply_turns", "select conversation_id, first(sender) sender, count(*) n_bubbles, max(timestamp_ms) end_ms, sum(length(content))::bigint n_chars from i where not breaks group by conversation_id, island", _BUBBLES)(lambda m: ordered.reply_turns(m, ordered.breaker()))
_FITS = f"f as (select *, row_number() over run n, sum(length(content) + {len(ordered.MARK)}) over run - {len(ordered.MARK)} size from i where not breaks window run as (partition by conversation_id, island order by timestamp_ms, message_id))"
for _most in (60, 500):
    events(f"fn28_reply_texts_{_most}", f"select conversation_id, first_id, case when length(t) > {_most} then t[1:{_most - 1}] || '…' else t end \"text\" from (select conversation_id, min(message_id) filter (n = 1) first_id, string_agg(content, '{ordered.MARK}' order by n) t from f where n = 1 or size <= {_most} group by conversation_id, island)", f"{_BUBBLES}, {_FITS}")(
        lambda m, most=_most: ordered.reply_texts(m, ordered.breaker(), most=most)
    )
events("win07_daily_starts", "select sender, count(*) starts from (select sender, row_number() over (partition by conversation_id, strftime(ts, '%Y-%m-%d') order by timestamp_ms, message_id) n from m) where n = 1 group by sender")(
    lambda m: m.groupBy("conversation_id", C.day(F.col("ts")).alias("d")).agg(F.min_by("sender", F.struct("timestamp_ms", "message_id")).alias("sender")).groupBy("sender").agg(F.count("*").alias("starts"))
)
events("win17_round_robin", "select message_id, conversation_id, rn from (select *, row_number() over (partition by conversation_id order by timestamp_ms desc, message_id) rn from m) order by rn, conversation_id limit 200")(
    lambda m: summaries.round_robin(m, "conversation_id", [F.desc("timestamp_ms"), F.col("message_id")], 200).select("message_id", "conversation_id", "rn")
)

# -- conversations and time
events("agg13_conversation_summary", """select conversation_id, message_count, n_participants, first_ms, last_ms, avg_response_ms, last_ms - first_ms duration_ms, message_count - 1 turns from
(select conversation_id, count(*) message_count, count(distinct sender) n_participants, min(timestamp_ms) first_ms, max(timestamp_ms) last_ms from m group by 1) left join (select conversation_id, floor(avg(latency_ms) + 0.5)::bigint avg_response_ms from r group by 1) using (conversation_id)""", REPLIES)(lambda m: summaries.conversation_summary(m, ordered.responses(m)))  # fmt: skip
events("agg14_messages_by_sender", "select conversation_id, sender, count(*) message_count from m group by all")(summaries.messages_by_sender)
events("agg15_platforms", "select source, count(distinct conversation_id) conversations, count(*) messages from m group by all")(summaries.platform_summary)
events("agg16_monthly", "select conversation_id, strftime(ts, '%Y-%m') \"month\", count(*) message_count from m group by all")(summaries.monthly_messages)
events("agg17_latency_histogram", f"select conversation_id, {C.bucket_sql('latency_ms', C.LATENCIES, False)} bucket, count(*) reply_count from r group by all", REPLIES)(lambda m: summaries.latency_histogram(ordered.responses(m)))
events("agg18_active_hours", "select conversation_id, hour(ts) \"hour\", dayofweek(ts) day_of_week, sender, count(*) message_count from m group by all")(summaries.active_hours)
for _grain, _sql in {"hour": "hour(ts)", "day_of_week": "dayofweek(ts)", "month": "strftime(ts, '%Y-%m')"}.items():
    events(f"agg21_activity_by_{_grain}", f'select {_sql} "{_grain}", count(*) message_count, count(*) filter ({MEDIA}) media_count, round(avg(compound), 6) avg_sentiment, count(distinct sender) unique_senders from m group by 1')(lambda m, g=_grain: summaries.activity_by(m, g))
events("agg23_peaks", "select \"hour\", message_count from (select hour(ts) \"hour\", count(*) message_count from m group by 1) order by message_count desc, \"hour\" limit 3")(lambda m: m.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("message_count")).orderBy(F.desc("message_count"), "hour").limit(3))
events("agg24_media_by_sender", f"select conversation_id, sender, count(*) filter (has_photos) photos, count(*) filter (has_videos) videos, count(*) filter ({MEDIA}) media_messages, count(*) messages from m group by all")(summaries.media_by_sender)
events("agg25_media_rollup", f"select conversation_id, sender, count(*) filter ({MEDIA}) media_messages, count(*) messages, grouping(conversation_id, sender)::bigint \"level\", round(count(*) filter ({MEDIA}) / count(*), 6) media_ratio from m group by rollup (conversation_id, sender)")(summaries.media_rollup)
events("agg48_participants", "select conversation_id, count(distinct sender) n_participants from m where not is_system group by all")(lambda m: m.filter("not is_system").groupBy("conversation_id").agg(F.count_distinct("sender").alias("n_participants")))
events("v102_weekday_hours", "select sender, dayofweek(ts) weekday, hour(ts) \"hour\", count(*) n from m group by all")(lambda m: m.groupBy("sender", (F.dayofweek("ts") - 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n")))
events("v107_turn_pairs", "select prev_sender, sender, count(*) n from o where sender != prev_sender group by all", ORDERED)(lambda m: ordered.with_previous(m.select(*ordered.NARROW)).filter("sender != prev_sender").groupBy("prev_sender", "sender").agg(F.count("*").alias("n")))

# -- sentiment
_DAILY = "case when compound_sum / n > 0.1 then 'positive' when compound_sum / n < -0.1 then 'negative' else 'neutral' end label"
for _id, _keys in {"agg35_timeline": [], "agg36_sender_timeline": ["sender"], "agg39_mergeable": ["sender", "conversation_id"]}.items():
    _k = "".join(f"{k}, " for k in _keys)
    events(_id, f"select *, {_DAILY} from (select {_k}strftime(ts, '%Y-%m-%d') \"date\", round(sum(compound), 6) compound_sum, count(*) n from m where not is_system group by all)")(lambda m, k=_keys: summaries.daily_sentiment(m, *k))
events("agg37_extreme_example", "select sender, strftime(ts, '%Y-%m-%d') \"date\", arg_max(message_id, (abs(compound), -message_id)) message_id from m group by all")(lambda m: m.groupBy("sender", C.day(F.col("ts")).alias("date")).agg(F.max_by("message_id", F.struct(F.abs("compound"), -F.col("message_id"))).alias("message_id")))
# the oracle joins days, Spark multiplies blocks of senders
_MEANS = "g as (select sender, \"day\", conversation_id, avg(compound) v, count(*) n from {m} where not sys group by all having count(*) >= 3)"
_LAST = 'd as (select sender, "day", arg_max(v, conversation_id) v from g group by all)'
_WEIGHTED = 'd as (select sender, "day", sum(v * n) / sum(n) v from g group by all)'
_R = """c as (select sender1, sender2, shared_days, total_days, case when sqrt(greatest(b, 0)) > 1e-9 then (n * xy - x * y) / sqrt(b) else 0 end r from
(select a.sender sender1, b.sender sender2, count(*) n, count(*) shared_days, greatest(any_value(a.days), any_value(b.days)) total_days, sum(a.v) x, sum(b.v) y, sum(a.v * b.v) xy, (count(*) * sum(a.v * a.v) - sum(a.v) * sum(a.v)) * (count(*) * sum(b.v * b.v) - sum(b.v) * sum(b.v)) b
 from (select *, count(*) over (partition by sender) as days from d) a join (select *, count(*) over (partition by sender) as days from d) b on a."day" = b."day" and a.sender < b.sender group by all) where n >= {least})"""
_BANDS = "case when abs(r) >= 0.7 then 'strong' when abs(r) >= 0.4 then 'moderate' when abs(r) >= 0.2 then 'weak' else 'none' end"


def _moods(name: str, table: str, means: str, least: int, sql: str) -> Callable:
    """Register a query over correlations ``c`` of the messages in ``table``."""
    whole = tables.oracle(table, f"{_MEANS.replace('{m}', '{' + table + '}')}, {means}, {_R.replace('{least}', str(least))} {sql}", more=True)

    def wrap(query: Callable[[DataFrame], DataFrame]):
        register(name, whole)(lambda spark, sf_dir: query(tables.make(table, spark, sf_dir, {})))
        return query

    return wrap


def _weighted(m: DataFrame) -> DataFrame:
    by = m.filter("not sys").groupBy("sender", "day", "conversation_id").agg(F.avg("compound").alias("v"), F.count("*").alias("n")).filter("n >= 3")
    return by.groupBy("sender", "day").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))


def _rated(pairs: DataFrame) -> DataFrame:
    return pairs.select("sender1", "sender2", "shared_days", "total_days", F.round("correlation", 4).alias("correlation"), moods.strength(F.col("correlation")).alias("strength"))


_moods("agg42_mood_correlation", "m", _LAST, 5, f"select sender1, sender2, shared_days, total_days, round(r, 4) correlation, {_BANDS} strength from c order by abs(round(r, 4)) desc, sender1, sender2 limit 50")(lambda m: _rated(moods.correlations(moods.daily(m.filter("not sys")), most=50)))
_moods("agg42_mood_pairs", "m", _WEIGHTED, 5, f"select sender1, sender2, shared_days, total_days, round(r, 4) correlation, {_BANDS} strength from c")(lambda m: _rated(moods.correlations(_weighted(m))))
_moods("agg42_mood_summary", "m", _LAST, 5, f"select count(*) total_correlations, count(*) filter ({_BANDS} = 'strong') strong_correlations, floor(avg(abs(r)) * 1000 + 0.5) / 1000 average_correlation from c")(
    lambda m: moods.correlations(moods.daily(m.filter("not sys"))).agg(F.count("*").alias("total_correlations"), F.count_if(moods.strength(F.col("correlation")) == "strong").alias("strong_correlations"), C.js_round(F.avg(F.abs("correlation")), 3).alias("average_correlation"))
)
_moods("dsh07_mood_pairs", "sm", _WEIGHTED, 3, """, e as (select distinct x.sender p1, y.sender p2 from (select distinct conversation_id, sender from {sm}) x join (select distinct conversation_id, sender from {sm}) y on x.conversation_id = y.conversation_id and x.sender < y.sender)
select sender1 s1, sender2 s2, shared_days, round(r, 4) correlation from c join e on sender1 = p1 and sender2 = p2""")(
    lambda m: moods.correlations(_weighted(m), min_days=3, shared=m.select("sender", F.col("conversation_id").alias("key"))).select(F.col("sender1").alias("s1"), F.col("sender2").alias("s2"), "shared_days", F.round("correlation", 4).alias("correlation"))
)

# -- turns, bursts, starters, engagement
events("agg49_burst_depths", "select conversation_id, message_count depth, count(*) bursts from b group by all", _islands(300_000, 2))(lambda m: summaries.burst_depths(ordered.gap_islands(m, 300_000, 2)))
events("agg49_burst_starters", "select starter, count(*) bursts, sum(message_count)::bigint messages from b group by 1 order by bursts desc, starter limit 20", _islands(300_000, 2))(lambda m: summaries.burst_starters(ordered.gap_islands(m, 300_000, 2)))
events("agg51_turn_stats", "select *, round(100 * turn_count / sum(turn_count) over (partition by conversation_id), 6) percentage from (select conversation_id, participant, count(*) turn_count, round(avg(message_count), 6) avg_length, max(message_count) max_length from t group by all)", TURNS)(lambda m: summaries.turn_stats(ordered.turns(m)))
events("agg50_turn_patterns", """select conversation_id, turn_count, round(most / least, 4) turn_ratio, round(share, 6) max_message_share, case when share > 0.7 then 'dominant' when most <= 2 * least and people > 1 then 'balanced' when most > 0.7 * turn_count then 'dominant' when pause < 300000 and turn_count > 10 then 'responsive' else 'sporadic' end pattern_type from
(select conversation_id, count(*) people, sum(n)::bigint turn_count, max(n) most, min(n) least, max(msgs) / sum(msgs) share from (select conversation_id, participant, count(*) n, sum(message_count) msgs from t group by all) group by 1)
join (select conversation_id, coalesce(avg(p) filter (p > 0 and p < 86400000), 0) pause from (select *, start_ms - lag(end_ms) over (partition by conversation_id order by turn_no) p from t) group by 1) using (conversation_id)""", TURNS)(lambda m: summaries.turn_patterns(ordered.turns(m)))  # fmt: skip
events("agg56_starter_responses", "select s.message_id, s.conversation_id, s.sender, count(x.message_id) response_count from o s left join m x on s.conversation_id = x.conversation_id and x.timestamp_ms > s.timestamp_ms and x.timestamp_ms <= s.timestamp_ms + 86400000 and x.sender != s.sender where s.prev_id is null or s.gap_ms >= 14400000 group by all", ORDERED)(lambda m: summaries.starter_responses(m, ordered.session_starters(m)))
_PARTS = ", ".join(f"round({k}, 4) {k}" for k in summaries.WEIGHTS)
_SCORED = f"""y as (select participant, round(overall, 4) overall_score, {_PARTS}, conversations conversations_count, messages total_messages, case when overall >= 70 then 'high' when overall >= 40 then 'medium' else 'low' end engagement_tier from
(select *, {' + '.join(f'{k} * {w}' for k, w in summaries.WEIGHTS.items())} overall from (select *, least(100, messages / conversations / g_per * 50) message_frequency,
 case when latency > 0 then least(100, g_latency / latency * 50) else 50 end response_speed, least(100, starts / conversations * 100) conversation_initiation,
 case when len > 0 then least(100, len / g_len * 50) else 25 end message_length, least(100, n_days / greatest(1, ceil(span)) * 100) consistency, least(100, conversations / g_conv * 200) social_connectivity
 from p, (select avg(messages / conversations) g_per, avg(latency) g_latency, avg(len) g_len from p), (select count(distinct conversation_id) g_conv from m))))"""
_SCORES = f"""{REPLIES}, mm as (select * from m where conversation_id in (select conversation_id from m group by 1 having count(distinct sender) >= 2)), p as (select sender participant, count(distinct conversation_id) conversations, count(*) messages, avg(coalesce(length(content), 0)) len, count(distinct strftime(ts, '%Y-%m-%d')) n_days, (max(timestamp_ms) - min(timestamp_ms)) / 86400000 span,
 coalesce(any_value(starts), 0) starts, coalesce(any_value(latency), 0) latency from mm
 left join (select participant, count(*) starts from (select arg_min(sender, (timestamp_ms, message_id)) participant from mm group by conversation_id) group by 1) s on s.participant = sender
 left join (select responder, avg(latency_ms) latency from r group by 1) l on l.responder = sender group by 1), {_SCORED}"""
events("agg53_engagement", "select * from y", _SCORES)(lambda m: summaries.engagement(m, ordered.responses(m)))
events("agg55_conversation_engagement", """select conversation_id, floor(avg(overall_score) * 10 + 0.5) / 10 avg_engagement, count(*) filter (engagement_tier = 'high') high, count(*) filter (engagement_tier = 'medium') medium, count(*) filter (engagement_tier = 'low') low, round(var_pop(overall_score), 4) variance
from (select distinct conversation_id, sender from mm) k join y on y.participant = k.sender group by 1""", _SCORES)(lambda m: summaries.conversation_engagement(m, ordered.responses(m)))  # fmt: skip


@register("dsh09_engagement", tables.oracle("sm", f"""{_SCORES.replace(" from m)", " from m)")}, z as (select c.conversation_id, c.sender, c.n, y.* from (select conversation_id, sender, count(*) n from sm group by all) c join y on y.participant = c.sender)
select sender participant, floor(avg(overall_score) * 10 + 0.5) / 10 overall_score, floor(avg(message_frequency) * 10 + 0.5) / 10 message_frequency, floor(avg(response_speed) * 10 + 0.5) / 10 response_speed, floor(avg(social_connectivity) * 10 + 0.5) / 10 social_connectivity, count(*) conversations, sum(n)::bigint messages,
case when avg(overall_score) >= 70 then 'high' when avg(overall_score) >= 40 then 'medium' else 'low' end tier from z group by sender""", more=True))  # fmt: skip
def dsh09_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the members of selected conversations, averaged over these; messages are those of the selection."""
    made: dict[str, DataFrame] = {}
    m, sm = tables.make("m", spark, sf_dir, made), tables.make("sm", spark, sf_dir, made)
    return summaries.engagement_of_selection(m, ordered.responses(m), sm)


events("per08_infer_self", "select sender, count(*) chats from (select distinct conversation_id, sender from m where conversation_id in (select conversation_id from m group by 1 having count(distinct sender) = 2)) group by 1 order by chats desc, sender limit 1")(
    lambda m: m.join(m.groupBy("conversation_id").agg(F.count_distinct("sender").alias("n")).filter("n = 2"), "conversation_id", "left_semi").select("conversation_id", "sender").distinct().groupBy("sender").agg(F.count("*").alias("chats")).orderBy(F.desc("chats"), "sender").limit(1)
)
events("join09_shared_conversations", "select conversation_id from m where sender = 'user_1' intersect select conversation_id from m where sender = 'user_11'")(lambda m: m.filter("sender = 'user_1'").select("conversation_id").intersect(m.filter("sender = 'user_11'").select("conversation_id")))
events("flt03_participants", "select message_id from m where conversation_id not in (select conversation_id from k) or exists (select 1 from k where k.conversation_id = m.conversation_id and k.sender = m.sender)", "k as (select distinct conversation_id, sender from m where message_id % 2 = 0 and source = 'whatsapp')")(
    lambda m: summaries.participants_filter(m, m.filter("message_id % 2 = 0 and source = 'whatsapp'").select("conversation_id", F.col("sender").alias("participant"))).select("message_id")
)
events("per04_reply_quantiles", "select responder, (list_sort(list(latency_ms)))[least(count(*), (count(*) * 0.5)::int + case when (count(*) * 0.5)::int > count(*) * 0.5 then 0 else 1 end)] median_ms, count(*) n from r group by 1", REPLIES)(
    lambda m: summaries.reply_quantiles(ordered.responses(m), {"median_ms": 0.5})
)
events("per04_reply_profile", """select *, case when median_ms < 30000 then 'very fast (<30s)' when median_ms < 300000 then 'quick (under 5m)' when median_ms < 3600000 then 'moderate (minutes to an hour)' else 'slow (often hours+)' end label from
(select responder, v[least(n, floor(n * 0.5::double)::bigint + 1)] median_ms, v[least(n, floor(n * 0.9::double)::bigint + 1)] p90_ms, n from (select responder, list_sort(list(latency_ms)) v, count(*) n from r group by 1))""", REPLIES)(
    lambda m: summaries.reply_quantiles(ordered.responses(m), {"median_ms": 0.5, "p90_ms": 0.9}).withColumn("label", summaries.latency_label(F.col("median_ms")))
)

# -- texts
_METRICS = "x as (select message_id, conversation_id, sender, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) word_count, len(regexp_extract_all(content, '[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}]')) emoji_count, len(regexp_extract_all(content, '" + texts.URL + "')) url_count from m)"
events("fn06_text_metrics", "select message_id, conversation_id, sender, word_count, emoji_count, url_count from x", _METRICS)(texts.text_metrics)
events("agg01_text_summary", "select count(*) total_messages, round(avg(word_count), 6) avg_words, sum(emoji_count)::bigint total_emojis, sum(url_count)::bigint total_urls from x", _METRICS)(lambda m: texts.text_summary(texts.text_metrics(m)))
events("agg02_emoji_by_sender", "select * from (select conversation_id, sender, sum(emoji_count)::bigint emoji_count from x group by all) where emoji_count > 0", _METRICS)(lambda m: texts.emoji_by_sender(texts.text_metrics(m)))
events("agg03_top_emojis", "select sender, emoji, n, rank from (select *, row_number() over (partition by sender order by n desc, emoji) rank from (select sender, emoji, count(*) n from (select sender, unnest(regexp_extract_all(content, '[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}]')) emoji from m) group by all)) where rank <= 5")(texts.top_emojis)
events("agg05_length_distribution", f"""select conversation_id, bucket, coalesce(n, 0) n, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by conversation_id), 6) percentage from
(select distinct conversation_id, unnest([{', '.join(f"'{label}'" for _, label in C.LENGTHS)}]) bucket from x where word_count > 0) left join (select conversation_id, {C.bucket_sql('word_count', C.LENGTHS, True)} bucket, count(*) n from x where word_count > 0 group by all) using (conversation_id, bucket)""", _METRICS)(lambda m: texts.length_distribution(texts.text_metrics(m)))  # fmt: skip
register("agg06_word_frequencies", tables.oracle("w", "select word, sender, conversation_id, count(*) n from {w} group by word, sender, conversation_id having count(*) > 1 order by n desc, word, sender, conversation_id limit 1000"))(lambda spark, sf_dir: texts.word_frequencies(messages_from_events(spark, sf_dir)))
for _source in tables.SOURCES:
    register("fn16_snippets" if _source == "events" else f"fn16_snippets_of_{_source}", tables.oracle("m", "c as (select message_id, array_to_string(list_filter(regexp_split_to_array(content, '\\s+'), lambda z: z <> ''), ' ') s from m) select message_id, case when length(s) > 140 then s[1:139] || '…' else s end snippet, case when length(s) > 120 then s[1:119] || '…' else s end shorter from c", more=True, source=_source))(
        lambda spark, sf_dir, source=_source: tables.messages(spark, sf_dir, source).select("message_id", texts.snippet(F.col("content")).alias("snippet"), texts.snippet(F.col("content"), 120).alias("shorter"))
    )
events("agg09_url_domains", "select regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') domain, sender, conversation_id, count(*) n, min(timestamp_ms) first_seen, max(timestamp_ms) last_seen from (select *, unnest(regexp_extract_all(content, 'https?://[^\\s]+')) url from m) group by 1, 2, 3 order by n desc, domain, sender, conversation_id limit 100")(texts.url_domains)
events("agg45_emotions", f"select * from (select message_id, conversation_id, sender, {', '.join(f'{texts.emotion_sql(k)} {k}' for k in texts.EMOTIONS)} from m) where {' + '.join(texts.EMOTIONS)} > 0")(texts.emotions)
_LOW = "lower(trim(content))"
_MARKED = " or ".join(f"contains({_LOW}, '{x}')" for x in C.SYSTEM_MARKERS)
events("flt01_system", f"select message_id from m where not (is_system or content is null or length({_LOW}) < 3 or starts_with({_LOW}, '__') or {_MARKED} or regexp_matches({_LOW}, '{C.SYSTEM_PATTERN}'))")(lambda m: m.filter(~C.is_system(F.col("content"), F.col("is_system"))).select("message_id"))


@register("per17_vector_top", "select v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) score from embeddings v, (select embedding from embeddings where vec_id = 0) q where v.vec_id != 0 order by score desc, vec_id limit 10")
def per17_vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.vector_top(_table("embeddings")(spark, sf_dir), 0)


@register("per17_vector_top_all", """select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from
(select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) score from embeddings v join embeddings q on q.vec_id % 20 = 0 and v.vec_id != q.vec_id)) where rank <= 10""")  # fmt: skip
def per17_vector_top_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.vector_top_all(_table("embeddings")(spark, sf_dir))


@register("win09_context_pairs", """with c as (select *, lag(role) over w pr, lag(text) over w pt from conversations window w as (partition by conv_id order by turn))
select 'meta:c' || conv_id conversation_id, conv_id * 1000 + turn message_id, pt context, text reply from c where role != pr and role != 'system' and pr != 'system'""")  # fmt: skip
def win09_context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message and the adjacent one before it by another role; a system row resets."""
    m = ordered.with_previous(messages_from_conversations(spark, sf_dir), context="content", prev_system="is_system")
    return m.filter("sender != prev_sender and not is_system and not prev_system").select("conversation_id", "message_id", "context", F.col("content").alias("reply"))


@register("fn21_page_hosts", "select regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') host, count(*) n from pages group by 1 having host <> ''")
def fn21_page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    return _table("pages")(spark, sf_dir).groupBy(host.alias("host")).agg(F.count("*").alias("n")).filter("host is not null and host <> ''")


# -- cleaning of the first generation; the messages hold no entities, forms or accents, which tests cover
events("fn33_clean_texts", "select message_id, regexp_replace(content, '[\\x00-\\x1F\\x7F]', '', 'g') cleaned from m")(lambda m: m.select("message_id", clean.cleaned("content").alias("cleaned")))
events("fn34_clean_words", """select message_id, word, count(*) n from (select message_id, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'), 'http\\S+', '', 'g'), '[^A-Za-z0-9_''-]', ' ', 'g')), ' +')) word from m)
where length(word) > 1 and not regexp_matches(word, '^[0-9]+$') group by all""")(lambda m: m.select("message_id", F.explode(clean.cleaned_words("content")).alias("word")).groupBy("message_id", "word").agg(F.count("*").alias("n")))  # fmt: skip


events("fn35_emoji_runs", f"select message_id, len(regexp_extract_all(content, '{clean.EMOJI_RUN}')) runs from m")(lambda m: m.select("message_id", clean.emoji_runs("content").alias("runs")))
events("fn36_tags", "select message_id, left(regexp_replace(lower(trim(content)), '[^\\pL\\pN_]', '_', 'g'), 50) tag from m")(lambda m: m.select("message_id", clean.tag("content").alias("tag")))
events("src20_folder_titles", """select distinct folder, array_to_string(list_transform(string_split(replace(regexp_replace(folder, '_[0-9]+$', ''), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') title
from (select replace(conversation_id, ':', '_') folder from m)""")(lambda m: m.select(F.replace("conversation_id", F.lit(":"), F.lit("_")).alias("folder")).distinct().select("folder", clean.folder_title("folder").alias("title")))

#: A stand-in for a lexicon file, whose words stand in the messages.
FEW_VALENCES = {"funny": 1.9, "great": 3.1, "love": 3.2, "good": 1.9, "happy": 2.7, "thanks": 1.9, "sad": -2.1, "angry": -2.3, "sorry": -0.3, "hate": -2.7}


@register("fn09_lexicon_sentiment")
def fn09_lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(FEW_VALENCES.items()), "token string, valence double")
    m = messages_from_events(spark, sf_dir).select("message_id", "content", "is_system")
    return sentiment.with_sentiment(m, lexicon, skip=F.col("is_system")).select("message_id", "compound", "pos", "neg", "neu")


register("v104_reaction_points", tables.oracle("x", "select message_id, left(regexp_replace(lower(trim(actor)), '[^\\pL\\pN_]', '_', 'g'), 50) actor, emoji from {x}"))(lambda spark, sf_dir: tables.make("x", spark, sf_dir, {}).select("message_id", clean.tag("actor").alias("actor"), "emoji"))


# -- operators stated in SQL
def _stated(name: str, source: str = "events") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {"m": tables.messages(spark, sf_dir, source)}
        inputs = STATEMENTS[name][0].split()
        return apply(name, spark, **{k: tables.make(k, spark, sf_dir, made) for k in inputs})

    return query


#: Rules on texts, which the turns of conversations try with other words than the events' few phrases.
ON_CONVERSATIONS = (
    "agg01_text_totals", "agg06_words_without_stop_words", "agg07_top_words", "agg10_content_types", "agg11_content_summary", "agg57_starter_topics", "agg58_topics", "agg60_importance", "fn05_reaction_detector", "fn10_content_class", "fn14_words", "fn15_name_blocklist",
    "fn17_topic_keywords", "fn31_timeline_score", "per01_base_stats", "per02_vocabulary", "per07_few_shot_pairs", "per11_bubble_habits", "per11_bubble_triggers", "per12_turn_habits", "per23_held_out_pairs", "per24_fine_tune_rows", "win08_reply_pairs", "win10_turn_habits",
)
#: Statements that Spark answers in another form.
BY_OPERATOR = {"set06_jaccard": lambda spark, sf_dir: likeness.pairs(tables.make("w", spark, sf_dir, {}))}
for _name, (_inputs, _text) in STATEMENTS.items():
    register(_name, tables.oracle(_inputs, _text))(BY_OPERATOR.get(_name) or _stated(_name))
for _name in ON_CONVERSATIONS:
    register(f"{_name}_of_conversations", tables.oracle(*STATEMENTS[_name], source="conversations"))(_stated(_name, "conversations"))
