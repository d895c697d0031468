"""Aggregations over messages, replies, turns and bursts.  Every function maps tables to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import compat as C
from parley.operators import ordered

WEIGHTS = {"message_frequency": 0.25, "response_speed": 0.20, "conversation_initiation": 0.15, "message_length": 0.10, "consistency": 0.15, "social_connectivity": 0.15}

#: Turns of a conversation that one task sorts.
TURNS_A_SLICE = 1_000_000


def media_message():
    return F.col("has_photos") | F.col("has_videos") | F.coalesce(F.col("content").ilike("%sent an attachment%"), F.lit(False))


def conversation_summary(m: DataFrame, replies: DataFrame) -> DataFrame:
    base = m.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.count_distinct("sender").alias("n_participants"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))
    latency = replies.groupBy("conversation_id").agg(C.js_round(F.avg("latency_ms")).cast("long").alias("avg_response_ms"))
    return base.join(latency, "conversation_id", "left").select("*", (F.col("last_ms") - F.col("first_ms")).alias("duration_ms"), (F.col("message_count") - 1).alias("turns"))


def attachment_series(m: DataFrame, photos: DataFrame, videos: DataFrame) -> DataFrame:
    """conversation_id, month, photo_count and video_count of the messages that have any; photos and videos hold a row each, by message_id."""
    counts = [t.groupBy("message_id").agg(F.count("*").alias(n)) for t, n in ((photos, "photo_count"), (videos, "video_count"))]
    shown = m.filter("conversation_id is not null and (has_photos or has_videos)").select("message_id", "conversation_id", C.month(F.timestamp_millis("timestamp_ms")).alias("month"))
    joined = shown.join(counts[0], "message_id", "left").join(counts[1], "message_id", "left")
    return joined.groupBy("conversation_id", "month").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("photo_count", "video_count")))


def messages_by_sender(m: DataFrame) -> DataFrame:
    return m.groupBy("conversation_id", "sender").agg(F.count("*").alias("message_count"))


def platform_summary(m: DataFrame) -> DataFrame:
    return m.groupBy("source").agg(F.count_distinct("conversation_id").alias("conversations"), F.count("*").alias("messages"))


def monthly_messages(m: DataFrame) -> DataFrame:
    return m.groupBy("conversation_id", C.month(F.col("ts")).alias("month")).agg(F.count("*").alias("message_count"))


def latency_histogram(replies: DataFrame) -> DataFrame:
    return replies.groupBy("conversation_id", C.bucket(F.col("latency_ms"), C.LATENCIES, inclusive=False).alias("bucket")).agg(F.count("*").alias("reply_count"))


def reply_quantiles(replies: DataFrame, shares: dict[str, float], width: int = 8192) -> DataFrame:
    """The reply latency at rank floor(n * share) of each responder, by name, and the number of replies.

    Equal latencies are counted first.  The bucket that holds the rank is found from the counts of
    buckets of ``width`` milliseconds, and the value among that bucket's latencies only, so that no
    task handles more rows of a responder than there are buckets or milliseconds in one.
    """
    values = replies.groupBy("responder", "latency_ms").agg(F.count("*").alias("c")).withColumn("bucket", F.floor(F.col("latency_ms") / width))
    w = Window.partitionBy("responder")
    running = lambda w: F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    buckets = values.groupBy("responder", "bucket").agg(F.sum("c").alias("c")).select("responder", "bucket", (running(w.orderBy("bucket")) - F.col("c")).alias("before"), "c", F.sum("c").over(w).alias("n"))
    ranks = F.array(*(F.struct(F.lit(k).alias("share"), F.least(F.col("n") - 1, F.floor(F.col("n") * p)).alias("rank")) for k, p in shares.items()))
    held = buckets.select("responder", "bucket", "before", "c", "n", F.inline(ranks)).filter("before <= rank and rank < before + c").drop("c")
    inside = values.join(held, ["responder", "bucket"]).withColumn("upto", F.col("before") + running(Window.partitionBy("responder", "share").orderBy("latency_ms")))
    return inside.filter("upto - c <= rank and rank < upto").groupBy("responder").agg(*(F.max(F.when(F.col("share") == k, F.col("latency_ms"))).alias(k) for k in shares), F.max("n").alias("n"))


def latency_label(ms):
    return F.when(ms.isNull(), "unknown").when(ms < 30_000, "very fast (<30s)").when(ms < 300_000, "quick (under 5m)").when(ms < 3_600_000, "moderate (minutes to an hour)").otherwise("slow (often hours+)")


def active_hours(m: DataFrame) -> DataFrame:
    return m.groupBy("conversation_id", F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("day_of_week"), "sender").agg(F.count("*").alias("message_count"))


def activity_by(m: DataFrame, grain: str) -> DataFrame:
    key = {"hour": F.hour("ts"), "day_of_week": F.dayofweek("ts") - 1, "month": C.month(F.col("ts"))}[grain]
    return m.groupBy(key.alias(grain)).agg(F.count("*").alias("message_count"), F.count_if(media_message()).alias("media_count"), F.round(F.avg("compound"), 6).alias("avg_sentiment"), F.count_distinct("sender").alias("unique_senders"))


def media_by_sender(m: DataFrame) -> DataFrame:
    flag = lambda c: F.sum(F.col(c).cast("int")).alias(c.removeprefix("has_"))
    return m.groupBy("conversation_id", "sender").agg(flag("has_photos"), flag("has_videos"), F.count_if(media_message()).alias("media_messages"), F.count("*").alias("messages"))


def media_rollup(m: DataFrame) -> DataFrame:
    """By sender within a conversation, by conversation, and overall, in one pass."""
    out = m.rollup("conversation_id", "sender").agg(F.count_if(media_message()).alias("media_messages"), F.count("*").alias("messages"), F.grouping_id().alias("level"))
    return out.withColumn("media_ratio", F.round(C.ratio(F.col("media_messages"), F.col("messages")), 6))


def daily_sentiment(m: DataFrame, *keys: str) -> DataFrame:
    """Sums and counts by day, which any selection can add up again, and their mean."""
    out = m.filter("not is_system").groupBy(*keys, C.day(F.col("ts")).alias("date")).agg(F.round(F.sum("compound"), 6).alias("compound_sum"), F.count("*").alias("n"))
    mean = F.col("compound_sum") / F.col("n")
    return out.withColumn("label", F.when(mean > 0.1, "positive").when(mean < -0.1, "negative").otherwise("neutral"))


def turn_stats(t: DataFrame) -> DataFrame:
    total = Window.partitionBy("conversation_id")
    by = t.groupBy("conversation_id", "participant").agg(F.count("*").alias("turn_count"), F.round(F.avg("message_count"), 6).alias("avg_length"), F.max("message_count").alias("max_length"))
    return by.withColumn("percentage", F.round(100 * F.col("turn_count") / F.sum("turn_count").over(total), 6))


def turn_patterns(t: DataFrame) -> DataFrame:
    """Who holds the floor: dominant by message share, else balanced, responsive or sporadic."""
    pause = F.col("start_ms") - F.col("prev_end")
    pauses = ordered.with_lags(t, F.floor(F.col("turn_no") / TURNS_A_SLICE), ["turn_no"], prev_end="end_ms").select("conversation_id", F.when((pause > 0) & (pause < 86_400_000), pause).alias("pause")).groupBy("conversation_id").agg(F.coalesce(F.avg("pause"), F.lit(0.0)).alias("pause"))
    by = t.groupBy("conversation_id", "participant").agg(F.count("*").alias("n"), F.sum("message_count").alias("msgs"))
    c = by.groupBy("conversation_id").agg(F.count("*").alias("people"), F.sum("n").alias("turn_count"), F.max("n").alias("most"), F.min("n").alias("least"), (F.max("msgs") / F.sum("msgs")).alias("share")).join(pauses, "conversation_id")
    pattern = F.when(F.col("share") > 0.7, "dominant").when((F.col("most") <= 2 * F.col("least")) & (F.col("people") > 1), "balanced").when(F.col("most") > 0.7 * F.col("turn_count"), "dominant")
    pattern = pattern.when((F.col("pause") < 300_000) & (F.col("turn_count") > 10), "responsive").otherwise("sporadic")
    return c.select("conversation_id", "turn_count", F.round(F.col("most") / F.col("least"), 4).alias("turn_ratio"), F.round("share", 6).alias("max_message_share"), pattern.alias("pattern_type"))


def burst_depths(bursts: DataFrame) -> DataFrame:
    return bursts.groupBy("conversation_id", F.col("message_count").alias("depth")).agg(F.count("*").alias("bursts"))


def burst_starters(bursts: DataFrame, k: int = 20) -> DataFrame:
    return bursts.groupBy("starter").agg(F.count("*").alias("bursts"), F.sum("message_count").alias("messages")).orderBy(F.desc("bursts"), "starter").limit(k)


def starter_responses(m: DataFrame, starters: DataFrame, within_ms: int = 86_400_000) -> DataFrame:
    """For each session starter, the messages of others in the day after it."""
    counted = ordered.counts_after(m, within_ms).withColumnRenamed("n_after", "response_count")
    return counted.join(starters.select("message_id"), "message_id", "left_semi").select("message_id", "conversation_id", "sender", "response_count")


def engagement(m: DataFrame, replies: DataFrame) -> DataFrame:
    """Six components of 0 to 100 per participant, scaled by means over participants, and their weighted sum.

    Conversations of one sender count in the number of all conversations and in nothing else.
    """
    every = m.agg(F.count_distinct("conversation_id").alias("g_conversations"))
    shared = m.groupBy("conversation_id").agg(F.count_distinct("sender").alias("n")).filter("n >= 2")
    m = m.join(shared, "conversation_id", "left_semi")
    first = m.groupBy("conversation_id").agg(F.min_by("sender", F.struct("timestamp_ms", "message_id")).alias("participant"))
    starts = first.groupBy("participant").agg(F.count("*").alias("starts"))
    latency = replies.groupBy(F.col("responder").alias("participant")).agg(F.avg("latency_ms").alias("latency"))
    p = m.groupBy(F.col("sender").alias("participant")).agg(
        F.count_distinct("conversation_id").alias("conversations"), F.count("*").alias("messages"), F.avg(F.coalesce(F.length("content"), F.lit(0))).alias("length"),
        F.count_distinct(C.day(F.col("ts"))).alias("days"), ((F.max("timestamp_ms") - F.min("timestamp_ms")) / 86_400_000).alias("span"),
    )
    p = p.join(starts, "participant", "left").join(latency, "participant", "left").fillna({"starts": 0, "latency": 0.0, "length": 0.0})
    p = p.withColumn("per", F.col("messages") / F.col("conversations"))
    whole = p.agg(F.avg("per").alias("g_per"), F.avg("latency").alias("g_latency"), F.avg("length").alias("g_length")).crossJoin(every)
    p = p.crossJoin(F.broadcast(whole))  # one row
    cap = lambda c: F.least(F.lit(100.0), c)
    parts = {
        "message_frequency": cap(C.ratio(F.col("per"), F.col("g_per")) * 50),
        "response_speed": F.when(F.col("latency") > 0, cap(F.try_divide(F.col("g_latency"), F.col("latency")) * 50)).otherwise(50.0),
        "conversation_initiation": cap(F.col("starts") / F.col("conversations") * 100),
        "message_length": F.when(F.col("length") > 0, cap(F.try_divide(F.col("length"), F.col("g_length")) * 50)).otherwise(25.0),
        "consistency": cap(F.col("days") / F.greatest(F.lit(1), F.ceil("span")) * 100),
        "social_connectivity": cap(F.col("conversations") / F.col("g_conversations") * 200),
    }
    p = p.withColumns(parts).withColumn("overall", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    tier = F.when(F.col("overall") >= 70, "high").when(F.col("overall") >= 40, "medium").otherwise("low")
    return p.select("participant", F.round("overall", 4).alias("overall_score"), *(F.round(k, 4).alias(k) for k in WEIGHTS), F.col("conversations").alias("conversations_count"), F.col("messages").alias("total_messages"), tier.alias("engagement_tier"))


def conversation_engagement(m: DataFrame, replies: DataFrame) -> DataFrame:
    """The mean of the scores of a conversation's members, how many are of each tier, and how far they differ."""
    scores = engagement(m, replies).select(F.col("participant").alias("sender"), "overall_score", "engagement_tier")
    members = m.select("conversation_id", "sender").distinct().join(scores, "sender")
    tier = lambda t: F.count_if(F.col("engagement_tier") == t).alias(t)
    out = members.groupBy("conversation_id").agg(F.count("*").alias("n"), C.js_round(F.avg("overall_score"), 1).alias("avg_engagement"), tier("high"), tier("medium"), tier("low"), F.round(F.var_pop("overall_score"), 4).alias("variance"))
    return out.join(m.groupBy("conversation_id").agg(F.count_distinct("sender").alias("people")).filter("people >= 2").select("conversation_id"), "conversation_id", "left_semi").drop("n")


def engagement_of_selection(m: DataFrame, replies: DataFrame, selected: DataFrame) -> DataFrame:
    """Scores of all messages' participants, averaged over the selected conversations that each writes in."""
    scores = engagement(m, replies).withColumnRenamed("participant", "sender")
    rows = selected.groupBy("conversation_id", "sender").agg(F.count("*").alias("n")).join(scores, "sender")
    mean = lambda c: C.js_round(F.avg(c), 1).alias(c)
    tier = F.when(F.avg("overall_score") >= 70, "high").when(F.avg("overall_score") >= 40, "medium").otherwise("low")
    return rows.groupBy(F.col("sender").alias("participant")).agg(mean("overall_score"), mean("message_frequency"), mean("response_speed"), mean("social_connectivity"), F.count("*").alias("conversations"), F.sum("n").alias("messages"), tier.alias("tier"))


def participants_filter(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Rows whose sender belongs to the row's conversation; conversations without participants keep theirs."""
    known = participants.select("conversation_id").distinct().withColumn("known", F.lit(True))
    member = participants.select("conversation_id", F.col("participant").alias("sender")).distinct().withColumn("member", F.lit(True))
    return rows.join(known, "conversation_id", "left").join(member, ["conversation_id", "sender"], "left").filter("known is null or member").drop("known", "member")


def top_per_group(counts: DataFrame, group: list[str], by: str, tie: str, k: int) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), tie))).filter(F.col("rank") <= k)


def round_robin(df: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """Take the first of each group, then the second of each, and so on, up to ``limit`` rows."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("rn", group).limit(limit)
