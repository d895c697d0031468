"""The driver's tables as messages: message_id, conversation_id, sender, source, timestamp_ms, ts, content, flags, compound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The texts that event messages take in turn.
PHRASES = (
    "hey, how are you doing today?", "lol that is so funny 😂😂", "check this out https://www.example.org/page?x=1", "I am so happy and excited about the trip!!",
    "sent an attachment", "good morning everyone", "no", "I really hate when this happens, so angry and annoyed 😡",
    "what time is the meeting tomorrow and who is going to bring the projector for the presentation?", "ok thanks", "see http://news.example.com/a and www.example.org ❤️", "I feel sad and lonely, missing you",
)


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks are two-person chats, other events are groups of ten."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    direct = F.col("event_type").isin("view", "click")
    phrases = F.array(*map(F.lit, PHRASES))
    return e.select(
        F.col("event_id").alias("message_id"),
        F.when(direct, F.concat(F.lit("instagram:dm_"), F.expr("user_id div 2"))).otherwise(F.concat(F.lit("whatsapp:group_"), F.expr("user_id % 10"))).alias("conversation_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("sender"),
        F.when(direct, "instagram").otherwise("whatsapp").alias("source"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(phrases, (F.col("event_id") % 12 + 1).cast("int")).alias("content"),
        (F.col("event_id") % 11 == 0).alias("has_photos"),
        (F.col("event_id") % 13 == 0).alias("has_videos"),
        (F.col("event_id") % 17 == 0).alias("has_share"),
        (F.col("event_id") % 23 == 0).alias("has_audio"),
        (F.col("event_id") % 19 == 0).alias("is_system"),
        (((F.col("event_id") * 37 + F.col("user_id") * 11) % 201 - 100).cast("double") / 100).alias("compound"),
    )


_CASE = " ".join(f"when {i} then '{p}'" for i, p in enumerate(PHRASES))
#: The same for the oracle: a CTE named m.
EVENTS_SQL = f"""m as (select event_id message_id,
  case when event_type in ('view', 'click') then 'instagram:dm_' || (user_id // 2) else 'whatsapp:group_' || (user_id % 10) end conversation_id,
  'user_' || user_id sender, case when event_type in ('view', 'click') then 'instagram' else 'whatsapp' end source, epoch_us(ts) // 1000 timestamp_ms, ts,
  case event_id % 12 {_CASE} end "content", event_id % 11 = 0 has_photos, event_id % 13 = 0 has_videos, event_id % 17 = 0 has_share, event_id % 23 = 0 has_audio, event_id % 19 = 0 is_system,
  ((event_id * 37 + user_id * 11) % 201 - 100)::double / 100 compound from events)"""


#: The turns of conversations for the oracle: a CTE named m.
CONVERSATIONS_SQL = """m as (select conv_id * 1000 + turn message_id, 'meta:c' || conv_id conversation_id, role sender, 'meta' source, 1704067200000 + conv_id * 86400000 + turn * 60000 timestamp_ms, make_timestamp((1704067200000 + conv_id * 86400000 + turn * 60000) * 1000) ts,
  text "content", false has_photos, false has_videos, false has_share, false has_audio, role = 'system' is_system, ((conv_id * 37 + turn * 11) % 201 - 100)::double / 100 compound from conversations)"""


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per turn, a minute apart; system turns are flagged."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ms = F.lit(1704067200000) + F.col("conv_id") * 86400000 + F.col("turn") * 60000
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.concat(F.lit("meta:c"), F.col("conv_id")).alias("conversation_id"), F.col("role").alias("sender"), F.lit("meta").alias("source"),
        ms.alias("timestamp_ms"), F.timestamp_millis(ms).alias("ts"), F.col("text").alias("content"), *(F.lit(False).alias(f"has_{k}") for k in ("photos", "videos", "share", "audio")), (F.col("role") == "system").alias("is_system"),
        (((F.col("conv_id") * 37 + F.col("turn") * 11) % 201 - 100).cast("double") / 100).alias("compound"),
    )
