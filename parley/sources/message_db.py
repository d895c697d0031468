"""The message database of a desktop client (SQLite) as messages.

Tasks read ranges of row numbers, each through its own read-only connection, so no table passes through
the driver; the file must lie where all executors can open it.  The joins are Spark's.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

#: Row numbers a task reads, and rows of a batch.
RANGE, BATCH = 200_000, 5_000
# Row kinds and beginnings of texts that mark notices.
NOTICE_KINDS = (1, 2, 3)
NOTICE_TEXT = "^(You )?reacted to|^Loved |^Liked |^Disliked |^Laughed at |^Emphasized |^Questioned "
EPOCH_MS = 978_307_200_000
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _open(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """row_id and the columns that schema names, of one table of the file."""
    with _open(path) as db:
        low, high = db.execute(f"select min(rowid), max(rowid) from {name}").fetchone()
    out = spark.createDataFrame([], f"row_id long, {schema}").schema
    if low is None:
        return spark.createDataFrame([], out)
    types = [pa.int64() if isinstance(f.dataType, LongType) else pa.binary() if isinstance(f.dataType, BinaryType) else pa.string() for f in out]
    query = f"select rowid, {', '.join(f.name for f in out[1:])} from {name} where rowid between ? and ?"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as db:
            for first in (x for b in batches for x in b.column(0).to_pylist()):
                found = db.execute(query, (first, min(high, first + RANGE - 1)))
                while rows := found.fetchmany(BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=out.names)

    starts = spark.range(low, high + 1, RANGE, numPartitions=max(1, -(-(high + 1 - low) // RANGE)))
    return starts.mapInArrow(run, out)


def trimmed(c: Column) -> Column:
    """c without blanks at its ends; null where nothing is left."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t != "", t)


def time_ms(raw: Column) -> Column:
    """Milliseconds of a time since 2001 in nano-, micro-, milliseconds or seconds, by its size; none is 0."""
    ms = F.when(raw > 10**15, F.floor(raw / 1_000_000)).when(raw > 10**12, F.floor(raw / 1000)).when(raw < 10**11, raw * 1000).otherwise(raw)
    return F.when(F.coalesce(raw, F.lit(0)) == 0, 0).otherwise(ms + EPOCH_MS).cast("long")


def body_text(blob: Column) -> Column:
    """The longest readable stretch of an archived text (the first of equals), less the archive's own names."""
    parts = F.transform(F.split(F.make_valid_utf8(blob.cast("string")), CONTROL), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    fit = F.filter(parts, lambda p: (F.length(p) >= 2) & p.rlike("[a-zA-Z0-9]") & ~p.rlike("^NS[A-Z]|^__k"))
    return F.aggregate(fit, F.lit(None).cast("string"), lambda best, p: F.when(best.isNull() | (F.length(p) > F.length(best)), p).otherwise(best))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """conversation_id, sender, timestamp_ms, content, is_system and source of every message in a chat."""
    chat = table(spark, path, "chat", "chat_identifier string, display_name string").withColumnRenamed("row_id", "chat_id")
    member = table(spark, path, "chat_message_join", "chat_id long, message_id long").drop("row_id")
    handle = table(spark, path, "handle", "id string").select(F.col("row_id").alias("handle_id"), F.col("id").alias("handle"))
    message = table(spark, path, "message", "text string, attributedBody binary, date long, is_from_me long, handle_id long, is_system_message long, item_type long").withColumnRenamed("row_id", "message_id")
    rows = message.join(member, "message_id").join(chat, "chat_id").join(handle, "handle_id", "left")
    named = F.coalesce(trimmed(F.col("display_name")), F.when(F.col("chat_identifier") != "", F.col("chat_identifier")), F.concat(F.lit("chat_"), F.col("chat_id")))
    rows = rows.withColumn("content", F.coalesce(trimmed(F.col("text")), body_text(F.col("attributedBody"))))
    true = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        F.concat(F.lit("imessage:"), named).alias("conversation_id"),
        F.when(true(F.col("is_from_me") != 0), "Me").otherwise(F.coalesce(trimmed(F.col("handle")), F.lit("Unknown"))).alias("sender"),
        time_ms(F.col("date")).alias("timestamp_ms"), "content",
        (true(F.col("is_system_message") != 0) | true(F.col("item_type").isin(*NOTICE_KINDS)) | true(F.col("content").rlike(NOTICE_TEXT))).alias("is_system"),
        F.lit("imessage").alias("source"),
    )
