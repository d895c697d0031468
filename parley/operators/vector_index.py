"""Vectors of personas' messages, kept up to date in a database.

The newest messages of each person with enough of them get a vector; those that have one of the model are
left alone, vectors of other models go.  Texts are embedded by any function from texts to vectors, in batches
of ``BATCH`` inside tasks; a task stops after ``ERRORS`` failed batches and the rest is done by the next run.
``hashed`` is an embedder that needs no model: signed counts of words, hashed into ``DIMS`` places.

Null or short texts, notices and people with few messages get none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.store import Database

# The shortest text, messages that make a person eligible and messages of one that get vectors.
LEAST_CHARS, LEAST_MESSAGES, NEWEST = 8, 20, 2500
BATCH, ERRORS, DIMS = 64, 5, 64
TABLE = "embeddings"
SCHEMA = "message_id long, provider string, model string, dims int, embedding array<float>"

Embedder = Callable[[list[str]], list[list[float]]]


def hashed(texts: list[str]) -> list[list[float]]:
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % DIMS] += 1 if h >> 16 & 1 else -1
    return out.tolist()


def eligible(m: DataFrame) -> DataFrame:
    """message_id and content of the messages that are to have vectors."""
    rows = m.filter((F.length(F.trim("content")) >= LEAST_CHARS) & ~F.col("is_system"))
    enough = rows.groupBy("sender").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_MESSAGES).select("sender")
    newest = F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("timestamp_ms"), F.desc("message_id")))
    return rows.join(enough, "sender", "left_semi").withColumn("newest", newest).filter(F.col("newest") <= NEWEST).select("message_id", F.trim("content").alias("content"))


def embed(rows: DataFrame, embedder: Embedder, provider: str, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                if errors >= ERRORS:
                    return
                try:
                    found = embedder(part.column(1).to_pylist())
                except Exception:  # noqa: BLE001  (an embedder may be anything; the rest is left to the next run)
                    errors += 1
                    continue
                made = [(i, v) for i, v in zip(part.column(0).to_pylist(), found, strict=True) if v]
                n = len(made)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), pa.array([provider] * n), pa.array([model] * n), pa.array([len(v) for _, v in made], pa.int32()), pa.array([v for _, v in made], pa.list_(pa.float32()))], names=["message_id", "provider", "model", "dims", "embedding"])

    return rows.select("message_id", "content").mapInArrow(run, SCHEMA)


def missing(database: Database, m: DataFrame, model: str) -> DataFrame:
    """The eligible messages without a vector of this model."""
    rows = eligible(m)
    if TABLE not in database.manifest()["tables"]:
        return rows
    return rows.join(database.read(TABLE).filter(F.col("model") == model).select("message_id"), "message_id", "left_anti")


def update(database: Database, m: DataFrame, embedder: Embedder = hashed, provider: str = "local", model: str = "hashed") -> None:
    """Give vectors to what has none, and drop those of other models, in one commit."""
    made = embed(missing(database, m, model), embedder, provider, model)
    with database.commit() as tx:
        tx.create(TABLE, made.schema, ["message_id"])
        tx.delete(TABLE, tx.read(TABLE).filter(F.col("model") != model).select("message_id"))
        tx.upsert(TABLE, made)
