"""Samples of labelled documents for the operators that learn."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the text 'null')."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")).cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """text and label (0 or 1) of at most ``per_class`` labelled documents of each class.

    ``learn`` says which rows of labels may be learned from.  The sample is the rows of smallest id
    hash, so it does not depend on partitioning; a document labelled both ways is left out; its ids are broadcast, which ``2 * per_class`` bounds.
    Of rows that share an id one text is taken, the least.
    """
    known = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    known = known.filter("label = other").select("__id", "label", F.xxhash64("__id").alias("__h"))
    ids = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy("__h", "__id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("__id", "__h", F.col("text").cast("string").alias("text"), "label")
    return found.groupBy("__id", "__h", "label").agg(F.min("text").alias("text")).select("__h", "text", "label")


def table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    """A whole sample as one table, in a task."""
    found = list(batches)
    return pa.Table.from_batches(found, None if found else pa.schema([("__h", pa.int64()), ("text", pa.string()), ("label", pa.int32())]))
