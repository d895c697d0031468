"""Likeness of the word sets of each two senders that share a word, by products of blocks of senders.

Senders of the same words are one class.  A class is cut into parts of about ``BLOCK`` senders, parts are
dealt to blocks of about ``BLOCK`` senders, and every pair of blocks is one task: it counts the common
words of its parts by matrix products over ``WORDS`` words at a time, and the pairs of parts are then spread out
into pairs of senders, row by row.  No pair is left out, none meets another by a join on words, and a task
holds the word sets of two blocks, however many senders share a word or all words.

Rows without a sender or a word are left out; a table without pairs gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.store import scratch_folder

BLOCK = 512
WORDS = 1024
PARTS = "own boolean, these array<string>, those array<string>, common long, either long"


def _common(words: pa.Array, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The number of common words of each of these rows with each of the others."""
    number = words.flatten().dictionary_encode()
    row = pc.list_parent_indices(words).to_numpy()
    order = np.argsort(number.indices.to_numpy(), kind="stable")
    number, row = number.indices.to_numpy()[order], row[order]
    out = np.zeros((len(rows), len(others)), np.int64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, WORDS):
        first, end = np.searchsorted(number, (start, start + WORDS))
        has = np.zeros((len(words), WORDS), np.float32)
        has[row[first:end], number[first:end] - start] = 1
        out += (has[rows] @ has[others].T).astype(np.int64)
    return out


def _pairs_of_parts(table: pa.Table) -> pa.Table:
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    block, words, senders = table["block"].to_numpy(), table["words"].combine_chunks(), table["senders"].combine_chunks()
    rows, others = np.flatnonzero(block == low), np.flatnonzero(block == high)
    size = pc.list_value_length(words).to_numpy().astype(np.int64)
    common = _common(words, rows, others)
    i, j = np.nonzero(np.triu(common) if low == high else common)
    common, i, j = common[i, j], rows[i], others[j]
    these, those = (senders.take(pa.array(k)).cast(pa.list_(pa.string())) for k in (i, j))
    return pa.table({"own": pa.array(i == j), "these": these, "those": those, "common": common, "either": size[i] + size[j] - common})


def pairs(words: DataFrame) -> DataFrame:
    """s1 < s2 and jaccard, to six digits, of the senders of ``words`` (sender, word) that share a word."""
    spark = words.sparkSession
    path = scratch_folder(spark, "word-sets")
    sets = words.select("sender", "word").filter("sender is not null and word is not null").groupBy("sender").agg(F.array_sort(F.collect_set("word")).alias("words"))
    sets.write.parquet(path)
    sets = spark.read.schema(sets.schema).parquet(path)
    blocks = max(1, -(-sets.count() // BLOCK))
    # at most one in BLOCK senders
    large = sets.groupBy("words").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("words", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = sets.join(F.broadcast(large), "words", "left").withColumn("part", F.pmod(F.xxhash64("sender"), F.coalesce("parts", F.lit(1))))
    parts = dealt.groupBy("words", "part").agg(F.array_sort(F.collect_list("sender")).alias("senders"))
    parts = parts.select("words", "senders", F.pmod(F.xxhash64("words") + F.col("part"), F.lit(blocks)).cast("int").alias("block"))
    met = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    # tasks cost by pairs and not by bytes, so small ones are not put together
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(_pairs_of_parts, PARTS)
    either = found.select("own", F.explode("these").alias("x"), "those", F.round(F.col("common").cast("double") / F.col("either"), 6).alias("jaccard"))
    either = either.select("own", "x", F.explode("those").alias("y"), "jaccard").filter("not own or x < y")
    return either.select(F.least("x", "y").alias("s1"), F.greatest("x", "y").alias("s2"), "jaccard")
