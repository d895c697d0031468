"""Correlation of the daily moods of all pairs of senders, by products of blocks of senders.

Senders are dealt to blocks by hash, about ``BLOCK`` to each, and every pair of blocks is one task: it
holds the values of its senders by day as two matrices and gets the sums over shared days of all their
pairs from five matrix products.  No pair is left out, none meets another by a join on days, and a task
holds two blocks of senders and ``DAYS`` days at a time, however many rows share a day or a conversation.

A sender's value of a day is that of their last conversation of the day that has ``least`` messages.
Where only pairs with a key in common are asked for, the senders of each key are dealt to blocks by themselves, and
small keys go together in bins of about ``BLOCK`` senders: senders without a key in common are not
compared, unless a bin holds both.

Rows without a sender, a day or a value are left out; a table without pairs gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.store import scratch_folder

BLOCK = 512
DAYS = 1024
PAIR = "sender1 string, sender2 string, shared_days long, total_days long, correlation double"


def daily(m: DataFrame, least: int = 3) -> DataFrame:
    """sender, day and v: the mean feeling in the last conversation of the day with ``least`` messages."""
    by = m.groupBy("sender", "day", "conversation_id").agg(F.avg("compound").alias("v"), F.count("compound").alias("n")).filter(F.col("n") >= least)
    return by.groupBy("sender", "day").agg(F.max_by("v", "conversation_id").alias("v"))


def strength(correlation: Column) -> Column:
    size = F.abs(correlation)
    return F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("none")


def _sums(a: dict[str, np.ndarray], b: dict[str, np.ndarray], width: int) -> list[np.ndarray]:
    """n, x, y, xx, yy and xy of all pairs, over slices of days."""
    out = [np.zeros((len(a["first"]) - 1, len(b["first"]) - 1)) for _ in range(6)]
    for start in range(0, width, DAYS):
        held = []
        for s in (a, b):
            inside = (s["day"] >= start) & (s["day"] < start + DAYS)
            v = np.zeros((len(s["first"]) - 1, min(DAYS, width - start)))
            has = np.zeros_like(v)
            v[s["row"][inside], s["day"][inside] - start] = s["v"][inside]
            has[s["row"][inside], s["day"][inside] - start] = 1
            held.append((v, has))
        (v, p), (w, q) = held
        for total, left, right in zip(out, (p, v, p, v * v, p, v), (q, q, w, q, w * w, w), strict=True):
            total += left @ right.T
    return out


def _side(names: np.ndarray, days: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    who, row = np.unique(names, return_inverse=True)
    return who, {"row": row, "day": days, "v": values, "first": np.arange(len(who) + 1)}


def _together(who: tuple[np.ndarray, np.ndarray], names: tuple[np.ndarray, np.ndarray], keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the pairs of two sides have a key in common, over slices of keys."""
    out = np.zeros((len(who[0]), len(who[1])), bool)
    both, at = np.intersect1d(*keys), []
    for side, said, key in zip(who, names, keys, strict=True):
        kept = np.isin(key, both)
        at.append((np.searchsorted(side, said[kept]), np.searchsorted(both, key[kept])))
    for start in range(0, len(both), DAYS):
        held = []
        for side, (row, key) in zip(who, at, strict=True):
            inside = (key >= start) & (key < start + DAYS)
            has = np.zeros((len(side), min(DAYS, len(both) - start)), np.float32)
            has[row[inside], key[inside] - start] = 1
            held.append(has)
        out |= held[0] @ held[1].T > 0
    return out


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _places(members: DataFrame) -> DataFrame:
    """members (sender, key) with the group of each key and the number of blocks of that group.

    A key with more than half of ``BLOCK`` senders is a group by itself; the others share groups by hash.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    small = F.col("n") <= BLOCK // 2
    bins = sizes.filter(small).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK)).alias("bins"))  # one row
    group = F.when(small, F.concat(F.lit("bin "), F.pmod(F.xxhash64("key"), F.col("bins")))).otherwise(F.concat(F.lit("key "), "key"))
    blocks = F.when(small, 1).otherwise(F.ceil(F.col("n") / BLOCK))
    return members.join(sizes.crossJoin(F.broadcast(bins)).select("key", group.alias("group"), blocks.cast("int").alias("blocks")), "key")


def correlations(daily: DataFrame, min_days: int = 5, most: int | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Pearson's r of each pair of senders with ``min_days`` shared days; 0 where one does not vary.

    ``total_days`` is the larger number of days of the two.  ``most`` keeps as many pairs of the largest
    |r| (to four digits; then by name), chosen in each task first.  ``shared`` (sender, key) keeps
    the pairs that have a key in common; one with several is given by the first group that holds any of them.
    """
    rows = daily.filter("sender is not null and day is not null and v is not null").select("sender", F.col("day").alias("key"), "v")
    enough = rows.groupBy("sender").agg(F.count("*").alias("days")).filter(F.col("days") >= min_days)
    tied = shared is not None
    block_of = F.pmod(F.xxhash64("sender"), F.col("blocks")).cast("int").alias("block")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # tie: a row of a key, not of a day; early: of a key whose group comes before this one
    values = [F.lit(False).alias("tie"), F.lit(False).alias("early")]
    if tied:
        rows = _stored(rows.join(enough, "sender"), "moods")
        senders = rows.select("sender", "days").distinct()
        members = _stored(_places(_stored(shared.select("sender", F.col("key").cast("string").alias("key")).filter("key is not null").distinct().join(senders, "sender"), "mood-keys")), "mood-places")
        places = members.select("sender", "group", "blocks").distinct().select("sender", "group", block_of, others)
        keys = members.select("sender", "key", F.lit(1.0).alias("v"), "days", F.lit(True).alias("tie"), F.col("group").alias("of"))
        keys = keys.join(places, "sender").filter(F.col("of") <= F.col("group")).withColumn("early", F.col("of") < F.col("group")).drop("of")
        rows = rows.select("*", *values).join(places, "sender").unionByName(keys)
    else:
        blocks = max(1, -(-enough.count() // BLOCK))
        rows = rows.join(enough, "sender").select("*", *values, F.lit("").alias("group"), F.lit(blocks).alias("blocks")).select("*", block_of).select("*", others).drop("blocks")
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def block(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        names, keys = np.array(table["sender"].to_pylist(), object), np.array(table["key"].to_pylist(), object)
        tie, early, v, of, days = (table[c].to_numpy() for c in ("tie", "early", "v", "block", "days"))
        _, number = np.unique(keys, return_inverse=True)
        sides = []
        for b in (low, high):
            pick = (of == b) & ~tie
            who, side = _side(names[pick], number[pick], v[pick])
            held = np.zeros(len(who), np.int64)
            held[side["row"]] = days[pick]
            sides.append((who, side, held))
        (a, left, days_a), (b, right, days_b) = sides
        width = int(number[~tie].max()) + 1 if (~tie).any() else 0
        n, x, y, xx, yy, xy = _sums(left, right, width)
        fit = n >= min_days
        if low == high:
            fit = np.triu(fit, 1)
        if tied:
            for first in (False, True):
                picks = [(of == k) & tie & (early == first) for k in (low, high)]
                common = _together((a, b), tuple(names[p] for p in picks), tuple(number[p] for p in picks))
                fit &= ~common if first else common
        i, j = np.nonzero(fit)
        n, x, y, xx, yy, xy = (s[i, j] for s in (n, x, y, xx, yy, xy))
        below = np.maximum((n * xx - x * x) * (n * yy - y * y), 0)
        r = np.where(np.sqrt(below) > 1e-9, (n * xy - x * y) / np.sqrt(np.where(below > 0, below, 1)), 0.0)
        one, two = a[i], b[j]
        swap = one > two
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        if most is not None:
            best = np.lexsort((two.astype(str), one.astype(str), -np.abs(np.round(r, 4))))[:most]
            one, two, n, r, i, j = one[best], two[best], n[best], r[best], i[best], j[best]
        total = np.maximum(days_a[i], days_b[j])
        return pa.table({"sender1": pa.array(one.tolist(), pa.string()), "sender2": pa.array(two.tolist(), pa.string()), "shared_days": n.astype(np.int64), "total_days": total, "correlation": r})

    # tasks cost by pairs and not by bytes, so small ones are not put together
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "group", "low", "high").groupBy("group", "low", "high").applyInArrow(block, PAIR)
    if most is not None:
        found = found.orderBy(F.desc(F.abs(F.round("correlation", 4))), "sender1", "sender2").limit(most)
    return found
