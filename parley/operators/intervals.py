"""Joins of intervals with points in time, by cells of time.

Both sides are cut into cells of a quarter of the usual length of an interval.  A point lies in one
cell, an interval is copied to each cell it touches, and the two meet by an equi-join on key and cell;
the exact bounds are tested after it.  So a point is compared with the intervals of at most a quarter more
than their length, whatever else its key holds, and a key with a third of all rows is dealt out by time.

A cell that holds many points is dealt to several tasks, and the intervals are copied to each of these:
a cell counts as hot from ``HOT`` points on, if it has more than one in ``HOT_CELLS`` of all points, so at
most ``HOT_CELLS`` rows are broadcast.

Rows with a null key, bound or time, and intervals that end before they begin, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in the usual length of an interval, points that make a cell hot, and hot cells at most.
PARTS = 4
HOT = 20_000
HOT_CELLS = 4096
_CELL, _SALT, _DEALT = "__cell", "__salt", "__dealt"


def _hot_cells(points: DataFrame, on: list[str], hot: int) -> DataFrame:
    counts = points.groupBy(*on, _CELL).agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("every"))  # one row
    least = F.greatest(F.lit(hot), F.ceil(F.col("every") / HOT_CELLS))
    return counts.crossJoin(F.broadcast(every)).filter(F.col("n") > least).select(*on, _CELL, F.ceil(F.col("n") / least).cast("int").alias(_DEALT))


def candidates(intervals: DataFrame, points: DataFrame, on: list[str], start: str, stop: str, at: str, usual_ms: int, hot: int = HOT) -> DataFrame:
    """The pairs that share a key and a cell, before the bounds are tested; the two sides share no other column."""
    cell = max(1, usual_ms // PARTS)
    number = lambda c: F.floor(F.col(c) / cell)
    near = intervals.filter(F.col(start) <= F.col(stop)).withColumn(_CELL, F.explode(F.sequence(number(start), number(stop))))
    found = points.filter(F.col(at).isNotNull()).withColumn(_CELL, number(at))
    dealt = F.broadcast(_hot_cells(found, on, hot))
    salt = F.pmod(F.xxhash64(*(c for c in points.columns if c not in on)), F.coalesce(_DEALT, F.lit(1)))
    found = found.join(dealt, [*on, _CELL], "left").withColumn(_SALT, salt.cast("int")).drop(_DEALT)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(_DEALT, F.lit(1)) - 1))
    near = near.join(dealt, [*on, _CELL], "left").withColumn(_SALT, copies).drop(_DEALT)
    return near.join(found, [*on, _CELL, _SALT]).drop(_CELL, _SALT)


def pairs(intervals: DataFrame, points: DataFrame, on: list[str], start: str, stop: str, at: str, usual_ms: int, hot: int = HOT) -> DataFrame:
    """Each interval with each point of its key between its bounds, both included."""
    return candidates(intervals, points, on, start, stop, at, usual_ms, hot).filter(F.col(at).between(F.col(start), F.col(stop)))
