"""Sharding: minimax contiguous partition of atomic groups.

Rows are put in groups of equal texts, groups in the order of a digest of the text, and the
ordered groups are cut into ``n`` contiguous shards so that the largest shard is as small as it
can be.  The smallest feasible capacity is found by binary search: a capacity is feasible if filling
shards greedily needs no more than ``n`` of them.  A greedy fill needs only one thing from the
data, the last group whose running size does not exceed a limit.  The driver brackets the answer
with the few ends it knows and asks the data, one aggregation at a time, only about the intervals
that are still undecided.

Only built-in DataFrame functions are used.  Running sums never pass through one task: sizes are
summed within ``BLOCKS`` digest ranges, the sums of these few blocks are summed in turn, and the
two are added.  A group that holds a large share of the rows is numbered in ``SALTS`` parts.  What
reaches the driver or is broadcast is bounded by ``BLOCKS``, ``WIDTH`` and the number of shards.

Defined results for odd input: a null text has size 1 and forms one group, apart from the empty
text; equal rows (same id and text) get distinct slots; with fewer groups than shards the last
shards stay empty; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.storage import stored

BLOCKS = 4096
SALTS = 64
WIDTH = 256


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(body.cast("binary")), F.lit("null")).alias("grp"),
    ).withColumns({"block": _block(), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})


def _block():
    """The first three digits of the digest as a number; the null group comes last."""
    return F.when(F.col("grp") == "null", F.lit(BLOCKS)).otherwise(F.conv(F.substring("grp", 1, 3), 16, 10).cast("int"))


def _groups(rows: DataFrame) -> DataFrame:
    """For each group its rows, bytes, and the rows and bytes of all groups before it."""
    groups = rows.groupBy("grp", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    inside = Window.partitionBy("block").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"))
    totals = totals.select("block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("b0"))
    local = groups.withColumns({"ln": F.coalesce(F.sum("n").over(inside), F.lit(0)), "lb": F.coalesce(F.sum("bytes").over(inside), F.lit(0))})
    return local.join(F.broadcast(totals), "block").select(
        "grp", "block", "n", "bytes", (F.col("n0") + F.col("ln")).alias("row0"), (F.col("b0") + F.col("lb") + F.col("bytes")).alias("end")
    )


class _Ends:
    """What the driver knows of the running sizes at which groups end.

    ``known`` holds some of them, always including the total; inside the ``whole`` intervals it
    holds all.  A greedy fill that looks up only known ends is never better than the true one, and
    one that takes an unknown end to be as late as allowed is never worse, so the two bracket the
    least feasible capacity until the intervals between them are resolved.
    """

    def __init__(self, known: list[int], total: int):
        self.known, self.total = sorted(known), total
        self.whole: list[tuple[int, int]] = []

    def last(self, limit: int, hopeful: bool) -> int:
        if limit >= self.total:
            return self.total
        if hopeful and not any(a < limit <= b for a, b in self.whole):
            return limit
        k = bisect_right(self.known, limit)
        return self.known[k - 1] if k else 0

    def fill(self, capacity: int, shards: int, hopeful: bool = False) -> list[int]:
        ends, at = [], 0
        while len(ends) < shards and at < self.total:
            at = max(at, self.last(at + capacity, hopeful))
            ends.append(at)
        return ends

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity in [low, high] whose fill holds everything; high always does."""
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def learn(self, ends: list[int], whole: list[tuple[int, int]]) -> None:
        self.known = sorted({*self.known, *ends})
        self.whole += whole


def _disjoint(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The running sizes at which the shards of least possible maximum end.

    Every round is one aggregation that returns at most ``shards * WIDTH`` rows and narrows the
    undecided intervals ``WIDTH`` times, so the number of rounds grows as the logarithm of the bytes.
    """
    blocks = groups.groupBy("block").agg(F.max("end").alias("last"), F.max("bytes").alias("largest")).collect()
    if not blocks:
        return []
    total, largest = max(r["last"] for r in blocks), max(r["largest"] for r in blocks)
    ends = _Ends([r["last"] for r in blocks], total)
    low, high = max(largest, -(-total // shards)), largest + total // shards
    best = total  # a fill by block ends alone may need one shard for everything
    while True:
        low = ends.least(low, high, shards, hopeful=True)
        best = ends.least(low, max(best, low), shards, hopeful=False)
        high = min(high, best)
        if low >= best:
            return ends.fill(best, shards)
        early, late = [0, *ends.fill(low, shards)], [0, *ends.fill(high, shards, hopeful=True)]
        asked = _disjoint([(early[min(i, len(early) - 1)] + low - 1, min(total, y + high)) for i, y in enumerate(late) if y < total])
        place, number = F.lit(None).cast("int"), F.lit(0).cast("long")
        for i, (a, b) in enumerate(asked):
            inside = (F.col("end") > a) & (F.col("end") <= b)
            place = F.when(inside, i).otherwise(place)
            number = F.when(inside, F.floor((F.col("end") - a - 1) / -(-(b - a) // WIDTH))).otherwise(number)
        found = groups.select("end", place.alias("place"), number.alias("cell")).filter("place is not null")
        found = found.groupBy("place", "cell").agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n")).collect()
        crowded = {(r["place"], r["cell"]) for r in found if r["n"] > 2}
        whole = []
        for i, (a, b) in enumerate(asked):
            step = -(-(b - a) // WIDTH)
            whole += _disjoint([(a + c * step, min(b, a + (c + 1) * step)) for c in range(WIDTH) if (i, c) not in crowded])
        ends.learn([x for r in found for x in (r["lo"], r["hi"])], whole)


def shard(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of df.

    The law is ``bytes``: groups of equal texts stay together and shard sizes are near equal.
    """
    rows = _rows(df, doc_id, text)
    groups = stored(_groups(rows), "groups")
    cuts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for end in cuts[:-1]:
        number = number + F.when(F.col("end") > end, 1).otherwise(0)
    placed = groups.withColumn("shard", number.cast("int"))
    first = placed.groupBy("shard").agg(F.min("row0").alias("shard_row0"))
    placed = placed.join(F.broadcast(first), "shard").select("grp", "shard", (F.col("row0") - F.col("shard_row0")).alias("slot0"))
    parts = rows.groupBy("grp", "salt").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("grp").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("m0", F.coalesce(F.sum("m").over(earlier), F.lit(0))).join(placed, "grp")
    parts = parts.select("grp", "salt", "shard", (F.col("slot0") + F.col("m0")).alias("slot0"))
    inside = Window.partitionBy("grp", "salt").orderBy("doc_id")
    numbered = rows.withColumn("r", F.row_number().over(inside) - 1).join(parts, ["grp", "salt"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
