"""Suffix-array dedup with a logarithmic family of indexes.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is removed.  Texts are
indexed by sampled suffixes: of each LENGTH-byte window the suffix whose first ``ANCHOR`` bytes hash
lowest, a choice that depends on the window's bytes alone, so that equal windows sample equal
suffixes.  About one suffix in ``LENGTH - ANCHOR`` / 2 is kept.

Sampled suffixes are held in arrays in suffix order, range-partitioned and sorted by their first
``HEAD`` bytes and among equal ones by the fingerprint of their first ANCHOR bytes, so suffixes whose
common prefix is that long stand side by side.  Documents come in batches.  A new batch gets its own
array, is scanned in a sort-merge with the array of each existing level for entries that agree in
ANCHOR bytes, and is then added: while a level of its size exists, the two merge into one of the next
level.  An entry keeps only the first and last place and the number of its suffixes, so a passage of a
million copies is one row.

The family says which suffixes match somewhere else; what to remove is then decided exactly, on the
documents that have one.  The windows around such a suffix are compared in blocks of ``WIDTH``: by
the string that all of them cover and by the string that any of them touches.  If the second
repeats, all windows of the block do; if the first does not, none does.  Only where the two differ
are windows compared one by one.  All strings are compared by 64-bit fingerprints and counted with
partial aggregation.  Equal texts count as one text with copies and are removed whole.  The texts that
have a match are written once in buckets, by which the results of each step are joined to them.

Defined results for odd input: a null text is empty; texts shorter than LENGTH keep everything;
equal rows are copies of each other and lose everything if long enough; an empty table gives an
empty table; extra columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbytes as tb
from parley.llm.storage import bucketed, drop, scratch, spread_join, stored

LENGTH = 400
ANCHOR = 128
HEAD = 8
WIDTH = 32
BATCHES = 4


class Hashes:
    """Fingerprints of the substrings of a run of documents."""

    def __init__(self, docs: tb.Docs):
        self.prefix = tb.prefix_hash(docs.data)
        self.inverse = tb.powers(len(docs.data) + 1)[1]

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return tb.mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start] + np.uint64(length))

    def every(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return tb.mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n] + np.uint64(length)) if n > 0 else np.zeros(0, np.uint64)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[i : i + width] for every i that has so many."""
    n = len(v)
    if n < width:
        return v[:0]
    blocks = np.full((-(-n // width)) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``HEAD`` bytes from each place on, as numbers in the order of the bytes."""
    raw = np.ascontiguousarray(data[at[:, None] + np.arange(HEAD)])
    return (raw.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).astype(np.int64)


def sampled(docs: tb.Docs) -> tuple[np.ndarray, ...]:
    """Document, place, fingerprint, first bytes, and the least and most bytes from a window's start to it."""
    size = np.diff(docs.offsets)
    if not (size >= LENGTH).any():
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty, empty, empty
    g = Hashes(docs).every(ANCHOR)
    v = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_least(v, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), np.maximum(size - LENGTH + 1, 0))
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0), np.maximum(size - LENGTH + 1, 0)) + docs.offsets[:-1][owner]
    chosen = at[starts]
    new = np.append(True, chosen[1:] != chosen[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chosen)) - 1
    x, doc = chosen[first], owner[first]
    return doc, x - docs.offsets[:-1][doc], g[x], _heads(docs.data, x), x - starts[last], x - starts[first]


class LevelFamily:
    """Arrays of distinct suffix entries, one per level; level k holds 2**k batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.hits: list[DataFrame] = []

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        entries = rows.groupBy("head", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        return stored(entries.repartitionByRange("head", "key").sortWithinPartitions("head", "key"), "suffixes")

    def add(self, batch: DataFrame) -> None:
        """Index a batch of rows (head, key, at) and note the keys that match within it or an older one."""
        new = self._array(batch.select("head", "key", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(1).cast("long").alias("n")))
        self.hits.append(stored(new.filter("first != last").select("key", "n"), "matches"))
        for level in self.levels.values():
            old = level.select("head", "key", F.col("first").alias("f"), F.col("last").alias("l"), F.col("n").alias("m"))
            self.hits.append(stored(new.join(old.hint("merge"), ["head", "key"]).filter("least(first, f) != greatest(last, l)").select("key", (F.col("n") + F.col("m")).alias("n")), "matches"))
        k = 0
        while k in self.levels:
            old = self.levels.pop(k)
            merged = self._array(new.unionByName(old))
            drop(old)
            drop(new)
            new, k = merged, k + 1
        self.levels[k] = new

    def matched(self) -> DataFrame:
        """The keys found, and about how many suffixes have each."""
        out = self.hits[0]
        for t in self.hits[1:]:
            out = out.unionByName(t)
        return out.groupBy("key").agg(F.max("n").alias("n"))


def _body(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _suffixes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in tb.text_slices(b.column(1)):
                doc, x, key, head, _, _ = sampled(part)
                sigs = b.column(0)[part.first : part.first + len(part)].to_numpy()
                fresh = np.array([s not in seen and not seen.add(s) for s in sigs.tolist()], bool)
                keep = fresh[doc] if len(doc) else np.zeros(0, bool)
                columns = (head, key.astype(np.int64), sigs[doc] if len(doc) else doc, x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["head", "key", "sig", "x"])

    return docs.mapInArrow(run, "head long, key long, sig long, x int")


def _blocks(docs: DataFrame) -> DataFrame:
    """idk, sig, place q of a block's last window, its core and hull; hull is null at a document's edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.text_slices(b.column(2)):
                h, rows = Hashes(part), b.slice(part.first, len(part))
                matched = np.repeat(part.offsets[:-1], pa.compute.list_value_length(rows.column(3)).to_numpy()) + pa.compute.list_flatten(rows.column(3)).to_numpy()
                owner, x, _, _, low, high = sampled(part)
                found = np.isin(part.offsets[:-1][owner] + x, matched)
                owner, x, low, high = owner[found], x[found], low[found], high[found]
                count = high // WIDTH - low // WIDTH + 1
                owner, x = np.repeat(owner, count), np.repeat(x, count)
                k = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low // WIDTH, count)
                q, base, size = x - k * WIDTH, part.offsets[:-1][owner], np.diff(part.offsets)[owner]
                inside = (q >= 0) & (q - WIDTH + 1 + LENGTH <= size)
                q, base, size, owner = q[inside], base[inside], size[inside], owner[inside]
                core = h.of(base + q, LENGTH - WIDTH + 1)
                whole = (q - WIDTH + 1 >= 0) & (q + LENGTH <= size)
                start = np.where(whole, base + q - WIDTH + 1, 0)
                hull = h.of(np.minimum(start, len(part.data) - LENGTH - WIDTH + 1) if len(part.data) >= LENGTH + WIDTH - 1 else start * 0, min(LENGTH + WIDTH - 1, len(part.data)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), rows.column(1).take(pa.array(owner)), pa.array(q.astype(np.int32)), pa.array(core.astype(np.int64)), pa.array(hull.astype(np.int64), mask=~whole)], names=["idk", "sig", "q", "core", "hull"])

    return docs.mapInArrow(run, "idk long, sig long, q int, core long, hull long")


def _singles(docs: DataFrame) -> DataFrame:
    """idk, sig, place and fingerprint of every window in the listed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.text_slices(b.column(2)):
                h, rows = Hashes(part), b.slice(part.first, len(part))
                owner = np.repeat(np.arange(len(part)), pa.compute.list_value_length(rows.column(3)).to_numpy())
                q = pa.compute.list_flatten(rows.column(3)).to_numpy().astype(np.int64)
                p = (q[:, None] - np.arange(WIDTH)).ravel()
                owner = np.repeat(owner, WIDTH)
                inside = (p >= 0) & (p + LENGTH <= np.diff(part.offsets)[owner])
                place = np.unique(part.offsets[:-1][owner[inside]] + p[inside])
                owner = np.searchsorted(part.offsets, place, "right") - 1
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), rows.column(1).take(pa.array(owner)), pa.array((place - part.offsets[:-1][owner]).astype(np.int32)), pa.array(h.of(place, LENGTH).astype(np.int64))], names=["idk", "sig", "p", "key"])

    return docs.mapInArrow(run, "idk long, sig long, p int, key long")


def _cut(docs: DataFrame) -> DataFrame:
    """sig, kept bytes and figures of documents with the ranges of their repeated window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.text_slices(b.column(1)):
                rows, kept, removed, spans = b.slice(part.first, len(part)), [], [], []
                ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(rows.column(2)).to_numpy())])
                found = pa.compute.list_flatten(rows.column(2))
                begin, last = (found.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                for i in range(len(part)):
                    data, mine = part.data[part.offsets[i] : part.offsets[i + 1]], slice(ends[i], ends[i + 1])
                    edge = np.bincount(np.maximum(begin[mine], 0), minlength=len(data) + 1)
                    edge -= np.bincount(np.minimum(last[mine] + LENGTH, len(data)), minlength=len(data) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(data[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["sig", "kept", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, "sig long, kept binary, n_removed long, n_spans long, kept_sha256 string")


@scratch
def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sig, copies) of the texts that occur more than once, and what ``_cut`` gives for others."""
    docs = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)).alias("idk"), F.xxhash64(_body(f"`{text}`")).alias("sig"), _body(f"`{text}`").alias("body"))
    suffixes = stored(_suffixes(docs.select("sig", "body")), "sampled")
    family = LevelFamily()
    for i in range(BATCHES):
        family.add(suffixes.filter(F.pmod("sig", F.lit(BATCHES)) == i).select("head", "key", F.struct("sig", "x").alias("at")))
    for level in family.levels.values():
        drop(level)
    matched = stored(family.matched(), "matched")
    hit = spread_join(suffixes.select("key", "sig", "x"), matched.select("key"), "key", matched).groupBy("sig").agg(F.collect_set("x").alias("anchors"))
    texts = stored(docs.groupBy("sig").agg(F.min("idk").alias("idk"), F.count("*").alias("copies")), "texts")
    wanted = hit.join(texts, "sig").select("idk", "sig", "anchors")
    # by id and text, since a text's copies may be very many; one of equal rows
    held = bucketed(docs.join(wanted.hint("shuffle_hash"), ["idk", "sig"]).dropDuplicates(["idk", "sig"]).select("idk", "sig", "body", "anchors"), "matched_texts", "idk", "sig")
    drop(suffixes)

    at = F.struct("sig", "q")
    blocks = stored(_blocks(held), "blocks")
    hulls = blocks.groupBy("core", "hull").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    hulls = stored(hulls.withColumn("many", F.col("hull").isNotNull() & (F.col("first") != F.col("last"))), "hulls")
    cores = hulls.groupBy("core").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.bool_or(~F.col("many")).alias("unsure"), F.sum("n").alias("n")).filter("f != l").select("core", "unsure", "n")
    # a block's own verdict by hull where it repeats; by core whether it may
    many = hulls.filter("many").select(F.xxhash64("core", "hull").alias("pair"), "n")
    keyed = blocks.withColumn("pair", F.xxhash64("core", "hull"))
    sure = spread_join(keyed.select("pair", "idk", "sig", "q"), many.select("pair"), "pair", many).select("idk", "sig", (F.col("q") - (WIDTH - 1)).alias("a"), F.col("q").alias("b"))
    doubtful = stored(cores.filter("unsure"), "doubtful")
    unsure = spread_join(blocks.select("core", "idk", "sig", "q"), doubtful.select("core"), "core", doubtful).groupBy("idk", "sig").agg(F.collect_set("q").alias("q"))
    singles = stored(_singles(held.join(unsure.hint("shuffle_hash"), ["idk", "sig"]).select("idk", "sig", "body", "q")), "singles")
    place = F.struct("sig", "p")
    again = stored(singles.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first != last").select("key", "n"), "again")
    single = spread_join(singles.select("key", "idk", "sig", "p"), again.select("key"), "key", again).select("idk", "sig", F.col("p").alias("a"), F.col("p").alias("b"))
    ranges = sure.unionByName(single).groupBy("idk", "sig").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    cut = stored(_cut(held.join(ranges.hint("shuffle_hash"), ["idk", "sig"]).select("sig", "body", "ranges")), "cut")
    return texts.filter("copies > 1").select("sig", "copies"), cut


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of df."""
    copies, cut = removals(df, doc_id, text)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("sig"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("sha"))
    joined = spread_join(rows, copies.join(cut.drop("kept"), "sig", "full"), "sig", copies.withColumnRenamed("copies", "n"), "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def clean(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with each text reduced to what is kept; rows of which nothing is left go.

    A character cut in two is dropped.
    """
    copies, cut = removals(df, doc_id, text)
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    body = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    rows = rows.withColumns({"sig": F.xxhash64(body), "n": F.octet_length(body)})
    joined = spread_join(rows, copies.join(cut.select("sig", "kept"), "sig", "full"), "sig", copies.withColumnRenamed("copies", "m").select("sig", F.col("m").alias("n")), "left")
    joined = joined.filter(f"not (copies is not null and n >= {LENGTH}) and not (kept is not null and octet_length(kept) = 0)")
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    return joined.select(*(F.when(F.col("kept").isNull(), F.col(n)).otherwise(left).alias(c) if c == text else F.col(n).alias(c) for c, n in names.items()))


def brute(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """For tests: n_bytes, n_removed, n_spans and digest of each text, by comparing all substrings."""
    data = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - LENGTH + 1):
            count[d[i : i + LENGTH]] = count.get(d[i : i + LENGTH], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if count[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out
