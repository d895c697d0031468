"""N-gram Jaccard join over parity sketches.

The distinct ``k``-word shingles of a text are XOR-hashed into a bit sketch of P parts: each
shingle flips one of 2**32 bits of its part.  Shingles that two texts share cancel, so the Hamming
distance of two sketches never exceeds the symmetric difference of their sets.  Texts whose Jaccard
similarity reaches the threshold differ in at most D shingles, D growing with the size band, so of
P > D parts at least P - D agree.  A part is kept as the XOR of the mixed positions of its set
bits; texts are joined on (band, part, that word).  All texts rank their parts in one order, by the
number of shingles in them, and a text that can differ from a partner in d shingles joins on its
first d + 1: of so many one must agree, and parts of few shingles, which say little, stay out.

Every candidate is verified before it closes anything.  Texts that share a word are tested in pairs,
by size, by the Hamming distance of short dense sketches, and then by the sets themselves, which are
fetched only for pairs that pass.  Of a word that more than ``SMALL`` texts share, each text is first
tested against one; where some are not linked with that one, these are compared with the rest in
blocks of ``BLOCK`` texts by their dense sketches.  A forest of the pairs that pass is verified, and
only where one of its pairs fails, all of them.  So a large group of near copies costs a number of
verifications in proportion to its size.  Texts with the same set are one from the start.

Defined results for odd input: a null, empty or blank text has an empty set and is linked with
nothing; a text of fewer than ``k`` words is one shingle; rows that share a doc_id are separate
texts of the same id; a null doc_id never names a component unless all its members have none; an
empty table gives an empty table; extra columns are ignored (``keep_first`` keeps them, whatever
their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbytes as tb
from parley.llm.components import components
from parley.llm.storage import scratch, spread_join, stored

SMALL = 32
BLOCK = 1024
DENSE_WORDS = 8
_PART = np.uint64(0xA0761D6478BD642F)


class Rule(NamedTuple):
    """Link when ``100 * intersection >= percent * union`` of the k-word shingle sets."""

    k: int = 5
    percent: int = 80

    def linked(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of two linked sets of ``total`` elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def band_starts(self, most: int) -> list[int]:
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, out[-1] * 8 // 5))
        return out


def shingles(docs: tb.Docs, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    w = tb.words(docs, tb.NOT_BLANK, tb.LOWER)
    h, _ = tb.windows(w, k)
    for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if z - a >= k:
            yield np.unique(h[a : z - k + 1])
        elif z > a:
            order = np.arange(1, z - a + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
            yield tb.mix(np.atleast_1d(np.add.reduce(tb.mix(w.hash[a:z] ^ order)) + np.uint64(z - a)))
        else:
            yield np.zeros(0, np.uint64)


def part_words(s: np.ndarray, start: int, most: int, rule: Rule) -> np.ndarray:
    """The join keys of a set for pairs whose larger set has start..most elements."""
    band = rule.most_apart(2 * most)
    needed = rule.most_apart(len(s) + min(most, 100 * len(s) // rule.percent)) + 1
    parts = band * 13 // 10 + 6 if band else 1
    bit = tb.mix(s ^ np.uint64(start * 2654435761))
    part = ((bit >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    count = np.bincount(part, minlength=parts)
    used = np.flatnonzero(count)
    begin = np.cumsum(count[used]) - count[used]
    word = np.zeros(parts, np.uint64)
    word[used] = np.bitwise_xor.reduceat(tb.mix((bit & np.uint64(0xFFFFFFFF)) + _PART)[order], begin)
    key = tb.mix(word ^ tb.mix(np.arange(parts, dtype=np.uint64) + np.uint64(start << 24)))
    # equal keys have equal counts, so this order is the same for all sets
    return key[np.lexsort((key, -count))[:needed]]


def keys(s: np.ndarray, starts: list[int], rule: Rule) -> np.ndarray:
    """The keys for every band whose larger partner may link with a set of this size."""
    n, out = len(s), []
    i = int(np.searchsorted(starts, n, "right")) - 1
    while rule.percent * starts[i] <= 100 * n:
        out.append(part_words(s, starts[i], starts[i + 1] - 1, rule))
        i += 1
    return np.concatenate(out)


def signature(s: np.ndarray) -> int:
    return int(tb.mix(np.atleast_1d(np.add.reduce(tb.mix(s)) + np.uint64(len(s))))[0].astype(np.int64))


def dense_sketch(s: np.ndarray) -> np.ndarray:
    bits = 64 * DENSE_WORDS
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _text_key():
    return F.xxhash64("text").alias("tsig")


def _sized(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text hash, signature of the set, its size and its dense sketch (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.text_slices(b.column(2)):
                sets = list(shingles(part, rule.k))
                rows = slice(part.first, part.first + len(part))
                sketch = pa.array([dense_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
                columns = [b.column(0)[rows], b.column(1)[rows], pa.array([signature(s) if len(s) else 0 for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), sketch]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tsig", "sig", "n_shingles", "sketch"])

    return docs.select("doc_id", _text_key(), "text").mapInArrow(run, "doc_id long, tsig long, sig long, n_shingles long, sketch array<long>")


def _pairs_within(node: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """All pairs (smaller first) inside groups of ``SMALL`` nodes at most."""
    out = [np.zeros((2, 0), np.int64)]
    for m in np.unique(size[size > 1]).tolist():
        rows = node[begin[size == m][:, None] + np.arange(m)]
        i, j = np.triu_indices(m, 1)
        out.append(np.stack([rows[:, i].ravel(), rows[:, j].ravel()]))
    return out


class _Meeting:
    """Rows of (key, node) in order become pairs, and for keys of many nodes also memberships."""

    def __init__(self):
        self.key, self.node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: tuple[int, int] | None = None  # a key of many nodes that may go on, and its first node
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def _note(self, pairs: list[np.ndarray]) -> None:
        self.pairs += pairs
        self.held += sum(p.shape[1] for p in pairs)

    def _large(self, key: int, nodes: np.ndarray) -> pa.RecordBatch:
        first = self.open[1] if self.open and self.open[0] == key else int(nodes[0])
        self.open = (key, first)
        self._note([np.stack([np.full(len(nodes), first), nodes])[:, nodes != first]])
        return _batch("key a b", np.full(len(nodes), key), np.full(len(nodes), first), nodes)

    def add(self, key: np.ndarray, node: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
        key, node = np.concatenate([self.key, key]), np.concatenate([self.node, node])
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
        key, node = key[fresh], node[fresh]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        size = np.diff(np.append(begin, len(key)))
        if len(begin) and not last and size[-1] <= SMALL and not (self.open and self.open[0] == key[-1]):
            self.key, self.node = key[begin[-1] :], node[begin[-1] :]  # may go on
            begin, size = begin[:-1], size[:-1]
        else:
            self.key, self.node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large = size > SMALL
        if len(begin) and self.open:
            large[0] |= key[begin[0]] == self.open[0]
        for g in np.flatnonzero(large).tolist():
            yield self._large(int(key[begin[g]]), node[begin[g] : begin[g] + size[g]])
        self._note(_pairs_within(node, begin[~large], size[~large]))
        if self.held > 1 << 19 or last:
            found = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *self.pairs], axis=1), axis=1)
            self.pairs, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.nulls(found.shape[1], pa.int64()), pa.array(found[0]), pa.array(found[1])], names=["key", "a", "b"])


def _met(docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of sets that share a key (null) or, of a key that many sets share, its first set and each (key, a, b)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, seen = [1], set()
        for b in batches:
            for part in tb.text_slices(b.column(0)):
                held, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s in shingles(part, rule.k):
                    sig = signature(s) if len(s) else 0
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        if starts[-1] < 2 * len(s) + 2:
                            starts = rule.band_starts(4 * len(s) + 4)
                        held.append(keys(s, starts, rule))
                        nodes.append(np.full(len(held[-1]), sig, np.int64))
                if len(seen) > 1 << 20:  # copies are also found behind the shuffle
                    seen.clear()
                yield _batch("key node", np.concatenate(held).view(np.int64), np.concatenate(nodes))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _Meeting()
        for b in batches:
            yield from m.add(b.column(0).to_numpy(), b.column(1).to_numpy())
        none = np.zeros(0, np.int64)
        yield from m.add(none, none, last=True)

    rows = docs.select("text").mapInArrow(sketch, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "key long, a long, b long")


def _near(rule: Rule) -> str:
    """SQL: whether sets of na and nb elements with sketches sa and sb may be linked."""
    apart = "aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return f"100 * least(na, nb) >= {rule.percent} * greatest(na, nb) and {apart} <= (na + nb) * {100 - rule.percent} div {100 + rule.percent}"


def _tested(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that pass by size and sketch; pairs of one set (a large key's first) are dealt out."""
    whole = pairs
    for x in "ab":
        sets = nodes.select(F.col("sig").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        whole = spread_join(whole, sets, x, _counts(pairs, x))
    return whole.filter(_near(rule)).select("a", "b")


def _counts(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count("*").alias("n"))


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets are similar enough; each set's text is fetched once and sent to its pairs."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(nodes.select("sig", "rep"), "sig")
    keyed = docs.select(*_row_key("doc_id", _text_key()), "text")
    texts = keyed.join(named.select("sig", F.col("rep.nul").alias("nul"), F.col("rep.idk").alias("idk"), F.col("rep.tsig").alias("tsig")).hint("shuffle_hash"), ["nul", "idk", "tsig"])
    texts = texts.groupBy("sig").agg(F.any_value("text").alias("text"))  # a row may stand there twice
    whole = pairs
    for x in "ab":
        whole = spread_join(whole, texts.select(F.col("sig").alias(x), F.col("text").alias(f"t{x}")), x, _counts(pairs, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [batch.column(i).to_numpy() for i in (0, 1)]
            both = np.concatenate(sigs)
            _, first, back = np.unique(both, return_index=True, return_inverse=True)
            column = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first))
            sets = [s for part in tb.text_slices(column) for s in shingles(part, rule.k)]
            left, right = np.split(back, 2)
            good = [rule.linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
            keep = np.array(good, bool)
            yield _batch("a b", sigs[0][keep], sigs[1][keep])

    return whole.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart; from now on they are not."""
        ends = []
        for x in (i, j):
            while (y := self.up.get(x, x)) != x:
                self.up[x] = x = self.up.get(y, y)
            ends.append(x)
        self.up[ends[0]] = ends[1]
        return ends[0] != ends[1]


def near_pairs(sig: np.ndarray, group: np.ndarray, size: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, rule: Rule, forest: bool) -> list[tuple[int, int]]:
    """Pairs from ``left`` and ``right`` of different groups that pass by size and sketch, or a forest of them."""
    found, joined = [], _Forest()
    same = len(left) == len(right) and (left == right).all()
    for i in left.tolist():
        others = right[right > i] if same else right
        others = others[group[others] != group[i]]
        apart = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64)
        near = apart <= (size[i] + size[others]) * (100 - rule.percent) // (100 + rule.percent)
        near &= 100 * np.minimum(size[i], size[others]) >= rule.percent * np.maximum(size[i], size[others])
        found += zip(apart[near].tolist(), [i] * int(near.sum()), others[near].tolist(), strict=True)
    if forest:
        found = [x for x in sorted(found) if joined.join(int(group[x[1]]), int(group[x[2]]))]
    return [(min(a, b), max(a, b)) for a, b in ((int(sig[i]), int(sig[j])) for _, i, j in found)]


def _across(members: DataFrame, nodes: DataFrame, rule: Rule, forest: bool) -> DataFrame:
    """Pairs (key, a, b) of members (key, sig, group) of one key and different groups that pass by sketch."""
    mixed = members.groupBy("key").agg(F.count("*").alias("m"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low != high")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    rows = rows.join(nodes.select("sig", "n_shingles", "sketch"), "sig")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    dealt = rows.select("key", F.explode(cells).alias("cell"), "own", "sig", "group", "n_shingles", "sketch").select("key", "cell.i", "cell.j", "own", "sig", "group", "n_shingles", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def test(rows: pa.Table) -> pa.RecordBatch:
        own, sig, group, size = (rows.column(c).to_numpy() for c in ("own", "sig", "group", "n_shingles"))
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(own), DENSE_WORDS)
        left, right = np.flatnonzero(own == rows.column("i")[0].as_py()), np.flatnonzero(own == rows.column("j")[0].as_py())
        found = near_pairs(sig, group, size, sketch, left, right, rule, forest)
        return _batch("key a b", np.full(len(found), rows.column("key")[0].as_py(), np.int64), *np.array(found, np.int64).reshape(-1, 2).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            cell = np.stack([b.column(i).to_numpy() for i in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1, [b.num_rows]]) if b.num_rows else [0]
            for x, z in zip(cuts[:-1], cuts[1:], strict=True):
                if now != (now := tuple(cell[:, x].tolist())) and held:
                    yield test(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(x, z - x))
        if held:
            yield test(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "key long, a long, b long")


def _row_key(doc_id: str, *more) -> list:
    """Columns without nulls that tell rows of different ids apart."""
    return [F.col(doc_id).isNull().alias("nul"), F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("idk"), *more]


class Classes(NamedTuple):
    sized: DataFrame  # doc_id, tsig, sig, n_shingles, sketch of every row
    classes: DataFrame  # sig, root of every set that is not empty
    nodes: DataFrame  # sig, n_shingles, sketch, first, rep (nul, idk, tsig) of every set that is not empty


@scratch
def _classes(docs: DataFrame, rule: Rule) -> Classes:
    sized = stored(_sized(docs, rule), "sizes")
    row = F.struct(*_row_key("doc_id", F.col("tsig")))
    nodes = sized.filter("n_shingles > 0").groupBy("sig").agg(F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch"), F.min("doc_id").alias("first"), F.min(row).alias("rep"))
    nodes = stored(nodes, "nodes")
    met = stored(_met(docs, rule), "met")
    pairs = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "pairs")
    tried = stored(_tested(pairs, nodes, rule), "tried")
    links = [stored(_linked(tried, nodes, docs, rule), "links")]
    members = met.filter("key is not null")
    if not members.isEmpty():
        # the sets linked with a key's first set are one group, any other is its own
        direct = links[0].select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links[0].select(F.col("b").alias("x"), F.col("a").alias("y")))
        near = members.join(direct, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
        members = stored(near.select("key", F.col("b").alias("sig"), F.when(F.col("x").isNotNull() | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("b")).alias("group")), "members")
        found = stored(_across(members, nodes, rule, forest=True), "found")
        links.append(stored(_linked(stored(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs"), nodes, docs, rule), "links"))
        # where all of a forest holds, its key has no other components; elsewhere every pair of components is verified
        failed = found.join(links[0].unionByName(links[1]), ["a", "b"], "left_anti").select("key").distinct()
        members = stored(members.join(failed, "key", "left_semi").select("key", "sig"), "members")
        if not members.isEmpty():
            roots = components(links[0].unionByName(links[1]))
            members = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("group", F.coalesce("root", "sig"))
            rest = _across(members, nodes, rule, forest=False).select("a", "b").distinct()
            links.append(stored(_linked(stored(rest.join(tried.unionByName(found.select("a", "b")), ["a", "b"], "left_anti"), "pairs"), nodes, docs, rule), "links"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    roots = components(every)
    return Classes(sized, stored(nodes.select("sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root")), "classes"), nodes)


@scratch
def join(df: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of df."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sized, classes, nodes = _classes(docs, rule)
    named = classes.join(nodes.select("sig", "first"), "sig")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("sig", "component_id")
    alone = sized.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    linked = spread_join(sized.filter("n_shingles > 0").select("doc_id", "n_shingles", "sig"), named, "sig")
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))


@scratch
def keep_first(df: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df of each component, that of the least doc_id (rows without an id come last).

    Of different texts that share this id the one of least hash stays, and of equal rows one.  Rows
    with an empty set are linked with nothing and all stay.
    """
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    docs = rows.select(F.col(names[doc_id]).cast("long").alias("doc_id"), F.col(names[text]).cast("string").alias("text"))
    _, classes, nodes = _classes(docs, rule)
    kept = classes.join(nodes.select("sig", "rep"), "sig").groupBy("root").agg(F.min("rep").alias("rep")).select("rep.*")
    tsig = F.xxhash64(F.col(names[text]).cast("string")).alias("tsig")
    keyed = rows.select(*_row_key(names[doc_id], tsig), *names.values())
    one = keyed.join(kept, ["nul", "idk", "tsig"], "left_semi").dropDuplicates(["nul", "idk", "tsig"])
    blank = ~F.coalesce(F.col(names[text]).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = one.unionByName(keyed.filter(blank))
    return whole.select(*names.values()).toDF(*df.columns)
