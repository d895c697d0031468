"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

Documents are tokenised once for each block of items and kept as a forward index: the terms of each
document that some item of the block has, with their counts.  Counts of documents and terms are taken
over all of it.  The forward index is then read in shards of at most ``SHARD`` postings.  A shard is
turned into one list for each term, sorted by impact, and answers every item by Fagin's threshold
algorithm: its lists are read side by side, ``STRIDE`` entries at a time, every document met is scored
in full from the forward index, and the reading stops when the sum of the impacts last read, which
no document still unseen can exceed, falls strictly below the k-th best score.  Equal scores are ranked by
id, so reading goes on while the two are equal.  The best of one shard are the k-th score that the next
shard of the task begins with; the best of all tasks are merged in two steps of a ranked top k.

Terms are found by hash and compared byte by byte.  Only the terms of a block go to the tasks; a block ends
at ``ITEMS`` items or ``BLOCK_BYTES`` bytes of text (one item may be longer).

Defined results for odd input: a null, empty or termless text of an item finds nothing, such a
document is not counted and never found; a null doc_id is ranked before others of its score; equal rows
are ranked one by one; equal rows of items count once; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import textbytes as tb
from parley.llm.storage import scratch, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
ITEMS = 2000
BLOCK_BYTES = 4 << 20
SHARD = 2_000_000
STRIDE = 64
SALTS = 64
NO_ID = -(1 << 63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Terms:
    """The different terms of a block of items, found in documents by hash and then by their bytes."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        split = [re.findall(TERM, text.translate({ord(c): c.lower() for c in UPPER})) if text else [] for _, text in items]
        self.words = sorted({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(self.words)}
        self.items = [(item, np.array(sorted({number[w] for w in ws}), np.int64)) for (item, _), ws in zip(items, split, strict=True)]
        docs = next(tb.text_slices(pa.array(self.words, pa.large_string()), 1 << 62), None)
        if docs is None:
            self.hash = np.zeros(0, np.uint64)
            return
        w = tb.words(docs, tb.ALNUM, tb.LOWER)
        self.order = np.argsort(w.hash, kind="stable")
        self.hash, self.data, self.start, self.size = w.hash[self.order], docs.data, w.start, w.end - w.start

    def find(self, data: np.ndarray, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms, and which."""
        k = np.searchsorted(self.hash, w.hash)
        k[k == len(self.hash)] = 0
        at = np.flatnonzero(self.hash[k] == w.hash) if len(self.hash) else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        term = self.order[k[at]]
        size = w.end[at] - w.start[at]
        same = size == self.size[term]
        at, term, size = at[same], term[same], size[same]
        if not len(at):
            return at, at
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        differ = tb.LOWER[data[np.repeat(w.start[at], size) + inside]] != self.data[np.repeat(self.start[term], size) + inside]
        same = np.add.reduceat(differ, ends - size) == 0
        return at[same], term[same]


def _count(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    """For each document its number of terms, and those of the block with their counts."""
    for b in batches:
        for docs in tb.text_slices(b.column(1)):
            w = tb.words(docs, tb.ALNUM, tb.LOWER)
            at, term = terms.find(docs.data, w)
            pairs, tf = np.unique(w.doc[at] * (len(terms.words) + 1) + term, return_counts=True)
            cuts = np.searchsorted(pairs // (len(terms.words) + 1), np.arange(len(docs) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (pairs % (len(terms.words) + 1), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(docs.first, len(docs)), pa.array(np.diff(w.bounds)), *lists], names=["doc_id", "n", "terms", "tfs"])


class Shard(NamedTuple):
    """Documents with their postings, by document (``first``, ``term``, ``impact``) and by term in order of impact."""

    ids: np.ndarray
    first: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    lists: np.ndarray  # postings by term, highest impact first
    begin: np.ndarray
    doc: np.ndarray

    @classmethod
    def make(cls, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> Shard:
        lists = np.lexsort((-impact, term))
        begin = np.searchsorted(term[lists], np.arange(n_terms + 1))
        return cls(ids, np.concatenate([[0], np.cumsum(sizes)]), term, impact, lists, begin, np.repeat(np.arange(len(ids)), sizes))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The full scores of documents, looked up in the forward index; ``asked`` is true for the item's terms."""
        n = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(n)
        at = np.repeat(self.first[docs] - ends + n, n) + np.arange(ends[-1])
        return np.add.reduceat(np.where(asked[self.term[at]], self.impact[at], 0), ends - n)

    def best(self, terms: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best of ``held`` and this shard, and the number of documents looked up."""
        ids, scores = held
        asked = np.zeros(len(self.begin) - 1, bool)
        asked[terms] = True
        at, end = self.begin[terms], self.begin[terms + 1]
        at, end = at[at < end], end[at < end]
        seen, looked = np.zeros(len(self.ids), bool), 0
        bound = int(self.impact[self.lists[at]].sum())
        while len(at) and bound > 0 and (len(scores) < k or bound >= scores[k - 1]):
            # a round-robin stride: the next entries of every list
            n = np.minimum(end - at, stride)
            ends = np.cumsum(n)
            docs = np.unique(self.doc[self.lists[np.repeat(at - ends + n, n) + np.arange(ends[-1])]])
            docs = docs[~seen[docs]]
            seen[docs] = True
            if len(docs):
                looked += len(docs)
                found = self.scores(docs, asked)
                if len(scores) >= k:
                    better = found >= scores[k - 1]
                    docs, found = docs[better], found[better]
                ids, scores = np.concatenate([ids, self.ids[docs]]), np.concatenate([scores, found])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            last = self.impact[self.lists[at + n - 1]]
            at = at + n
            more = at < end  # a list read to its end can't add to an unseen document
            bound, at, end = int(last[more].sum()), at[more], end[more]
        return ids, scores, looked


def _search(batches: Iterator[pa.RecordBatch], terms: Terms, weight: np.ndarray, k: int, most: int, stride: int) -> Iterator[pa.RecordBatch]:
    """The best k of each item among the documents of one task, shard after shard."""
    none = np.zeros(0, np.int64)
    held = [(none, none) for _ in terms.items]
    parts: list[tuple] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        ids, m, sizes, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        tf = tf.astype(np.int64)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
        some = impact > 0
        sizes = np.add.reduceat(some, np.cumsum(sizes) - sizes) if len(sizes) else sizes
        used = sizes > 0
        shard = Shard.make(ids[used], sizes[used], term[some], impact[some], len(weight))
        for i, (_, wanted) in enumerate(terms.items):
            ids, scores, _ = shard.best(wanted, k, held[i], stride)
            held[i] = ids, scores
        parts.clear()
        waiting = 0

    for b in batches:
        sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        some = pa.array(sizes > 0)
        if not sizes.any():
            continue
        ids, m, term, tf = (b.column(i).filter(some) for i in range(4))
        parts.append((ids.fill_null(NO_ID).to_numpy(), m.to_numpy(), sizes[sizes > 0], term.flatten().to_numpy(), tf.flatten().to_numpy()))
        waiting += len(parts[-1][3])
        if waiting >= most:
            flush()
    if parts:
        flush()
    out = [(item, d, s) for (item, _), (ids, scores) in zip(terms.items, held, strict=True) for d, s in zip(ids.tolist(), scores.tolist(), strict=True)]
    columns = zip(*out, strict=True) if out else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")))
    return ranked.filter(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int, shard: int, stride: int) -> DataFrame:
    terms = Terms(items)
    forward = stored(docs.mapInArrow(lambda batches: _count(batches, terms), "doc_id long, n long, terms array<int>, tfs array<int>").filter("n > 0"), "forward-index")
    count, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a row for each term of the block
    df = dict(map(tuple, forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
    weights = docs.sparkSession.createDataFrame([(t, count, df.get(t, 0)) for t in range(len(terms.words))], "t int, all long, df long").select("t", F.floor(1000 * F.log((2 * F.col("all") + 2) / (2 * F.col("df") + 1))).alias("w"))
    weight = np.zeros(len(terms.words), np.int64)
    for t, w in weights.collect():
        weight[t] = w
    # wider than 64 bits on the way
    longer = F.expr(f"cast(10 + (cast(90 * n as decimal(38, 0)) * {count}) div {max(total, 1)} as bigint)")
    found = forward.select("doc_id", longer.alias("m"), "terms", "tfs").mapInArrow(lambda batches: _search(batches, terms, weight, k, shard, stride), "item_id long, doc_id long, score long")
    some = _best(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), k, "item_id", "salt").drop("salt", "rank")
    return _best(some, k, "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len(row[1] or "")
        if block and (len(block) == ITEMS or size + n > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    if block:
        yield block


@scratch
def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, stride: int = STRIDE) -> DataFrame:
    """The ``k`` best documents of every item (item_id, text): item_id, rank, doc_id, score."""
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()):
        part = _block(picked, block, k, shard, stride)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def oracle_sql(docs: str = "documents", items: str = "benchmark", k: int = K) -> str:
    """The rows of ``search`` in DuckDB's SQL."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')"
    return f"""
with d as (select row_number() over () r, doc_id, {words} ws from {docs}),
s as (select count(*) n_docs, sum(len(ws)) n_terms from d where len(ws) > 0),
p as (select r, term, count(*) tf from (select r, unnest(ws) term from d) group by r, term),
q as (select distinct item_id, term from (select item_id, unnest({words}) term from {items})),
f as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) w from p, s where term in (select term from q) group by term, n_docs),
m as (select r, doc_id, 10 + (90 * len(ws) * n_docs) // n_terms m from d, s where len(ws) > 0),
t as (select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join p using (term) join f using (term) join m using (r) group by item_id, r),
o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) rank from t join m using (r) where score > 0)
select item_id, rank::int rank, doc_id, score from o where rank <= {k}"""
