"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``PASSAGE`` words, and passages are TF-IDF vectors over the words of
the benchmark.  A randomised SVD of all passages is computed where they lie: each task multiplies
its rows by a random matrix and back (``A'(A R)``), partial products are summed by a shuffle over
blocks of features, and the small rest, features by ``RANK``, is solved on the driver.  Overlapping
windows of every text and all items are projected onto the leading singular vectors; pairs of
cosine ``CANDIDATE`` or more that share enough words are candidates.  A candidate counts if it has
``RUN`` words of the item in one piece, or if the longest common subsequence of its words with the
item is long: ``strong`` by itself, or ``needed`` with half of the item's answer, its last ``ANSWER``
words.  So a copy that is cut anywhere and a paraphrase that keeps most words in order are caught and
a passage on the same subject is not.

The benchmark is the stated query set.  It is handled in blocks of about ``ITEMS`` items, and what
is broadcast is bounded by a block's words.  Words and statistics cover all documents.

Items of fewer than ``LEAST_WORDS`` words are matched exactly and whatever their cosine: their words must
follow each other in a text, and an item of fewer than ``CONTAINED`` words must be all of it.

Defined results for odd input: null or empty texts and items match nothing; rows that share a doc_id
are searched one by one and reported once (``keep_clean`` decides row by row, also without an id);
equal items are each reported; an empty table of either kind gives an empty table; extra columns are
ignored (``keep_clean`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbytes as tb
from parley.llm.storage import stored

PASSAGE = 32
STEP = 16
RANK = 40
CANDIDATE = 0.15
ANSWER = 6
RUN = 13
LEAST_WORDS = 8
CONTAINED = 4
ITEMS = 500
FEATURE_BLOCK = 256
CHUNK = 4096


class Item(NamedTuple):
    item_id: int
    words: np.ndarray  # features, 1 and up


class Queries(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; feature f is vocabulary[f - 1], 0 is any other word
    items: list[Item]


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for docs in tb.text_slices(texts):
        w = tb.words(docs, tb.ALNUM, tb.LOWER)
        yield docs.first, w.hash, w.bounds


def read_queries(rows: list[tuple[int, str | None]]) -> Queries:
    found = []
    for first, h, bounds in _word_hashes(pa.array([t for _, t in rows], pa.string())):
        found += [(rows[first + i][0], h[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    found = [(i, h) for i, h in found if len(h)]
    vocabulary = np.unique(np.concatenate([h for _, h in found])) if found else np.zeros(0, np.uint64)
    return Queries(vocabulary, [Item(i, np.searchsorted(vocabulary, h) + 1) for i, h in found])


def _features(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[k] == h, k + 1, 0).astype(np.uint16 if len(vocabulary) < 65535 else np.uint32)


def _encoded(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id and the features of all its words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a first look at 16 bits of the hash settles most words that are in no item
        near = np.zeros(1 << 16, bool)
        near[(queries.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        kind = np.uint16 if len(queries.vocabulary) < 65535 else np.uint32
        for b in batches:
            for first, h, bounds in _word_hashes(b.column(1)):
                f = np.zeros(len(h), kind)
                maybe = np.flatnonzero(near[(h >> np.uint64(48)).astype(np.int64)])
                f[maybe] = _features(h[maybe], queries.vocabulary)
                packed = [f[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first : first + len(packed)], pa.array(packed, pa.binary())], names=["doc_id", "words"])

    return docs.mapInArrow(run, "doc_id long, words binary")


def _passages(column: pa.Array, wide: bool, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of features, ``size`` words a row (0 after a text's end), and each row's text."""
    words = [np.frombuffer(x, np.uint32 if wide else np.uint16) for x in column.to_pylist()]
    at = 0
    while at < len(words):
        end, rows = at, 0
        while end < len(words) and rows < CHUNK:
            rows += -(-len(words[end]) // size)
            end += 1
        counts = np.array([-(-len(x) // size) for x in words[at:end]])
        out = np.zeros((rows, size), np.int32)
        flat = out.ravel()
        for x, start in zip(words[at:end], (np.cumsum(counts) - counts) * size, strict=True):
            flat[start : start + len(x)] = x
        yield out, np.repeat(np.arange(at, end), counts)
        at = end


def _summed(partial: DataFrame) -> dict[int, np.ndarray]:
    """Sum vectors by key in the cluster; the keys are blocks of features, so few rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.float64)
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    out = partial.repartition("block").mapInArrow(run, "block int, sums binary")
    return {r["block"]: np.frombuffer(r["sums"], np.float64) for r in out.toLocalIterator()}


def _frequencies(encoded: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """In how many passages each feature stands, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 2)
        for b in batches:
            for m, _ in _passages(b.column(0), n >= 65535, PASSAGE):
                s = np.sort(m, axis=1)
                fresh = np.ones(s.shape, bool)
                fresh[:, 1:] = s[:, 1:] != s[:, :-1]
                total[: n + 1] += np.bincount(s[fresh], minlength=n + 1)
                total[n + 1] += len(m)
        blocks = range(0, n + 2, FEATURE_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // FEATURE_BLOCK for a in blocks], pa.int32()), pa.array([total[a : a + FEATURE_BLOCK].tobytes() for a in blocks], pa.binary())], names=["block", "sums"])

    got = _summed(encoded.select("words").mapInArrow(run, "block int, sums binary"))
    flat = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(n + 2)
    return flat[: n + 1], int(flat[n + 1])


def _sketch(encoded: DataFrame, weight: np.ndarray, random: np.ndarray) -> np.ndarray:
    """A' (A R) for the TF-IDF matrix A of all passages."""
    n, shared = len(weight) - 1, encoded.sparkSession.sparkContext.broadcast((weight, random))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, random = shared.value
        scaled = (weight[:, None] * random).astype(np.float32)
        total = np.zeros((n + 1, random.shape[1]))
        for b in batches:
            for m, _ in _passages(b.column(0), n >= 65535, PASSAGE):
                y = np.zeros((len(m), random.shape[1]), np.float32)
                for k in range(PASSAGE):
                    y += scaled[m[:, k]]
                flat = m.ravel()
                order = np.argsort(flat, kind="stable")
                order = order[np.searchsorted(flat[order], 1) :]
                f = flat[order]
                if len(f):
                    starts = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                    total[f[starts]] += np.add.reduceat(y[order // PASSAGE], starts, axis=0)
        total *= weight[:, None]
        blocks = range(0, n + 1, FEATURE_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // FEATURE_BLOCK for a in blocks], pa.int32()), pa.array([total[a : a + FEATURE_BLOCK].tobytes() for a in blocks], pa.binary())], names=["block", "sums"])

    got = _summed(encoded.select("words").mapInArrow(run, "block int, sums binary"))
    return np.concatenate([got[k] for k in sorted(got)]).reshape(n + 1, -1) if got else np.zeros((n + 1, random.shape[1]))


def leading_vectors(sketch: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A from ``A'A R``."""
    q, r = np.linalg.qr(sketch)
    middle = random.T @ sketch
    core = r @ np.linalg.pinv((middle + middle.T) / 2, rcond=1e-10, hermitian=True) @ r.T
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; 0 matches nothing."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    where.pop(0, None)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def needed(length: int) -> int:
    """Words of an item that a text must have in order; short items need nearly all of theirs."""
    return min(length, -(-(6 * length) // 10) + 2)


def strong(length: int) -> int:
    """Words of an item in order that need no answer beside them."""
    return min(length, -(-(13 * length) // 20) + 2)


def has_run(item: list[int], window: list[int]) -> bool:
    """Whether ``RUN`` words of the item follow each other in the window."""
    runs = {tuple(item[i : i + RUN]) for i in range(len(item) - RUN + 1)}
    return any(tuple(window[i : i + RUN]) in runs for i in range(len(window) - RUN + 1)) if runs else False


def holds_short(item: list[int], window: list[int], words: int) -> bool:
    """Whether a short item stands in the window as it is, or is all of a text of so many words."""
    if len(item) < CONTAINED and len(item) != words:
        return False
    return any(window[i : i + len(item)] == item for i in range(len(window) - len(item) + 1))


def is_match(item: list[int], window: list[int], words: int = 0) -> int:
    """The length of the common subsequence if the window holds the item or enough of it, else 0.

    ``words`` is the number of words of the whole text.
    """
    if len(item) < LEAST_WORDS:
        return len(item) if holds_short(item, window, words) else 0
    common = lcs_length(item, window)
    answer = item[-ANSWER:]
    if common >= strong(len(item)) or common >= needed(len(item)) and 2 * lcs_length(answer, window) >= len(answer):
        return common
    return common if common >= RUN and has_run(item, window) else 0


def _masks(lists: list[list[int]], n: int) -> np.ndarray:
    """For each item of at most 64 words and each feature, the item's places that hold it, as bits."""
    out = np.zeros((len(lists), n + 1), np.uint64)
    for k, words in enumerate(lists):
        if len(words) <= 64:
            for i, x in enumerate(words):
                out[k, x] |= np.uint64(1 << i)
    return out


def _matches(m: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, size: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """``is_match`` of the items, of at most 64 words each, with rows begin to end of m, many at once."""
    one = np.uint64(1)
    full = ~np.uint64(0) >> (64 - size).astype(np.uint64)
    tail = np.minimum(size, ANSWER)
    shift = (size - tail).astype(np.uint64)
    tail_full = (one << tail.astype(np.uint64)) - one
    v, w = full.copy(), tail_full.copy()
    run = np.zeros(len(item), bool)
    nothing = np.zeros(len(item), np.uint64)
    # places where the last 1, 2, 4 and 8 words end in the item; the oldest comes first
    ends1, ends2, ends4, ends8 = [nothing], [nothing] * 2, [nothing] * 4, [nothing] * (RUN - 8)
    for c in range(int((end - begin).max()) if len(item) else 0):
        row = np.minimum(begin + c, len(m) - 1)
        inside = begin + c < end
        for k in range(m.shape[1]):
            at = np.where(inside, masks[item, m[row, k]], np.uint64(0))
            u = v & at
            v = ((v + u) | (v - u)) & full
            u = w & (at >> shift)
            w = ((w + u) | (w - u)) & tail_full
            two = at & (ends1.pop(0) << one)
            four = two & (ends2.pop(0) << np.uint64(2))
            eight = four & (ends4.pop(0) << np.uint64(4))
            run |= (eight & (ends8.pop(0) << np.uint64(RUN - 8))) != 0
            ends1.append(at)
            ends2.append(two)
            ends4.append(four)
            ends8.append(eight)
    common = size - np.bitwise_count(v).astype(np.int64)
    answered = 2 * (tail - np.bitwise_count(w).astype(np.int64)) >= tail
    least = np.array([[needed(x), strong(x)] for x in range(65)])[size]
    return np.where(run | (common >= least[:, 1]) | (common >= least[:, 0]) & answered, common, 0)


HITS = "doc_id long, item_id long, position long, lcs_words long, item_words long, cosine double"


def _search(encoded: DataFrame, queries: Queries, weight: np.ndarray, basis: np.ndarray) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast((queries.items, weight, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, basis = shared.value
        n = len(weight) - 1
        scaled = (weight[:, None] * basis).astype(np.float32)
        scaled[0] = 0
        lists = [i.words.tolist() for i in items]
        size = np.array([len(x) for x in lists])
        latent = np.stack([scaled[i.words].sum(0) for i in items])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        member = np.zeros((n + 1, len(items)), np.int8)
        for k, i in enumerate(items):
            member[i.words, k] = 1
        masks = _masks(lists, n)
        # some window holds this many words of an item that matches, since windows overlap by half
        short = size < LEAST_WORDS
        distinct = np.array([len(set(x)) for x in lists])
        enough = np.where(short, distinct, 11 * np.minimum(size, PASSAGE - STEP // 2) // 20).astype(np.int8)
        for b in batches:
            rows: list[tuple] = []
            ids = b.column(0).to_pylist()
            length = pc.binary_length(b.column(1)).to_numpy() // (4 if n >= 65535 else 2)
            for m, owner in _passages(b.column(1), n >= 65535, STEP):
                half = np.zeros((len(m), scaled.shape[1]), np.float32)
                for k in range(STEP):
                    half += scaled[m[:, k]]
                y = half.copy()
                joined = np.zeros(len(owner), bool)
                joined[:-1] = owner[1:] == owner[:-1]
                y[joined] += half[1:][joined[:-1]]
                inside = np.zeros((len(m), len(items)), np.int8)
                for k in range(STEP):
                    inside += member[m[:, k]]
                both = inside.copy()
                both[joined] += inside[1:][joined[:-1]]
                passage, item = np.nonzero(both >= enough)
                y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                cosine = np.einsum("ij,ij->i", y[passage], latent[item])
                near = (cosine >= CANDIDATE) | short[item]
                passage, item, cosine = passage[near], item[near], cosine[near]
                first = np.searchsorted(owner, owner)
                last = np.searchsorted(owner, owner, "right")
                reach = -(-size[item] // STEP) + 1
                begin, end = np.maximum(first[passage], passage - reach), np.minimum(last[passage], passage + 2 + reach)
                found, middle = np.zeros(len(item), np.int64), np.flatnonzero((size[item] <= 64) & ~short[item])
                for at in np.split(middle, range(CHUNK, len(middle), CHUNK)):
                    found[at] = _matches(m, begin[at], end[at], item[at], size[item[at]], masks)
                for j in np.flatnonzero((size[item] > 64) | short[item]):
                    found[j] = is_match(lists[item[j]], m[begin[j] : end[j]].ravel().tolist(), length[owner[passage[j]]])
                true = np.flatnonzero(found)
                for p, k, c, common in zip(passage[true].tolist(), item[true].tolist(), cosine[true].tolist(), found[true].tolist(), strict=True):
                    rows.append((ids[owner[p]], items[k].item_id, int(p - first[p]) * STEP, common, len(lists[k]), c))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.float64()], strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

    return encoded.mapInArrow(run, HITS)


def _block(docs: DataFrame, rows: list[tuple[int, str | None]]) -> DataFrame | None:
    queries = read_queries(rows)
    if not queries.items:
        return None
    n = len(queries.vocabulary)
    encoded = stored(_encoded(docs, queries), "features")
    df, passages = _frequencies(encoded, n)
    weight = np.log((1 + passages) / (1 + df))
    weight[0] = 0
    rank = min(RANK, n)
    random = np.random.default_rng(11).normal(size=(n + 1, min(n, RANK + 8)))
    basis = leading_vectors(_sketch(encoded, weight, random), random, rank)
    return _search(encoded, queries, weight, basis)


def hits(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it, with the place of the best match."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // ITEMS))
    found = None
    for k in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        part = _block(docs, rows)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], HITS)
    best = F.max(F.struct("lcs_words", "cosine", (-F.col("position")).alias("back"), "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.back")).alias("position"), "b.lcs_words", "b.item_words", "b.cosine")


def keep_clean(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose text has no hit; rows are told apart by id and text, so each is judged by its own."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = rows.withColumn("row", F.xxhash64(F.col(names[doc_id]).cast("long"), F.col(names[text]).cast("string")))
    bad = hits(rows, benchmark, "row", names[text]).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(bad, "row", "left_anti").select(*names.values()).toDF(*df.columns)


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """For tests: all pairs whose texts pass ``is_match`` anywhere, without the latent search."""
    queries = read_queries(items)
    out = set()
    for first, h, bounds in _word_hashes(pa.array([t for _, t in docs], pa.string())):
        for i in range(len(bounds) - 1):
            f = _features(h[bounds[i] : bounds[i + 1]], queries.vocabulary).tolist() if len(queries.vocabulary) else []
            for item in queries.items:
                words, reach = item.words.tolist(), -(-len(item.words) // STEP) + 1
                for p in range(0, len(f), STEP):
                    if is_match(words, f[max(0, p - reach * STEP) : p + (2 + reach) * STEP], len(f)):
                        out.add((docs[first + i][0], item.item_id))
                        break
    return out
