"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and a stretch of many words without a sentence end also at words whose
hash is the least of the ``NEAR`` words on either side, so that the cuts inside a repeated passage
agree however its sentences begin and end, and at every ``SAME``-th repetition of one word.  Runs of pieces that are long enough (``LONG_ENOUGH``:
three pieces of 12 words, two of 20, one of 25) are hashed, and the hashes are joined over all
documents.  Of each run that occurs more than once the first occurrence (by doc_id, then text digest,
then place) stays; a piece covered by any other occurrence goes.

Runs of every length count, but only those are hashed that are no longer long enough without their
last piece, or without their first: a longer repeated run is covered by these, from its first piece
on by the former and up to its last by the latter.

Hashes are counted with partial aggregation, so a run that a third of all documents hold is a few
rows by the time it is shuffled; only the runs found repeated are joined back to their places.
Shorter runs are not compared by themselves: they repeat by chance.

Defined results for odd input: a null or empty text has no sentences and is kept as an empty
text; a text of fewer than ``SPAN`` pieces is one run if it has ``LEAST_WORDS``; rows with the
same doc_id and text count as one document, so neither removes from the other; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbytes as tb
from parley.llm.storage import drop, scratch, spread_join, stored

SPAN = 3
LEAST_WORDS = 12
#: Pieces and words from which on a run is compared; either more pieces or fewer with more words.
LONG_ENOUGH = ((SPAN, LEAST_WORDS), (2, 20), (1, 25))
NEAR = 6
#: A word that only repeats itself has no least one: it is cut after so many repetitions.
SAME = 16
_STOPS = tb.byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


def _order(h: np.ndarray) -> np.ndarray:
    """A value from each word and the word before it, above 0."""
    out = h.copy()
    out[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    return tb.mix(out) | np.uint64(1)


def _inner_cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words of least value among their ``NEAR`` neighbours; sentence starts and ends are lower still."""
    value = np.append(np.where(first, np.uint64(0), _order(h)), np.zeros(NEAR, np.uint64))
    at = np.flatnonzero(value)
    at = at[(at >= NEAR) & (at < len(h))]
    for d in range(1, NEAR + 1):
        at = at[(value[at] < value[at - d]) & (value[at] <= value[at + d])]
    fresh = first.copy()
    fresh[1:] |= h[1:] != h[:-1]
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    out = (place > 0) & (place % SAME == 0)
    out[at] = True
    return out


def sentences(docs: tb.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin byte, end byte (next begin), hash of the words and number of words of each piece.

    A sentence ends after a stop that is followed by a blank, or at a line feed, and takes the
    blanks after it; one without words belongs to the sentence before it.
    """
    w = tb.words(docs, tb.NOT_BLANK, tb.LOWER)
    if not len(w.start):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    lines = np.concatenate([[0], np.cumsum(docs.data == 10)])
    first = np.zeros(len(w.start), bool)
    first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    first[1:] |= _STOPS[docs.data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
    first |= _inner_cuts(w.hash, first)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(w.start)))
    place = np.arange(len(w.start)) - np.repeat(at, size)
    mixed = tb.mix(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    owner = np.searchsorted(w.bounds, at, "right") - 1
    begin = w.start[at]
    new = np.append(True, owner[1:] != owner[:-1])
    begin[new] = docs.offsets[:-1][owner[new]]
    end = np.append(begin[1:], len(docs.data))
    end = np.minimum(end, docs.offsets[1:][owner])
    return begin, end, tb.mix(np.add.reduceat(mixed, at) + size.astype(np.uint64)), size


def _runs(docs: tb.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place (first piece and number of pieces) and hash of every run that is compared."""
    begin, _, h, size = sentences(docs)
    owner = np.searchsorted(docs.offsets, begin, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    n, end = len(h), bounds[1:][owner]
    total, words = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    enough = np.zeros(n + 1, bool)  # with one piece less
    starts, lengths, hashes = [], [], []
    at, k = np.arange(n), 0
    while len(at):
        total[at] += tb.mix(h[at + k] + np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        words[at] += size[at + k]
        k += 1
        long = np.zeros(len(at), bool)
        for pieces, least in LONG_ENOUGH:
            if k >= pieces:
                long |= words[at] >= least
        # a whole text of few pieces is compared as it is
        whole = (k < SPAN) & (at == bounds[:-1][owner[at]]) & (at + k == end[at]) & (words[at] >= LEAST_WORDS)
        take = long & ~(enough[at] & enough[at + 1]) | whole & ~long
        starts.append(at[take])
        lengths.append(np.full(take.sum(), k))
        hashes.append(tb.mix(total[at[take]] + np.uint64(k)))
        enough[at[long]] = True
        at = at[(at + k < end[at]) & ~(enough[at] & enough[at + 1])]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    return owner[start], (start - bounds[:-1][owner[start]]) * LEAST_WORDS + np.concatenate(lengths) - 1, np.concatenate(hashes).astype(np.int64)


def _places(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.text_slices(b.column(2)):
                owner, place, h = _runs(part)
                order = np.argsort(owner, kind="stable")
                rows = b.select([0, 1]).slice(part.first, len(part)).take(pa.array(owner[order]))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(place[order].astype(np.int32)), pa.array(h[order])], names=["doc_id", "sig", "place", "hash"])

    return docs.mapInArrow(run, "doc_id long, sig long, place int, hash long")


@scratch
def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, sig and the sorted places of each document's non-first repeated runs."""
    places = stored(_places(docs), "runs")
    at = F.struct("doc_id", "sig", "place")
    many = stored(places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "run-counts")
    found = stored(spread_join(places, many.select("hash"), "hash", many), "repeated-runs")
    drop(places)
    first = found.groupBy("hash").agg(F.min(at).alias("first"))
    later = spread_join(found, first, "hash", many).filter(at != F.col("first"))
    cut = later.select("doc_id", "sig", "place").distinct().groupBy("doc_id", "sig").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return stored(cut, "repeated-places")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, text without its repeated pieces, and the counts of both."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("sig"), "text")
    found = repeated(docs).select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), "places")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sig") == F.col("__sig")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.text_slices(b.column(1)):
                yield _cut(part, b.slice(part.first, len(part)))

    return joined.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long, n_spans long, n_bytes long, n_removed_bytes long")


def _cut(docs: tb.Docs, rows: pa.RecordBatch) -> pa.RecordBatch:
    begin, end, _, _ = sentences(docs)
    owner = np.searchsorted(docs.offsets, begin, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    raw, texts, figures = docs.data.tobytes(), [], np.zeros((5, len(docs)), np.int64)
    for i, places in enumerate(rows.column(2).to_pylist()):
        a, z = bounds[i], bounds[i + 1]
        whole = raw[docs.offsets[i] : docs.offsets[i + 1]]
        figures[0, i], figures[3, i] = z - a, len(whole)
        if places:
            gone = np.zeros(z - a, bool)
            for p in places:
                gone[p // LEAST_WORDS : p // LEAST_WORDS + p % LEAST_WORDS + 1] = True
            whole = b"".join(raw[begin[j] : end[j]] for j in range(a, z) if not gone[j - a])
            figures[1, i], figures[2, i] = gone.sum(), gone[0] + (gone[1:] & ~gone[:-1]).sum()
        figures[4, i] = figures[3, i] - len(whole)
        texts.append(whole.decode())
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), *map(pa.array, figures)], names=["doc_id", "text", "n_sentences", "n_removed", "n_spans", "n_bytes", "n_removed_bytes"])


def brute(docs: list[tuple[int, str | None]]) -> dict[int, list[bool]]:
    """For tests: by doc_id, whether each piece goes; plain Python, comparing the words of all runs of up to 60 words."""
    import re

    cut = {}
    for i, text in docs:
        words = [(m.group().lower() if m.group().isascii() else m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        first = [not k or words[k - 1][0][-1] in ".!?" or "\n" in text[words[k - 1][2] : a] for k, (_, a, _) in enumerate(words)]
        (part,) = tb.text_slices(pa.array([text or ""]))
        value = [0 if f else v for f, v in zip(first, _order(tb.words(part, tb.NOT_BLANK, tb.LOWER).hash).tolist(), strict=True)] + [0] * NEAR
        parts: list[list[str]] = []
        same = 0
        for k, (w, _, _) in enumerate(words):
            same = 0 if first[k] or w != words[k - 1][0] else same + 1
            if first[k] or same and same % SAME == 0 or value[k] < min(value[max(0, k - NEAR) : k]) and value[k] <= min(value[k + 1 : k + 1 + NEAR]):
                parts.append([])
            parts[-1].append(w)
        cut[i] = parts
    seen, gone = set(), {i: [False] * len(p) for i, p in cut.items()}
    for i in sorted(cut):
        p = cut[i]
        for k in range(len(p)):
            for n in range(1, len(p) - k + 1):
                run, words = tuple(map(tuple, p[k : k + n])), sum(map(len, p[k : k + n]))
                if any(n >= a and words >= b for a, b in LONG_ENOUGH) or n == len(p) < SPAN and words >= LEAST_WORDS:
                    if run in seen:
                        gone[i][k : k + n] = [True] * n
                    seen.add(run)
                if words > 60:
                    break
    return gone


def digest(df: DataFrame) -> DataFrame:
    """The result with the kept text replaced by its sha256."""
    return df.select("doc_id", "n_sentences", "n_removed", "n_spans", "n_bytes", "n_removed_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
