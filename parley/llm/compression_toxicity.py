"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A text is cut at
words into windows of about ``WINDOW`` bytes, and each window is compressed twice: with the ordinary
dictionary, and with the toxic one in front of it.  The bytes that the toxic dictionary saves are
its distance from ordinary text.  A document is judged by its best windows, and a logistic curve
fitted to labelled documents turns the savings into a score; the curve is the calibrated threshold.

The dictionary for toxic text is trained on one sample for each toxic document: the words in it, as
they follow each other, whose distinct contexts set toxic documents apart.  So what toxic documents
share with all others, which the ordinary dictionary explains already, does not fill it.
Learning runs in one task on a bounded sample (``PER_CLASS`` documents of each class); only the two
dictionaries and three numbers come back.  Every whole text is scored on its own row.

Defined results for odd input: a null or empty text has no window and saves nothing; without
labelled rows of both classes every score is the share of label 1 (0 if there are none); a document
labelled both ways is not learned from; repeated
rows are scored one by one; a null doc_id counts as the text 'null' in the fold; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import labelled
from parley.llm import textbytes as tb

WINDOW = 256
DICTIONARY = 2048
PER_CLASS = 1500
#: Search in full: a window is small and so are the dictionaries.
SEARCH = {"window_log": 16, "hash_log": 15, "chain_log": 15, "search_log": 4, "min_match": 5, "target_length": 64, "strategy": 5}
BEST = 2
SHARE, TIMES = 0.01, 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    bias: float
    slopes: tuple[float, ...]


def windows(docs: tb.Docs) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased bytes, where windows begin and end in them, and the windows of each document.

    A window begins at the first word that starts ``WINDOW`` bytes or more after a multiple of
    WINDOW, so every byte of a text is in one window and no word is cut.
    """
    data, n = tb.LOWER[docs.data], len(docs)
    w = tb.NOT_BLANK[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    starts = np.flatnonzero(start)
    first, last = docs.offsets[:-1], docs.offsets[1:]
    owner = np.searchsorted(docs.offsets, starts, "right") - 1
    cell = (starts - first[owner]) // WINDOW
    new = np.ones(len(starts), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])
    begin, owner = starts[new], owner[new]
    end = np.append(begin[1:], len(data))
    end = np.minimum(end, last[owner])
    return data.tobytes(), np.stack([begin, end], 1), np.bincount(owner, minlength=n)


def _coder(dictionary: bytes):
    import zstandard as z

    kept = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    parameters = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
    kept.precompute_compress(compression_params=parameters)
    return z.ZstdCompressor(dict_data=kept, compression_params=parameters)


def _sizes(coder, data: bytes, cuts: np.ndarray) -> np.ndarray:
    import zstandard as z

    if not len(cuts):
        return np.zeros(0, np.int64)
    out = np.empty(len(cuts), np.int64)
    for at in range(0, len(cuts), 50_000):
        part = cuts[at : at + 50_000].copy()
        part[:, 1] -= part[:, 0]
        low = part[0, 0]
        part[:, 0] -= low
        buffers = z.BufferWithSegments(data[low : low + part[-1, 0] + part[-1, 1]], part.astype(np.uint64).tobytes())
        packed = coder.multi_compress_to_buffer(buffers, threads=1)
        out[at : at + len(part)] = [len(packed[i]) for i in range(len(packed))]
    return out


def savings(docs: tb.Docs, ordinary, both) -> np.ndarray:
    """For each document the savings of its ``BEST`` best windows, best first (0 where missing), their sum over all windows, and the logarithm of the number of windows."""
    data, cuts, counts = windows(docs)
    gain = np.maximum(_sizes(ordinary, data, cuts) - _sizes(both, data, cuts), 0)
    owner = np.repeat(np.arange(len(docs)), counts)
    order = np.lexsort((-gain, owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((len(docs), BEST + 2))
    kept = rank < BEST
    out[owner[order][kept], rank[kept]] = gain[order][kept]
    out[:, BEST] = np.bincount(owner, np.maximum(gain - 1, 0), len(docs))
    out[:, BEST + 1] = np.log1p(counts)
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples are used as they are."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, samples, k=32, d=6, steps=1).as_bytes()
    except z.ZstdError:
        return b" ".join(samples) or b" "


def _uses(part: list[tuple[bytes, int]]) -> Counter:
    """In how many contexts each word stands; copies of a passage share theirs and count once."""
    seen = set()
    for s, _ in part:
        words = s.split()
        seen |= set(zip(words, [b"", *words], [*words[1:], b""], strict=False))
    return Counter(w for w, _, _ in seen)


def _telling(foul: list[tuple[bytes, int]], plain: list[tuple[bytes, int]]) -> set[bytes]:
    """The words that set toxic documents apart.

    Such a word has a use for ``SHARE`` of the toxic documents and is ``TIMES`` as frequent there.
    """
    toxic, common = _uses(foul), _uses(plain)
    docs, others = (max(1, len({d for _, d in part})) for part in (foul, plain))
    return {w for w, n in toxic.items() if n >= max(3, SHARE * docs) and n / docs > TIMES * (common[w] + 0.5) / others}


def _residue(foul: list[tuple[bytes, int]], telling: set[bytes]) -> list[bytes]:
    """For each toxic document its telling words in order, as one sample."""
    found: dict[int, list[bytes]] = {}
    for s, d in foul:
        found.setdefault(d, []).extend(w for w in s.split() if w in telling)
    return [b" " + b" ".join(words) + b" " for words in found.values() if words]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias first) by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: pa.Array, labels: np.ndarray) -> Model:
    """Half of the sample trains the dictionaries, the other half calibrates the curve."""
    if len(labels) < 4 or len(np.unique(labels)) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(b" ", b" ", float(np.log((share + 1e-3) / (1 - share + 1e-3))), (0.0,) * (BEST + 2))
    half = np.arange(len(labels)) % 2 == 0
    cut: list[tuple[bytes, int, int]] = []
    kept = pa.array(np.flatnonzero(half))
    base = 0
    for docs in tb.text_slices(texts.take(kept)):
        data, cuts, counts = windows(docs)
        owner = np.repeat(np.arange(len(docs)), counts) + base
        base += len(docs)
        cut += [(data[a:b], int(o), int(labels[half][o])) for (a, b), o in zip(cuts.tolist(), owner, strict=True)]
    plain, foul = [x[:2] for x in cut if not x[2]], [x[:2] for x in cut if x[2]]
    ordinary = _dictionary([x for x, _ in plain])
    toxic = _dictionary(_residue(foul, _telling(foul, plain)) or [x for x, _ in foul])
    a, b = _coder(ordinary), _coder(toxic + ordinary)
    x = np.concatenate([savings(d, a, b) for d in tb.text_slices(texts.take(pa.array(np.flatnonzero(~half))))])
    w = _logistic(x, labels[~half])
    return Model(ordinary, toxic, float(w[0]), tuple(map(float, w[1:])))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int = PER_CLASS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = labelled.table(batches).sort_by([("__h", "ascending"), ("text", "ascending")])
        m = train(t.column("text").combine_chunks(), t.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.ordinary]), pa.array([m.toxic]), pa.array([m.bias]), pa.array([list(m.slopes)])], names=["o", "t", "b", "s"])

    row = labelled.sample(docs, labels, label, learn, per_class).repartition(1).mapInArrow(run, "o binary, t binary, b double, s array<double>").first()
    if row is None:  # no labelled row at all
        return train(pa.array([], pa.string()), np.zeros(0, np.int32))
    return Model(bytes(row["o"]), bytes(row["t"]), row["b"], tuple(row["s"]))


def score(docs: DataFrame, model: Model, folds: int, held: int, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, both = _coder(model.ordinary), _coder(model.toxic + model.ordinary)
        for b in batches:
            for part in tb.text_slices(b.column(2)):
                s = 1 / (1 + np.exp(-np.clip(model.bias + savings(part, ordinary, both) @ np.array(model.slopes), -500, 500)))
                rows = slice(part.first, part.first + len(part))
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], b.column(1)[rows], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (labelled.fold("doc_id", folds) == held).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
