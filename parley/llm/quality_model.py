"""Quality classifier: supervised subword embeddings.

Words and byte n-grams of a text are hashed into one table of learned vectors; their mean is a
document's vector and a softmax over it gives the class.  The vectors and the output layer are
trained together by stochastic gradient descent in numpy, in one task, on a bounded sample of
labelled documents (``PER_CLASS`` of each class).  A word that follows itself also counts as one
of a few general word pairs, so that loops of any word share a vector.

Scoring reads every whole text.  The mean and the output layer are linear, so each table entry
shrinks to the number it adds to the class margin and a document's score is a mean of such
numbers under a sigmoid (the softmax of two classes).

Defined results for odd input: a null or empty text has no features to judge and gets ``NOTHING`` as
its score, a low one; without labelled rows of both classes every other score is the share of label 1
(0.5 if there is none); a document labelled both ways is not learned from; repeated rows are scored one by one; a null doc_id counts as the text 'null' in the fold;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import labelled
from parley.llm import textbytes as tb

BUCKETS = 1 << 17
DIMS = 8
GRAMS = (3, 5)
PER_CLASS = 1500
EPOCHS = 4
BATCH = 32
RATE = 6.0
NOTHING = 0.05
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_REPEAT = np.uint64(0x5BD1E995)


def features(docs: tb.Docs) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of all features, grouped by document, and the number of each document's."""
    parts, owners = [], []
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    w = tb.words(docs, tb.NOT_BLANK)
    owner = w.doc
    parts.append((w.hash >> shift).astype(np.int32))
    owners.append(owner)
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])) + 1
    parts.append(np.full(len(again), int(tb.mix(np.array([_REPEAT]))[0] >> shift), np.int32))
    owners.append(owner[again])
    n = len(docs.data)
    if n:
        p = tb.prefix_hash(docs.data)
        inverse = tb.powers(n + 1)[1]
        position_owner = np.repeat(np.arange(len(docs)), np.diff(docs.offsets))
        for k in GRAMS:
            if n < k:
                continue
            whole = position_owner[k - 1 :] == position_owner[: n - k + 1]
            h = (p[k:] - p[: n - k + 1]) * inverse[: n - k + 1]
            parts.append((tb.mix(h + np.uint64(k)) >> shift).astype(np.int32)[whole])
            owners.append(position_owner[: n - k + 1][whole])
    entry, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return entry[order], np.bincount(owner, minlength=len(docs))


def train(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The margin that each table entry adds, and the bias."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (DIMS, BUCKETS)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (2, DIMS)), np.zeros(2)
    found = [x for d in tb.text_slices(texts) for x in np.split(*(lambda e, c: (e, np.cumsum(c)[:-1]))(*features(d)))]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(found))
        for at in range(0, len(order), BATCH):
            pick = [i for i in order[at : at + BATCH] if len(found[i])]
            if not pick:
                continue
            entry = np.concatenate([found[i] for i in pick])
            sizes = np.array([len(found[i]) for i in pick])
            starts = np.cumsum(sizes) - sizes
            mean = np.stack([np.add.reduceat(row[entry], starts) for row in table], 1) / sizes[:, None]
            logits = mean @ out.T + bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            wrong = prob.copy()
            wrong[np.arange(len(pick)), labels[pick]] -= 1
            wrong *= weight[pick][:, None] / len(pick)
            back = (wrong @ out) / sizes[:, None]
            out -= rate * wrong.T @ mean
            bias -= rate * wrong.sum(0)
            for k in range(DIMS):
                table[k] -= (rate * 30) * np.bincount(entry, np.repeat(back[:, k], sizes), BUCKETS).astype(np.float32)
    direction = out[1] - out[0]
    return (direction.astype(np.float32) @ table).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train in one task on the bounded sample; only the model's ``BUCKETS`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = labelled.table(batches).sort_by([("__h", "ascending"), ("text", "ascending")])
        margin, bias = train(t.column("text").combine_chunks(), t.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([margin.tobytes()]), pa.array([bias])], names=["margin", "bias"])

    row = labelled.sample(docs, labels, label, learn, per_class).repartition(1).mapInArrow(run, "margin binary, bias double").first()
    if row is None:  # no labelled row at all
        return train(pa.array([], pa.string()), np.zeros(0, np.int32))
    return np.frombuffer(row["margin"], np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], folds: int, held: int, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = shared.value
        for b in batches:
            for part in tb.text_slices(b.column(2)):
                entry, sizes = features(part)
                total = np.concatenate([[0.0], np.cumsum(margin[entry], dtype=np.float64)])
                ends = np.cumsum(sizes)
                mean = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
                s = np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500))), NOTHING)
                rows = slice(part.first, part.first + len(part))
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], b.column(1)[rows], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (labelled.fold("doc_id", folds) == held).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
