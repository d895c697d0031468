"""Byte-level BPE by dynamic programming over prefixes.

A byte string has one encoding, so each of its prefixes has one last token, and that token ``t`` is
the only one for which the prefix without it ends in a token that may stand before ``t``.  A table of
these last tokens holds the encodings of all prefixes at once: walking back from the end gives the
ids, an append fills in the new prefixes and touches no old one, and an edit keeps the prefixes before it.
Two tokens may stand side by side if merging their joined bytes gives the two again; that is decided
from the order in which the parts beside the seam are merged away, and remembered by pair.

A text is first split by a pattern and each match is encoded by itself.  ``Encoding`` holds a text that
changes: an edit splits again from the last match that could not see it, up to the first border that
stands as before.  ``encode``, ``decode``, ``digest`` and ``revise`` work on DataFrames, row by row and
without a shuffle; a task holds one slice of matches and a bounded number of known ones.

Defined results for odd input: a null text is empty and has no ids; a null array of ids decodes to no
bytes; equal rows are encoded one by one; a null doc_id is kept; an empty table gives an empty table;
extra columns are kept by ``encode`` and ``decode`` and ignored by the others; a very long match costs
time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Matches that a task remembers, the longest of them in characters, and matches in one slice.
KNOWN = 1_000_000
KNOWN_CHARS = 64
SLICE = 100_000
PAIRS = 4_000_000
NEVER = 1 << 30
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Tokens by rank, where each lies in a byte string, and which two may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"a byte-level vocabulary has every byte as a token; missing: {missing[:5]}")
        self.longest = max(map(len, ranks))
        self.sizes = array("i", [0] * (max(self.tokens) + 1))
        self.places = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
            self.places.add_word(token.decode("latin-1"), rank)
        self.places.make_automaton()
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._flat = {kind: self._table([say(self.tokens.get(r, b""), r) for r in range(len(self.sizes))]) for kind, say in {"bytes": lambda t, _: t, "decimal": lambda t, r: b"%d " % r}.items()}

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        """From lines of a token in base 64 and its rank."""
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t})

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(e) for e in entries])
        return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(sizes) - sizes, sizes

    def _spelled(self, ids: np.ndarray, kind: str) -> bytes:
        flat, first, sizes = self._flat[kind]
        if not len(ids):
            return b""
        n = sizes[ids]
        ends = np.cumsum(n)
        return flat[np.repeat(first[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return self._spelled(ids, "bytes")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a space."""
        return self._spelled(ids, "decimal")

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The parts of data after merging pairs of least rank, leftmost first, down to ``until`` parts at least."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list] | None:
        """The parts at the left and at the right end of a token while it is merged, each with the rank
        that ends it; None for a token that merging never makes."""
        if token not in self._edges:
            data = self.tokens[token]
            if len(data) == 1:
                found = ([(data, NEVER)], [(data, NEVER)])
            elif len(halves := self.merge(data, 2)) > 2:
                found = None
            else:
                found = tuple([(data, NEVER), *((part, min(dies, token)) for part, dies in self.edges(self.ranks[half])[side])] for side, half in enumerate(halves))
            self._edges[token] = found
        return self._edges[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b, one after the other, gives a and b."""
        left, right = self.edges(a), self.edges(b)
        if left is None or right is None:
            return False
        for x, x_ends in left[1]:
            for y, y_ends in right[0]:
                # of equal ranks the leftmost merges first
                if (rank := self.ranks.get(x + y)) is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def extend(self, last: array, data: bytes) -> None:
        """Append to ``last``, which holds the last token of each prefix of data so far, those of the longer ones."""
        known = len(last)
        last.extend([-1] * (len(data) - known))
        pairs, sizes = self._pairs, self.sizes
        if len(pairs) > PAIRS:
            pairs.clear()
        since = max(0, known - self.longest)
        for end, token in self.places.iter(data[since:].decode("latin-1")):
            end += since
            if end < known or last[end] >= 0:
                continue
            start = end - sizes[token]
            if start < 0:
                ok = self.edges(token) is not None
            else:
                pair = last[start] << 24 | token
                ok = pairs.get(pair)
                if ok is None:
                    ok = pairs[pair] = self.fits(last[start], token)
            if ok:
                last[end] = token

    def walk(self, last: array) -> list[int]:
        """The ids of the whole, from the last tokens of its prefixes."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= self.sizes[ids[-1]]
        return ids[::-1]

    def encode_bytes(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last = array("i")
        self.extend(last, data)
        return self.walk(last)


class Encoding:
    """The ids of a text that changes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.starts, self.tables, self.kept = "", [], [], 0
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of the characters from start to stop; ``kept`` counts the matches left alone."""
        old, starts, tables = self.text, self.starts, self.tables
        self.text = text = old[:start] + new + old[stop:]
        moved, edited = len(text) - len(old), start + len(new)
        # a match has seen its own characters and two more at most
        first = max(0, bisect_right(starts, start - 2) - 1)
        while first and (starts[first] if first < len(starts) else len(old)) + 2 > start:
            first -= 1
        at, found, made, rest = starts[first] if first < len(starts) else 0, [], [], len(starts)
        for m in self.pattern.finditer(text, at):
            if m.start() >= edited:
                same = bisect_left(starts, m.start() - moved)
                if same < len(starts) and starts[same] == m.start() - moved:
                    rest = same
                    break
            data, table = m.group().encode(), array("i")
            i = bisect_left(starts, m.start()) if m.start() <= start else len(starts)
            if i < len(starts) and starts[i] == m.start():
                before = old[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(old)].encode()
                table = tables[i][: _common(before, data)]
            self.vocabulary.extend(table, data)
            found.append(m.start())
            made.append(table)
        self.starts = starts[:first] + found + [s + moved for s in starts[rest:]]
        self.tables = tables[:first] + made + tables[rest:]
        self.kept = first + len(starts) - rest

    def ids(self) -> list[int]:
        ends = [*self.starts[1:], len(self.text)][: len(self.starts)]
        out = []
        for start, end, table in zip(self.starts, ends, self.tables, strict=True):
            whole = self.vocabulary.ranks.get(self.text[start:end].encode()) if len(table) <= self.vocabulary.longest else None
            out += [whole] if whole is not None else self.vocabulary.walk(table)
        return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


class Encoder:
    """Ids of whole texts; the ids of short matches already seen are looked up."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._clear()

    def _clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.first, self.flat = array("q", [0]), array("i")

    def _slices(self, text: str) -> Iterator[list[str]]:
        if len(text) <= SLICE:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, SLICE)]:
            yield part

    def _known(self, piece: str) -> int:
        at = self.entry.get(piece)
        if at is None:
            self.flat.extend(self.vocabulary.encode_bytes(piece.encode()))
            self.first.append(len(self.flat))
            at = len(self.first) - 2
            if len(piece) <= KNOWN_CHARS:
                self.entry[piece] = at
        return at

    def ids(self, text: str) -> Iterator[np.ndarray]:
        """The ids in slices, which together are those of the text."""
        for pieces in self._slices(text):
            if len(self.first) > KNOWN or len(self.flat) > 8 * KNOWN:
                self._clear()
            entries = list(map(self.entry.get, pieces))
            if None in entries:
                entries = list(map(self._known, pieces))
            e = np.array(entries, np.int64)
            first, flat = np.frombuffer(self.first, np.int64), np.frombuffer(self.flat, np.int32)
            n = first[e + 1] - first[e]
            ends = np.cumsum(n)
            yield flat[np.repeat(first[e] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            del first, flat  # the arrays can't grow while they are viewed


#: By vocabulary and pattern, kept for the later tasks of a Python worker.
_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(raw: bytes, pattern: str) -> Encoder:
    key = (hash(raw), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary.parse(raw), pattern)
    return _ENCODERS[key]


def _read(spark: SparkSession, path: str):
    """The vocabulary's file for the tasks; a vocabulary is a fixed file of about a megabyte."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _added(df: DataFrame, source: str, out: str, kind: T.DataType, make) -> DataFrame:
    """df with the column ``out`` made from the values of ``source``; row by row, whatever the other columns are named."""
    taken = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(source)
    kept = [(c, n) for c, n in zip(taken, df.columns, strict=True) if n != out]
    schema = T.StructType([T.StructField(c, df.schema[df.columns.index(n)].dataType) for c, n in kept] + [T.StructField("made", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                made = pa.array([one(v) for v in _column(part, taken[at])], pa.binary() if isinstance(kind, T.BinaryType) else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c, _ in kept] + [made], names=[c for c, _ in kept] + ["made"])

    return df.toDF(*taken).mapInArrow(run, schema).toDF(*[n for _, n in kept], out)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each whole text; ``vocabulary`` is the path of a file of tokens and ranks."""
    raw = _read(df.sparkSession, vocabulary)

    def make():
        encoder = _encoder(raw.value, pattern)
        return lambda t: np.concatenate([np.zeros(0, np.int32), *encoder.ids(t or "")])

    return _added(df, text, ids, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with the bytes that each array of ids stands for."""
    raw = _read(df.sparkSession, vocabulary)

    def make():
        v = _encoder(raw.value, "").vocabulary
        return lambda x: v.decode(np.array(x or [], np.int64))

    return _added(df, ids, out, T.BinaryType(), make)


def digest(df: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The number and digest of each text's ids and the digest of what they decode to, a slice at a time."""
    raw = _read(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value, pattern)
        for b in batches:
            rows = []
            for value in b.column(1):
                n, tail = 0, b""
                said, decoded = hashlib.sha256(), hashlib.sha256()
                for ids in encoder.ids(value.as_py() or ""):
                    n += len(ids)
                    spelled = tail + encoder.vocabulary.decimals(ids)
                    said.update(spelled[:-1])
                    tail = spelled[-1:]  # a space, unless nothing follows
                    decoded.update(encoder.vocabulary.decode(ids))
                rows.append((n, said.hexdigest(), decoded.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    picked = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(run, DIGEST)


def revise(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The ids of edited texts: df has doc_id, text, start, stop (in characters) and new.

    Returns doc_id, ids of the edited text, and how many matches of the pattern kept their ids.  Nulls
    count as an empty text, an edit at the start, and nothing put in.
    """
    raw = _read(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(raw.value, pattern).vocabulary
        for b in batches:
            rows = []
            for text, start, stop, new in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                text, start = text or "", min(max(start or 0, 0), len(text or ""))
                held = Encoding(v, pattern, text)
                held.replace(start, min(max(stop or 0, start), len(text)), new or "")
                rows.append((held.ids(), held.kept))
            columns = list(zip(*rows, strict=True)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.int64())], names=["doc_id", "ids", "kept"])

    picked = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("start").cast("long"), F.col("stop").cast("long"), F.col("new").cast("string"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, kept long")
