"""Sum-of-squares online packing of token sequences into windows of a fixed size.

Documents are tokenised, cut into pieces of at most ``window`` ids and packed as they come.  A
full piece fills a window by itself.  Any other piece goes to the fill level that makes the sum of
the squared counts of partially filled windows smallest; the counts are kept in one array by
level, so a placement is a few vector operations on ``window`` numbers whatever has gone before.
When a partition ends, the pieces of its unfinished windows are dealt out again in order and cut
at window borders, so that a partition pads one window at most.

Every partition of the input packs on its own: nothing is shuffled, and a task that runs again
gives the same rows.  A text is split at blanks, which no token crosses, and the ids of the words
already seen are kept (for at most ``WORDS`` of them); memory holds one slice of text, the words
and the unfinished windows.

Defined results for odd input: a null or empty text has the single id that ends a document; equal
rows are packed one by one; a null doc_id is kept; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbytes as tb

WINDOW = 4096
END_ID = 2
WORDS = 1_500_000
SLICE_BYTES = 1 << 22
#: A word is also cut between an ASCII letter (1) and one of these signs (2): no token holds both.
PARTS = np.full(256, 3, np.uint8)
PARTS[0x41:0x5B] = PARTS[0x61:0x7B] = 1
PARTS[list(b".,;:!?")] = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids by word, for words separated by ASCII blanks; entry 0 is the end of a document."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], end_id: int):
        self.encode, self.end_id = encode, end_id
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.flat = np.array([0, 1]), np.array([self.end_id], np.uint32)

    def _add(self, raw: bytes, w: tb.Words, new: np.ndarray, where: np.ndarray) -> None:
        found = self.encode([raw[w.start[i] : w.end[i]].decode("utf-8", "replace") for i in where])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in found])])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.uint32)])
        entries = np.arange(len(self.first) - 1 - len(new), len(self.first) - 1)
        places = np.searchsorted(self.hashes, new)
        self.hashes, self.at = np.insert(self.hashes, places, new), np.insert(self.at, places, entries)

    def ids(self, docs: tb.Docs) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in order, and where each document's ids begin and end."""
        raw = docs.data.tobytes()
        fold = None if b"<|" in raw else tb.LOWER  # all but the names of special ids is lower-cased
        w = tb.words(docs, tb.NOT_BLANK, fold, PARTS)
        distinct, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > WORDS:
            self._clear()
        k = np.searchsorted(self.hashes, distinct)
        known = k < len(self.hashes)
        known[known] = self.hashes[k[known]] == distinct[known]
        if not known.all():
            self._add(raw, w, distinct[~known], where[~known])
        entry = self.at[np.searchsorted(self.hashes, distinct)][back] if len(distinct) else np.zeros(0, np.int64)
        entry = np.insert(entry, w.bounds[1:], 0)
        sizes = self.first[entry + 1] - self.first[entry]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.first[entry] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends[w.bounds[1:] + np.arange(len(docs))]])


class Packer:
    """The windows of one partition.  ``put`` and ``close`` give the rows that became final."""

    def __init__(self, window: int, first_id: int = 0):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window, np.int64)  # of partly filled windows, by level
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]  # the pieces of each

    def _number(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _row(self, piece: tuple, sequence: int, offset: int) -> tuple:
        doc, start, ids, total = piece
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset

    def _finish(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self._number(), 0
        for p in pieces:
            yield self._row(p, sequence, offset)
            offset += len(p[2])

    def level(self, size: int) -> int:
        """The level to put a piece of this size on (0: a new window); ties go to the fullest."""
        n = self.count
        room = self.window - size
        change = np.where(n[: room + 1] > 0, -2 * n[: room + 1] + 1, np.iinfo(np.int64).max)
        change[0] = 0
        change[:room] += np.where(change[:room] < np.iinfo(np.int64).max, 2 * n[size:] + 1, 0)
        return room - int(np.argmin(change[::-1]))

    def put(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total, cut = len(ids), len(ids) // self.window * self.window
        for start in range(0, cut, self.window):
            yield self._row((doc, start, ids[start : start + self.window], total), self._number(), 0)
        if cut == total:
            return
        size = total - cut
        level = self.level(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        pieces.append((doc, cut, ids[cut:].copy(), total))
        if level + size == self.window:
            yield from self._finish(pieces)
        else:
            self.open[level + size].append(pieces)
            self.count[level + size] += 1

    def close(self) -> Iterator[tuple]:
        """Deal the unfinished windows out again, fullest first, cutting where a window is full."""
        held, filled = [], 0
        for pieces in (x for level in self.open[::-1] for x in level):
            for doc, start, ids, total in pieces:
                while len(ids):
                    part = ids[: self.window - filled]
                    held.append((doc, start, part, total))
                    start, ids, filled = start + len(part), ids[len(part) :], filled + len(part)
                    if filled == self.window:
                        yield from self._finish(held)
                        held, filled = [], 0
        if held:
            yield from self._finish(held)


#: By tokenizer, kept for the later tasks of a Python worker.
_KNOWN: dict[tuple[str, int], WordIds] = {}


def _encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def pack(df: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document; ``tokenizer`` is the path of a tokenizer's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _KNOWN.setdefault((tokenizer, end_id), WordIds(_encoder(tokenizer), end_id))
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        types = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows: list[tuple] = []
        for b in batches:
            docs = b.column(0).to_pylist()
            for part in tb.text_slices(b.column(1), SLICE_BYTES):
                flat, ends = known.ids(part)
                for i in range(len(part)):
                    rows += packer.put(docs[part.first + i], flat[ends[i] : ends[i + 1]])
            if len(rows) > 20_000:
                yield batch(rows)
                rows = []
        rows += packer.close()
        if rows:
            yield batch(rows)

    picked = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)
