"""Licence scan: templates with markup compiled into token automata.

A template is wording with two kinds of markup, ``<<optional>> ... <<end>>`` for words that may be
missing and ``<<var:n>>`` for one to n words that may be replaced.  ``compile_template`` turns it
into an automaton over word hashes whose states carry the words they accept; a text is accepted
where its words lead from a start to the end, so all mandatory wording must match exactly.  Beside
the templates a scan reports the places of fixed base phrases.

Texts are lower-cased (A-Z) and split into words of digits, letters and non-ASCII characters, on
flat byte buffers; an automaton only runs where the first words of its template stand.  Each
document is scanned whole on its own row and nothing is shuffled.

Defined results for odd input: a null, empty or word-free text has no words, no labels and score
0; repeated rows are scanned one by one; nulls in other columns do not matter; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbytes as tb

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label and markup of the templates.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license <<optional>>version<<end>> 2 0"),
    ("gpl-notice", "<<optional>>this <<var:3>> is<<end>> licensed under <<optional>>the terms of<<end>> the gnu general public license <<optional>>as published by the free software foundation either<<end>> version <<var:1>>"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by nc <<optional>>sa<<end>> <<var:1>> 0"),
    ("cc-by-4.0", "licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by 4 0"),
    ("mit-notice", "<<optional>>this <<var:3>> is<<end>> <<optional>>licensed<<end>> <<optional>>released<<end>> under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this <<var:6>> to deal in the software without restriction"),
    (
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var:6>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var:6>> be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-2-full",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by <<var:8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Part(NamedTuple):
    """A stretch of a template: words, whether they may be missing, or the most words of a gap."""

    words: tuple[str, ...]
    optional: bool
    gap: int


def parse(markup: str) -> list[Part]:
    """The parts of a template; optional regions hold words and gaps and do not nest."""
    out, optional = [], False
    for token in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if token == "<<optional>>":
            optional = True
            out.append([])
        elif token == "<<end>>":
            optional = False
        elif token.startswith("<<var:"):
            part = Part((), optional, int(token[6:-2]))
            out[-1].append(part) if optional else out.append(part)
        elif token.split():
            part = Part(tuple(token.lower().split()), optional, 0)
            out[-1].append(part) if optional else out.append(part)
    return out


class Automaton:
    """States 0..end; ``step[s]`` maps a word hash to the next state, ``loose[s]`` takes any word."""

    def __init__(self, markup: str):
        self.step: list[dict[int, int]] = [{}]
        self.loose: list[int | None] = [None]
        self.jump: list[list[int]] = [[]]
        at = 0
        for region in parse(markup):
            begin = at
            for part in region if isinstance(region, list) else [region]:
                at = self._gap(at, part.gap) if part.gap else self._words(at, part.words)
            if isinstance(region, list):
                self.jump[begin].append(at)
        self.end = at
        self.first = sorted(self._firsts({0}))

    def _state(self) -> int:
        self.step.append({})
        self.loose.append(None)
        self.jump.append([])
        return len(self.step) - 1

    def _words(self, at: int, words: tuple[str, ...]) -> int:
        for h in word_hashes(" ".join(words)):
            self.step[at][int(h)] = at = self._state()
        return at

    def _gap(self, at: int, most: int) -> int:
        states = [at] + [self._state() for _ in range(most)]
        for a, b in zip(states, states[1:], strict=False):
            self.loose[a] = b
        out = self._state()
        for s in states[1:]:
            self.jump[s].append(out)
        return out

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.jump[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def _firsts(self, states: set[int]) -> set[int]:
        return {h for s in self.closure(states) for h in self.step[s]}

    def accepts(self, words: np.ndarray) -> bool:
        """Whether the template matches from the first of these words on."""
        states = self.closure({0})
        for h in words.tolist():
            moved = {self.step[s][h] for s in states if h in self.step[s]} | {self.loose[s] for s in states if self.loose[s] is not None}
            states = self.closure(moved)
            if self.end in states:
                return True
            if not states:
                return False
        return self.end in states


def word_hashes(text: str) -> np.ndarray:
    return tb.words(next(tb.text_slices(pa.array([text]))), tb.ALNUM, tb.LOWER).hash


def regex(markup: str) -> str:
    """The same language as a regular expression over words that each follow one space."""

    def one(part: Part) -> str:
        return f"(?: [^ ]+){{1,{part.gap}}}" if part.gap else "".join(f" {w}" for w in part.words)

    return "".join(f"(?:{''.join(map(one, r))})?" if isinstance(r, list) else one(r) for r in parse(markup)) + " "


def scan(df: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels and a score.

    The score is 1 where a template accepts, 0.5 where only a base phrase stands, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(word_hashes(p), label) for p, label in phrases.items()]
        machines = [(Automaton(markup), label) for label, markup in templates]
        firsts = np.array(sorted({h for m, _ in machines for h in m.first}), np.uint64)
        for b in batches:
            for docs in tb.text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(docs.first, len(docs)), *_scan(docs, base, machines, firsts)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    picked = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def _scan(docs: tb.Docs, base: list, machines: list, firsts: np.ndarray) -> list[pa.Array]:
    w = tb.words(docs, tb.ALNUM, tb.LOWER)
    n = len(docs)
    count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    labels: list[set[str]] = [set() for _ in range(n)]
    base_labels: list[set[str]] = [set() for _ in range(n)]

    def doc_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(w.bounds, at, "right") - 1

    for phrase, label in base:
        at = np.flatnonzero(w.hash[: max(0, len(w.hash) - len(phrase) + 1)] == phrase[0])
        for k, h in enumerate(phrase[1:], 1):
            at = at[w.hash[at + k] == h]
        doc = doc_of(at)
        inside = at + len(phrase) <= w.bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        np.add.at(count, doc, 1)
        np.minimum.at(low, doc, at - w.bounds[doc])
        np.maximum.at(high, doc, at - w.bounds[doc])
        for d in np.unique(doc):
            base_labels[d].add(label)
    full = np.zeros(n, bool)
    for at in np.flatnonzero(np.isin(w.hash, firsts)):
        d = int(doc_of(at))
        rest, h = w.hash[at : w.bounds[d + 1]], int(w.hash[at])
        for machine, label in machines:
            if h in machine.first and label not in labels[d] and machine.accepts(rest[: 4 * len(machine.step)]):
                labels[d].add(label)
                full[d] = True
    texts = [",".join(sorted(x)) for x in base_labels], [",".join(sorted(x | y)) for x, y in zip(base_labels, labels, strict=True)]
    none = count == 0
    return [
        pa.array(np.diff(w.bounds)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none),
        pa.array(texts[0]), pa.array(texts[1]), pa.array(np.where(full, 1.0, np.where(none, 0.0, 0.5))),
    ]


def oracle_sql(table: str = "documents") -> str:
    """The rows of ``scan`` in DuckDB's SQL: templates as regular expressions over the joined words."""
    places, found = [], []
    for p, label in PHRASES.items():
        words = p.split()
        places.append(f"list_transform(list_filter(range(1, len(ws) - {len(words) - 2}), lambda i: {' and '.join(f'ws[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(words))}), lambda i: struct_pack(i := i - 1, l := '{label}'))")
    for label, markup in TEMPLATES:
        found.append(f"case when regexp_matches(j, '{regex(markup)}') then '{label}' end")
    joined = places[0]
    for p in places[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws from {table}),
p as (select doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' j, {joined} b from w),
q as (select *, list_filter([{', '.join(found)}], lambda x: x is not null) t, list_distinct(list_transform(b, lambda x: x.l)) bl from p)
select doc_id, len(ws)::bigint n_words, len(b)::bigint n_base, list_min(list_transform(b, lambda x: x.i))::bigint first_word, list_max(list_transform(b, lambda x: x.i))::bigint last_word,
  array_to_string(list_sort(bl), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, t))), ',') labels,
  case when len(t) > 0 then 1.0 when len(b) > 0 then 0.5 else 0.0 end::double score from q"""
