"""Likeness of senders by their words: all conversations are read, and each pair that shares a word has a row."""

import random

import numpy as np
import pyarrow as pa

from parley.operators import likeness
from parley.operators.statements import apply
from parley.plans import registry, tables

WORDS = "conversation_id string, sender string, word string"


def test_words_of_all_conversations_count(spark):
    rows = [("whatsapp:group_1", "a", "one"), ("whatsapp:group_2", "a", "two"), ("instagram:dm_1", "b", "two"), ("meta:c1", "b", "one"), ("imessage:x", "c", "two")]
    got = apply("set06_jaccard", spark, w=spark.createDataFrame(rows, WORDS)).collect()
    likeness = {(r.s1, r.s2): r.jaccard for r in got}
    assert likeness[("a", "b")] == 1 and likeness[("a", "c")] == 0.5


def _row_of_each_pair(sets):
    said = sorted(sets)
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for i, a in enumerate(said) for b in said[i + 1 :] if sets[a] & sets[b]}


def test_every_pair_has_a_row(spark, monkeypatch):
    monkeypatch.setattr(likeness, "BLOCK", 8)
    rng = random.Random(6)
    sets = {f"a{i}": {"one", "two"} for i in range(30)} | {f"b{i}": {"two", "three", "four"} for i in range(9)} | {"c": {"five"}, "d": {"one"}}
    sets |= {f"e{i}": set(rng.sample([f"w{k}" for k in range(20)] + ["one"], rng.randint(1, 6))) for i in range(25)}
    rows = [(rng.choice(("whatsapp:group_1", "instagram:dm_1")), s, w) for s, ws in sets.items() for w in ws for _ in range(2)] + [("meta:c1", None, "one"), ("meta:c1", "f", None)]
    w = spark.createDataFrame(rows, WORDS)
    want = _row_of_each_pair(sets)
    for got in (likeness.pairs(w), apply("set06_jaccard", spark, w=w.filter("word is not null"))):
        found = [(r.s1, r.s2, r.jaccard) for r in got.collect()]
        assert len(found) == len(want) and {(a, b): j for a, b, j in found} == want


def test_common_words_over_slices(monkeypatch):
    monkeypatch.setattr(likeness, "WORDS", 3)
    rng = random.Random(7)
    sets = [set(rng.sample(range(20), rng.randint(1, 12))) for _ in range(15)]
    words = pa.array([[f"w{k}" for k in sorted(s)] for s in sets])
    assert likeness._common(words, np.arange(5), np.arange(5, 15)).tolist() == [[len(a & b) for b in sets[5:]] for a in sets[:5]]


def test_no_words_give_no_pairs(spark):
    assert likeness.pairs(spark.createDataFrame([], WORDS)).collect() == []


def test_registered_query_gives_each_pair_of_senders(spark, sf_dir):
    said = {}
    for r in tables.make("w", spark, sf_dir, {}).select("sender", "word").distinct().collect():
        said.setdefault(r.sender, set()).add(r.word)
    want = _row_of_each_pair(said)
    got = registry.queries()["set06_jaccard"](spark, sf_dir)
    assert got.columns == ["s1", "s2", "jaccard"]
    found = got.collect()
    assert len(found) == len(want) and {(r.s1, r.s2): r.jaccard for r in found} == want
