"""The n-gram join on keys of many texts, on repeated and null ids, and the amount of work it does."""

import random

import pytest

from parley.llm import parity_join

WORDS = ["".join(p) for p in zip(*[iter("abcdefghijklmnopqrstuvwxyzabdcfehgjilknmporqtsvuxwzy" * 6)] * 3, strict=False)]


def components(docs, k, percent):
    """Component of each row by comparing all pairs of sets."""
    sets = []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    ids = {}
    for i, (doc, _) in enumerate(docs):
        ids.setdefault(root(i), []).append(doc)
    return [min((x for x in ids[root(i)] if x is not None), default=None) for i in range(len(docs))], sets


def family(rng, size, words, changed):
    """Texts that differ from one text in up to ``changed`` words, so that some pairs link and others do not."""
    base = [rng.choice(WORDS) for _ in range(words)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randint(0, changed)):
            t[rng.randrange(words)] = rng.choice(WORDS) + "x"
        out.append(" ".join(t))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = " ".join(rng.choice(WORDS) for _ in range(40))
    docs = family(rng, 60, 120, 3) + family(rng, 40, 60, 4) + family(rng, 30, 12, 1)
    docs += [f"{' '.join(rng.choice(WORDS) for _ in range(rng.randint(8, 60)))} {shared}" for _ in range(60)]
    return docs


@pytest.mark.parametrize(("small", "block"), [(4, 16), (32, 1024)])
def test_keys_of_many_texts(spark, monkeypatch, small, block):
    monkeypatch.setattr(parity_join, "SMALL", small)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    rng = random.Random(4)
    docs = list(enumerate(corpus(2)))
    docs += [(3, "quite another text " * 3), (5, docs[80][1]), (None, docs[0][1] + " end"), (None, None), (7, ""), (None, "alone without an id"), (9, docs[9][1])]
    rng.shuffle(docs)
    want, sets = components(docs, 5, 80)
    got = parity_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), parity_join.Rule(5, 80)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, ((i, len(s), c) for (i, _), s, c in zip(docs, sets, want, strict=True))))


def test_keep_first_keeps_different_texts_of_one_id(spark):
    rng = random.Random(6)
    a, b = ([t, t + " end"] for t in (family(rng, 1, 80, 0)[0], family(rng, 1, 80, 0)[0]))
    docs = [(1, a[0], 0, 0), (1, b[0], 0, 1), (2, a[1], 0, 2), (3, b[1], 0, 3), (1, a[0], 0, 4), (None, a[1] + " x", 0, 5), (None, "no id but a text of its own", 0, 6), (8, None, 0, 7), (8, " ", 0, 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __kept int, tsig int")
    out = parity_join.keep_first(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(str(r.text) for r in rows) == sorted(map(str, [a[0], b[0], docs[6][1], None, " "]))
    assert {r.doc_id for r in rows if r.text in (a[0], b[0])} == {1}


def test_verified_pairs_are_few(spark, monkeypatch):
    """The sets of at most a small multiple of the true pairs are fetched."""
    seen = []
    whole = parity_join._linked
    monkeypatch.setattr(parity_join, "_linked", lambda pairs, *more: (seen.append(pairs.count()), whole(pairs, *more))[1])
    docs = list(enumerate(corpus(3)))
    parity_join.join(spark.createDataFrame(docs, "doc_id long, text string"), parity_join.Rule(5, 80)).count()
    _, sets = components(docs, 5, 80)
    true = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(seen) <= 1.5 * true
