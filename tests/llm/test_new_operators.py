"""Prefix BPE against tiktoken, the threshold search and the Merkle manifest against brute force and SQL."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from parley.llm import merkle_manifest, prefix_bpe, queries, ranked_search

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, g string, terms string, made int"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z", 1)


@pytest.fixture(scope="module")
def tables():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference(tables):
    import tiktoken

    with open(tables[0], "rb") as f:
        raw = f.read()
    v = prefix_bpe.Vocabulary.parse(raw)
    assert {t: int(r) for t, r in ((base64.b64decode(a), b) for a, b in map(bytes.split, raw.splitlines()))} == v.ranks
    return v, tiktoken.Encoding("own", pat_str=tables[1], mergeable_ranks=v.ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñ漢") for _ in range(rng.randint(1, 9)))
    odd = [None, "", " \n\t ", "word", "Word", "A" * 4000, "ab " * 3000, " " * 1500, "<|endoftext|> it's 12\r\n\r\n  x", "😀​é"]
    return [*odd, odd[3], *(" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)), " ".join(word() for _ in range(60_000))]


@pytest.fixture(scope="module")
def odd(spark, texts):
    rows = [row(i, t, [None, "en", "de", "", "é"][i % 5], [None, "s"][i % 2]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], row(None, "no id"), row(None, "No Id")], COLUMNS).repartition(4)


def test_prefix_bpe_against_tiktoken(spark, sf_dir, tables, reference, odd):
    _, tk = reference
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        got = sorted(map(tuple, prefix_bpe.digest(df, *tables).collect()), key=repr)
        want = []
        for r in df.collect():
            ids = tk.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode_bytes(ids)).hexdigest()))
        assert got == sorted(want, key=repr)


def test_ids_come_back_as_text_and_other_columns_stay(spark, tables, odd):
    got = prefix_bpe.decode(prefix_bpe.encode(odd, *tables, ids="made"), tables[0], ids="made")
    assert got.columns == [*(c for c in odd.columns if c != "made"), "made", "bytes"]
    assert all(bytes(r.bytes).decode() == (r.text or "") and r.node == "x" for r in got.collect())
    assert prefix_bpe.encode(odd.limit(0), *tables).count() == prefix_bpe.digest(odd.limit(0), *tables).count() == 0
    assert [bytes(r.bytes) for r in prefix_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), tables[0]).collect()] == [b""]


def test_pairs_fit_as_merging_says(reference):
    v, _ = reference
    rng = random.Random(2)
    for most in (600, 4000, 50_000):
        for a, b in ((rng.randrange(most), rng.randrange(most)) for _ in range(4000)):
            assert v.fits(a, b) == (v.merge(v.tokens[a] + v.tokens[b]) == [v.tokens[a], v.tokens[b]])


def test_every_prefix_is_encoded_by_the_table(reference):
    from array import array

    v, tk = reference
    data = b"the quick internationalisation of xylophones, zzzzzzzz"
    data = data.replace(b" ", b"")
    last = array("i")
    for k in range(0, len(data), 7):
        v.extend(last, data[: k + 7])
    for k in range(1, len(data) + 1):
        assert v.walk(last[:k]) == tk._core_bpe.encode_single_piece(data[:k])


def test_edits_give_the_ids_of_the_new_text(spark, tables, reference):
    v, tk = reference
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("ab \n\t'sé1漢😀.-= l​") for _ in range(rng.randint(0, n)))
    for _ in range(400):
        held = prefix_bpe.Encoding(v, tables[1], some(40))
        for _ in range(4):
            i = rng.randint(0, len(held.text))
            held.replace(i, min(len(held.text), i + rng.randint(0, 5)), some(5))
            assert held.ids() == tk.encode_ordinary(held.text)
        held.append("  x")
        assert held.ids() == tk.encode_ordinary(held.text)
    long = "some words stand here " * 500
    edits = [(1, long, 5000, 5003, "XY"), (2, None, None, None, "new"), (3, "abc", 9, 2, None)]
    got = {r.doc_id: r for r in prefix_bpe.revise(spark.createDataFrame(edits, "doc_id long, text string, start long, stop long, new string"), *tables).collect()}
    assert got[1].ids == tk.encode_ordinary(long[:5000] + "XY" + long[5003:]) and got[1].kept > 1990
    assert got[2].ids == tk.encode_ordinary("new") and got[3].ids == tk.encode_ordinary("abc")


def ranked(docs, items, k=10):
    terms = lambda t: re.findall(ranked_search.TERM, "".join(c.lower() if c in ranked_search.UPPER else c for c in t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s:
                found.append((-s, -1 if i is None else i))
        out += [(item, r, None if i < 0 else i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "stride", "items"), [(ranked_search.SHARD, ranked_search.STRIDE, ranked_search.ITEMS), (40, 1, 3)])
def test_search_against_brute_force(spark, odd, texts, monkeypatch, shard, stride, items):
    monkeypatch.setattr(ranked_search, "ITEMS", items)
    asked = [(k, t) for k, t in enumerate(texts[:30])] + [(3, texts[3]), (None, "word"), (77, "a b c d e"), (78, "no such thing")]
    df = spark.createDataFrame(asked, "item_id long, text string")
    # many equal scores, which stand in order of id
    docs = odd.unionByName(spark.createDataFrame([row(900 - i, "a word of many") for i in range(40)], COLUMNS))
    got = sorted(map(tuple, ranked_search.search(docs, df, shard=shard, stride=stride).collect()), key=repr)
    assert got == ranked([(r.doc_id, r.text) for r in docs.collect()], asked)
    assert ranked_search.search(docs.limit(0), df).count() == ranked_search.search(docs, df.limit(0)).count() == 0


def test_threshold_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    docs, term = np.divmod(np.flatnonzero(rng.random(20_000 * 5) < 0.5), 5)
    used, sizes = np.unique(docs, return_counts=True)
    impact = (rng.pareto(1.0, len(term)) * 1000).astype(np.int64) + 1
    shard = ranked_search.Shard.make(used, sizes, term, impact, 5)
    none = np.zeros(0, np.int64)
    ids, scores, looked = shard.best(np.arange(5), 10, (none, none))
    every = np.add.reduceat(impact, np.cumsum(sizes) - sizes)
    order = np.lexsort((used, -every))[:10]
    assert ids.tolist() == used[order].tolist() and scores.tolist() == every[order].tolist()
    assert looked < len(used) / 5


def proven(rows):
    """The manifest in plain Python, from whole trees."""
    h = merkle_manifest.digest
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    lower = lambda t: t and "".join(c.lower() if c in merkle_manifest.UPPER else c for c in t)

    def tree(nodes):
        paths, runs = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            for first in range(0, len(nodes), 8):
                run = nodes[first : first + 8]
                for k in range(len(run)):
                    for i in runs[first + k]:
                        paths[i].append((run[:k], run[k + 1 :]))
            runs = [sum(runs[f : f + 8], []) for f in range(0, len(nodes), 8)]
            nodes = [h("".join(nodes[f : f + 8])) for f in range(0, len(nodes), 8)]
        return nodes[0], paths

    def fold(node, path):
        for left, right in path:
            node = h("".join([*left, node, *right]))
        return node

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        subroot, paths = trees[g]
        for (_, _, node, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            held = node if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 else leaf(r, lower(r.text))
            folded = fold(held, path + up)
            proof = h("".join("".join(left + right) for left, right in path + up))
            out.append((r.doc_id, node, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_manifest_against_whole_trees(spark, odd):
    assert sorted(map(tuple, merkle_manifest.manifest(odd).collect()), key=repr) == proven(odd.collect())
    assert merkle_manifest.manifest(odd.limit(0)).count() == 0
    one = odd.filter("doc_id = 5")
    assert sorted(map(tuple, merkle_manifest.manifest(one).collect()), key=repr) == proven(one.collect())


def test_manifest_of_several_tiers(spark):
    docs = spark.createDataFrame([row(i, f"Text {i}", None if i % 3 else "en") for i in range(1, 700)], COLUMNS).repartition(5)
    for height in (1, 2, 4):
        assert sorted(map(tuple, merkle_manifest.manifest(docs, height).collect()), key=repr) == proven(docs.collect())


@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_traversal_gives_each_path(height):
    for n in {1, 2, 7, 8, 9, 63, 64, 65, 300, 511, 512, 513, 4096} & set(range(1, 8**height + 1)):
        rows = [[merkle_manifest.digest(str(i)) for i in range(n)]]
        for _ in range(height):
            rows.append([merkle_manifest.digest("".join(rows[-1][f : f + 8])) for f in range(0, len(rows[-1]), 8)])
        walk = merkle_manifest.Traversal(rows[0].__getitem__, n, height)
        assert walk.top() == rows[-1][0]
        for k, path in enumerate(walk.paths()):
            want = []
            for level in range(height):
                at = k // 8**level
                run = rows[level][at // 8 * 8 : at // 8 * 8 + 8]
                want.append(run[: at % 8] + run[at % 8 + 1 :])
            assert path == want


@pytest.mark.parametrize("name", ["op12_threshold_search", "op13_merkle_manifest"])
def test_new_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_op11_on_the_table(spark, sf_dir, reference):
    _, tk = reference
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = {r.doc_id: r.n_tokens for r in queries.queries()["op11_prefix_bpe"](spark, sf_dir).collect()}
    assert got == {i: len(tk.encode_ordinary(t)) for i, t in texts.items()}
