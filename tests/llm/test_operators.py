"""The text operators against brute force, round trips and held-out accuracy, and on odd tables."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from parley.llm import compression_toxicity, decontamination, labelled, license_scan, packing, parity_join, quality_model, quality_rules, queries, sentence_spans, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, sig string, n int"
BASE = " ".join(random.Random(1).choice("the of and some quite different words stand here today maybe é".split()) for _ in range(400))
ODD = [(1, BASE), (1, BASE), (2, BASE), (3, None), (4, ""), (None, "a null id"), (5, BASE[:900] + "X. " + BASE[900:]), (6, "word"), (7, "ab " * 5000), (8, " \n\t ")]


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(ODD)], SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_quality_rules"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_templates_accept_optional_and_replaceable_words(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "licensed under the apache license 2.0", "licensed under an apache license 2.0", "This nice little work is licensed under the GNU General Public License, version 3"]
    got = [r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["apache,apache-2.0", "apache,apache-2.0", "apache", "gpl,gpl-notice"]


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()).collect()
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    t, by = Tokenizer.from_file(tokenizer_path()), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.start)
        assert pieces[0].doc_tokens == len(ids) == sum(p.length for p in pieces)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, sf_dir, k, percent):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    sets = {}
    for i, text in docs:
        w = text.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = parity_join.join(spark.createDataFrame(docs, "doc_id long, text string"), parity_join.Rule(k, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root(i)) for i in sets}


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(0, BASE), (1, BASE[:700] + "X" + BASE[700:]), (2, "a" * 900), (3, "ab" * 450), (4, BASE[100:500]), (5, BASE[100:499]), (6, None), (7, ""), (8, BASE), (9, "q" + BASE[300:900] + "z" + BASE[300:900])]
    for k in range(10, 24):
        p = rng.randrange(len(BASE))
        docs.append((k, BASE[:p] + rng.choice("XYZ") + BASE[p + rng.randint(0, 3) :]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: x for (i, _), x in zip(docs, suffix_dedup.brute([t for _, t in docs]), strict=True)}


def test_sentence_spans_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    want = sentence_spans.brute(docs)
    got = sentence_spans.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got} == {i: (len(x), sum(x)) for i, x in want.items()}


def test_sentence_spans_find_passages_of_few_sentences(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for i in range(0, 80, 2):
        # 60 words from inside one sentence into the next: at most one sentence of it is whole
        passage = f"{text(25)}. {text(35)}" if i % 4 else text(60)
        docs += [(i + k, f"{text(10)}. {text(7 + k)} {passage} {text(9 - k)}. {text(12)}.") for k in (0, 1)]
    got = {r.doc_id: r.n_removed_bytes for r in sentence_spans.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert not any(got[i] for i in range(0, 80, 2))
    assert sum(got[i] > 0 for i in range(1, 80, 2)) >= 36 and sum(got[i] for i in range(1, 80, 2)) >= 40 * 60 * 7 // 2


def test_decontamination_finds_planted_items(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    docs += [(10_000 + i, f"{docs[i][1][:300]} {t} {docs[i][1][300:600]}") for i, t in items]
    got = decontamination.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(10_000 + i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}


def test_decontamination_of_cut_and_replaced_items_against_brute_force(spark, sf_dir):
    rng = random.Random(2)
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist() if len(r["text"].split()) >= 25][:40]
    items.append((-1, " ".join(f"long{k}" for k in range(90))))  # does not fit 64 bits
    cuts = [lambda w: w[:-6], lambda w: w[: 7 * len(w) // 10], lambda w: w[6:], lambda w: [v if rng.random() > 0.2 else "qqq" for v in w]]
    planted = []
    for n, cut in enumerate(cuts):
        for i, text in items:
            around = docs[(7 * n + i) % len(docs)][1].split()
            planted.append(((n + 1) * 100_000 + i, " ".join([*around[:50], *cut(text.split()), *around[50:90]])))
    docs = docs[:60] + planted
    got = {(r.doc_id, r.item_id) for r in decontamination.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == decontamination.brute(docs, items)
    assert {(n * 100_000 + i, i) for n in (1, 2, 3) for i, _ in items} <= got
    assert sum((400_000 + i, i) in got for i, _ in items) >= 0.9 * len(items)


@pytest.mark.parametrize(("module", "label", "folds", "held", "least"), [(quality_model, "quality", 4, 2, 0.95), (compression_toxicity, "toxic", 3, 1, 0.85)])
def test_held_out_accuracy(spark, module, label, folds, held, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.fit(docs, labels, label, labelled.fold("doc_id", folds) != held)
    got = module.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model, folds, held).filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert sum(a == b for a, b in got) / len(got) >= least


def test_minimax_capacity(spark):
    sizes = [random.Random(5).randint(1, 5000) for _ in range(800)]
    ends = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame([(i // 50, s, e) for i, (s, e) in enumerate(zip(sizes, ends, strict=True))], "block int, bytes long, end long")
    cuts = sharding.minimax_cuts(groups, 16)

    def shards(capacity):
        n, held = 1, 0
        for s in sizes:
            n, held = (n + 1, s) if held + s > capacity else (n, held + s)
        return n

    best = max(b - a for a, b in zip([0, *cuts], cuts, strict=False))
    assert cuts[-1] == ends[-1] and shards(best) <= 16 < shards(best - 1)


def every(spark, df):
    bench = spark.createDataFrame([(1, BASE[50:250]), (2, None)], "item_id long, text string")
    none_labelled = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    yield license_scan.scan(df)
    yield decontamination.hits(df, bench)
    yield parity_join.join(df)
    yield packing.pack(df, tokenizer_path())
    yield quality_rules.apply_rules(df)
    yield sentence_spans.digest(sentence_spans.dedup(df))
    yield suffix_dedup.digest(df)
    yield sharding.shard(df)
    for module, label in ((quality_model, "quality"), (compression_toxicity, "toxic")):
        yield module.score(df, module.fit(df, none_labelled, label, labelled.fold("doc_id", 4) != 2), 4, 2)


def test_odd_rows_have_results(spark, odd):
    rows = [x.count() for x in every(spark, odd)]
    assert rows[0] == len(ODD) and rows[1] > 0 and rows[2] == len(ODD) and rows[3] > len(ODD) and rows[4:] == [len(ODD)] * 6


def test_empty_tables_give_empty_tables(spark, none):
    assert [x.count() for x in every(spark, none)] == [0] * 10


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
