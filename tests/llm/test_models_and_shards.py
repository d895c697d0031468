"""Trained models on odd texts, whole licences, and every column of the sharding."""

import zlib

import pytest

from parley.llm import compression_toxicity, labelled, license_scan, quality_model, sharding


@pytest.mark.parametrize(("module", "label", "folds", "held"), [(quality_model, "quality", 4, 2), (compression_toxicity, "toxic", 3, 1)])
def test_trained_models_on_odd_texts(spark, module, label, folds, held):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    both = labels.limit(5).withColumn(label, 1 - labels[label])
    model = module.fit(docs, labels.unionByName(both), label, labelled.fold("doc_id", folds) != held)
    odd = [(1, None), (1, ""), (2, " \n "), (None, "a text"), (None, "a text"), (3, "x" * 3_000_000), (4, "the same sentence again. " * 100_000)]
    rows = module.score(spark.createDataFrame(odd, "doc_id long, text string"), model, folds, held).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert not any(r.predicted for r in rows if r.doc_id == 1 or r.doc_id == 2)
    assert len({r.score for r in rows if r.doc_id is None}) == 1
    fold = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % folds == held
    assert all(r.held_out == fold(r.doc_id) for r in rows)


def test_every_column_of_the_sharding(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(90_000 + i, "the same text many times") for i in range(500)] + [(None, None), (None, ""), (7, None), (7, "é")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16).collect()
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by, places = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        places.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert set(by) <= set(range(16)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert all(len(s) == 1 for k, s in places.items() if k[1] > 1)
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    assert max(sizes) <= sum(sizes) / 16 + max(groups.values())


def test_whole_licences(spark):
    body = dict(license_scan.TEMPLATES)["mit-full"].replace("<<var:6>>", "software and associated documentation files").replace("<<optional>>including the next paragraph<<end>> ", "")
    texts = [f"Copyright X. {body}. End", body.replace("merge", "move"), body.replace(" or substantial portions", "")]
    got = [r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["mit-full,mit-text", "mit-text", "mit-text"]


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(7, f"text {i}") for i in range(20_001)] + [(i, "other") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), *((i, i % 2) for i in range(20, 60))], "doc_id long, quality int")
    found = labelled.sample(docs, labels, "quality", labelled.fold("doc_id", 4) >= 0, per_class=30).collect()
    assert len(found) == 41 and [r.text for r in found if r.text.startswith("text")] == ["text 0"]
