"""Merge store against a dict, replacement by source, datasets with a manifest, vectors kept up to date, decoding, ids."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import vector_index
from parley.sources import datasets, importers, store
from parley.sources.store import Database

SCHEMA = "k long, part string, v string, seq int"


def test_batches_give_the_state_of_a_dict(spark, tmp_path):
    db, rng, want = Database(spark, str(tmp_path), buckets=7), random.Random(1), {}
    states = []
    for batch in range(3):
        rows = [(rng.choice([None, *range(30)]), rng.choice("ab"), f"{batch}-{i}", i) for i in range(40)]
        gone = [(rng.randrange(30),) for _ in range(5)]
        with db.commit() as tx:
            tx.create("t", spark.createDataFrame([], SCHEMA).schema, ["k", "part"], ["k"])
            tx.upsert("t", spark.createDataFrame(rows, SCHEMA), order="seq")
            tx.delete("t", spark.createDataFrame(gone, "k long"))
        for k, part, v, seq in rows:
            want[k, part] = (v, seq)
        want = {key: x for key, x in want.items() if (key[0],) not in gone}
        states.append(dict(want))
        assert db.version() == batch + 1
    for version, state in enumerate(states, 1):
        assert {(r.k, r.part): (r.v, r.seq) for r in db.read("t", version).collect()} == state
    with db.commit() as tx:
        tx.upsert("t", spark.createDataFrame([], SCHEMA))
        tx.delete("t", spark.createDataFrame([("b",)], "part string"))
    assert {r.part for r in db.read("t").collect()} == {"a"}


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    row = lambda v: spark.createDataFrame([(1, "a", v, 1)], SCHEMA)
    with db.commit() as tx:
        tx.create("t", row("").schema, ["k"])
        tx.upsert("t", row("old"))
    with pytest.raises(ValueError, match="stop"), db.commit() as tx:
        tx.upsert("t", row("new"))
        raise ValueError("stop")
    assert [r.v for r in db.read("t").collect()] == ["old"] and db.version() == 1
    with pytest.raises(FileExistsError), db.commit() as tx:
        tx.upsert("t", row("late"))
        with db.commit() as other:
            other.upsert("t", row("first"))
    assert [r.v for r in db.read("t").collect()] == ["first"] and db.version() == 2


def test_a_source_is_replaced_with_all_that_hangs_on_it(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    facts = lambda rows: spark.createDataFrame(rows, "message_id long, conversation_id string, source string, content string")
    photo = lambda rows: spark.createDataFrame(rows, "message_id long, place int, uri string")
    store.replace_sources(db, facts([(1, "i:a", "instagram", "old"), (2, "i:a", "instagram", "old too")]), {"photos": photo([(1, 0, "x.jpg"), (1, 1, "y.jpg")])})
    store.replace_sources(db, facts([(9, "w:a", "whatsapp", "kept")]), {"photos": photo([(9, 0, "z.jpg")])})
    scores = spark.createDataFrame([(1, 0.5), (9, 0.25)], "message_id long, compound double")
    times = spark.createDataFrame([("i:a", 5), ("w:a", 6)], "conversation_id string, latency long")
    with db.commit() as tx:
        tx.create("sentiment", scores.schema, ["message_id"])
        tx.upsert("sentiment", scores)
        tx.create("response_times", times.schema, ["conversation_id", "latency"])
        tx.upsert("response_times", times)
    store.replace_sources(db, facts([(3, "i:b", "instagram", "new")]), {"photos": photo([(3, 0, "n.jpg")])})
    assert {(r.message_id, r.content) for r in db.read("messages").collect()} == {(3, "new"), (9, "kept")}
    assert {r.uri for r in db.read("photos").collect()} == {"n.jpg", "z.jpg"}
    assert [r.message_id for r in db.read("sentiment").collect()] == [9] and [r.latency for r in db.read("response_times").collect()] == [6]


def test_fresh_and_stale(spark, tmp_path):
    db, root = Database(spark, str(tmp_path / "db")), str(tmp_path / "out")
    assert datasets.freshness(db) == {"last_import_at": None, "last_import_sources": [], "last_generate_at": None, "stale": False, "reason": None}
    datasets.record_import(db, ["instagram", "whatsapp"], "2024-01-01T00:00:00.000Z")
    assert datasets.freshness(db)["stale"] and datasets.freshness(db)["last_import_sources"] == ["instagram", "whatsapp"]
    datasets.Run(spark, root, "2024-01-02T00:00:00.000Z").publish(db)
    assert not datasets.freshness(db)["stale"]
    datasets.record_import(db, ["whatsapp"], "2024-01-03T00:00:00.000Z")
    assert datasets.freshness(db)["stale"]


def test_a_run_becomes_current_as_a_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert datasets.current(spark, root) is None
    rows = spark.createDataFrame([("é", 1), (None, 2)], "a string, b int")
    run = datasets.Run(spark, root)
    run.lines("rows", rows)
    run.document("few", rows)
    run.document("summary", {"n": 2, "name": "é"}, pretty=True)
    assert datasets.current(spark, root) is None
    run.publish()
    held = datasets.current(spark, root)
    assert set(held["datasets"]) == {"rows", "few", "summary"} and all(d["bytes"] for d in held["datasets"].values())
    read = lambda name: (tmp_path / held["datasets"][name]["path"]).read_text()
    assert json.loads(read("few")) == [{"a": "é", "b": 1}, {"a": None, "b": 2}] and ": " not in read("few") and "\n  " in read("summary")
    assert sorted(map(str, datasets.read_lines(spark, root, "rows", "a string, b int").collect())) == sorted(map(str, rows.collect()))
    monkeypatch.setattr(datasets, "MOST", 1)
    with pytest.raises(ValueError, match="more than"):
        datasets.Run(spark, root).document("few", rows)
    assert datasets.current(spark, root) == held
    monkeypatch.setenv(datasets.FOLDER, str(tmp_path / "elsewhere"))
    datasets.Run(spark).publish()
    assert datasets.current(spark, str(tmp_path / "elsewhere"))["datasets"] == {}


PAIR = "persona string, partner string, conversation_id string, source string, context string, reply string, with_you boolean"


def test_two_runs_share_no_pair(spark, tmp_path):
    root = str(tmp_path)
    pairs = spark.createDataFrame([("Sam", "Ann", "c", "instagram", f"context {i}", f"reply {i}", i % 2 == 0) for i in range(6)], PAIR)
    first = datasets.Run(spark, root)
    assert datasets.unused(pairs, datasets.read_lines(spark, root, "few_shot", datasets.KEYS)).count() == 6
    first.lines("few_shot", pairs.filter("context < 'context 3'").select("persona", F.concat(F.lit(" "), "context").alias("context"), "reply"))
    first.lines("styles", spark.createDataFrame([("Sam", "You are Sam.")], "persona string, style string"))
    first.publish()
    rest = datasets.unused(pairs, datasets.read_lines(spark, root, "few_shot", datasets.KEYS))
    assert {r.context for r in rest.collect()} == {"context 3", "context 4", "context 5"}
    second = datasets.Run(spark, root)
    datasets.export_fine_tune(second, rest, "Ann", datasets.read_lines(spark, root, "styles", "persona string, style string"))
    second.publish()
    held = datasets.current(spark, root)["datasets"]
    lines = [json.loads(x) for f in (tmp_path / held["fine_tune"]["path"]).glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 3 and lines[0]["messages"][0] == {"role": "system", "content": "You are Sam."} and set(lines[0]["meta"]) == {"sender", "conversation_id", "source", "with_you"}
    meta = json.loads((tmp_path / held["fine_tune.meta"]["path"]).read_text())
    assert (meta["examples"], meta["senders"], meta["account_holder"]) == (3, 1, "Ann") and "3 chats of 1 people" in (tmp_path / held["FINE_TUNE.md"]["path"]).read_text()
    plain = datasets.fine_tune_rows(rest).first().messages[0].content
    assert plain == "You are Sam texting. Match their style exactly. Reply with only the message text."


def test_the_second_run_makes_only_new_vectors(spark, tmp_path):
    row = lambda i, s, t, sys=False: (i, s, t, i, sys)
    rows = [row(i, "a", f"some words {i}") for i in range(25)] + [row(100 + i, "b", "too few messages") for i in range(5)] + [row(200, "a", "short"), row(201, "a", None), row(202, "a", "a long notice", True)]
    m = lambda more=(): spark.createDataFrame([*rows, *more], "message_id long, sender string, content string, timestamp_ms long, is_system boolean")
    db, asked = Database(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def embedder(texts):
        asked.add(len(texts))
        return vector_index.hashed(texts)

    vector_index.update(db, m(), embedder, model="one")
    assert sorted(r.message_id for r in db.read("embeddings").collect()) == list(range(25))
    before = asked.value
    vector_index.update(db, m([row(300, "a", "words that are new")]), embedder, model="one")
    assert db.read("embeddings").count() == 26 and asked.value - before <= 4  # one text, and once more where a plan is run again
    vector_index.update(db, m(), embedder, model="two")
    assert {(r.model, r.dims) for r in db.read("embeddings").select("model", "dims").distinct().collect()} == {("two", vector_index.DIMS)}

    def failing(texts):
        raise OSError("no service")

    vector_index.update(db, m(), failing, model="three")
    assert db.read("embeddings").count() == 0


def test_a_batch_is_made_once(spark, tmp_path):
    db, asked = Database(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def embedder(texts):
        asked.add(len(texts))
        return vector_index.hashed(texts)

    m = lambda n: spark.createDataFrame([(i, "a", f"some words {i}", i, False) for i in range(n)], "message_id long, sender string, content string, timestamp_ms long, is_system boolean")
    for n in (40, 60, 61):
        vector_index.update(db, m(n), embedder)
        rows = [r.message_id for r in db.read("embeddings").collect()]
        assert sorted(rows) == list(range(n)) and asked.value == n


def test_rows_of_an_import_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(name):
        made.add(1)
        return name

    chat = F.udf(counted, "string")(F.col("conversation_id"))
    none = F.array().cast("array<struct<uri:string,creation_timestamp:long>>")
    m = spark.createDataFrame([(f"messenger:c{i % 3}", "a", i, f"text {i}", "messenger") for i in range(30)], "conversation_id string, sender string, timestamp_ms long, content string, source string")
    m = m.withColumn("conversation_id", chat).withColumns({k: none for k in ("photos", "videos", "audio_files")}).withColumn("reactions", F.array().cast("array<struct<reaction:string,actor:string>>"))
    db = Database(spark, str(tmp_path))
    importers.load(db, m)
    assert sorted(r.message_id for r in db.read("messages").collect()) == list(range(1, 31)) and made.value == 30
    assert db.files.names(f"{db.root}/staged") == []


def test_texts_are_decoded_at_any_depth(spark):
    spell = lambda t: "".join(f"{chr(92)}u{b:04x}" for b in t.encode())
    said, meant = f"don{spell('’')}t", "don’t"
    rows = [(said, 42, True, [said, None], {"k": said}, (said, [(said, 1.5)]), None), (None, None, None, None, None, None, said)]
    schema = "t string, n int, b boolean, a array<string>, m map<string,string>, s struct<x: string, y: array<struct<z: string, w: double>>>, u string"
    df = spark.createDataFrame(rows, schema)
    got = importers.decode_all(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    one, two = sorted(got.collect(), key=lambda r: r.t is None)
    assert (one.t, one.n, one.b, one.a, one.m, one.s.x, one.s.y[0].z, one.s.y[0].w, one.u) == (meant, 42, True, [meant, None], {"k": meant}, meant, meant, 1.5, None)
    assert tuple(two) == (None, None, None, None, None, None, meant)
    cases = {said: True, spell("😀"): True, "don't": False, f"{chr(92)}u0041": False, "": False, None: False}
    found = spark.createDataFrame([(k,) for k in cases], "t string").select("t", importers.looks_encoded(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in found} == cases


def test_ids_are_gapless_whatever_the_conversations_hash_to(spark, monkeypatch):
    monkeypatch.setattr(importers, "ID_BUCKETS", 2)  # so that conversations share a bucket
    rows = [(f"c{i % 5}", "ab"[i % 2], (i * 7919) % 50 * 86_400_00, f"t{i}") for i in range(400)] + [(None, "a", 1, "x"), ("c1", "a", None, "no time")]
    got = importers.with_ids(spark.createDataFrame(rows, "conversation_id string, sender string, timestamp_ms long, content string").repartition(4)).collect()
    assert sorted(r.message_id for r in got) == list(range(1, len(rows) + 1))
    by = sorted(got, key=lambda r: r.message_id)
    for c in ("c0", "c3", None):
        mine = [(r.timestamp_ms or -1, r.sender, r.content) for r in by if r.conversation_id == c]
        assert mine == sorted(mine)


def test_chat_files_of_the_usual_name_and_dots_in_dates(spark, tmp_path):
    (tmp_path / "x").mkdir()
    lines = ["31.12.23, 22:30 - Ann: hello", "31.12.2023, 22:31 - Ann: you left it here", "more"] + ["line"] * 5
    (tmp_path / "x" / "_chat.txt").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    (tmp_path / "other.txt").write_text("[12/31/23, 10:30:45 PM] Bob: sticker omitted\n", encoding="utf-8")
    rows = sorted(importers.chat_text(spark, str(tmp_path)).collect(), key=lambda r: r.timestamp_ms)
    assert [(r.sender, r.is_system) for r in rows] == [("Ann", False), ("Bob", True), ("Ann", True)]
    assert rows[2].content == "you left it here\nmore" + "\nline" * 5 and rows[0].conversation_id == "whatsapp:WhatsApp Chat"
    from parley.sources import exports

    assert ("x", "whatsapp") in {(r.path.split("/")[-2], r.platform) for r in exports.files(spark, str(tmp_path)).collect()}
    assert any("_chat.txt" in r.candidate or r.candidate == "x" for r in exports.discover(spark, str(tmp_path)).collect())
