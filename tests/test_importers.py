"""Importers on small exports, text repair, replacement by source, and streams against batch."""

import json

from pyspark.sql import functions as F

from parley import streaming
from parley.operators import ordered
from parley.sources import importers
from parley.sources.adapters import messages_from_events


def test_json_export(spark, tmp_path):
    latin = "café ❤".encode().decode("latin-1")
    d = tmp_path / "instagram" / "inbox" / "bob_1"
    d.mkdir(parents=True)
    rows = [
        {"sender_name": "Bob", "timestamp_ms": 2, "photos": [{"uri": "a.jpg", "creation_timestamp": 1}]},
        {"sender_name": "Ann", "timestamp_ms": 1, "content": latin, "reactions": [{"reaction": "❤".encode().decode("latin-1"), "actor": "Bob"}]},
        {"sender_name": None, "timestamp_ms": 3, "content": "no sender"}, {"sender_name": "Ann", "timestamp_ms": 4, "content": "gone", "is_unsent": True}, {"sender_name": "Ann", "timestamp_ms": 5, "content": "call", "type": "Call"},
    ]
    (d / "message_1.json").write_text(json.dumps({"messages": rows}))
    got = {r.timestamp_ms: r for r in importers.json_export(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert (got[2].content, got[2].is_system, got[2].has_photos) == ("Bob sent 1 photo", True, True)
    assert (got[1].content, got[1].reactions[0].reaction, got[1].is_system) == ("café ❤", "❤", False)
    assert [r.timestamp_ms for r in importers.folder_messages(spark, str(tmp_path), "bob_1").collect()] == [1, 2, 4, 5] and importers.folder_messages(spark, str(tmp_path), "other").count() == 0
    assert {r.uri for r in importers.attachments(importers.with_ids(importers.json_export(spark, str(tmp_path))))["photos"].collect()} == {"a.jpg"}
    assert got[4].content is None and got[5].is_system and got[1].conversation_id == "instagram:bob_1"


def test_chat_text(spark, tmp_path):
    (tmp_path / "WhatsApp Chat with Ann.txt").write_text(
        "15/03/24, 10:30:45 - Messages and calls are end-to-end encrypted\n15/03/24, 10:30:45 - Ann: hello\nand more\n[3/25/2024, 1:05 PM] Bob: ok: fine\n‎[26/03/2024, 01:05:09] Ann: image omitted\n", encoding="utf-8"
    )
    rows = importers.chat_text(spark, str(tmp_path)).orderBy("timestamp_ms", "sender").collect()
    at = lambda s: spark.sql(f"select unix_millis(timestamp'{s}')").first()[0]
    assert [(r.sender, r.content, r.is_system) for r in rows] == [("Ann", "hello\nand more", False), ("System", "Messages and calls are end-to-end encrypted", True), ("Bob", "ok: fine", False), ("Ann", "image omitted", True)]
    assert [r.timestamp_ms for r in rows] == [at("2024-03-15 10:30:45")] * 2 + [at("2024-03-25 13:05:00"), at("2024-03-26 01:05:09")]
    assert {r.conversation_id for r in rows} == {"whatsapp:Ann"}


def test_text_repair(spark):
    cases = {"Ã©tÃ©": "été", "plain": "plain", "já €": "já €", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", importers.repair(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == cases
    spell = lambda t: "".join(f"{chr(92)}u{b:04x}" for b in t.encode())
    df = spark.createDataFrame([(f"a{spell('é')}b {spell('😂')}",), ("none",)], "t string").select(importers.unescape(F.col("t")).alias("u"))
    assert [r.u for r in df.collect()] == ["aéb 😂", "none"]


def test_replace_by_source(spark, tmp_path):
    path = str(tmp_path / "m")
    row = lambda s, c: spark.createDataFrame([(c, s)], "content string, source string")
    for s, c in (("instagram", "old"), ("whatsapp", "w"), ("instagram", "new")):
        importers.replace_by_source(row(s, c), path)
    assert {(r.source, r.content) for r in spark.read.parquet(path).collect()} == {("instagram", "new"), ("whatsapp", "w")}


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    m = messages_from_events(spark, sf_dir).select("conversation_id", "sender", "timestamp_ms", "ts", "message_id")
    m.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    for name, made in (("activity", streaming.activity(live, "60 days")), ("bursts", streaming.bursts(live, late="60 days"))):
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    want = m.groupBy("conversation_id", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("message_count"))
    assert sorted(map(tuple, spark.table("activity").select("conversation_id", "start", "message_count").collect())) == sorted(map(tuple, want.collect()))
    columns = ["conversation_id", "message_count", "start_ms", "end_ms"]
    assert sorted(map(tuple, spark.table("bursts").select(columns).collect())) == sorted(map(tuple, ordered.gap_islands(m, 300_000).select(columns).collect()))
