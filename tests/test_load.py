"""Imports into the keyed store: ids go on, a source replaces itself with its children, others stay."""

from __future__ import annotations

import os

from parley.sources import importers
from parley.sources.store import Database

ITEM = "array<struct<uri: string, creation_timestamp: bigint>>"
SCHEMA = f"path string, sender_name string, timestamp_ms bigint, content string, type string, is_unsent boolean, photos {ITEM}, videos {ITEM}, audio_files {ITEM}, share struct<link: string, share_text: string>, reactions array<struct<reaction: string, actor: string>>"


def _raw(spark, app: str, rows: list[tuple]):
    photos = lambda n: [(f"{i}.jpg", i) for i in range(n)]
    data = [(f"/export/{app}/inbox/ann_1/message_1.json", "Ann", ms, text, None, False, photos(n), None, None, None, [("❤", "Bob")] if n else None) for ms, text, n in rows]
    return importers.normalized(spark.createDataFrame(data, SCHEMA))


def test_load_replaces_a_source_and_numbers_on(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), buckets=2)
    # equal rows of one time differ in their children only
    importers.load(db, _raw(spark, "instagram", [(1, None, 1), (1, None, 2), (2, "hi there", 0), (None, "no time", 1)]))
    first = db.read("messages").collect()
    assert sorted(r.message_id for r in first) == [1, 2, 3]
    assert sorted(r.content for r in first) == ["Ann sent 1 photo", "Ann sent 2 photos", "hi there"]
    per = {r.message_id: r["count"] for r in db.read("photos").groupBy("message_id").count().collect()}
    assert {r.content: per.get(r.message_id, 0) for r in first} == {"Ann sent 1 photo": 1, "Ann sent 2 photos": 2, "hi there": 0}
    importers.load(db, _raw(spark, "facebook", [(5, None, 3)]))
    both = db.read("messages").collect()
    assert len({r.message_id for r in both}) == len(both) == 4 and max(r.message_id for r in both) == 4
    importers.load(db, _raw(spark, "instagram", [(9, "only this", 0)]))
    last = {r.content: r.message_id for r in db.read("messages").collect()}
    assert set(last) == {"Ann sent 3 photos", "only this"} and len(set(last.values())) == 2
    assert {r.message_id for r in db.read("photos").collect()} == {last["Ann sent 3 photos"]} == {r.message_id for r in db.read("reactions").collect()}
    version = db.version()
    importers.load(db, _raw(spark, "facebook", []))
    assert db.version() == version and not os.listdir(tmp_path / "db" / "staged")
