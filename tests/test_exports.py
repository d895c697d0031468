"""Exports of text blocks, platforms and candidates of a folder, and the cleaning of texts."""

import os

from pyspark.sql import functions as F

from parley.functions import clean
from parley.sources import exports

BLOCKS = """Jan 05, 2024  9:03:07 AM (Read by you after 3 minutes)
Ann
hello
there

Jan 05, 2024 12:00:00 PM
Bob
attachments/IMG_1.heic
Tapbacks:
Loved by Ann

Jan 05, 2024 12:30:00 PM Ann named the conversation "x"

Jan 06, 2024 12:00:01 AM
Bob
Mum added Zed to the conversation.

Feb 29, 2024 11:59:59 PM
Me
clip.mov
with words
Mar  1, 2024  1:00:00 AM
Me

lost body
Mar  1, 2024  1:00:01 AM
Ann
Liked by Bob
last
"""


def test_block_text(spark, tmp_path):
    (tmp_path / "family").mkdir()
    (tmp_path / "family" / "Ann & Bob.txt").write_text(BLOCKS.replace("\n", "\r\n"))
    (tmp_path / "whatsapp.txt").write_text(BLOCKS)
    (tmp_path / "notes.txt").write_text("Jan 05, 2024 9:03:07 AM\nAnn\nonly one line of time\n")
    (tmp_path / "empty.txt").write_text("")
    rows = exports.block_text(spark, str(tmp_path)).orderBy("timestamp_ms").collect()
    at = lambda s: spark.sql(f"select unix_millis(timestamp'{s}')").first()[0]
    assert [(r.sender, r.content, r.has_photos, r.has_videos) for r in rows] == [("Ann", "hello\nthere", False, False), ("Bob", "[attachment: IMG_1.heic]", True, False), ("Me", "clip.mov\nwith words", False, True), ("Ann", "last", False, False)]
    assert [r.timestamp_ms for r in rows] == [at(s) for s in ("2024-01-05 09:03:07", "2024-01-05 12:00:00", "2024-02-29 23:59:59", "2024-03-01 01:00:01")]
    assert {(r.conversation_id, r.source, r.is_system) for r in rows} == {("imessage:family/Ann & Bob", "imessage", False)}


def test_platforms_and_candidates(spark, tmp_path):
    def put(name, text, age):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        os.utime(p, (1_700_000_000 - age, 1_700_000_000 - age))

    put("a/blocks.txt", BLOCKS, 0)
    put("b/message_1.json", "{}", 0)
    put("c/chat.txt", "x", 0)
    put("d/notes.txt", "x", 0)
    first = lambda p: [r.platform for r in exports.platform(spark, str(tmp_path / p)).collect()]
    assert [first(p) for p in "abcd"] == [["imessage"], ["meta"], ["whatsapp"], []]
    assert first("") == ["imessage"]
    put("e/chat.db", "x", 0)
    assert first("") == ["imessage_db"]
    put("old.zip", "x", 900)
    put("older instagram.zip", "x", 1050)
    found = exports.discover(spark, str(tmp_path)).collect()
    base = 1_700_000_000_000
    assert {r.candidate: r.score - base for r in found} == {"a": 0, "b": 0, "c/chat.txt": 500_000, "e/chat.db": 500_000, "old.zip": 100_000, "older instagram.zip": 50_000}
    assert [r.candidate for r in found] == ["c/chat.txt", "e/chat.db", "old.zip", "older instagram.zip", "a", "b"]


def test_cleaning(spark):
    cases = {"Ã©tÃ©": "été", "plain\x00 text\x7f": "plain text", "ﬁne ½ 😂": "fine 1⁄2 😂", "café": "café", "&lt;b&gt;": "<b>", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", clean.cleaned("t").alias("u")).collect()} == cases
    cases = {"Don't re-do 12 a http://x.y/z it 😂": ["don't", "re-do", "it"], "w" * 200: ["w" * 128], "": [], None: [], "Tom &amp; Jerry_1": ["tom", "jerry_1"], "ItÃ©m": ["itém"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", clean.cleaned_words(F.col("t")).alias("u")).collect()} == cases
