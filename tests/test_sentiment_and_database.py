"""Lexicon sentiment on published examples, and a message database."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from parley.functions import sentiment
from parley.sources import message_db

LEXICON = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "sux": -1.5, "horrible": -2.5, "great": 3.1}
# Published examples of the rules with their scores.
KNOWN = [
    ("VADER is smart, handsome, and funny.", 0.8316, 0.746, 0.0, 0.254), ("VADER is smart, handsome, and funny!", 0.8439, 0.752, 0.0, 0.248),
    ("VADER is very smart, handsome, and funny.", 0.8545, 0.701, 0.0, 0.299), ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227, 0.754, 0.0, 0.246),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342, 0.767, 0.0, 0.233), ("VADER is not smart, handsome, nor funny.", -0.7424, 0.0, 0.646, 0.354),
    ("The book was good.", 0.4404, 0.492, 0.0, 0.508), ("Today SUX!", -0.5461, 0.0, 0.779, 0.221), ("At least it isn't a horrible book.", 0.431, 0.363, 0.0, 0.637),
]


@pytest.mark.parametrize("known", KNOWN)
def test_published_examples(known):
    assert sentiment.judge(known[0], LEXICON) == known[1:]


def test_sentiment_of_rows(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("".join(f"{w}\t{v}\t0.5\n" for w, v in LEXICON.items()) + "broken line\n\n")
    lexicon = sentiment.read_lexicon(spark, str(tmp_path / "lexicon.txt"))
    m = spark.createDataFrame([(1, "The book was good.", False), (2, "The book was good.", True), (3, None, False), (4, " ", None), (5, "good but horrible", None)], "id int, content string, sys boolean")
    got = {r.id: r for r in sentiment.with_sentiment(m, lexicon, skip=F.col("sys")).collect()}
    assert (got[1].compound, got[1].pos) == (0.4404, 0.492)
    assert all((got[i].compound, got[i].pos, got[i].neg, got[i].neu) == (0, 0, 0, 1) for i in (2, 3, 4))
    assert got[5].compound < 0
    assert sentiment.with_sentiment(m.limit(0), lexicon).count() == 0


def test_message_database(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chat.db")
    db = sqlite3.connect(path)
    db.executescript("""create table chat (chat_identifier text, display_name text); create table handle (id text); create table chat_message_join (chat_id integer, message_id integer);
        create table message (text text, attributedBody blob, date integer, is_from_me integer, handle_id integer, is_system_message integer, item_type integer);""")
    assert message_db.messages(spark, path).count() == 0
    db.executemany("insert into chat values (?, ?)", [("+491", None), ("chat9", " Friends "), (None, "")])
    db.execute("insert into handle values ('+491 ')")
    archived = b"\x04\x0bstreamtyped\x81\xe8\x03\x01NSAttributedStringNSObject\x01+\x05a longer hidden text here\x86\x02__kIMMessagePart"
    rows = [
        (" hi ", None, 5 * 10**17, 0, 1, 0, 0), (None, archived, 600_000_000, 1, 0, 0, 0), ("", None, None, 0, 7, 0, 0),
        ("Loved “hi”", None, 5 * 10**11, 0, 1, 0, 0), ("named", None, 5 * 10**14, 0, 1, 0, 2), ("in no chat", None, 1, 0, 1, 0, 0), ("x", None, 0, 0, None, 1, None),
    ]
    db.executemany("insert into message values (?, ?, ?, ?, ?, ?, ?)", rows)
    db.executemany("insert into chat_message_join values (?, ?)", [(1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 7)])
    db.commit()
    db.close()
    monkeypatch.setattr(message_db, "RANGE", 2)
    e = message_db.EPOCH_MS
    # a byte that is not UTF-8 stays in an archived text as the replacement sign
    got = sorted((r.conversation_id, r.sender, r.timestamp_ms, r.content, r.is_system) for r in message_db.messages(spark, path).collect() if r.content)
    assert got == [
        ("imessage:+491", "+491", 5 * 10**11 + e, "hi", False), ("imessage:+491", "Me", 600_000_000_000 + e, "a longer hidden text here\ufffd", False),
        ("imessage:Friends", "+491", 5 * 10**11 + e, "Loved “hi”", True), ("imessage:Friends", "+491", 5 * 10**11 + e, "named", True), ("imessage:chat_3", "Unknown", 0, "x", True),
    ]
    empty = message_db.messages(spark, path).filter("content is null").collect()
    assert [(r.sender, r.timestamp_ms, r.is_system) for r in empty] == [("Unknown", 0, False)]
