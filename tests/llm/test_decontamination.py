"""Decontamination: short items, rows without ids, clashing columns."""

from parley.llm import decontamination

ITEMS = [(1, "what is the tallest mountain on earth"), (2, "two words"), (3, "one short item of exactly nine words stands here"), (4, None), (5, "")]
DOCS = [
    (1, "what is the tallest mountain on earth"), (2, "before it: What is the tallest mountain on Earth? and after it some more words"), (3, "the tallest mountain on earth is what"),
    (4, "two words"), (5, "not only two words but more"), (None, "see: one short item of exactly nine words stands here"), (None, "a clean text without an id"), (1, "another text of the first id"), (7, None), (8, ""),
]


def test_short_items_match_whole(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.hits(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (None, 3)} == decontamination.brute(DOCS, ITEMS)


def test_rows_are_judged_by_their_own_text(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, __bad int, row int")
    out = decontamination.keep_clean(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, (DOCS[i] for i in (2, 4, 6, 7, 8, 9))))
