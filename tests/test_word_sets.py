"""Likeness of senders by their words: classes of equal sets, pairs of classes."""

from parley.operators.statements import apply


def test_pairs_of_classes_and_members_give_every_pair(spark):
    sets = {f"a{i:02}": {"one", "two"} for i in range(40)} | {f"b{i:02}": {"two", "three", "four"} for i in range(40)} | {"c": {"five"}, "d": {"one"}}
    rows = [("whatsapp:group_1", s, w) for s, ws in sets.items() for w in ws] * 2 + [("whatsapp:group_2", "a00", "five")]
    got = apply("set06_jaccard", spark, w=spark.createDataFrame(rows, "conversation_id string, sender string, word string")).collect()
    assert len(got) == len(sets) + 2
    rep = {r.s2: r.s1 for r in got if r.kind == "same"}
    likeness = {(r.s1, r.s2): r.jaccard for r in got if r.kind == "pair"}
    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
            a, b = sorted((rep[x], rep[y]))
            assert round(both, 6) == (1 if a == b else likeness.get((a, b), 0))
