"""Relationship cards at size: others ranked once for each set of chats, the newest lines taken in parts."""

import random

from pyspark.sql import functions as F

from parley.operators import relationships

SCHEMA = "message_id long, conversation_id string, sender string, content string, timestamp_ms long, is_system boolean"


def _chats(seed):
    rng = random.Random(seed)
    rows, people = [], [f"p{i}" for i in range(30)] + ["me"]
    for c in range(6):
        members = rng.sample(people, 26)
        rows += [(f"c{c}", rng.choice(members)) for _ in range(150)] + ([(f"c{c}", "me")] if c % 3 else [])
    return [(i, c, who, f"line {i}", 1000 - i // 2, i % 17 == 0) for i, (c, who) in enumerate(rows)]


def test_talkative_others_of_every_persona(spark):
    rows = _chats(4)
    plain = [(c, who) for _, c, who, _, _, system in rows if not system]
    mine = {c for c, who in plain if who == "me"}
    want = {}
    for p in {who for _, who in plain} - {"me"}:
        chats = {c for c, who in plain if who == p} & mine
        n = {}
        for c, who in plain:
            if c in chats and who not in (p, "me"):
                n[who] = n.get(who, 0) + 1
        best = sorted((-k, who) for who, k in n.items() if k >= 3)[: relationships.OTHERS]
        want |= {(p, who): True for _, who in best}
    m, me = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("me",)], "sender string")
    got = [(r.persona, r["name"]) for r in relationships.talkative(m, me).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)


def test_newest_lines_are_taken_in_parts(spark, monkeypatch):
    rows = _chats(5)
    monkeypatch.setattr(relationships, "LINES", 9)
    m, me = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("me",)], "sender string")
    mine = {c for _, c, who, _, _, system in rows if who == "me" and not system}
    want = set()
    for p in {r[2] for r in rows} - {"me"}:
        of = sorted(((-t, -i) for i, c, who, _, t, system in rows if who == p and c in mine and not system))[:9]
        want |= {(p, -i) for _, i in of} if len(of) >= relationships.LEAST else set()
    found = relationships.lines(m, me)
    assert {(r.persona, r.message_id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("Window" in line and "part#" in line for line in plan.splitlines())
    assert found.filter(F.col("newest") > 9).count() == 0
