"""Every query with SQL gives the same rows as DuckDB, and hand-made cases give known results."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import intervals, moods, ordered, summaries, texts, triggers
from parley.plans import registry

MIN = 60_000
BASE = 1_700_000_000_000
SCHEMA = "message_id long, conversation_id string, sender string, timestamp_ms long"


def canon(rows, columns):
    return sorted(tuple(str(round(float(r[c]), 5)) if isinstance(r[c], (int, float)) and not isinstance(r[c], bool) else str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert canon([r.asDict() for r in got.collect()], got.columns) == canon(rows, got.columns)


def test_responses(spark):
    day = 86_400_000
    m = spark.createDataFrame([(1, "c1", "A", BASE), (2, "c1", "A", BASE + MIN), (3, "c1", "B", BASE + 6 * MIN), (4, "c1", "A", BASE + 6 * MIN + day + 1000), (5, "c2", "X", BASE), (6, "c2", "Y", BASE + 2 * MIN)], SCHEMA)
    got = {(r.conversation_id, r.from_message_id, r.to_message_id, r.latency_ms) for r in ordered.responses(m).collect()}
    assert got == {("c1", 2, 3, 5 * MIN), ("c2", 5, 6, 2 * MIN)}


def test_turn_patterns(spark):
    rows = [(i, "balanced", "AB"[i % 2], BASE + i * 10 * MIN) for i in range(6)] + [(10 + i, "dominant", x, BASE + i * 10 * MIN) for i, x in enumerate("ABACAAAAAA")]
    t = ordered.turns(spark.createDataFrame(rows, SCHEMA))
    found = {r.conversation_id: r for r in summaries.turn_patterns(t).collect()}
    assert found["balanced"].pattern_type == "balanced" and found["balanced"].turn_ratio == 1
    assert found["dominant"].pattern_type == "dominant" and found["dominant"].max_message_share == 0.8


def test_bursts_and_sessions_at_the_limits(spark):
    m = spark.createDataFrame([(1, "c", "A", BASE), (2, "c", "B", BASE + 5 * MIN), (3, "c", "A", BASE + 10 * MIN + 1), (4, "c", "A", BASE + 10 * MIN + 1 + 4 * 60 * MIN)], SCHEMA)
    assert [(r.message_count, r.starter) for r in ordered.gap_islands(m, 5 * MIN, 2).collect()] == [(2, "A")]
    assert {r.message_id for r in ordered.session_starters(m).collect()} == {1, 4}


def test_slices_of_time_give_the_rows_of_one_window(spark, monkeypatch):
    rng = np.random.default_rng(5)
    times = np.sort(rng.integers(-40, 40, 400)) * 30_000
    rows = [(i, "hot", "ABC"[int(x)], int(t), bool(b), "x" * (i % 5)) for i, (t, x, b) in enumerate(zip(times, rng.integers(0, 3, 400), rng.random(400) < 0.2, strict=True))]
    rows += [(1000, "cold", "A", 7, False, "x"), (1001, "cold", "B", None, False, None), (1002, None, "B", 5, False, "y"), (1003, "once", "A", 0, True, "")]
    m = spark.createDataFrame(rows, SCHEMA + ", breaks boolean, content string").repartition(7)

    def found():
        frames = [ordered.with_previous(m, before="content"), ordered.turns(m), ordered.gap_islands(m, 60_000), ordered.reply_turns(m, F.col("breaks"), 60_000), ordered.session_starters(m, 120_000), summaries.turn_patterns(ordered.turns(m))]
        return [canon([r.asDict() for r in f.collect()], f.columns) for f in frames]

    whole = found()
    monkeypatch.setattr(ordered, "SLICE_MS", 100_000)
    monkeypatch.setattr(summaries, "TURNS_A_SLICE", 3)
    assert found() == whole
    last: dict = {}
    want = set()
    for i, c, sender, t, _, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[1], -(10**15) if r[3] is None else r[3], r[0])):
        p = last.get(c)
        want.add((i, p and p[0], p and p[1], None if not p or p[2] is None or t is None else t - p[2]))
        last[c] = (i, sender, t)
    assert {(r.message_id, r.prev_id, r.prev_sender, r.gap_ms) for r in ordered.with_previous(m).collect()} == want
    timed = [r for r in rows if r[1] and r[3] is not None]
    after = {i: sum(d == c and y != x and t < u <= t + 90_000 for _, d, y, u, _, _ in timed) for i, c, x, t, _, _ in timed}
    assert {r.message_id: r.n_after for r in ordered.counts_after(m, 90_000).collect()} == after


def test_counts_after_run_from_the_start_of_a_slice(spark):
    # a frame that also moves at its start costs its length for every row
    m = spark.createDataFrame([(1, "c", "A", BASE)], SCHEMA)
    plan = ordered.counts_after(m, 90_000)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rangeframe, unboundedpreceding") == plan.count("rangeframe") > 0


def test_perfect_correlation(spark):
    rows = [(s, "c1", f"2024-01-0{d}", v * (0.8 - 0.2 * (d - 1))) for d in range(1, 7) for s, v in (("A", 1.0), ("B", 0.5)) for _ in range(3)] + [("C", "c1", f"2024-01-0{d}", 0.5) for d in (1, 2) for _ in range(3)]
    m = spark.createDataFrame(rows, "sender string, conversation_id string, day string, compound double")
    (r,) = moods.correlations(moods.daily(m)).collect()
    assert (r.sender1, r.sender2, r.shared_days, r.total_days, round(r.correlation, 9)) == ("A", "B", 6, 6, 1.0)


@pytest.mark.parametrize(("block", "most"), [(512, None), (40, None), (40, 50)])
def test_every_pair_of_a_large_conversation_is_correlated(spark, monkeypatch, block, most):
    monkeypatch.setattr(moods, "BLOCK", block)
    rng = np.random.default_rng(7)
    # 150 senders of one conversation, some of whom share too few days; one does not vary
    values = {(f"s{i}", f"d{d:02}"): 0.25 if i == 3 else float(rng.normal()) for i in range(150) for d in range(12) if rng.random() < (0.3 if i % 10 == 0 else 0.8)}
    got = {(r.sender1, r.sender2): r for r in moods.correlations(spark.createDataFrame([(s, d, v) for (s, d), v in values.items()], "sender string, day string, v double"), most=most).collect()}
    days = {s: {d for t, d in values if t == s} for s, _ in values}
    want = {}
    for a in days:
        for b in days:
            both = sorted(days[a] & days[b])
            if a < b and len(both) >= 5 and len(days[a]) >= 5 and len(days[b]) >= 5:
                x, y = (np.array([values[s, d] for d in both]) for s in (a, b))
                r = 0.0 if "s3" in (a, b) else float(np.corrcoef(x, y)[0, 1])
                want[a, b] = (len(both), max(len(days[a]), len(days[b])), round(r, 4) + 0.0)
    if most:
        want = dict(sorted(want.items(), key=lambda p: (-abs(p[1][2]), p[0]))[:most])
    assert {k: (r.shared_days, r.total_days, round(r.correlation, 4) + 0.0) for k, r in got.items()} == want and len(want) == (most or len(want)) > 40


def test_pairs_that_share_a_chat(spark):
    rows = [(s, f"d{d}", float((hash_ + d * 3) % 5)) for hash_, s in enumerate("abcd") for d in range(6)]
    shared = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("d", "z"), ("zz", "x")], "sender string, key string")
    got = moods.correlations(spark.createDataFrame(rows, "sender string, day string, v double"), shared=shared).collect()
    assert {(r.sender1, r.sender2) for r in got} == {("a", "b"), ("c", "d")}


@pytest.mark.parametrize("block", [512, 6])
def test_only_senders_of_one_chat_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(moods, "BLOCK", block)
    rng, sums, compared = np.random.default_rng(4), moods._sums, spark.sparkContext.accumulator(0)

    def counted(a, b, width):
        compared.add((len(a["first"]) - 1) * (len(b["first"]) - 1))
        return sums(a, b, width)

    monkeypatch.setattr(moods, "_sums", counted)
    # chats of 20 and 3 senders, some of whom are in several; the last sender has too few days
    chats = {f"s{i:02}": {f"large{i // 20}", f"small{i // 3}", *([f"small{i % 7}"] if i % 5 == 0 else [])} for i in range(80)}
    rows = [(s, f"d{d}", float(rng.normal())) for s in chats for d in range(2 if s == "s79" else 6)]
    shared = [(s, c) for s, of in chats.items() for c in sorted(of)] + [("s00", None), ("s01", None)]
    got = moods.correlations(spark.createDataFrame(rows, "sender string, day string, v double"), shared=spark.createDataFrame(shared, "sender string, key string")).collect()
    want = sorted((a, b) for a in chats for b in chats if a < b < "s79" and chats[a] & chats[b])
    assert sorted((r.sender1, r.sender2) for r in got) == want
    if block == 6:
        assert 0 < compared.value < 80 * 80 / 2


@pytest.mark.parametrize("scale", [1, 10])
def test_interval_join_compares_little_more_than_it_gives(spark, scale):
    rng = np.random.default_rng(scale)
    n, hour = 400 * scale, 3_600_000
    # one conversation has a third of all rows; the span grows with the rows
    points = [(i, "hot" if i % 3 == 0 else f"c{i % 7}", int(t)) for i, t in enumerate(rng.integers(0, n * hour // 100, n))]
    asked = [(-i, c, t, t + 2 * hour) for i, c, t in points[::4]] + [(9, None, 0, 1), (9, "hot", None, 5), (9, "hot", 5, 4)]
    left = spark.createDataFrame(asked, "id long, k string, a long, b long")
    right = spark.createDataFrame([*points, (-1, "hot", None), (-2, None, 7)], "at_id long, k string, t long")
    args = (left, right, ["k"], "a", "b", "t", 2 * hour)
    want = {(i, j) for i, c, a, b in asked[:-3] for j, d, t in points if c == d and a <= t <= b}
    for hot in (intervals.HOT, 3):
        assert {(r.id, r.at_id) for r in intervals.pairs(*args, hot=hot).collect()} == want
        assert intervals.candidates(*args, hot=hot).count() <= 1.5 * len(want)
    plan = intervals.pairs(*args)._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan


@pytest.mark.parametrize("name", ["agg46_emotion_totals", "agg49_burst_distribution", "agg55_conversation_engagement", "srt01_by_count"])
def test_no_task_gets_all_rows(spark, sf_dir, name):
    """No window without keys, for which all rows would go to one partition."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        assert node.nodeName() != "Window" or node.partitionSpec().nonEmpty()
        todo += [node.children().apply(i) for i in range(node.children().length())]


def test_keywords_of_a_text_count_once_for_each_list(spark):
    texts_ = [(1, "Work at the office, so much WORK; a promotion denied"), (2, None), (3, ""), (4, "nothing here")]
    got = triggers.keywords(spark.createDataFrame(texts_, "id long, content string"), "content").collect()
    lists = {(r.id, r.cause, r.kind, r.keyword, r.weight) for r in got}
    assert len(got) == len(lists)
    want = {(i, c, k, w, x) for i, t in texts_ if t for c, _, k, w, x in triggers.lexicon() if w in t.lower()}
    assert lists == want and (1, "work_stress", "negative", "promotion denied", 2.0) in lists


def test_reply_quantiles_without_a_list_of_replies(spark):
    rows = [("a", (i * 7919) % 5000 + 1000) for i in range(997)] + [("b", 86_400_000)] + [("c", 1000 + 9000 * i) for i in range(10)]
    replies = spark.createDataFrame(rows, "responder string, latency_ms long")
    out = summaries.reply_quantiles(replies, {"median_ms": 0.5, "p90_ms": 0.9})
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    plan = registry.queries()["per04_reply_quantiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    by = {k: sorted(v for r, v in rows if r == k) for k in "abc"}
    assert {r.responder: (r.median_ms, r.p90_ms, r.n) for r in out.collect()} == {k: (v[min(len(v) - 1, len(v) // 2)], v[min(len(v) - 1, int(len(v) * 0.9))], len(v)) for k, v in by.items()}


def test_vector_search_of_all_queries_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(150, 8)), np.ones((60, 8)), np.zeros((3, 8))]).astype(np.float32)
    ids = rng.permutation(len(v)).tolist()
    monkeypatch.setattr(texts, "QUERIES", 4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in texts.vector_top_all(df, 20, 7).collect()}
    unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    want = {}
    for i, x in zip(ids, unit, strict=True):
        if i % 20 == 0:
            near = sorted((-round(float(y @ x), 6), j) for j, y in zip(ids, unit, strict=True) if j != i)[:7]
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(near)}
    assert got == want
