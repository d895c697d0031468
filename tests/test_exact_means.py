"""Means of scores and times that meet a bound, a sign or a half exactly don't depend on the order of addition."""

import itertools

from pyspark.sql import functions as F

from parley.operators import relationships
from parley.operators.statements import apply

MOODS = "message_id long, sender string, conversation_id string, day string, compound double, word_count int, emoji_count int, sys boolean"


def _days(scores_by_sender):
    rows = [(who, f"2024-01-{d:02}", c) for who, days in scores_by_sender.items() for d, scores in enumerate(days, 1) for c in scores]
    return [(i, who, "c", day, c, 6, 0, False) for i, (who, day, c) in enumerate(rows)]


def test_streaks_take_the_sign_of_the_exact_sum(spark):
    # 0.1 + 0.2 - 0.3 is above 0 in doubles, -0.1 - 0.2 + 0.3 below
    m = spark.createDataFrame(_days({"a": [(0.1, 0.2, -0.3)], "b": [(-0.1, -0.2, 0.3)], "c": [(0.1, 0.2, -0.2)] * 2}), MOODS).coalesce(1)
    got = {r.sender: (r.positive_streak, r.negative_streak) for r in apply("win13_streaks", spark, m=m).collect()}
    assert got == {"a": (0, 0), "b": (0, 0), "c": (2, 0)}


def test_moods_at_a_bound_are_neutral(spark):
    m = spark.createDataFrame(_days({"a": [(0.05,) * 3] * 5, "b": [(0.1, 0.2, -0.3)] * 5, "c": [(-0.05,) * 3] * 5}), MOODS).coalesce(1)
    got = {r.sender: (str(r["mean"]), r.variability, r.dominant, r.trend) for r in apply("agg43_mood_patterns", spark, m=m).collect()}
    assert got == {"a": ("0.05", 0, "neutral", "stable"), "b": ("0.0", 0, "neutral", "stable"), "c": ("-0.05", 0, "neutral", "stable")}


def test_tone_at_a_bound_is_neutral(spark):
    m = spark.createDataFrame(_days({"a": [(0.05,) * 3], "b": [(-0.05,) * 3], "c": [(0.06,) * 3]}), MOODS).coalesce(1)
    got = {r.sender: r.summary.split(", ")[-1] for r in apply("per06_style_summary", spark, m=m).collect()}
    assert got == {"a": "neutral tone", "b": "neutral tone", "c": "warm tone"}


def test_card_tone_at_a_bound_is_neutral(spark):
    # fifteen times 0.05 is above 0.75 in doubles
    rows = [(i, "c", who, f"line {i}", i, False, 0.05, 2) for i, who in enumerate(["me"] + ["p"] * 15)]
    m = spark.createDataFrame(rows, "message_id long, conversation_id string, sender string, content string, timestamp_ms long, is_system boolean, compound double, word_count int").coalesce(1)
    assert relationships.cards(m, spark.createDataFrame([("me",)], "sender string")).first().tone == "fairly neutral with you"


def test_half_a_millisecond_is_rounded_up(spark):
    # mean answer times in tenths; in half of their orders the doubles sum to less than 2.5
    orders = sorted(set(itertools.permutations((7, 1, 6, 7, 4))))
    rows = [(5 * k + i, f"user{k}", n) for k, order in enumerate(orders) for i, n in enumerate(order)]
    starters = spark.createDataFrame([(i, "c", who, i) for i, who, _ in rows], "message_id long, conversation_id string, sender string, timestamp_ms long")
    m = starters.select("message_id", F.lit(9).alias("hour"), F.lit("x").alias("content"))
    answers = spark.createDataFrame([(i, int(j < n)) for i, _, n in rows for j in range(10)], "message_id long, after_ms long")
    got = apply("agg57_starter_patterns", spark, s=starters, m=m, sa=answers)
    assert {r.avg_response_ms for r in got.collect()} == {1}
