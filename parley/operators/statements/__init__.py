"""Operators stated in SQL, by topic.

Each is one statement over named tables; ``apply("agg31_reactions_by_emoji", spark, m=..., x=...)``
runs it on any DataFrames with the columns of ``parley.plans.tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.operators.statements import engagement, importing, media, mood, peaks, persona, points, scope, text

STATEMENTS: dict[str, tuple[str, str]] = {}
for _module in (importing, text, media, mood, peaks, engagement, persona, scope, points):
    STATEMENTS |= _module.STATEMENTS


def apply(name: str, spark: SparkSession, **tables: DataFrame) -> DataFrame:
    inputs, sql = STATEMENTS[name]
    return spark.sql(sql, **{k: tables[k] for k in inputs.split()})
