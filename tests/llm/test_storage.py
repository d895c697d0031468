"""Joins on frequent keys give the rows of a plain join and deal them to several tasks; bucketed tables lie in the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from parley.llm import storage


def test_spread_join_deals_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT", 50)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id") % 60).alias("key"), F.col("id").alias("row"))
    table = spark.range(60).select(F.col("id").alias("key"), (F.col("id") * 3).alias("value"))
    plain = sorted(map(tuple, rows.join(table, "key").collect()))
    joined = storage.spread_join(rows, table, "key")
    assert sorted(map(tuple, joined.collect())) == plain
    missing = storage.spread_join(rows, table.filter("key != 7"), "key", how="left")
    assert missing.count() == 1000 and missing.filter("key = 7 and value is null").count() == rows.filter("key = 7").count()
    none = storage.spread_join(rows.filter("false"), table, "key")
    assert none.columns == joined.columns and none.count() == 0


def test_bucketed_tables_lie_in_the_shared_folder(spark):
    shared = storage.shared_folder(spark)

    @storage.scratch
    def made():
        held = storage.bucketed(spark.range(100).select("id", (F.col("id") % 3).alias("k")).repartition("k"), "sample", "k")
        assert all(f"/{os.path.basename(shared)}/" in f for f in held.inputFiles())
        return storage.stored(held.groupBy("k").count(), "counts")

    before = {t.name for t in spark.catalog.listTables()}
    assert sorted(r["count"] for r in made().collect()) == [33, 33, 34]
    assert {t.name for t in spark.catalog.listTables()} == before
    assert not [f for f in os.listdir(shared) if f.startswith("parley_sample")]
