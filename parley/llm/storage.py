"""Where intermediate tables go, and joins that a frequent key does not slow down.

Lineage is cut by writing to the folder that ``spark.checkpoint.dir`` names, which the driver and
every executor share.  Only a local session, as in tests, may leave it unset and gets a temporary
folder; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more than ``HOT`` rows is dealt to a task for each ``HOT`` of them, ``SALTS`` tasks at most;
#: ``HOT_KEYS`` keys at most are, so that any other key has less than one row in ``HOT_KEYS`` of all.
HOT = 1000
HOT_KEYS = 1000
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: The folders written inside calls of ``scratch`` functions, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back, with no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df written in the shared folder in buckets by ``keys``, so that joins on them do not move it again.

    df should be dealt by these keys already, or every task writes a file for each bucket.
    """
    spark = df.sparkSession
    table = f"parley_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    if _open:
        _open[-1] += [table, path]
    return spark.table(table)


def _remove(spark: SparkSession, folder: str) -> None:
    if "/" not in folder:
        spark.sql(f"drop table if exists {folder}")
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {unquote(f).rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}


def drop(df: DataFrame) -> None:
    """Remove the files behind a table that ``stored`` made."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, unquote(folder))


def scratch(function: Callable) -> Callable:
    """A function that returns DataFrames (one, or a tuple) and leaves no stored table behind that they do not read."""

    @wraps(function)
    def run(*args, **kwargs):
        _open.append([])
        try:
            out = function(*args, **kwargs)
        finally:
            paths = _open.pop()
        tables = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        read = set().union(*map(_folders, tables)) if tables else set()
        for p in paths:
            if p.rsplit("/", 1)[-1] in read:
                if _open:
                    _open[-1].append(p)
            elif tables:
                _remove(tables[0].sparkSession, p)
        return out

    return run


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; no column of rows but the key may be in table.

    Rows of the most frequent keys are dealt to up to ``SALTS`` tasks, and the table's rows of these keys
    are copied to each.  ``counts`` (key, n) may give the frequencies if they are known; the keys that are
    broadcast are ``HOT_KEYS`` at most.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    tasks = F.least(F.lit(SALTS), F.ceil(F.col("n") / HOT)).cast("int")
    hot = F.broadcast(counts.filter(F.col("n") > HOT).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key, tasks.alias("__tasks")))
    others = [c for c in rows.columns if c != key]
    salt = F.when(F.col("__tasks").isNotNull(), F.pmod(F.xxhash64(*(others or [key])), F.col("__tasks")).cast("int")).otherwise(0)
    dealt = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__tasks")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1))
    copied = table.join(hot, key, "left").withColumn("__salt", copies).drop("__tasks")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")
