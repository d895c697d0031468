"""Keyed tables that are merged batch by batch, and the state they hold at each version.

A ``Database`` is a folder of parquet files and manifests.  A table's rows lie in hash buckets of some of their
key's columns; a manifest names the folder of every bucket of every table.  A commit writes only the
buckets that its changes touch, beside the old ones, and then puts a manifest with the next number
in place by one rename: readers see all of a commit or nothing, a job that dies before the rename leaves
the last version as it was, and older versions stay readable.  Two writers of one version: the second fails.

Defined results for odd input: a key with a null in it is a key like others; of several rows of a batch
with one key the last by ``order`` stays (then by all columns); an empty batch changes nothing; a table
without rows reads as an empty table; columns that the table doesn't have are ignored.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table, and files that a bucket is written in.
BUCKETS = 64
FILES = 4
_BUCKET = "__bucket"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a local session may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """Small files and names of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str, replace: bool = False) -> None:
        """Write a file elsewhere and rename it to its name; fails if that is taken, unless ``replace``."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace:
            options = self._jvm.org.apache.hadoop.fs.Options.Rename
            overwrite = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
            overwrite[0] = options.OVERWRITE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(self._path(aside), self._path(path), overwrite)
        elif self._fs.exists(self._path(path)) or not self._fs.rename(self._path(aside), self._path(path)):
            self._fs.delete(self._path(aside), False)
            raise FileExistsError(path)


class Database:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.files = Files(spark, self.root)

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.root}/versions/{version:010}.json")) if version else {"tables": {}}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["tables"][table])

    def _rows(self, table: dict, only: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = sorted({p for b, p in table["buckets"].items() if only is None or b in only})
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    @contextmanager
    def commit(self) -> Iterator[Transaction]:
        """Changes to any tables that become visible together, when the block ends without an error."""
        before = self.version()
        changes = Transaction(self, self.manifest(before))
        yield changes
        self.files.publish(f"{self.root}/versions/{before + 1:010}.json", json.dumps(changes.manifest))


class Transaction:
    def __init__(self, database: Database, manifest: dict):
        self.database, self.manifest = database, manifest

    def create(self, table: str, schema: T.StructType, keys: list[str], by: list[str] | None = None) -> None:
        """A table with these keys, in buckets by the columns ``by`` of them (default: all); nothing if it is there."""
        self.manifest["tables"].setdefault(table, {"schema": schema.jsonValue(), "keys": keys, "by": by or keys, "n": self.database.buckets, "buckets": {}})

    def read(self, table: str) -> DataFrame:
        """The rows with the changes made so far."""
        return self.database._rows(self.manifest["tables"][table])

    def _bucket(self, table: dict):
        # nulls hash alike, whatever their type
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in table["by"])), F.lit(table["n"])).cast("string")

    def _write(self, table: dict, rows: DataFrame) -> dict[str, str]:
        """Write rows below a new folder; the folder of each bucket that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_BUCKET, self._bucket(table))
        spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(FILES))
        dealt.repartition(_BUCKET, spread).write.partitionBy(_BUCKET).parquet(f"{self.database.root}/{folder}")
        names = [n for n in self.database.files.names(f"{self.database.root}/{folder}") if n.startswith(_BUCKET)]
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names}

    def _replace(self, table: dict, rows: DataFrame, touched: set[str]) -> None:
        """Write the rows of the touched buckets anew."""
        kept = {b: p for b, p in table["buckets"].items() if b not in touched}
        table["buckets"] = kept | self._write(table, rows)

    def _touched(self, table: dict, rows: DataFrame) -> set[str]:
        return {r[0] for r in rows.select(self._bucket(table)).distinct().collect()}  # as many as there are buckets at most

    @staticmethod
    def _same(columns: list[str]):
        return reduce(lambda a, b: a & b, (F.col(f"old.`{c}`").eqNullSafe(F.col(f"new.`{c}`")) for c in columns))

    def upsert(self, table: str, rows: DataFrame, order: str | None = None) -> None:
        """Put rows in; those whose key is there take the place of the old ones."""
        t = self.manifest["tables"][table]
        columns = [f["name"] for f in t["schema"]["fields"]]
        ranked = F.row_number().over(_last(t["keys"], order, columns))
        new = rows.select(*columns, *([F.col(order).alias("__order")] if order else [])).withColumn("__n", ranked).filter("__n = 1").select(*columns)
        # rows may be dear to make, so they are written before it is known which buckets they touch
        written = self._write(t, new)
        both = set(written) & set(t["buckets"])
        fresh = {b: written.pop(b) for b in both}
        if both:
            rows = self.database._rows(t | {"buckets": fresh})
            old = self.database._rows(t, both)
            left = old.alias("old").join(rows.select(*t["keys"]).alias("new"), self._same(t["keys"]), "left_anti")
            self._replace(t, left.select(*columns).unionByName(rows.select(*columns)), both)
            for path in fresh.values():
                self.database.files.remove(f"{self.database.root}/{path}")
        t["buckets"] |= written

    def delete(self, table: str, rows: DataFrame) -> None:
        """Take out what agrees with any of ``rows`` in all columns that these have."""
        t = self.manifest["tables"][table]
        if not t["buckets"]:
            return
        gone = rows.distinct()
        touched = self._touched(t, gone) if set(t["by"]) <= set(rows.columns) else set(t["buckets"])
        touched &= set(t["buckets"])
        if touched and not gone.isEmpty():
            old = self.database._rows(t, touched)
            self._replace(t, old.alias("old").join(gone.alias("new"), self._same(rows.columns), "left_anti"), touched)


def _last(keys: list[str], order: str | None, columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*([F.desc("__order")] if order else []), *(F.desc(c) for c in columns))


#: The facts, what hangs on them by message, and what is derived by conversation.
FACTS = "messages"
BY_MESSAGE = ("sentiment", "text_metrics", "emotions", "reactions", "photos", "videos", "audio", "embeddings")
BY_CONVERSATION = ("response_times", "conversations")


def replace_sources(database: Database, facts: DataFrame, children: dict[str, DataFrame] | None = None) -> None:
    """Put in messages (message_id, conversation_id, source, ...) and their children in the place of all that the database holds of these sources.

    Every table of messages or conversations loses the rows of the messages that go; other sources stay.
    """
    children = children or {}
    with database.commit() as tx:
        tx.create(FACTS, facts.schema, ["message_id"])
        for name, rows in children.items():
            tx.create(name, rows.schema, rows.columns, ["message_id"])
        old = tx.read(FACTS).join(facts.select("source").distinct(), "source", "left_semi")
        messages, chats = old.select("message_id"), old.select("conversation_id").distinct()
        for name in tx.manifest["tables"]:
            if name in BY_MESSAGE:
                tx.delete(name, messages)
            elif name in BY_CONVERSATION:
                tx.delete(name, chats)
        tx.delete(FACTS, messages)
        tx.upsert(FACTS, facts)
        for name, rows in children.items():
            tx.upsert(name, rows)


def set_meta(database: Database, **values: str) -> None:
    """Upsert of named values."""
    rows = database.spark.createDataFrame(list(values.items()), "key string, value string")
    with database.commit() as tx:
        tx.create("meta", rows.schema, ["key"])
        tx.upsert("meta", rows)


def get_meta(database: Database, key: str) -> str | None:
    if "meta" not in database.manifest()["tables"]:
        return None
    found = database.read("meta").filter(F.col("key") == key).head()
    return found and found["value"]
