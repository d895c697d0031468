"""Datasets for readers outside Spark: JSON documents, lines of JSON, and whether they are up to date.

A run writes all its datasets below ``runs/<id>`` and becomes the current one when the manifest that names
them is put in place by one rename; a reader goes by the manifest, so it never sees half of a run, and a run
that fails leaves the one before it.  Large datasets are lines of JSON in many files, written by Spark; a
document is one file made on the driver and refuses more than ``MOST`` rows.

Defined results for odd input: null fields are left out of lines and null in documents; an empty table is an
empty dataset; rows keep their columns' names, whatever these are.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.store import Database, Files, get_meta, set_meta

#: Rows that a document may have.
MOST = 100_000
#: Names the folder of datasets where none is given.
FOLDER = "PARLEY_DATASETS"
LAST_IMPORT, LAST_SOURCES, LAST_GENERATE = "last_import_at", "last_import_sources", "last_generate_at"


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class Run:
    """One run's datasets, which ``publish`` makes the current ones."""

    def __init__(self, spark: SparkSession, root: str | None = None, at: str | None = None):
        self.spark, self.root = spark, (root or os.environ[FOLDER]).rstrip("/")
        self.files, self.id, self.at = Files(spark, self.root), uuid.uuid4().hex, at or now()
        self.datasets: dict[str, dict] = {}

    def _enter(self, name: str, path: str, kind: str) -> None:
        self.datasets[name] = {"path": path, "format": kind, "bytes": self.files.size(f"{self.root}/{path}")}

    def lines(self, name: str, rows: DataFrame) -> None:
        """Rows as lines of JSON."""
        path = f"runs/{self.id}/{name}.jsonl"
        rows.write.json(f"{self.root}/{path}")
        self._enter(name, path, "jsonl")

    def document(self, name: str, rows: DataFrame | dict | list, pretty: bool = False) -> None:
        """A file with one JSON value, compact unless ``pretty``."""
        if isinstance(rows, DataFrame):
            found = rows.limit(MOST + 1).toArrow().to_pylist()
            if len(found) > MOST:
                raise ValueError(f"{name} has more than {MOST} rows: write it as lines")
            rows = found
        path = f"runs/{self.id}/{name}.json"
        self.files.publish(f"{self.root}/{path}", json.dumps(rows, ensure_ascii=False, default=str, indent=2 if pretty else None, separators=None if pretty else (",", ":")))
        self._enter(name, path, "json")

    def text(self, name: str, text: str) -> None:
        path = f"runs/{self.id}/{name}"
        self.files.publish(f"{self.root}/{path}", text)
        self._enter(name, path, "text")

    def publish(self, database: Database | None = None) -> None:
        """Make this run the current one, and note the time in the database."""
        self.files.publish(f"{self.root}/manifest.json", json.dumps({"run": self.id, "generated_at": self.at, "datasets": self.datasets}), replace=True)
        if database is not None:
            set_meta(database, **{LAST_GENERATE: self.at})


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the current run; None before the first."""
    files = Files(spark, root)
    return json.loads(files.read(f"{root.rstrip('/')}/manifest.json")) if "manifest.json" in files.names(root) else None


def read_lines(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A dataset of lines of the current run; an empty table where there is none."""
    held = current(spark, root)
    if held is None or name not in held["datasets"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/{held['datasets'][name]['path']}")


def record_import(database: Database, sources: list[str], at: str | None = None) -> None:
    set_meta(database, **{LAST_IMPORT: at or now(), LAST_SOURCES: ",".join(sources)})


def freshness(database: Database) -> dict:
    """When messages came in and datasets were made, and whether the former was later."""
    imported, generated = get_meta(database, LAST_IMPORT), get_meta(database, LAST_GENERATE)
    never, later = bool(imported and not generated), bool(imported and generated and imported > generated)
    reason = "messages came in but nothing was generated" if never else "messages came in after the last run" if later else None
    sources = [s.strip() for s in (get_meta(database, LAST_SOURCES) or "").split(",") if s.strip()]
    return {"last_import_at": imported, "last_import_sources": sources, "last_generate_at": generated, "stale": never or later, "reason": reason}


# Fixed value: what stands in the place of a persona's style where none is known.
STYLE = "You are {} texting. Match their style exactly. Reply with only the message text."


def fine_tune_rows(pairs: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Pairs (persona, partner, conversation_id, source, context, reply, with_you) as chats of three turns with where they come from.

    ``styles`` (persona, style) are read back from the profiles of an earlier run.
    """
    plain = F.concat(*(F.lit(part) if i % 2 == 0 else F.col("persona") for i, part in enumerate([STYLE.split("{}")[0], "", STYLE.split("{}")[1]])))
    pairs = pairs.join(styles.select("persona", "style"), "persona", "left") if styles is not None else pairs.withColumn("style", F.lit(None).cast("string"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    system: Column = F.coalesce("style", plain)
    chat = F.array(turn("system", system), turn("user", F.col("context")), turn("assistant", F.col("reply")))
    return pairs.select(chat.alias("messages"), F.struct(F.col("persona").alias("sender"), "conversation_id", "source", "with_you").alias("meta"))


def export_fine_tune(run: Run, pairs: DataFrame, account_holder: str | None = None, styles: DataFrame | None = None) -> None:
    """The lines, a description of them and a note on what to do next, as datasets of a run."""
    rows = fine_tune_rows(pairs, styles)
    run.lines("fine_tune", rows)
    written = run.spark.read.schema(rows.schema).json(f"{run.root}/{run.datasets['fine_tune']['path']}")
    counted = written.agg(F.count("*").alias("examples"), F.count_distinct("meta.sender").alias("senders")).first()
    notes = ["No model is trained here.", "Remove the meta field where a trainer refuses it.", "Pairs with the account holder come first.", "Train only on people who agreed to it."]
    run.document("fine_tune.meta", {"generated_at": run.at, "format": "chat-jsonl", "examples": counted.examples, "senders": counted.senders, "account_holder": account_holder, "notes": notes}, pretty=True)
    run.text("FINE_TUNE.md", f"# Fine-tuning examples\n\n{counted.examples} chats of {counted.senders} people in `fine_tune.jsonl`.\n\n1. Ask the people in them.\n2. Remove `meta` if need be.\n3. Hand the lines to a trainer.\n4. Compare the model with held-out pairs.\n")


KEYS = "persona string, context string, reply string"


def unused(pairs: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs that are none of an earlier run's, by persona and trimmed texts."""
    key = lambda df: df.withColumns({"__c": F.trim("context"), "__r": F.trim("reply")})
    return key(pairs).join(key(earlier).select("persona", "__c", "__r").distinct(), ["persona", "__c", "__r"], "left_anti").select(*pairs.columns)
