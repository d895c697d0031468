"""Chat exports as messages: JSON folders, chat text files, and the repair of doubly encoded text.

Every importer gives conversation_id, sender, timestamp_ms, content, is_system and source; files are
read and parsed by Spark, a file a row, so an export of any number of chats is spread over the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import compat as C
from parley.sources.store import FACTS, Database, replace_sources

_ITEM = "array<struct<uri: string, creation_timestamp: bigint>>"
JSON_SCHEMA = f"""participants array<struct<name: string>>, title string, thread_path string, messages array<struct<sender_name: string, timestamp_ms: bigint, content: string, type: string, is_unsent: boolean,
    photos: {_ITEM}, videos: {_ITEM}, audio_files: {_ITEM}, share: struct<link: string, share_text: string>, reactions: array<struct<reaction: string, actor: string>>>>"""
# What a notice of a chat text file holds.
NOTICES = (
    "end-to-end encrypted",
    "security code changed",
    "created group",
    "added you",
    "left",
    "changed the subject",
    "changed this group",
    "changed the group",
    "removed",
    "joined using",
    "deleted this message",
    "message was deleted",
    "missed voice call",
    "missed video call",
    "calling",
    "media omitted",
    "document omitted",
    "sticker omitted",
    "gif omitted",
    "audio omitted",
    "video omitted",
    "image omitted",
    "contact card omitted",
    "waiting for this message",
    "messages and calls are",
)
_DATE = r"(\d{1,2}[/.]\d{1,2}[/.]\d{2,4}),? (\d{1,2}:\d{2}(?::\d{2})?)(?:[\s\x{202F}]?([AaPp][Mm]))?"
_LINE = rf"^[\x{{200E}}\x{{200F}}\x{{FEFF}}]*\[?{_DATE}\]?(?: - | )(.*)$"


def repair(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 becomes itself again; texts with any wider character are left alone."""
    narrow = text.rlike(r"^[\x{00}-\x{FF}]*$") & text.rlike(r"[\x{80}-\x{FF}]")
    return F.when(narrow, F.make_valid_utf8(F.encode(F.when(narrow, text), "ISO-8859-1").cast("string"))).otherwise(text)


def unescape(text: Column) -> Column:
    """Runs of literal ``\\u00XX`` become the UTF-8 text that their bytes spell."""
    run = r"((?:\\u00[0-9a-fA-F]{2})+)"
    parts = F.split(F.regexp_replace(text, run, "\x00$1\x00"), "\x00")
    spelled = lambda p: F.make_valid_utf8(F.unhex(F.regexp_replace(p, r"\\u00", "")).cast("string"))
    whole = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{run}$"), spelled(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("\\u00")), whole).otherwise(text)


def decoded(text: Column) -> Column:
    """A text of an export as it was written: both kinds of double encoding undone."""
    return unescape(repair(text))


def looks_encoded(text: Column) -> Column:
    """Whether a text holds literal ``\\u00XX`` of bytes above ASCII; false for null."""
    return F.coalesce(text.rlike(r"\\u00[89a-fA-F][0-9a-fA-F]"), F.lit(False))


def _decoded(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return decoded(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _decoded(v, kind.elementType)) if _has_text(kind) else value
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _decoded(v, kind.valueType)) if _has_text(kind.valueType) else value
    if isinstance(kind, T.StructType) and _has_text(kind):
        fields = [_decoded(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_text(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [getattr(kind, k) for k in ("elementType", "valueType") if hasattr(kind, k)]
    return isinstance(kind, T.StringType) or any(map(_has_text, inner))


def decode_all(df: DataFrame) -> DataFrame:
    """df with every text decoded, however deep in structs, arrays and values of maps; names and keys stay."""
    return df.select(*(_decoded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def source_of(path: Column) -> Column:
    return F.when(F.lower(path).contains("facebook"), "messenger").otherwise("instagram")


def namespaced(source: Column, raw: Column) -> Column:
    return F.when(raw.rlike("^(instagram|messenger|whatsapp|imessage|meta):.+$"), raw).otherwise(F.concat_ws(":", source, raw))


def json_export(spark: SparkSession, root: str) -> DataFrame:
    """The messages of all ``message_N.json`` below root; rows without a sender or a time are left out.

    A message of attachments alone gets a notice as its text and counts as a system message.
    """
    files = spark.read.schema(JSON_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "message_*.json").json(root)
    files = files.withColumn("path", F.col("_metadata.file_path"))
    return normalized(files.select("path", F.explode("messages").alias("x")).select("path", "x.*"))


def normalized(raw: DataFrame) -> DataFrame:
    """Messages as an export holds them (path and the fields of ``JSON_SCHEMA``'s messages), decoded and in the library's columns."""
    rows = decode_all(raw.filter("sender_name is not null and timestamp_ms is not null"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    sender, body = F.col("sender_name"), F.when(F.col("is_unsent"), None).otherwise(F.col("content"))
    some = lambda c, word: F.when(count(c) > 0, F.concat(sender, F.lit(" sent "), count(c), F.lit(f" {word}"), F.when(count(c) > 1, "s").otherwise("")))
    notice = F.coalesce(some("photos", "photo"), some("videos", "video"), F.when(count("audio_files") > 0, F.concat(sender, F.lit(" sent a voice message"))), F.when(F.col("share").isNotNull(), F.coalesce(F.col("share.share_text"), F.concat(sender, F.lit(" shared a link")))))
    source, folder = source_of(F.col("path")), F.element_at(F.split("path", "/"), -2)
    content = F.coalesce(body, notice)
    return rows.select(
        namespaced(source, folder).alias("conversation_id"), folder.alias("folder"), sender.alias("sender"), "timestamp_ms", content.alias("content"), source.alias("source"),
        (F.coalesce(F.col("type") == "Call", F.lit(False)) | (body.isNull() & notice.isNotNull()) | C.is_system(content, F.lit(False))).alias("is_system"),
        (count("photos") > 0).alias("has_photos"), (count("videos") > 0).alias("has_videos"), (count("audio_files") > 0).alias("has_audio"), F.col("share").isNotNull().alias("has_share"),
        F.coalesce("reactions", F.array()).alias("reactions"), F.col("share.link").alias("share_link"), *(F.coalesce(c, F.array()).alias(c) for c in ("photos", "videos", "audio_files")),
    )


def folder_messages(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """The messages of one conversation's folder, from all its files, in order of time."""
    return json_export(spark, root).filter(F.col("folder") == folder).sort("timestamp_ms", "sender", "content")


def chat_time(date: Column, time: Column, half: Column) -> Column:
    """Milliseconds of a chat file's date and time in the session's zone.

    The first number is the day unless the second is above 12; two-digit years are of this century.
    """
    a, b, y = (F.split(date, "[/.]")[i].cast("int") for i in range(3))
    month_first = (a <= 12) & (b > 12)
    h, minute = (F.split(time, ":")[i].cast("int") for i in (0, 1))
    second = F.coalesce(F.get(F.split(time, ":"), F.lit(2)).cast("int"), F.lit(0))
    hour = F.when(F.lower(half) == "pm", h % 12 + 12).when(F.lower(half) == "am", h % 12).otherwise(h)
    return F.unix_millis(F.try_make_timestamp(F.when(y < 100, y + 2000).otherwise(y), F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a), hour, minute, second.cast("decimal(8,6)")))


def chat_name(path: Column) -> Column:
    stem = F.regexp_replace(F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.txt$", ""), F.lit("%20"), F.lit(" ")), "^WhatsApp Chat (with|-) ", "")
    return F.when(stem.isin("_chat", "chat"), "WhatsApp Chat").otherwise(stem)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for b in batches:
        for path in b.column(0).to_pylist():
            system, at = fs.FileSystem.from_uri(path)
            with system.open_input_stream(at) as f:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read().decode("utf-8", "replace")])], names=["path", "value"])


def hidden_paths(spark: SparkSession, root: str, name: str) -> list[str]:
    """The paths of files of this name below root, which may begin with an underscore; Spark's own listing leaves such files out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(top, True)
    paths = []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName() == name:
            paths.append(path.toUri().toString())
    return sorted(paths)


def hidden_texts(spark: SparkSession, root: str, name: str = "_chat.txt") -> DataFrame:
    """path and value of such files, opened in tasks, one to a file."""
    paths = hidden_paths(spark, root, name)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return rows.mapInArrow(_read, "path string, value string")


def chat_text(spark: SparkSession, path: str) -> DataFrame:
    """The messages of chat text files; lines without a time go on with the message before them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.unionByName(hidden_texts(spark, path))
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    starts = lines.withColumn("start", F.col("line").rlike(_LINE).cast("int")).withColumn("no", F.sum("start").over(Window.partitionBy("path").orderBy("at"))).filter("no > 0")
    whole = starts.groupBy("path", "no").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts")).select("path", "no", F.col("parts")[0]["line"].alias("head"), F.transform(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: p["line"]).alias("more"))
    part = lambda i: F.regexp_extract("head", _LINE, i)
    body = part(4)
    has_sender = body.rlike(r"^[^:]{1,80}: ")
    text = F.array_join(F.concat(F.array(F.when(has_sender, F.regexp_replace(body, r"^[^:]{1,80}: ", "")).otherwise(body)), "more"), "\n")
    text = F.regexp_replace(text, r"\s+$", "")
    low, notice = F.lower(text), F.lit(False)
    for n in NOTICES:
        notice = notice | low.contains(n)
    return whole.select(
        namespaced(F.lit("whatsapp"), chat_name(F.col("path"))).alias("conversation_id"), F.when(has_sender, F.regexp_extract(body, r"^([^:]{1,80}): ", 1)).otherwise("System").alias("sender"),
        chat_time(part(1), part(2), part(3)).alias("timestamp_ms"), text.alias("content"), F.lit("whatsapp").alias("source"), (~has_sender | notice).alias("is_system"),
    ).filter("timestamp_ms is not null")


#: Hash buckets that conversations are numbered in, and the length of the slices of time in which one is.
ID_BUCKETS = 4096
SLICE_MS = 86_400_000


def with_ids(m: DataFrame) -> DataFrame:
    """message_id from 1 without gaps, along conversation (in order of hash bucket and name), time, sender and text.

    A conversation begins where those before it end, so no two share an id however large they are; it is
    sorted in slices of time, and only counts go through windows over more than a slice.
    """
    at = ["conversation_id", "__slice"]
    rows = m.withColumn("__slice", F.coalesce(F.floor(F.col("timestamp_ms") / SLICE_MS), F.lit(-(2**62)))).withColumn("__bucket", F.pmod(F.xxhash64("conversation_id"), F.lit(ID_BUCKETS)))
    before = lambda keys, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = rows.groupBy("__bucket", *at).agg(F.count("*").alias("n"))
    buckets = slices.groupBy("__bucket").agg(F.sum("n").alias("n")).select("__bucket", before([], ["__bucket"], "n").alias("__first"))  # ID_BUCKETS rows at most
    offsets = slices.join(buckets, "__bucket").select(F.col("conversation_id").alias("__chat"), F.col("__slice").alias("__at"), (F.col("__first") + before(["__bucket"], at, "n")).alias("__before"))
    placed = rows.join(offsets, F.col("conversation_id").eqNullSafe(F.col("__chat")) & (F.col("__slice") == F.col("__at"))).drop("__chat", "__at")
    return placed.withColumn("message_id", F.col("__before") + F.row_number().over(Window.partitionBy(*at).orderBy("timestamp_ms", "sender", "content"))).drop("__slice", "__bucket", "__before")


def attachments(m: DataFrame) -> dict[str, DataFrame]:
    """The children of messages with ids, by table: reactions, photos, videos and audio, one row each with its place."""
    items = {"photos": "photos", "videos": "videos", "audio": "audio_files"}
    out = {k: m.select("message_id", F.posexplode(c).alias("place", "x")).select("message_id", "place", "x.uri", "x.creation_timestamp") for k, c in items.items()}
    return out | {"reactions": m.select("message_id", F.posexplode("reactions").alias("place", "x")).select("message_id", "place", "x.reaction", "x.actor")}


def load(database: Database, m: DataFrame) -> None:
    """Put normalized messages and their children into the database in one commit, in the place of all it holds of their sources.

    Ids go on after the database's greatest.  The rows are written below its folder before they are numbered, which reads
    them more than once, and once more with their numbers, so that messages and children agree on the ids even of equal
    rows; both are removed after the commit.  No rows change nothing.
    """
    staged = f"{database.root}/staged/{uuid.uuid4().hex}"
    m.write.parquet(f"{staged}/plain")
    with_ids(m.sparkSession.read.schema(m.schema).parquet(f"{staged}/plain")).write.parquet(f"{staged}/numbered")
    rows = m.sparkSession.read.parquet(f"{staged}/numbered")
    last = 0
    if FACTS in database.manifest()["tables"]:
        last = database.read(FACTS).agg(F.max("message_id")).first()[0] or 0
    rows = rows.withColumn("message_id", F.col("message_id") + F.lit(last))
    if not rows.isEmpty():
        replace_sources(database, rows.drop("reactions", "photos", "videos", "audio_files"), attachments(rows))
    database.files.remove(staged)


def replace_by_source(m: DataFrame, path: str) -> None:
    """Store messages by source; sources that m has are replaced, others stay."""
    m.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
