"""Finding chat exports, telling their platform, and exports of text blocks as messages.

A folder's files are listed and sniffed by Spark; no file's content is read but that of text files.
``_chat.txt``, which Spark's own listing leaves out, is found by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.importers import hidden_paths, namespaced

#: Platforms in the order in which a folder is asked for them.
PLATFORMS = ("imessage_db", "imessage", "whatsapp", "meta")
# Names of message databases, reactions, notices and endings of attached files in block exports.
DATABASES = ("chat.db", "Chat.db", "messages.db")
TAPBACKS = ("Loved", "Liked", "Disliked", "Laughed", "Emphasized", "Questioned")
ANNOUNCEMENTS = ("added .+ to the conversation", "removed .+ from the conversation", "left the conversation", "changed their phone number", "changed the group photo", "changed the chat background", "named the conversation", "kept an audio message", "unsent a message")
PHOTOS = ("heic", "jpeg", "jpg", "png", "gif", "pdf", "svg")
VIDEOS = ("mov", "mp4", "m4a", "caf")
# What the kind of a candidate adds to its time of change, in milliseconds.
BONUS = {"zip": 1_000_000, "db": 500_000, "name": 100_000}

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_WHEN = rf"(?i)^\h*({'|'.join(_MONTHS)})\h+(\d{{1,2}}),\h+(\d{{4}})\h+(\d{{1,2}}):(\d{{2}}):(\d{{2}})\h+(AM|PM)"
_STAMP = rf"\h*(?:{'|'.join(_MONTHS)})\h+\d{{1,2}},\h+\d{{4}}\h+\d{{1,2}}:\d{{2}}:\d{{2}}\h+(?:AM|PM)(?:\h+\(Read by [^\n]+\))?\h*"


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _below(path: Column, root: str) -> Column:
    """The path from root on, or the name of a file that is the root itself."""
    rest = F.replace(F.regexp_replace(path, rf"^.*?\Q{root.rstrip('/')}\E/*", ""), F.lit("%20"), F.lit(" "))
    return F.when(rest == "", _name(path)).otherwise(rest)


def looks_like_blocks(text: Column) -> Column:
    """Two lines of time alone among the first thirty that are not blank, in the first 4,000 characters."""
    lines = F.filter(F.split(F.substring(text, 1, 4000), "\r?\n"), lambda x: F.trim(x) != "")
    return F.size(F.filter(F.slice(lines, 1, 30), lambda x: x.rlike(f"(?i)^{_STAMP}$"))) >= 2


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), "value", F.unix_millis(F.col("_metadata.file_modification_time")).alias("changed_ms"))


def _chat_named(path: Column) -> Column:
    low = F.lower(_name(path))
    return low.isin("chat.txt", "_chat.txt") | low.contains("whatsapp")


def block_text(spark: SparkSession, root: str) -> DataFrame:
    """The messages of text exports in blocks: a line of time, a line with the sender, the body up to a blank line.

    Notices on the line of time, announcements and lines of reactions are left out; a body that names
    an attached file stands for it.
    """
    files = _texts(spark, root).filter(~_chat_named(F.col("path")) & looks_like_blocks(F.col("value")))
    blocks = files.select("path", F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), rf"(?mi)^(?={_STAMP}$)")).alias("block"))
    lines = blocks.select("path", F.split(F.split("block", r"\n\h*(?:\n|$)", 2)[0], "\n").alias("lines")).filter(F.col("lines")[0].rlike(f"(?i)^{_STAMP}$") & (F.size("lines") > 2))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tapback = rf"(?i)^\s*Tapbacks:\s*$|^\s*(?:Tapbacks:\s*)?(?:{'|'.join(TAPBACKS)}) by\b"
    head = F.col("lines")[0]
    part = lambda i: F.regexp_extract(head, _WHEN, i)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(1))).cast("int")
    hour = part(4).cast("int") % 12 + F.when(F.upper(part(7)) == "PM", 12).otherwise(0)
    time = F.unix_millis(F.try_make_timestamp(part(3).cast("int"), month, part(2).cast("int"), hour, part(5).cast("int"), part(6).cast("decimal(8,6)")))
    body = lines.select("path", bare(F.col("lines")[1]).alias("sender"), time.alias("timestamp_ms"), bare(F.array_join(F.filter(F.slice("lines", 3, 1_000_000_000), lambda x: ~x.rlike(tapback)), "\n")).alias("text"))
    body = body.filter("timestamp_ms is not null and sender != '' and text != ''").filter(~F.col("text").rlike(rf"(?i)\b(?:{'|'.join(ANNOUNCEMENTS)})\b"))
    first = F.split("text", "\n")[0]
    attached, video = first.rlike(rf"(?i)^(?:attachments/|\S+\.(?:{'|'.join(PHOTOS + VIDEOS)}))$"), first.rlike(rf"(?i)\.(?:{'|'.join(VIDEOS)})$")
    chat = F.regexp_replace(_below(F.col("path"), root), r"\.txt$", "")
    return body.select(
        namespaced(F.lit("imessage"), chat).alias("conversation_id"), "sender", "timestamp_ms",
        F.when(attached & (F.col("text") == first), F.concat(F.lit("[attachment: "), F.regexp_extract(first, "([^/]+)/*$", 1), F.lit("]"))).otherwise(F.col("text")).alias("content"),
        F.lit("imessage").alias("source"), F.lit(False).alias("is_system"), (attached & ~video).alias("has_photos"), (attached & video).alias("has_videos"),
    )


def files(spark: SparkSession, root: str) -> DataFrame:
    """The files below root that are not empty, with their platform (null: none) and time of change."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("_metadata.file_path").alias("path"), F.unix_millis("modificationTime").alias("changed_ms"))
    name = _name(F.col("path"))
    other = F.when(name.isin(*DATABASES), "imessage_db").when(name.rlike(r"^message_\d+\.json$"), "meta")
    text = F.when(_chat_named(F.col("path")), "whatsapp").when(looks_like_blocks(F.col("value")), "imessage")
    hidden = spark.createDataFrame([(p, 0, "whatsapp") for p in hidden_paths(spark, root, "_chat.txt")], "path string, changed_ms long, platform string")
    return hidden.unionByName(listed.filter(~name.endswith(".txt")).select("path", "changed_ms", other.alias("platform"))).unionByName(_texts(spark, root).select("path", "changed_ms", text.alias("platform")))


def platform(spark: SparkSession, root: str) -> DataFrame:
    """One row with the first of PLATFORMS that root holds files of; none if it holds no export."""
    rank = F.array_position(F.array(*map(F.lit, PLATFORMS)), F.col("platform"))
    return files(spark, root).filter("platform is not null").groupBy("platform").agg(F.count("*").alias("files")).orderBy(rank).limit(1)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Exports at most one level below root, the likeliest first: archives, databases, chat files and folders of either.

    The score is the last change in milliseconds with what the kind and the name add.
    """
    rel, low = _below(F.col("path"), root), F.lower(_name(F.col("path")))
    depth = F.size(F.split(rel, "/"))
    alone = (low.endswith(".zip") & (depth == 1)) | ((low.endswith("chat.db") | low.isin("chat.txt", "_chat.txt")) & (depth <= 2))
    folder = F.when(F.col("platform").isNotNull() & (depth > 1), F.split(rel, "/")[0])
    found = files(spark, root).select(F.when(alone, rel).otherwise(folder).alias("candidate"), "changed_ms").filter("candidate is not null")
    name = F.lower(_name(F.col("candidate")))
    add = F.when(name.endswith(".zip"), BONUS["zip"]).otherwise(0) + F.when(name.isin("chat.db", "chat.txt", "_chat.txt"), BONUS["db"]).otherwise(0)
    add = add + F.when(name.rlike("instagram|facebook|whatsapp"), BONUS["name"]).otherwise(0)
    return found.groupBy("candidate").agg(F.max("changed_ms").alias("changed_ms")).select("candidate", (F.col("changed_ms") + add).alias("score")).orderBy(F.desc("score"), "candidate")
