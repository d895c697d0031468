"""Queries of what the library writes: each makes its store or datasets in a scratch folder, changes them in batches, and reads the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import summaries, texts, vector_index
from parley.plans import tables
from parley.plans.registry import register
from parley.sources import datasets, importers, store
from parley.sources.store import Database, scratch_folder


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.make("m", spark, sf_dir, {})


def _database(spark: SparkSession) -> Database:
    return Database(spark, scratch_folder(spark, "database"), buckets=16)


#: Messages as an export of JSON holds them, for the oracle: photos and videos in ones, twos and threes, every second message with media without a text.
_EXPORT = f"""raw as (select message_id, timestamp_ms, sender, is_system, case when source = 'instagram' then 'instagram:' else 'messenger:' end || split_part(conversation_id, ':', 2) conversation_id,
  case when message_id % 2 = 0 and (has_photos or has_videos or has_audio or has_share) then null else "content" end body, case when has_photos then message_id % 3 + 1 else 0 end photos, case when has_videos then message_id % 3 + 1 else 0 end videos, has_audio::bigint audio, has_share, (message_id % 7 = 0)::bigint reactions from m),
imported as (select *, case when body is not null then body when photos > 0 then sender || ' sent ' || photos || ' photo' || case when photos > 1 then 's' else '' end when videos > 0 then sender || ' sent ' || videos || ' video' || case when videos > 1 then 's' else '' end
  when audio > 0 then sender || ' sent a voice message' when has_share and message_id % 4 = 0 then 'see this 😮' when has_share then sender || ' shared a link' end "content" from raw)"""


def _garbled(text):
    """A text as exports hold it: UTF-8 read as Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def exported(m: DataFrame) -> DataFrame:
    """The messages as rows of a JSON export, garbled as these are."""
    items = lambda has, kind: F.when(F.col(has), F.transform(F.sequence(F.lit(1), (F.col("message_id") % 3 + 1).cast("int")), lambda i: F.struct(F.concat_ws("/", F.lit(kind), "message_id", i).alias("uri"), F.floor(F.col("timestamp_ms") / 1000).alias("creation_timestamp"))))
    one = F.array(F.struct(F.concat_ws("/", F.lit("audio"), "message_id").alias("uri"), F.floor(F.col("timestamp_ms") / 1000).alias("creation_timestamp")))
    media = F.col("has_photos") | F.col("has_videos") | F.col("has_audio") | F.col("has_share")
    folder = F.split("conversation_id", ":")[1]
    said = F.when(F.col("message_id") % 4 == 0, _garbled(F.lit("see this 😮")))
    return m.select(
        F.concat(F.lit("/export/"), F.when(F.col("source") == "instagram", "instagram").otherwise("facebook"), F.lit("/inbox/"), folder, F.lit("/message_1.json")).alias("path"),
        F.col("sender").alias("sender_name"), "timestamp_ms", F.when(~(media & (F.col("message_id") % 2 == 0)), _garbled(F.col("content"))).alias("content"), F.when(F.col("is_system"), "Call").otherwise("Generic").alias("type"), F.lit(False).alias("is_unsent"),
        items("has_photos", "photos").alias("photos"), items("has_videos", "videos").alias("videos"), F.when(F.col("has_audio"), one).alias("audio_files"),
        F.when(F.col("has_share"), F.struct(F.concat(F.lit("https://www.example.org/"), "message_id").alias("link"), said.alias("share_text"))).alias("share"),
        F.when(F.col("message_id") % 7 == 0, F.array(F.struct(_garbled(F.lit("❤️")).alias("reaction"), F.col("sender").alias("actor")))).alias("reactions"),
    )


def _imported(spark: SparkSession, sf_dir: str) -> Database:
    """A database with an import of all messages."""
    db = _database(spark)
    importers.load(db, importers.normalized(exported(_messages(spark, sf_dir))))
    return db


_NOT_SAID = tables.system_sql().replace("is_system or content is null", "content is null")


@register("snk01_imported_messages", tables.oracle("m", f"""{_EXPORT} select conversation_id, sender, timestamp_ms, "content", is_system or body is null or {_NOT_SAID} is_system, photos, videos, audio, reactions from imported""", more=True))
def snk01_imported_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export decoded, numbered and stored with its children in one commit, and read back with the number of each kind of child."""
    db = _imported(spark, sf_dir)
    out = db.read("messages").select("message_id", "conversation_id", "sender", "timestamp_ms", "content", "is_system")
    for kind in ("photos", "videos", "audio", "reactions"):
        n = db.read(kind).groupBy("message_id").agg(F.count("*").alias(kind))
        out = out.join(n, "message_id", "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    return out.drop("message_id")


@register("agg20_attachment_series", tables.oracle("m", f"""{_EXPORT} select conversation_id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m') "month", sum(photos)::bigint photo_count, sum(videos)::bigint video_count from imported where photos + videos > 0 group by all""", more=True))
def agg20_attachment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _imported(spark, sf_dir)
    return summaries.attachment_series(*map(db.read, ("messages", "photos", "videos")))


@register("fn08_emoji_total", tables.oracle("m", "select message_id, emoji_count emoji_total from {m}"))
def fn08_emoji_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The emojis of texts of which every second is garbled, counted before and after it is decoded."""
    raw = F.when(F.col("message_id") % 2 == 0, _garbled(F.col("content"))).otherwise(F.col("content"))
    return _messages(spark, sf_dir).select("message_id", texts.emoji_total(raw, importers.decoded(raw)).alias("emoji_total"))


@register("snk11_replace_metrics", tables.oracle("m", "select message_id, case when message_id % 2 = 0 then 2 * word_count else word_count end word_count from {m} where message_id % 5 <> 0"))
def snk11_replace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all messages, then other ones for those of even ids, then none for every fifth."""
    m, db = _messages(spark, sf_dir), _database(spark)
    first = m.select("message_id", F.col("word_count").cast("long").alias("word_count"))
    with db.commit() as tx:
        tx.create("text_metrics", first.schema, ["message_id"])
        tx.upsert("text_metrics", first)
    with db.commit() as tx:
        tx.upsert("text_metrics", first.filter("message_id % 2 = 0").withColumn("word_count", 2 * F.col("word_count")))
        tx.delete("text_metrics", first.filter("message_id % 5 = 0").select("message_id"))
    return db.read("text_metrics")


@register("snk10_upsert_meta", tables.oracle("m", "select sender k, arg_max(message_id, (message_id % 3, message_id)) v from {m} group by sender"))
def snk10_upsert_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of values by sender: each sender's last one in the last batch that has any."""
    m, db = _messages(spark, sf_dir), _database(spark)
    for batch in range(3):
        rows = m.filter(F.col("message_id") % 3 == batch).select(F.col("sender").alias("key"), F.col("message_id").alias("value"))
        with db.commit() as tx:
            tx.create("meta", rows.schema, ["key"])
            tx.upsert("meta", rows, order="value")
    return db.read("meta").select(F.col("key").alias("k"), F.col("value").alias("v"))


@register("snk02_replace_by_source", tables.oracle("m", """kept as (select * from m where source <> 'instagram' or message_id % 2 = 0)
select 'messages' "table", source, count(*) n, min(message_id) least, max(message_id) most from kept group by source union all select 'photos', source, count(*), min(message_id), max(message_id) from kept where has_photos group by source
union all select 'text_metrics', source, count(*), min(message_id), max(message_id) from m where source <> 'instagram' group by source""", more=True))  # fmt: skip
def snk02_replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with photos and metrics, then one source again with half of its messages: what hung on the others is gone."""
    m, db = _messages(spark, sf_dir), _database(spark)
    facts = m.select("message_id", "conversation_id", "source", "content")
    photos = m.filter("has_photos").select("message_id", F.lit(0).alias("place"))
    store.replace_sources(db, facts, {"photos": photos})
    metrics = m.select("message_id", "word_count")
    with db.commit() as tx:
        tx.create("text_metrics", metrics.schema, ["message_id"])
        tx.upsert("text_metrics", metrics)
    again = "message_id % 2 = 0"
    new = facts.filter("source = 'instagram'").filter(again)
    store.replace_sources(db, new, {"photos": photos.filter(again).join(new.select("message_id"), "message_id", "left_semi")})
    sources = m.select("message_id", "source")
    counts = [db.read(t).select("message_id").join(sources, "message_id").groupBy("source").agg(F.count("*").alias("n"), F.min("message_id").alias("least"), F.max("message_id").alias("most")).withColumn("table", F.lit(t)) for t in ("messages", "photos", "text_metrics")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("snk04_json_datasets", tables.oracle("m", "select conversation_id, sender, count(*) message_count from {m} group by conversation_id, sender"))
def snk04_json_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as lines of JSON, published and read back."""
    run = datasets.Run(spark, scratch_folder(spark, "datasets"))
    run.lines("messages_by_sender", summaries.messages_by_sender(_messages(spark, sf_dir)))
    run.publish()
    return datasets.read_lines(spark, run.root, "messages_by_sender", "conversation_id string, sender string, message_count long")


def _pairs(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    made = {"m": tables.messages(spark, sf_dir, source)}
    pairs, me = tables.make("rp", spark, sf_dir, made), tables.make("me", spark, sf_dir, made)
    holder = me.select(F.col("sender").alias("partner"), F.lit(True).alias("with_you"))
    return pairs.withColumn("source", F.split("conversation_id", ":")[0]).join(holder, "partner", "left").fillna(False, ["with_you"])


@register("snk05_fine_tune_lines", tables.oracle("rp me", f"""select persona sender, conversation_id, context, reply, replace('{datasets.STYLE.replace("{}", "@")}', '@', persona) "style", partner = (select sender from me) with_you from {{rp}}"""))
def snk05_fine_tune_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reply pairs as fine-tuning chats with their description, published and read back."""
    run, pairs = datasets.Run(spark, scratch_folder(spark, "datasets")), _pairs(spark, sf_dir)
    datasets.export_fine_tune(run, pairs)
    run.publish()
    kind = "messages array<struct<role: string, content: string>>, meta struct<sender: string, conversation_id: string, source: string, with_you: boolean>"
    rows = datasets.read_lines(spark, run.root, "fine_tune", kind)
    said = lambda i: F.col("messages")[i]["content"]
    return rows.select("meta.sender", "meta.conversation_id", said(1).alias("context"), said(2).alias("reply"), said(0).alias("style"), "meta.with_you")


@register("src22_unused_pairs", tables.oracle("rp", """f as (select * from (select *, row_number() over (partition by persona order by rn, conversation_id) pick from (select *, row_number() over (partition by persona, conversation_id order by turn_no) rn from rp)) where pick <= 80)
select persona, first_id from rp where (persona, trim(context), trim(reply)) not in (select (persona, trim(context), trim(reply)) from f)""", more=True, source="conversations"))  # fmt: skip
def src22_unused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs left for a second run, which reads the few-shot pairs of the first back from its dataset."""
    pairs = _pairs(spark, sf_dir, "conversations")
    nth = F.expr("row_number() over (partition by persona, conversation_id order by turn_no)")
    pick = F.expr("row_number() over (partition by persona order by nth, conversation_id)")
    shots = pairs.withColumn("nth", nth).withColumn("pick", pick).filter("pick <= 80")
    run = datasets.Run(spark, scratch_folder(spark, "datasets"))
    run.lines("few_shot", shots.select("persona", "context", "reply"))
    run.publish()
    return datasets.unused(pairs, datasets.read_lines(spark, run.root, "few_shot", datasets.KEYS)).select("persona", "first_id")


@register("dsh28_freshness", tables.oracle("m", """t as (select strftime(make_timestamp(min(timestamp_ms) * 1000), '%Y-%m-%dT%H:%M:%S') a, strftime(make_timestamp((min(timestamp_ms) + 86400000) * 1000), '%Y-%m-%dT%H:%M:%S') b, strftime(make_timestamp(max(timestamp_ms) * 1000), '%Y-%m-%dT%H:%M:%S') c, string_agg(distinct source, ',' order by source) s from m)
select 1 step, a imported, null generated, true stale, s sources from t union all select 2, a, b, false, s from t union all select 3, c, b, true, s from t""", more=True))  # fmt: skip
def dsh28_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import at the first message, a run a day later, an import at the last message: stale, fresh and stale again."""
    m, db = _messages(spark, sf_dir), _database(spark)
    text = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    at = m.agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("c"), F.array_sort(F.collect_set("source")).alias("s")).select(text(F.col("a")).alias("a"), text(F.col("a") + 86_400_000).alias("b"), text(F.col("c")).alias("c"), "s").first()
    states = []

    def note() -> None:
        f = datasets.freshness(db)
        states.append((len(states) + 1, f["last_import_at"], f["last_generate_at"], f["stale"], ",".join(f["last_import_sources"])))

    datasets.record_import(db, at.s, at.a)
    note()
    run = datasets.Run(spark, scratch_folder(spark, "datasets"), at.b)
    run.lines("messages_by_sender", summaries.messages_by_sender(m))
    run.publish(db)
    note()
    datasets.record_import(db, at.s, at.c)
    note()
    return spark.createDataFrame(states, "step int, imported string, generated string, stale boolean, sources string")


@register("per14_vector_upkeep", tables.oracle("m", """select message_id, 'hashed' model, 64 dims from (select message_id, row_number() over (partition by sender order by timestamp_ms desc, message_id desc) n, count(*) over (partition by sender) c from {m} where length(trim(content)) >= 8 and not is_system) where n <= 2500 and c >= 20"""))
def per14_vector_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for half of the messages with an older model, then for the same with the current one, then for what is missing."""
    m, db = _messages(spark, sf_dir), _database(spark)
    half = m.filter("message_id % 2 = 0")
    vector_index.update(db, half, model="older")
    vector_index.update(db, half)
    vector_index.update(db, m)
    return db.read(vector_index.TABLE).select("message_id", "model", "dims")
