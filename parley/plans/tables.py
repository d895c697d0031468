"""The tables that statements read, made from the driver's tables, for Spark and as SQL for the oracle.

m: messages with calendar columns, counts and flags; r: replies; t: turns; b: bursts; s: session
starters; nb: words that name people and conversations; vw: vocabulary; tp: topics; pv: messages with the one before;
me: the account holder; x: reactions; k: participants; w: words less stop words; em: single emojis; u: links;
e: emotion scores; rt: reply turns; rp: these with the turn of another before; mp: media messages; ma: these with the answers of others in two hours; sa: session
starters with the answers of others in a day; pw: messages of strong feeling with the messages up to six
hours before; de: the days' extremes; ev: peaks and valleys of these; tk: keywords near an event; sm: the messages of selected conversations by their participants; emb: vectors
scored against vector 0; pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import compat as C
from parley.operators import intervals, ordered, summaries, texts, triggers
from parley.sources.adapters import CONVERSATIONS_SQL, EVENTS_SQL, messages_from_conversations, messages_from_events

#: Stated once for both engines.
COMMON = {
    "x": ("m", "select message_id, conversation_id, sender target, concat('user_', cast(substr(sender, 6) as bigint) + 1) actor, case message_id % 5 when 0 then '❤️' when 1 then '❤' when 2 then '😂' when 3 then '👍' else '😮' end emoji, timestamp_ms, case message_id % 3 when 0 then timestamp_ms when 1 then cast(floor(timestamp_ms / 1000) as bigint) else 0 end reaction_ts from {m} where message_id % 7 = 0"),
    # of each day's messages of some feeling the stronger of the best and the worst, the worst on a tie
    "de": ("m", """select day, case when abs(hi) > abs(lo) then hi else lo end v, n, case when abs(hi) > abs(lo) then hi_id else lo_id end message_id, case when abs(hi) > abs(lo) then hi_ms else lo_ms end timestamp_ms, row_number() over (order by day) i from
    (select day, max(compound) hi, min(compound) lo, count(*) n, max_by(message_id, compound * 1000000000 - message_id) hi_id, min_by(message_id, compound * 1000000000 + message_id) lo_id, max_by(timestamp_ms, compound * 1000000000 - message_id) hi_ms, min_by(timestamp_ms, compound * 1000000000 + message_id) lo_ms from {m} where not sys and abs(compound) >= 1e-1 group by day)"""),
    "ev": ("de", """select day, v, i, message_id, timestamp_ms, prev, next, case when v > prev and v > next and v > mean + 25e-2 * sd then 'peak' else 'valley' end type from (select day, v, i, message_id, timestamp_ms, lag(v) over (order by i) prev, lead(v) over (order by i) next, avg(v) over () mean, stddev_pop(v) over () sd, count(*) over () n_days from {de})
    where n_days >= 3 and prev is not null and next is not null and (v > prev and v > next and v > mean + 25e-2 * sd or v < prev and v < next and v < mean - 25e-2 * sd)"""),
    "k": ("m", "select distinct conversation_id, sender participant from {m} where not sys"),
    # the account holder: who is in most two-person chats
    "me": ("m", "select sender from (select distinct conversation_id, sender from {m} where conversation_id in (select conversation_id from {m} group by conversation_id having count(distinct sender) = 2)) group by sender order by count(*) desc, sender limit 1"),
    "sm": ("m k", "select m.* from {m} m join {k} k on k.conversation_id = m.conversation_id and k.participant = m.sender where m.conversation_id like 'whatsapp:%' or m.conversation_id in ('instagram:dm_1', 'instagram:dm_2', 'instagram:dm_3')"),
}
_EMOJI = texts.EMOJI
_HOURS = 3_600_000
#: Words in capitals.
CAPITALS = r"\b[A-Z]{3,}\b"
_quoted = lambda *lists: ", ".join(f"'{w}'" for ws in lists for w in ws)
_WORDS = "lower(regexp_replace(content, '[^A-Za-z0-9_\\s''’]', ' ', 'g'))"


def system_sql() -> str:
    low = "lower(trim(content))"
    marked = " or ".join(f"contains({low}, '{x}')" for x in C.SYSTEM_MARKERS)
    return f"(is_system or content is null or length({low}) < 3 or starts_with({low}, '__') or {marked} or regexp_matches({low}, '{C.SYSTEM_PATTERN}'))"


_W = "over (partition by conversation_id order by timestamp_ms, message_id)"
_O = f"(select *, lag(message_id) {_W} prev_id, lag(sender) {_W} prev_sender, timestamp_ms - lag(timestamp_ms) {_W} gap_ms from m)"


def _islands(begins: str) -> str:
    return f"(select *, sum(case when prev_id is null or {begins} then 1 else 0 end) {_W} island from {_O})"


def _reply_kind() -> str:
    return "case when contains(b.content, 'reacted to') or contains(b.content, '❤️') then 'reaction' when b.has_photos or b.has_videos then 'media' else 'text' end"


ORACLE = {
    "m": f"""(select *, hour(ts) "hour", dayofweek(ts) dow, strftime(ts, '%Y-%m') "month", strftime(ts, '%Y-%m-%d') "day", has_photos or has_videos or content ilike '%sent an attachment%' media, {system_sql()} sys,
  len(list_filter(regexp_split_to_array(content, '\\s+'), lambda z: z <> '')) word_count, len(regexp_extract_all(content, '{_EMOJI}')) emoji_count, len(regexp_extract_all(content, '{texts.URL}')) url_count, len(regexp_extract_all(content, '{CAPITALS}')) caps_count,
  greatest(compound, 0) pos, greatest(-compound, 0) neg, 1 - abs(compound) neu from m0)""",
    "r": f"(select conversation_id, prev_id from_message_id, message_id to_message_id, sender responder, gap_ms latency_ms from {_O} where sender <> prev_sender and gap_ms between 1000 and 86400000)",
    "t": f"(select conversation_id, island::bigint turn_no, first(sender) participant, count(*) message_count, min(timestamp_ms) start_ms, max(timestamp_ms) end_ms from {_islands('sender <> prev_sender')} group by conversation_id, island)",
    "b": f"(select conversation_id, island::bigint island_no, arg_min(sender, (timestamp_ms, message_id)) starter, count(*) message_count, count(distinct sender) n_senders, min(timestamp_ms) start_ms, max(timestamp_ms) end_ms from {_islands('gap_ms > 300000')} group by conversation_id, island having count(*) >= 2)",
    "s": f"(select conversation_id, message_id, sender, timestamp_ms from {_O} where prev_id is null or gap_ms >= 14400000)",
    "nb": """(select distinct conversation_id, unnest(list_filter(list_concat(regexp_split_to_array(regexp_replace(lower(sender), '[^A-Za-z0-9_\\s''’]', ' ', 'g'), '\\s+'),
        regexp_split_to_array(regexp_replace(lower(regexp_replace(conversation_id, '^(instagram|messenger|whatsapp|imessage|meta):', '')), '[^A-Za-z0-9_\\s]', ' ', 'g'), '[\\s_]+')), lambda z: length(z) >= 2)) word from m where trim(sender) <> '')""",
    "w": f"(select message_id, conversation_id, sender, word from (select *, unnest(regexp_split_to_array({_WORDS}, '\\s+')) word from m where not sys and length(content) > 5) x where length(word) > 2 and not contains(word, 'http') and word not in ({_quoted(texts.STOP_WORDS, texts.NOTICE_WORDS)}) and not exists (select 1 from nb where nb.conversation_id = x.conversation_id and nb.word = x.word))",
    "vw": f"(select message_id, conversation_id, sender, word from (select *, unnest(regexp_extract_all(lower(content), '[a-z'']{{3,}}')) word from m where not is_system and content is not null) x where word not in ({_quoted(texts.STOP_WORDS)}) and not exists (select 1 from nb where nb.conversation_id = x.conversation_id and nb.word = x.word))",
    "tp": f"(select message_id, conversation_id, sender, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(content, 'https?://[^\\s]+', '', 'g'), '@[A-Za-z0-9_]+', '', 'g'), '[^A-Za-z0-9_\\s''’]', ' ', 'g')), '\\s+'), lambda z: length(z) >= 3 and z not in ({_quoted(texts.TOPIC_STOPS)}))[1:{texts.TOPICS}]) word from m)",
    "pv": f"(select *, lag(message_id) {_W} prev_id, lag(sender) {_W} prev_sender, lag(is_system) {_W} prev_system, lag(word_count) {_W} prev_words, lag(length(content)) {_W} prev_chars, lag(content) {_W} prev_content, timestamp_ms - lag(timestamp_ms) {_W} gap_ms from m where trim(content) <> '')",
    "em": f"(select message_id, conversation_id, sender, unnest(regexp_extract_all(content, '{_EMOJI}')) emoji from m)",
    "u": "(select regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') \"domain\", * exclude (url) from (select *, unnest(regexp_extract_all(content, 'https?://[^\\s]+')) url from m))",
    "e": f"(select message_id, conversation_id, sender, {', '.join(f'{texts.emotion_sql(k)} {k}' for k in texts.EMOTIONS)} from m)",
    "rt": f"""(select conversation_id, turn_no::bigint turn_no, any_value(sender) sender, count(*) n_bubbles, arg_min(message_id, (timestamp_ms, message_id)) first_id, min(timestamp_ms) start_ms, max(timestamp_ms) end_ms, sum(len(list_filter(regexp_split_to_array(said, '\\s+'), lambda z: z <> '')))::bigint words, sum(length(said))::bigint chars, min(length(said)) shortest, max(length(said)) longest,
        string_agg(said, ' ' order by timestamp_ms, message_id)[1:400] context, case when length(first(said order by timestamp_ms, message_id)) > 550 then first(said order by timestamp_ms, message_id)[1:549] || '…' else string_agg(said, '{ordered.MARK}' order by timestamp_ms, message_id) filter (pos = 1 or size <= 550) end reply from
        (select *, row_number() over run pos, sum(length(said) + {len(ordered.MARK)}) over run - {len(ordered.MARK)} size from (select *, sum(case when coalesce(aft, true) or breaks or sender <> prev_sender or gap_ms > 90000 then 1 else 0 end) {_W} turn_no from
        (select *, trim(content) said, lag(breaks) {_W} aft, lag(sender) {_W} prev_sender, timestamp_ms - lag(timestamp_ms) {_W} gap_ms from (select *, is_system or coalesce(trim(content), '') = '' or regexp_matches(lower(content), 'sent [0-9]+ photo|sent a voice message|shared a link') breaks from m))) where not breaks window run as (partition by conversation_id, turn_no order by timestamp_ms, message_id)) group by conversation_id, turn_no)""",
    "rp": "(select * exclude (sender, asked), sender persona, asked context from (select * exclude (context), lag(sender) over w partner, lag(first_id) over w prev_id, lag(chars) over w prev_chars, lag(end_ms) over w prev_end_ms, lag(context) over w asked from rt window w as (partition by conversation_id order by turn_no)) where partner <> sender and length(asked) >= 2)",
    "mp": "(select message_id, conversation_id, sender, \"hour\", timestamp_ms, case when has_photos then 'photo' when has_videos then 'video' else 'attachment' end kind from m where media)",
    "ma": f"""(select a.message_id, a.kind, b.message_id reply_id, b.sender responder, b.timestamp_ms - a.timestamp_ms after_ms, {_reply_kind()} reply_kind from mp a join m b on a.conversation_id = b.conversation_id and a.sender <> b.sender
        and b.timestamp_ms between a.timestamp_ms and a.timestamp_ms + {2 * _HOURS} and (b.timestamp_ms > a.timestamp_ms or b.message_id > a.message_id))""",
    "sa": f"(select s.message_id, b.timestamp_ms - s.timestamp_ms after_ms from s join m b on b.conversation_id = s.conversation_id and b.sender <> s.sender and b.timestamp_ms > s.timestamp_ms and b.timestamp_ms <= s.timestamp_ms + {24 * _HOURS})",
    "pw": f"(select p.message_id peak_id, b.message_id from m p join m b on b.\"day\" = p.\"day\" and b.conversation_id = p.conversation_id and b.timestamp_ms between p.timestamp_ms - {6 * _HOURS} and p.timestamp_ms where abs(p.compound) >= 0.99)",
    "tk": f"""(select ev."day", cause, place, kind, keyword, weight from ev join m b on b."day" = ev."day" and not b.sys and abs(b.compound) >= 0.1 and b.timestamp_ms between ev.timestamp_ms - {6 * _HOURS} and ev.timestamp_ms
        join (values {triggers.values()}) t(cause, place, kind, keyword, weight) on contains(lower(b.content), keyword))""",
    "emb": "(select v.vec_id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) score from embeddings v, (select embedding from embeddings where vec_id = 0) q)",
}
_NEEDS = {"nb": "m", "vw": "m nb", "tp": "m", "pv": "m", "me": "m", "rt": "m", "rp": "rt", "mp": "m", "ma": "m mp", "sa": "m s", "pw": "m", "de": "m", "ev": "de", "tk": "m ev", "x": "m", "k": "m", "sm": "m k", "r": "m", "t": "m", "b": "m", "s": "m", "w": "m nb", "em": "m", "u": "m", "e": "m", "m": "", "emb": "", "pages": ""}


#: Where messages come from, for Spark and as SQL.
SOURCES = {"events": (messages_from_events, EVENTS_SQL), "conversations": (messages_from_conversations, CONVERSATIONS_SQL)}


def messages(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    m, c = SOURCES[source][0](spark, sf_dir), F.col("content")
    compound = F.col("compound")
    return m.withColumns({
        "hour": F.hour("ts"), "dow": F.dayofweek("ts") - 1, "month": C.month(F.col("ts")), "day": C.day(F.col("ts")), "media": summaries.media_message(), "sys": C.is_system(c, F.col("is_system")),
        "word_count": texts.word_count(c), "emoji_count": F.regexp_count("content", F.lit(texts.EMOJI)), "url_count": F.regexp_count("content", F.lit(texts.URL)), "caps_count": F.regexp_count("content", F.lit(CAPITALS)),
        "pos": F.greatest(compound, F.lit(0.0)), "neg": F.greatest(-compound, F.lit(0.0)), "neu": 1 - F.abs(compound),
    })


def _media(m: DataFrame) -> DataFrame:
    kind = F.when(F.col("has_photos"), "photo").when(F.col("has_videos"), "video").otherwise("attachment")
    return m.filter("media").select("message_id", "conversation_id", "sender", "hour", "timestamp_ms", kind.alias("kind"))


def _media_answers(m: DataFrame, mp: DataFrame) -> DataFrame:
    asked = mp.select("message_id", "conversation_id", "sender", "kind", "timestamp_ms", (F.col("timestamp_ms") + 2 * _HOURS).alias("until"))
    answers = m.select("conversation_id", F.col("message_id").alias("reply_id"), F.col("sender").alias("responder"), F.col("timestamp_ms").alias("at"), F.expr(_reply_kind().replace("b.", "")).alias("reply_kind"))
    both = intervals.pairs(asked, answers, ["conversation_id"], "timestamp_ms", "until", "at", 2 * _HOURS).filter("sender <> responder and (at > timestamp_ms or reply_id > message_id)")
    return both.select("message_id", "kind", "reply_id", "responder", (F.col("at") - F.col("timestamp_ms")).alias("after_ms"), "reply_kind")


def _starter_answers(m: DataFrame, s: DataFrame) -> DataFrame:
    asked = s.select("message_id", "conversation_id", "sender", (F.col("timestamp_ms") + 1).alias("since"), (F.col("timestamp_ms") + 24 * _HOURS).alias("until"))
    answers = m.select("conversation_id", F.col("message_id").alias("reply_id"), F.col("sender").alias("responder"), F.col("timestamp_ms").alias("at"))
    both = intervals.pairs(asked, answers, ["conversation_id"], "since", "until", "at", 24 * _HOURS).filter("sender <> responder")
    return both.select("message_id", (F.col("at") - F.col("since") + 1).alias("after_ms"))


def _before_peaks(m: DataFrame) -> DataFrame:
    peaks = m.filter("abs(compound) >= 99e-2").select("conversation_id", "day", F.col("message_id").alias("peak_id"), (F.col("timestamp_ms") - 6 * _HOURS).alias("since"), F.col("timestamp_ms").alias("until"))
    return intervals.pairs(peaks, m.select("conversation_id", "day", "message_id", F.col("timestamp_ms").alias("at")), ["conversation_id", "day"], "since", "until", "at", 6 * _HOURS).select("peak_id", "message_id")


def _event_keywords(m: DataFrame, ev: DataFrame) -> DataFrame:
    windows = ev.select("day", (F.col("timestamp_ms") - 6 * _HOURS).alias("since"), F.col("timestamp_ms").alias("until"))
    texts = m.filter("not sys and abs(compound) >= 1e-1").select("day", "content", "message_id", F.col("timestamp_ms").alias("at"))
    near = intervals.pairs(windows, texts, ["day"], "since", "until", "at", 6 * _HOURS)
    return triggers.keywords(near, "content").select("day", "cause", "place", "kind", "keyword", "weight")


#: Tables of pairs, which Spark makes by cells of time and the oracle by comparing bounds.
_PAIRED = {"w": lambda m, nb: texts.without_names(texts.plain_words(m), nb), "vw": lambda m, nb: texts.vocabulary(m), "rp": ordered.reply_pairs, "mp": _media, "ma": _media_answers, "sa": _starter_answers, "pw": _before_peaks, "tk": _event_keywords}


def make(name: str, spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
    """The table of this name; tables already in ``made`` are used again."""
    if name in made:
        return made[name]
    base = {n: make(n, spark, sf_dir, made) for n in _NEEDS[name].split()}
    m = base.get("m")
    if name in COMMON:
        out = spark.sql(COMMON[name][1], **{k: base[k] for k in COMMON[name][0].split()})
    elif name == "m":
        out = messages(spark, sf_dir)
    elif name == "emb":
        v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        query = v.filter("vec_id = 0").select(F.col("embedding").alias("query")).limit(1)
        out = v.crossJoin(F.broadcast(query)).select("vec_id", texts.cosine(F.col("embedding"), F.col("query")).alias("score"))
    elif name == "pages":
        out = spark.read.parquet(f"{sf_dir}/pages.parquet")
    elif name in _PAIRED:
        out = _PAIRED[name](*(base[k] for k in _NEEDS[name].split()))
    else:
        out = {
            "rt": lambda m: ordered.turn_texts(m, ordered.breaker()), "r": ordered.responses, "t": ordered.turns, "b": lambda m: ordered.gap_islands(m, 300_000, 2), "s": ordered.session_starters, "nb": texts.name_blocklist, "tp": lambda m: m.select("message_id", "conversation_id", "sender", F.explode(texts.topic_keywords(F.col("content"))).alias("word")),
            "pv": lambda m: ordered.with_previous(m.filter("trim(content) <> ''").withColumn("n_chars", F.length("content")), prev_system="is_system", prev_words="word_count", prev_chars="n_chars", prev_content="content").drop("n_chars"),
            "em": lambda m: m.select("message_id", "conversation_id", "sender", F.explode(F.regexp_extract_all("content", F.lit(texts.EMOJI), F.lit(0))).alias("emoji")), "u": texts.links, "e": texts.emotion_scores,
        }[name](m)
    made[name] = out
    return out


def oracle(inputs: str, sql: str, more: bool = False, source: str = "events") -> str:
    """The statement in the oracle's dialect, with the tables it reads before it; ``more``: it begins with further CTEs."""
    names: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS[n].split():
            need(x)
        if n not in names and n != "pages":
            names.append(n)

    for n in inputs.split():
        need(n)
    plain = lambda s: s.format(**{n: n for n in _NEEDS})
    ctes = [f"{n} as {ORACLE[n] if n in ORACLE else '(' + plain(COMMON[n][1]) + ')'}" for n in names]
    if "m" in names:
        ctes.insert(0, SOURCES[source][1].replace("m as (", "m0 as (", 1))
    body = plain(sql).replace("left anti join", "anti join").replace("regexp_like(", "regexp_matches(").replace("sha2(", "sha256(").replace("), 256)", "))").replace("explode(sequence(", "unnest(generate_series(").replace("array_join(array_sort(collect_set(", "array_to_string(list_sort(list(distinct ")
    return f"with {', '.join(ctes)}{',' if more else ''} {body}" if ctes else body
