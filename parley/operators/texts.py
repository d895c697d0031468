"""Operators on message and document texts: metrics, buckets, emoji, words, links, emotions, vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import compat as C

# The emoji ranges.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
# What counts as a link, and the links whose hosts are read.
URL = r"(?:https?://|www\.|[a-zA-Z0-9][a-zA-Z0-9-]{1,61}[a-zA-Z0-9]\.)[^\s]+"
LINK = r"https?://[^\s]+"
# The words and signs that speak for an emotion; each list is counted by itself.
EMOTIONS = {
    "joy": (
        "happy|joy|excited|great|awesome|amazing|wonderful|fantastic|love|perfect|best|excellent|brilliant|superb", "haha|hehe|lol|lmao|rofl", "😂|😄|😊|😍|🥰|😘|💕|❤️|💖|🎉|🎊",
        "yay|woohoo|hooray|celebrate|celebration|party|fun|enjoy|enjoying", "good news|so good|feels good|makes me happy|thrilled|delighted|pleased",
    ),
    "sadness": ("sad|cry|crying|tears|upset|disappointed|depressed|miserable", "😢|😭|😞|😔|💔|😿|😪|😫|😩", "sorry|regret|miss you|missing you|hurt|pain|heartbreak|heartbroken", "feel bad|so sad|makes me sad|feeling down|bummed|devastated"),
    "anger": ("angry|mad|furious|rage|pissed|annoyed|irritated|frustrated|hate|disgusted", "😠|😡|🤬|💢|😤|👿|😾", "damn|shit|fuck|stupid|idiot|ridiculous|outrageous", "so mad|makes me angry|pissed off|fed up|sick of"),
    "fear": ("scared|afraid|fear|frightened|terrified|nervous|worried|anxious|panic", "😨|😰|😱|😖|😟|😧|😬", "dangerous|risky|unsafe|threatening|creepy|spooky", "so scared|makes me nervous|freaking out|paranoid"),
    "surprise": ("wow|whoa|omg|oh my god|shocking|surprised|unexpected|incredible|unbelievable", "😮|😯|😲|🤯|😵|😳", "can't believe|no way|plot twist|out of nowhere"),
}
# Words that make an emotion stronger or weaker, and by how much; the first that is there counts.
INTENSITY = (("very|extremely|incredibly|absolutely|totally|completely|really|so|super|ultra", 1.5), ("quite|pretty|fairly|somewhat|rather|kind of|sort of", 1.2), ("slightly|a bit|a little|barely|hardly|maybe|perhaps", 0.7))
# Words that say nothing by themselves, and words of notices.
STOP_WORDS = (
    "the", "and", "that", "this", "but", "for", "not", "you", "are", "was", "will",
    "can", "with", "have", "had", "they", "them", "their", "there", "then",
    "than", "when", "what", "who", "why", "how", "where", "which", "some", "any",
    "all", "one", "two", "see", "get", "got", "make", "made", "take", "come", "came",
    "went", "said", "say", "know", "think", "like", "just", "now", "way", "may",
    "use", "its", "only", "over", "also", "back", "after", "first", "well", "work",
    "life", "day", "part", "year", "much", "good", "new", "old", "great", "right",
    "still", "own", "long", "same", "want", "look", "find", "give", "here", "both",
    "last", "most", "very", "call", "even", "need", "feel", "try", "ask", "turn",
    "move", "live", "seem", "show", "help", "talk", "let", "put", "would", "could",
    "should", "his", "her", "him", "she", "your",
)
NOTICE_WORDS = (
    "sent", "photo", "photos", "video", "videos", "reacted", "reaction", "reactions",
    "message", "messages", "attachment", "attachments", "liked", "shared", "share",
    "voice", "removed", "unsent", "sticker", "stickers", "gamepigeon", "move",
    "named", "changed", "added", "call", "missed", "started", "ended",
)
# Words that are no topic of a starter, and how many topics it has.
# Further words that a list of top words leaves out, the last three lines notices of platforms.
TOP_WORD_STOPS = (
    "the", "and", "you", "that", "was", "for", "are", "with", "his", "they", "this", "have", "from",
    "not", "had", "but", "what", "can", "said", "all", "were", "when", "your", "how", "each", "she",
    "which", "their", "time", "will", "about", "out", "many", "then", "them", "these", "may", "way",
    "use", "her", "than", "call", "who", "its", "now", "find", "long", "down", "day", "did", "get",
    "come", "made", "part", "just", "like", "good", "know", "think", "want", "see", "back", "also",
    "well", "work", "make", "look", "feel", "going", "really", "yeah", "okay", "haha", "lol", "yes",
    "sure", "thanks", "thank", "nice", "cool",
    "sent", "photo", "photos", "video", "videos", "reacted", "reaction", "reactions",
    "message", "messages", "attachment", "attachments", "liked", "shared", "share",
    "voice", "removed", "unsent", "sticker", "stickers", "gamepigeon", "move",
    "named", "changed", "added", "missed", "started", "ended",
)
TOPIC_STOPS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her",
    "was", "one", "our", "out", "day", "get", "has", "him", "his", "how", "man",
    "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let",
    "put", "say", "she", "too", "use",
)
TOPICS = 5
#: Tasks that the words of one conversation are dealt to.
NAME_SALTS = 16


def emoji_total(raw: Column, decoded: Column) -> Column:
    """The emojis of a text as it stands or as decoded, whichever are more."""
    return F.greatest(*(F.coalesce(F.regexp_count(t, F.lit(EMOJI)), F.lit(0)) for t in (raw, decoded)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def snippet(text: Column, most: int = 140) -> Column:
    """A text on one line with single spaces, cut to ``most`` characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def text_metrics(m: DataFrame) -> DataFrame:
    return m.filter("content is not null").select("message_id", "conversation_id", "sender", word_count(F.col("content")).alias("word_count"), F.regexp_count("content", F.lit(EMOJI)).alias("emoji_count"), F.regexp_count("content", F.lit(URL)).alias("url_count"))


def text_summary(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("total_messages"), F.round(F.avg("word_count"), 6).alias("avg_words"), F.sum("emoji_count").alias("total_emojis"), F.sum("url_count").alias("total_urls"))


def emoji_by_sender(t: DataFrame) -> DataFrame:
    return t.groupBy("conversation_id", "sender").agg(F.sum("emoji_count").alias("emoji_count")).filter("emoji_count > 0")


def top_emojis(m: DataFrame, k: int = 5) -> DataFrame:
    seen = m.select("sender", F.explode(F.regexp_extract_all("content", F.lit(EMOJI), F.lit(0))).alias("emoji")).groupBy("sender", "emoji").agg(F.count("*").alias("n"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("n"), "emoji"))).filter(F.col("rank") <= k)


def length_distribution(t: DataFrame) -> DataFrame:
    """Every bucket of every conversation, zero-filled, with its share."""
    labels = F.array(*(F.lit(label) for _, label in C.LENGTHS))
    worded = t.filter("word_count > 0")
    grid = worded.select("conversation_id").distinct().select("conversation_id", F.explode(labels).alias("bucket"))
    counts = worded.groupBy("conversation_id", C.bucket(F.col("word_count"), C.LENGTHS, inclusive=True).alias("bucket")).agg(F.count("*").alias("n"))
    out = grid.join(counts, ["conversation_id", "bucket"], "left").fillna({"n": 0})
    return out.withColumn("percentage", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("conversation_id")), 6))


def name_tokens(name: Column) -> Column:
    """The words of a person's name, of two characters and more."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"[^A-Za-z0-9_\s'’]", " "), r"\s+"), lambda w: F.length(w) >= 2)


def label_tokens(label: Column) -> Column:
    """The words of a conversation's label, cut at underscores too."""
    return F.filter(F.split(F.regexp_replace(F.lower(label), r"[^A-Za-z0-9_\s]", " "), r"[\s_]+"), lambda w: F.length(w) >= 2)


def name_blocklist(m: DataFrame) -> DataFrame:
    """conversation_id and word: what names the conversation or anyone who writes in it."""
    who = m.filter("trim(sender) <> ''").select("conversation_id", "sender").distinct()
    label = F.regexp_replace("conversation_id", "^(instagram|messenger|whatsapp|imessage|meta):", "")
    return who.select("conversation_id", F.explode(F.array_union(name_tokens(F.col("sender")), label_tokens(label))).alias("word")).distinct()


def without_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """The words that name nobody in their conversation; a conversation's words are dealt to several tasks."""
    dealt = words.withColumn("__salt", F.pmod(F.xxhash64("message_id"), F.lit(NAME_SALTS)).cast("int"))
    copies = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
    return dealt.join(copies, ["conversation_id", "word", "__salt"], "left_anti").select(*words.columns)


def word_frequencies(m: DataFrame, k: int = 1000) -> DataFrame:
    """The most frequent words by sender and conversation that were used twice; names are taken out after counting."""
    said = m.withColumn("sys", C.is_system(F.col("content"), F.col("is_system")))
    counts = plain_words(said).groupBy("word", "sender", "conversation_id").agg(F.count("*").alias("n")).filter("n > 1")
    return counts.join(name_blocklist(m), ["conversation_id", "word"], "left_anti").select("word", "sender", "conversation_id", "n").orderBy(F.desc("n"), "word", "sender", "conversation_id").limit(k)


def plain_words(m: DataFrame) -> DataFrame:
    """The words of longer messages that are no notices, less stop words and links."""
    parts = F.split(F.lower(F.regexp_replace("content", r"[^A-Za-z0-9_\s'’]", " ")), r"\s+")
    out = m.filter("not sys and length(content) > 5").select("message_id", "conversation_id", "sender", F.explode(parts).alias("word"))
    return out.filter((F.length("word") > 2) & ~F.contains("word", F.lit("http")) & ~F.col("word").isin(*STOP_WORDS, *NOTICE_WORDS))


def words(m: DataFrame) -> DataFrame:
    return without_names(plain_words(m), name_blocklist(m))


def vocabulary(m: DataFrame) -> DataFrame:
    """The words of a persona's messages: letters and apostrophes, three and more, less stop words and names."""
    found = F.regexp_extract_all(F.lower("content"), F.lit("[a-z']{3,}"), F.lit(0))
    out = m.filter("not is_system and content is not null").select("message_id", "conversation_id", "sender", F.explode(found).alias("word"))
    return without_names(out.filter(~F.col("word").isin(*STOP_WORDS)), name_blocklist(m))


def topic_keywords(text: Column) -> Column:
    """The first words of a text that may be topics, without links and mentions."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://[^\s]+", ""), "@[A-Za-z0-9_]+", "")
    parts = F.split(F.lower(F.regexp_replace(bare, r"[^A-Za-z0-9_\s'’]", " ")), r"\s+")
    return F.slice(F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(*TOPIC_STOPS)), 1, TOPICS)


def links(m: DataFrame) -> DataFrame:
    """A row for each link of a message, with its host."""
    found = m.withColumn("url", F.explode(F.regexp_extract_all("content", F.lit(LINK), F.lit(0))))
    return found.withColumn("domain", F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")).filter("domain is not null").drop("url")


def url_domains(m: DataFrame, k: int = 100) -> DataFrame:
    counts = links(m).groupBy("domain", "sender", "conversation_id").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("first_seen"), F.max("timestamp_ms").alias("last_seen"))
    return counts.orderBy(F.desc("n"), "domain", "sender", "conversation_id").limit(k)


def _bounded(pattern: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])" if pattern[0].isascii() else pattern


def emotion_scores(m: DataFrame) -> DataFrame:
    """0.3 for every sign of an emotion, at most 1, times the intensity of the words around, at most 1."""
    times = F.lit(1.0)
    for pattern, factor in reversed(INTENSITY):
        times = F.when(F.col("content").rlike(_bounded(pattern)), factor).otherwise(times)
    scores = []
    for emotion, patterns in EMOTIONS.items():
        count = sum((F.regexp_count("content", F.lit(_bounded(p))) for p in patterns), F.lit(0))
        scores.append(F.coalesce(F.floor(F.least(F.lit(1.0), F.least(F.lit(1.0), count * 0.3) * times) * 100 + 0.5) / 100, F.lit(0.0)).alias(emotion))
    return m.select("message_id", "conversation_id", "sender", *scores)


def emotion_sql(emotion: str) -> str:
    """The same for the oracle."""
    quoted = lambda p: (f"(?i)\\b(?:{p})\\b" if p[0].isascii() else p).replace("'", "''")
    count = " + ".join(f"len(regexp_extract_all(content, '{quoted(p)}'))" for p in EMOTIONS[emotion])
    times = "case " + " ".join(f"when regexp_matches(content, '{quoted(p)}') then {f}::double" for p, f in INTENSITY) + " else 1::double end"
    return f"coalesce(floor(least(1::double, least(1::double, ({count}) * 0.3::double) * {times}) * 100 + 0.5) / 100, 0)"


def emotions(m: DataFrame) -> DataFrame:
    """Emotion scores of the messages that have any."""
    return emotion_scores(m).filter(sum((F.col(k) for k in EMOTIONS), F.lit(0.0)) > 0)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def vector_top(vectors: DataFrame, query_id: int, k: int = 10, least: float = -1.0) -> DataFrame:
    """The k vectors closest to one of them; the query is a single row."""
    query = vectors.filter(F.col("vec_id") == query_id).select(F.col("embedding").alias("query")).limit(1)
    scored = vectors.filter(F.col("vec_id") != query_id).crossJoin(F.broadcast(query)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)


QUERIES = 8192
TOP = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """One row of length 1 (or 0) per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _top_of_part(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """For every query the k best rows of each task, by matrix products of fixed size."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        none = np.int64(1) << 60
        far, who = np.full((len(ids), k), none), np.full((len(ids), k), none)  # a million less the score's millionths; vec_id
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
                vec, m = part.column(0).to_numpy(), _matrix(part.column(1))
                for q in range(0, len(ids), 256):
                    rows = slice(q, q + 256)
                    key = 1_000_000 - np.rint(queries[rows] @ m.T * 1e6).astype(np.int64)
                    key[ids[rows, None] == vec] = none >> 20
                    key = (key << 20) + np.arange(len(vec))
                    if len(vec) > k:
                        key = np.partition(key, k - 1, axis=1)[:, :k]
                    own = (key >> 20) == none >> 20
                    f = np.concatenate([far[rows], np.where(own, none, key >> 20)], 1)
                    w = np.concatenate([who[rows], np.where(own, none, vec[key & 0xFFFFF])], 1)
                    best = np.lexsort((w, f), axis=1)[:, :k]
                    far[rows], who[rows] = np.take_along_axis(f, best, 1), np.take_along_axis(w, best, 1)
        q, j = np.nonzero(far < none)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(who[q, j]), pa.array((1_000_000 - far[q, j]) / 1e6)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, TOP)


def vector_top_all(vectors: DataFrame, every: int = 20, k: int = 10) -> DataFrame:
    """The k vectors closest to each whose id is divisible by ``every``, over all others, with their rank.

    Queries are broadcast in blocks of about ``QUERIES``; each task keeps k rows a query.  Rows without
    an id or a vector are left out; a vector of norm 0 scores 0.
    """
    vectors = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    found = vectors.sparkSession.createDataFrame([], TOP)
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if len(block):
            ids = block["vec_id"].to_numpy()
            found = found.unionByName(_top_of_part(vectors, ids, _matrix(block["embedding"].combine_chunks()), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
