"""Retrieval of a persona's past messages for many queries at once: by keywords, by vectors, and of examples.

Queries are rows (query_id, persona, text, conversation_id, preferred), answered from messages by the
persona.  What a query may look at is bounded by recency, so each table is first cut to the newest rows by
key, which Spark does before the shuffle, and only these meet the queries:

* ``keyword_memories``: tiers of candidates (the open chat, preferred chats, an index from words to
  messages, the newest rows), where a tier counts only if those before it found too little;
* ``vector_memories``: at most ``OPEN_CHAT`` vectors of the open chat and ``CANDIDATES`` in all, then cosine;
* ``hybrid``: vectors first, keywords for what is missing;
* ``select_examples``: few-shot pairs by likeness, with a cap for each conversation.

Rows without a text, a sender, a conversation or a time are never found; a query without words finds only by
recency, one without a conversation has no open chat; equal scores are ranked newest first, then by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import texts

# Words that a query isn't searched for.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "is", "it", "this", "that", "i", "you", "he", "she", "we", "they", "me", "my",
    "your", "was", "are", "be", "have", "has", "had", "do", "did", "so", "if", "not",
    "just", "like", "yeah", "ok", "okay", "lol", "haha", "um", "uh", "what", "when",
    "where", "who", "how", "why", "can", "will", "would", "could", "should", "from",
    "about", "into", "than", "then", "them", "their", "there", "heres",
)
# A reply that is no more than an acknowledgement.
ACK = r"(?i)^(ok|k|kk|okay|lol|lmao|haha|hahah|yeah|yep|ye|nah|no|yes|sure|cool|nice|same|true|bet|omg| rip|ahaha|aha)\.?!?$"
# Rows of each tier, what each adds to a score (without words), and the scores that stop the search.
OPEN_ROWS, PREFERRED_CHATS, PREFERRED_ROWS, SEARCHED_WORDS, WORD_ROWS = 120, 8, 200, 3, 20
OPEN_BONUS, PREFERRED_BONUS, SAME_CHAT, PREFERENCE, RECENT = (0.5, 0.1), (0.35, 0.15), 0.3, 0.4, 0.05
ENOUGH, STRONG = 1.0, 1.2
#: The stage of what is taken where nothing is found.
LAST = 9
# Fixed values of the vector search.
OPEN_CHAT, CANDIDATES, LEAST_VECTORS, SAME_CHAT_COSINE, LEAST_COSINE = 800, 1200, 5, 0.04, 0.28
RUN = "[a-z0-9']{3,}"


def runs(text: Column) -> Column:
    """The words of a text of three characters and more, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(runs(text), lambda w: ~w.isin(*STOP_WORDS))


def overlap(asked: Column, found: Column) -> Column:
    """h + h / sqrt(n): h different words in common, n words found."""
    hits = F.size(F.array_intersect(asked, found)).cast("double")
    return F.when(hits > 0, hits + hits / F.sqrt(F.size(found))).otherwise(0.0)


def _newest(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("timestamp_ms"), F.desc("message_id"))
    return rows.withColumn("__newest", F.row_number().over(order)).filter(F.col("__newest") <= k).drop("__newest")


def _spoken(m: DataFrame) -> DataFrame:
    return m.filter("not is_system and trim(content) <> '' and sender is not null and conversation_id is not null and timestamp_ms is not null").select("message_id", "conversation_id", "sender", "content", "timestamp_ms")


def _postings(m: DataFrame) -> DataFrame:
    words = _spoken(m).select("message_id", "sender", "timestamp_ms", F.explode(F.array_distinct(runs(F.col("content")))).alias("word"))
    return _newest(words, WORD_ROWS, "word", "sender")


def index(m: DataFrame) -> DataFrame:
    """The newest ``WORD_ROWS`` messages of each sender with each word (word, sender, message_id, timestamp_ms), by ranges of words.

    More than that no query takes of a word.  Write it once to answer many batches of queries from it.
    """
    return _postings(m).repartitionByRange("word", "sender")


#: Lengths of the pieces that words are looked up by; a token by as much of its start as the longest one that it fills.
PIECES = (3, 5, 8, 12)


def _held_pieces(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word and piece: the words that hold the start of a token."""
    some = tokens.withColumn("piece", F.substr("token", F.lit(1), F.greatest(*(F.when(F.length("token") >= k, k) for k in PIECES))))
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - (k - 1)), lambda i: F.substr("word", i, F.lit(k)))
    pieces = F.flatten(F.array_compact(F.array(*(F.when(F.length("word") >= k, starts(k)) for k in PIECES))))
    return some.join(words.select("word", F.explode(F.array_distinct(pieces)).alias("piece")), "piece")


def _holding(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token with every word that contains it: by the start of the token, then in full."""
    return _held_pieces(tokens, words).filter(F.contains("word", "token")).select("token", "word")


def keyword_memories(m: DataFrame, queries: DataFrame, limit: int = 6, postings: DataFrame | None = None) -> DataFrame:
    """query_id, message_id, score and rank of the persona's messages that fit each query best.

    ``postings`` is the ``index`` of m, if it has been written before.
    """
    spoken = _spoken(m)
    q = queries.select("query_id", "persona", "conversation_id", F.coalesce("preferred", F.array().cast("array<string>")).alias("preferred"), F.array_distinct(tokens(F.col("text"))).alias("asked"))
    worded = F.size("asked") > 0
    # stage, message and what the stage adds; a stage's rows are the newest of its kind
    recent = _newest(spoken, OPEN_ROWS, "conversation_id", "sender").select("conversation_id", F.col("sender").alias("persona"), "message_id", "timestamp_ms")
    opened = q.join(recent, ["conversation_id", "persona"]).select("query_id", "message_id", F.lit(0).alias("stage"), F.when(worded, OPEN_BONUS[0]).otherwise(OPEN_BONUS[1]).alias("bonus"))
    chats = q.select("query_id", "persona", worded.alias("worded"), F.explode(F.slice(F.array_distinct("preferred"), 1, PREFERRED_CHATS)).alias("conversation_id"))
    of_chats = _newest(spoken, PREFERRED_ROWS, "conversation_id", "sender").withColumnRenamed("sender", "persona").select("conversation_id", "persona", "message_id", "timestamp_ms")
    preferred = _newest(chats.join(of_chats, ["conversation_id", "persona"]), PREFERRED_ROWS, "query_id").select("query_id", "message_id", F.lit(1).alias("stage"), F.when(F.col("worded"), PREFERRED_BONUS[0]).otherwise(PREFERRED_BONUS[1]).alias("bonus"))
    # the longest words, of equal ones the first
    longest = F.slice(F.array_sort(F.transform("asked", lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), 1, SEARCHED_WORDS)
    asked = q.select("query_id", "persona", F.posexplode(longest).alias("place", "x")).select("query_id", "persona", (F.col("place") + 2).alias("stage"), F.col("x.w").alias("token"))
    found = (_postings(m) if postings is None else postings).withColumnRenamed("sender", "persona")
    # what a token finds is the same for all queries of a persona, so it is looked up once for them
    held = asked.select("token", "persona").distinct().join(_holding(asked.select("token").distinct(), found.select("word").distinct()), "token")
    hits = held.join(found, ["word", "persona"]).select("token", "persona", "message_id", "timestamp_ms").distinct()
    searched = asked.join(_newest(hits, WORD_ROWS, "token", "persona"), ["token", "persona"]).select("query_id", "message_id", "stage", F.lit(0.0).alias("bonus"))
    # what is left where nothing is found: the newest of the open chat
    said = m.filter("not is_system and content is not null and timestamp_ms is not null")
    latest = _newest(said, limit, "conversation_id", "sender").select("conversation_id", F.col("sender").alias("persona"), "message_id")
    latest = q.join(latest, ["conversation_id", "persona"]).select("query_id", "message_id", F.lit(LAST).alias("stage"), F.lit(RECENT).alias("bonus"))
    # scores of all candidates, in the words of the message, which are cut once; a query has a bounded number of them
    rows = opened.unionByName(preferred).unionByName(searched).unionByName(latest).join(said.select("message_id", F.col("conversation_id").alias("chat"), tokens(F.col("content")).alias("words"), "timestamp_ms"), "message_id").join(q, "query_id")
    bonus = F.when((F.col("stage") > 1) & (F.col("chat") == F.col("conversation_id")), SAME_CHAT).otherwise(F.col("bonus"))
    scored = rows.select("query_id", "message_id", "timestamp_ms", "stage", "bonus", F.when(F.col("stage") < LAST, bonus).alias("more"), F.array_contains("preferred", F.col("chat")).alias("liked"), overlap(F.col("asked"), F.col("words")).alias("base"))
    score = F.round(F.col("base") + F.col("more") + F.when(F.col("liked"), PREFERENCE).otherwise(0.0), 9)
    scored = scored.filter(f"stage = {LAST} or base > 0 or more > 0").select("query_id", "message_id", "timestamp_ms", "stage", F.coalesce(score, "bonus").alias("score"))
    # the preferred chats count where the open one gave too little, a word where all before it gave too few good messages
    w, each = Window.partitionBy("query_id"), Window.partitionBy("query_id", "message_id")
    scored = scored.withColumn("enough", F.count_if((F.col("stage") == 0) & (F.col("score") >= ENOUGH)).over(w)).filter((F.col("stage") != 1) | (F.col("enough") < limit))
    scored = scored.withColumns({"at": F.min(F.when(F.col("score") >= STRONG, F.col("stage"))).over(each), "nth": F.row_number().over(each.orderBy("stage"))})
    going = F.lit(True)
    for s in range(2, SEARCHED_WORDS + 2):
        good = F.count_if((F.col("nth") == 1) & (F.col("at") < s)).over(w)
        scored = scored.withColumn(f"go{s}", going & (good < (min(3, limit) if s == 2 else limit)))
        going = F.col(f"go{s}")
    counted = scored.filter(" and ".join(f"(stage <> {s} or go{s})" for s in range(2, SEARCHED_WORDS + 2)))
    counted = counted.withColumn("found", F.count_if(F.col("stage") < LAST).over(w)).filter(f"stage < {LAST} or found = 0")
    best = counted.groupBy("query_id", "message_id").agg(F.max("timestamp_ms").alias("timestamp_ms"), F.max("score").alias("score"))
    return _ranked(best, limit).select("query_id", "message_id", F.round("score", 6).alias("score"), "rank")


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("timestamp_ms"), "message_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def vector_candidates(m: DataFrame, vectors: DataFrame, queries: DataFrame, model: str) -> DataFrame:
    """query_id with the messages and vectors that its search may score: first the open chat, then the persona's newest.

    ``vectors`` has message_id, model and embedding; queries has query_id, persona and conversation_id.
    """
    stored = _spoken(m).join(vectors.filter(F.col("model") == model).select("message_id", "embedding"), "message_id").withColumnRenamed("sender", "persona")
    q = queries.select("query_id", "persona", "conversation_id")
    opened = q.join(_newest(stored, OPEN_CHAT, "conversation_id", "persona"), ["conversation_id", "persona"]).select("query_id", "message_id", F.lit(0).alias("tier"), F.col("conversation_id").alias("chat"), "timestamp_ms", "embedding")
    widely = q.select("query_id", "persona").join(_newest(stored, CANDIDATES, "persona"), "persona").select("query_id", "message_id", F.lit(1).alias("tier"), F.col("conversation_id").alias("chat"), "timestamp_ms", "embedding")
    once = opened.unionByName(widely.join(opened.select("query_id", "message_id"), ["query_id", "message_id"], "left_anti"))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("timestamp_ms"), F.desc("message_id"))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CANDIDATES)


def vector_memories(m: DataFrame, vectors: DataFrame, queries: DataFrame, model: str, limit: int = 12) -> DataFrame:
    """query_id, message_id, score and rank by cosine with ``embedding`` of the query.

    Queries also have ``own``, a message that is never found (or null).  A persona with fewer than
    ``LEAST_VECTORS`` vectors of any model finds nothing.
    """
    known = vectors.select("message_id").join(m.filter("not is_system").select("message_id", F.col("sender").alias("persona")), "message_id")
    eligible = known.groupBy("persona").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_VECTORS).select("persona")
    q = queries.join(eligible, "persona", "left_semi")
    rows = vector_candidates(m, vectors, q, model).join(q.select("query_id", "own", F.col("conversation_id").alias("open"), F.col("embedding").alias("asked")), "query_id").filter("own is null or own <> message_id")
    score = texts.cosine(F.col("embedding"), F.col("asked")) + F.when(F.col("chat") == F.col("open"), SAME_CHAT_COSINE).otherwise(0.0)
    scored = rows.select("query_id", "message_id", "timestamp_ms", F.round(score, 9).alias("score")).filter(F.col("score") >= LEAST_COSINE)
    return _ranked(scored, limit).select("query_id", "message_id", F.round("score", 6).alias("score"), "rank")


def hybrid(by_vector: DataFrame, by_keyword: DataFrame, limit: int = 6) -> DataFrame:
    """The messages found by vector, then those by keyword that are not among them, up to ``limit``; mode is the first kind that found any.

    Of the keyword messages only as many are looked at as vectors left free.
    """
    kept = by_vector.filter(F.col("rank") <= limit)
    n = kept.groupBy("query_id").agg(F.count("*").alias("n"))
    more = by_keyword.join(n, "query_id", "left").fillna(0, ["n"]).filter(F.col("rank") <= limit - F.col("n")).join(kept.select("query_id", "message_id"), ["query_id", "message_id"], "left_anti")
    both = kept.select("query_id", "message_id", "score", F.lit("vector").alias("found_by"), "rank").unionByName(more.select("query_id", "message_id", "score", F.lit("keyword").alias("found_by"), (F.col("rank") + limit).alias("rank")))
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy("rank"))
    mode = F.when(F.max(F.col("found_by") == "vector").over(w), "vector").otherwise("keyword")
    return both.select("query_id", "message_id", "score", "found_by", mode.alias("mode"), place.cast("int").alias("rank")).filter(F.col("rank") <= limit)


# Words that don't count when two texts are compared.
COMMON = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "is", "it", "this", "that", "i", "you", "me", "my", "your", "was", "are", "be",
)


def token_jaccard(a: Column, b: Column) -> Column:
    """The different words of two characters and more that two texts share, of all that either has; 1 where neither has any."""
    x, y = (F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9']{2,}"), F.lit(0)), lambda w: ~w.isin(*COMMON))) for t in (a, b))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0)), 6).alias("jaccard")


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter text's words against the longer's; a text counts as one word at least."""
    n, k = F.greatest(F.lit(1), _words(a)), F.greatest(F.lit(1), _words(b))
    return F.round(F.least(n, k) / F.greatest(n, k), 6).alias("length_ratio")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def substance(query: Column, reply: Column) -> Column:
    """Engaged replies gain and acknowledgements lose, where the query says more than two words."""
    n = _words(F.replace(reply, F.lit("<<<BUBBLE>>>"), F.lit(" ")))
    return F.when(_words(query) <= 2, 0.0).when(F.trim(reply).rlike(ACK), -0.8).when(n >= 8, 0.45).when(n >= 4, 0.2).otherwise(-0.15)


def likeness(query: Column, context: Column, reply: Column) -> Column:
    """Overlap with the context and a quarter for each different word of the reply."""
    asked = tokens(query)
    return overlap(asked, tokens(context)) + 0.25 * F.size(F.array_intersect(asked, tokens(reply)))


def select_examples(pool: DataFrame, queries: DataFrame, most: int = 12, least: float = 0.15) -> DataFrame:
    """query_id, example_id, score and pick of at most ``most`` few-shot pairs for each query.

    ``pool`` has persona, example_id (its order), conversation_id, context, reply and with_you, a bounded number
    for each persona.  Pairs come in order of score; one conversation gives at most max(3, most / 3) of all but
    the last two; what is then missing is filled in order.  Without words in the query, or where the best
    score is below ``least``, the pairs of the open chat, those with you and the rest are taken in
    that order, a pair of the open chat once more in its other group.
    """
    cap = max(3, -(-most // 3))
    rows = queries.select("query_id", "persona", F.trim(F.coalesce("text", F.lit(""))).alias("query"), F.col("conversation_id").alias("open")).join(pool, "persona")
    score = likeness(F.col("query"), F.col("context"), F.col("reply")) + F.when(F.col("open") == F.col("conversation_id"), 0.55).otherwise(0.0) + F.when(F.col("with_you"), 0.7).otherwise(0.0) + substance(F.col("query"), F.col("reply"))
    w, order = Window.partitionBy("query_id"), [F.desc("score"), F.col("example_id")]
    rows = rows.withColumn("score", F.round(score, 9)).withColumn("plain", (F.col("query") == "") | (F.max("score").over(w) < least))
    ranked = rows.filter("not plain").withColumns({"at": F.row_number().over(w.orderBy(*order)), "nth": F.row_number().over(Window.partitionBy("query_id", "conversation_id").orderBy(*order))})
    ranked = ranked.withColumn("taken", F.count_if(F.col("nth") <= cap).over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    capped = (F.col("nth") <= cap) & (F.col("taken") <= most - 2)
    full = F.min(F.when((F.col("nth") <= cap) & (F.col("taken") == most - 2), F.col("at"))).over(w)
    tier = F.when(capped, 0).when(F.col("at") > full, F.when(F.col("at") <= full + 2, 1).otherwise(2)).otherwise(2)
    picked = ranked.withColumn("tier", tier)
    groups = F.array(F.when(F.col("open") == F.col("conversation_id"), 0), F.when(F.col("with_you"), 1).otherwise(2))
    plain = rows.filter("plain").withColumn("tier", F.explode(F.array_compact(groups))).withColumn("at", F.col("example_id"))
    columns = ["query_id", "example_id", "score", "tier", "at"]
    both = picked.select(*columns).unionByName(plain.select(*columns))
    return both.withColumn("pick", F.row_number().over(w.orderBy("tier", "at"))).filter(F.col("pick") <= most).select("query_id", "example_id", F.round("score", 6).alias("score"), "pick")
