"""How each persona writes to the account holder, mined from the chats they share.

A persona's lines are the newest ``LINES`` texts in those chats; fewer than ``LEAST`` give no card.  Phrases are
found by expressions on each line and counted with partial aggregation, so all personas are mined at once.
Equal counts are ordered by the phrase.  Rows without a sender, a chat or a text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import compat as C

LINES, LEAST = 3000, 8
#: Parts that a persona's lines are dealt to before the newest of all are taken.
PARTS = 64
# Places, endearments and what greetings, openings, endings and teasing look like.
PLACES = (
    "melbourne", "sydney", "brisbane", "perth", "adelaide", "canberra", "hobart",
    "london", "paris", "tokyo", "bali", "thailand", "japan", "australia", "nz",
    "new zealand", "airport", "cafe", "coffee", "uni", "campus", "office", "gym",
    "beach", "home", "work", "city", "suburb", "station", "hotel",
)
ENDEARMENTS = (
    "babe", "baby", "love", "hun", "honey", "bro", "dude", "mate", "fam", "hon",
    "sweetheart", "darling", "sis", "bestie", "bestiee",
)
GREETING = r"(?i)^(?:hey|hi|hello|yo|sup|heya|hiya|morning|afternoon|evening)\s+([a-z][a-z']{1,20})\b"
OPENER = r"(?i)^(hey|hi|hello|yo|sup|heya|hiya|morning|afternoon|evening|miss you|thinking of you|guess what|ok so|so+|wait|omg|hah+|lol)\b"
CLOSER = r"(?i)^(ok|k|kk|okay|night|gn|goodnight|bye|cya|ttyl|talk later|love you|ily|xx+|sleep well|drive safe)\b"
TEASE = r"(?i)\b(haha+|lol|lmao|jk|idiot|dumb|stupid|shut up|miss you|love you|babe|baby|cute|hot|sexy|nerd|loser|silly)\b"
MENTION = r"(?<![.!?]\s|^)([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?)"
#: Phrases of each kind that a card holds.
MOST = {"address": 6, "opener": 6, "closer": 6, "person": 8, "place": 6, "teasing": 5}
OTHERS = 20


def _names(full: Column) -> Column:
    """The first and the last word of a name, in small letters."""
    parts = F.filter(F.split(F.lower(F.trim(full)), r"\s+"), lambda p: p != "")
    return F.array_distinct(F.array_compact(F.array(F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1))))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _plain(m: DataFrame) -> DataFrame:
    return m.filter("not is_system and sender is not null and conversation_id is not null")


def shared_chats(m: DataFrame, me: DataFrame) -> DataFrame:
    """persona and conversation_id of the chats that a persona shares with the account holder (sender, one row), who is in column ``you``."""
    members = _plain(m).select("conversation_id", "sender").distinct()
    mine = members.join(F.broadcast(me.select("sender")), "sender", "left_semi").select("conversation_id")
    others = members.join(F.broadcast(me.select("sender")), "sender", "left_anti")
    return others.join(mine, "conversation_id", "left_semi").withColumnRenamed("sender", "persona").crossJoin(F.broadcast(me.select(F.col("sender").alias("you"))))


def lines(m: DataFrame, me: DataFrame) -> DataFrame:
    """The newest texts of each persona in the chats that it shares with the account holder."""
    said = _plain(m).filter("trim(content) <> ''").withColumnRenamed("sender", "persona")
    rows = said.join(shared_chats(m, me), ["conversation_id", "persona"])
    w, newest = Window.partitionBy("persona"), [F.desc("timestamp_ms"), F.desc("message_id")]
    # first the newest of each part of a persona's lines, so that a task never holds all lines of one
    part = Window.partitionBy("persona", "part").orderBy(*newest)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("message_id", "timestamp_ms"), F.lit(PARTS))).withColumn("newest", F.row_number().over(part)).filter(F.col("newest") <= LINES).drop("part")
    rows = rows.withColumn("newest", F.row_number().over(w.orderBy(*newest))).filter(F.col("newest") <= LINES)
    return rows.withColumn("n_lines", F.count("*").over(w)).filter(F.col("n_lines") >= LEAST).withColumn("text", F.trim("content"))


def _top(found: DataFrame) -> DataFrame:
    """The most frequent phrases of each persona and kind."""
    counts = found.filter("item is not null and item <> ''").groupBy("persona", "kind", "item").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("persona", "kind").orderBy(F.desc("n"), "item")))
    most = F.create_map(*(F.lit(x) for pair in MOST.items() for x in pair))
    return ranked.filter(F.col("rank") <= most[F.col("kind")])


def phrases(m: DataFrame, me: DataFrame) -> DataFrame:
    """persona, kind (address, opener, closer), item, n and rank."""
    rows = lines(m, me).withColumns({"low": F.lower("text"), "parts": _names(F.col("you")), "head": F.substring(F.split("text", "\n")[0], 1, 80)})
    greeted = F.lower(F.regexp_extract("head", GREETING, 1))
    mine = F.exists("parts", lambda p: F.startswith(greeted, F.substring(p, 1, 3)) | F.startswith(p, F.substring(greeted, 1, 3)))
    by_name = F.when((greeted != "") & (mine | greeted.isin(*ENDEARMENTS)), greeted)
    fond = [F.when(F.col("low").rlike(rf"\b{e}\b"), e) for e in ENDEARMENTS]
    short = (F.length("text") < 40) | F.col("head").rlike(GREETING)
    own = F.filter("parts", lambda p: (F.length(p) >= 3) & short & F.regexp_like(F.col("low"), F.concat(F.lit(r"\b\Q"), p, F.lit(r"\E\b"))))
    forms = F.filter(F.concat(F.array_compact(F.array(by_name, *fond)), own), lambda f: F.length(f) >= 2)
    address = rows.select("persona", F.lit("address").alias("kind"), F.explode(forms).alias("item"))
    opener = rows.select("persona", F.lit("opener").alias("kind"), F.lower(F.regexp_extract("text", OPENER, 1)).alias("item"))
    closer = rows.filter(_words(F.col("text")) <= 6).select("persona", F.lit("closer").alias("kind"), F.lower(F.regexp_extract("text", CLOSER, 1)).alias("item"))
    return _top(address.unionByName(opener).unionByName(closer))


def talkative(m: DataFrame, me: DataFrame) -> DataFrame:
    """persona and name of the ``OTHERS`` other members with most messages, three or more, in the chats that it shares with the account holder.

    Personas that share the same chats have the same others less themselves, so these are ranked once for each set of chats.
    """
    chats = shared_chats(m, me)
    of = chats.groupBy("persona", "you").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("conversation_id"))), 256).alias("circle"))
    # one persona stands for its circle
    first = of.groupBy("circle").agg(F.min("persona").alias("persona"))
    counts = _plain(m).groupBy("conversation_id", "sender").agg(F.count("*").alias("n"))
    both = counts.join(chats.join(first, "persona"), "conversation_id").filter("sender <> you").groupBy("circle", "sender").agg(F.sum("n").alias("n")).filter("n >= 3")
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("circle").orderBy(F.desc("n"), "sender"))).filter(F.col("place") <= OTHERS + 1)
    each = of.join(ranked, "circle").filter("sender <> persona")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("persona").orderBy("place"))).filter(F.col("place") <= OTHERS).select("persona", F.trim("sender").alias("name"))


def mentions(m: DataFrame, me: DataFrame) -> DataFrame:
    """persona, kind (person, place), item, n and rank: other members named twice, capitalised names and known places."""
    rows = lines(m, me)
    skip = lambda item: F.array_contains(F.concat(_names(F.col("you")), _names(F.col("persona")), F.array(F.lower("you"), F.lower("persona"), F.lit("instagram"), F.lit("user"))), F.lower(item))
    named = rows.select("persona", "you", "content").join(talkative(m, me), "persona").filter(F.length("name") >= 2)
    # a plain search spares most of the patterns, which are compiled for each row
    plain = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = named.filter(F.contains(plain(F.col("content")), plain(F.col("name")))).filter(F.regexp_like("content", F.concat(F.lit(r"(?i)\b\Q"), F.col("name"), F.lit(r"\E\b"))) & ~skip(F.col("name")))
    twice = named.groupBy("persona", "name").agg(F.count("*").alias("n")).filter("n >= 2").select("persona", F.lit("person").alias("kind"), F.col("name").alias("item"), "n")
    places = rows.select("persona", F.lit("place").alias("kind"), F.explode(F.array_compact(F.array(*(F.when(F.contains(F.lower("content"), F.lit(p)), p) for p in PLACES)))).alias("item"))
    written = rows.select("persona", "you", F.explode(F.regexp_extract_all("content", F.lit(MENTION), F.lit(1))).alias("item")).filter(~skip(F.col("item")) & ~F.lower("item").isin(*ENDEARMENTS))
    known = F.lower("item").isin(*PLACES)
    written = written.filter(known | F.contains("item", F.lit(" ")) | (F.length("item") >= 4)).select("persona", F.when(known, "place").otherwise("person").alias("kind"), F.when(known, F.lower("item")).otherwise(F.col("item")).alias("item"))
    counts = places.unionByName(written).groupBy("persona", "kind", "item").agg(F.count("*").alias("n")).unionByName(twice).groupBy("persona", "kind", "item").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("persona", "kind").orderBy(F.desc("n"), "item")))
    return ranked.filter((F.col("kind") == "person") & (F.col("rank") <= MOST["person"]) | (F.col("kind") == "place") & (F.col("rank") <= MOST["place"]))


def teasing(m: DataFrame, me: DataFrame) -> DataFrame:
    """persona, line and rank of short real lines of teasing or warmth, longer ones first, no line twice."""
    rows = lines(m, me).filter(F.length("text").between(8, 120) & F.col("text").rlike(TEASE)).withColumn("words", F.least(F.lit(20), _words(F.col("text"))))
    order = [F.desc("words"), F.col("newest")]
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy("persona", F.lower("text")).orderBy(*order))).filter("again = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("persona").orderBy(*order))).filter(F.col("rank") <= MOST["teasing"]).select("persona", F.col("text").alias("line"), "rank")


def tone(mean: Column, positive: Column, negative: Column) -> Column:
    out = F.when(mean.isNull(), "tone with you is hard to pin down from available data").when((mean > 0.2) & (positive > 0.35), "usually warm / upbeat with you")
    return out.when((mean < -0.1) | (negative > 0.3), "often blunt or cooler with you than average").when(mean > 0.05, "mildly positive / friendly with you").otherwise("fairly neutral with you")


def cards(m: DataFrame, me: DataFrame) -> DataFrame:
    """One row for each persona: shared messages and chats, tone, questions and words with the account holder and in all."""
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    chats = shared_chats(m, me)
    said = lines(m, me).groupBy("persona").agg(F.count("*").alias("shared_messages"), tenth(F.avg(_words(F.col("text")))).alias("words_with_you"), (F.floor(F.avg(F.contains("content", F.lit("?")).cast("double")) * 1000 + 0.5) / 1000).alias("question_rate"))
    counted = chats.groupBy("persona").agg(F.count("*").alias("shared_chats"))
    rows = _plain(m).withColumnRenamed("sender", "persona")
    feeling = rows.join(chats, ["conversation_id", "persona"]).groupBy("persona").agg(C.mean_score(F.col("compound")).alias("mean"), F.avg((F.col("compound") > 0.05).cast("double")).alias("positive"), F.avg((F.col("compound") < -0.05).cast("double")).alias("negative"))
    everywhere = rows.groupBy("persona").agg(tenth(F.avg("word_count")).alias("words_everywhere"))
    out = said.join(counted, "persona").join(feeling, "persona").join(everywhere, "persona")
    return out.select("persona", "shared_messages", "shared_chats", tone(F.col("mean"), F.col("positive"), F.col("negative")).alias("tone"), "question_rate", "words_with_you", "words_everywhere")
