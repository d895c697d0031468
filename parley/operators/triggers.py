"""What may have caused an emotional event: keywords of nine causes in the messages before it.

All keywords are found in one pass over a text by an automaton.  A keyword counts once for each text
and each list it stands in, wherever it stands in the text.  A null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# For each cause its general, negative and positive keywords.
CAUSES = {
    "work_stress": (
        ["work", "job", "boss", "meeting", "deadline", "project", "stress", "busy", "overtime", "office"],
        ["fired", "layoff", "promotion denied", "overworked", "burnout"],
        ["promotion", "raise", "bonus", "vacation", "weekend"],
    ),
    "relationship": (
        ["relationship", "boyfriend", "girlfriend", "partner", "date", "love", "breakup", "fight", "argument"],
        ["breakup", "fight", "argument", "cheating", "divorce", "lonely"],
        ["anniversary", "proposal", "wedding", "valentine", "love"],
    ),
    "health": (
        ["sick", "doctor", "hospital", "medicine", "pain", "headache", "flu", "covid", "vaccine"],
        ["sick", "pain", "hospital", "surgery", "diagnosis", "emergency"],
        ["better", "recovered", "healthy", "exercise", "gym"],
    ),
    "family": (
        ["family", "mom", "dad", "parents", "brother", "sister", "kids", "children", "baby"],
        ["fight", "argument", "death", "funeral", "divorce", "custody"],
        ["birth", "wedding", "graduation", "celebration", "reunion"],
    ),
    "social": (
        ["friends", "party", "social", "event", "gathering", "celebration", "birthday"],
        ["lonely", "isolated", "cancelled", "excluded", "drama"],
        ["party", "celebration", "fun", "friends", "social"],
    ),
    "achievement": (
        ["achievement", "success", "goal", "accomplished", "won", "passed", "graduated"],
        ["failed", "lost", "rejected", "denied", "missed"],
        ["won", "success", "achieved", "accomplished", "graduated", "promoted"],
    ),
    "weather_events": (
        ["weather", "rain", "snow", "storm", "sunny", "cold", "hot", "hurricane", "flood"],
        ["storm", "hurricane", "flood", "cold", "rain", "snow"],
        ["sunny", "warm", "beautiful", "clear"],
    ),
    "technology": (
        ["phone", "computer", "internet", "app", "software", "bug", "crash", "update"],
        ["crash", "bug", "broken", "virus", "hacked", "lost"],
        ["update", "new", "upgrade", "fixed", "working"],
    ),
    "financial": (
        ["money", "expensive", "cheap", "budget", "salary", "bonus", "bill", "debt"],
        ["expensive", "debt", "broke", "bill", "owe", "poor"],
        ["bonus", "raise", "cheap", "deal", "save", "rich"],
    ),
}
# What a keyword of each kind adds to the score of its cause.
WEIGHTS = {"general": 1.0, "negative": 2.0, "positive": 1.5}


def lexicon() -> list[tuple[str, int, str, str, float]]:
    """cause, its place among the causes, kind, keyword and weight."""
    return [(cause, place, kind, word, weight) for place, (cause, lists) in enumerate(CAUSES.items()) for (kind, weight), words in zip(WEIGHTS.items(), lists, strict=True) for word in words]


def values() -> str:
    """The lexicon as rows of SQL."""
    return ", ".join(f"('{c}', {p}, '{k}', '{w}', {x}::double)" for c, p, k, w, x in lexicon())


def _found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import ahocorasick

    automaton, entries = ahocorasick.Automaton(), {}
    for i, entry in enumerate(lexicon()):
        entries.setdefault(entry[3], []).append(i)
    for word, rows in entries.items():
        automaton.add_word(word, rows)
    automaton.make_automaton()
    for column in texts:
        yield pa.array([sorted({i for _, rows in automaton.iter(t) for i in rows}) if t else [] for t in column.to_pylist()], pa.list_(pa.int32()))


def keywords(rows: DataFrame, text: str) -> DataFrame:
    """A row for each keyword of each text, with its cause, the cause's place, its kind and its weight."""
    find = F.arrow_udf(_found, T.ArrayType(T.IntegerType()))
    entry = T.ArrayType(T.StructType([T.StructField("cause", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("keyword", T.StringType()), T.StructField("weight", T.DoubleType())]))
    table = F.array(*(F.struct(*map(F.lit, e)) for e in lexicon())).cast(entry)
    return rows.withColumn("__at", F.explode(find(F.lower(F.col(text))))).withColumn("__entry", F.element_at(table, F.col("__at") + 1)).select(*rows.columns, "__entry.*")
