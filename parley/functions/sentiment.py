"""Sentiment by a valence lexicon, with the published VADER rules (Hutto and Gilbert, 2014).

The lexicon is a table that the caller supplies (token, valence), read from a tab-separated file with
``read_lexicon``; it is sent to the tasks and may have ``MOST`` tokens.  Texts are judged by a pandas
UDF, in batches; a blank or null text, and any row of which ``skip`` holds, is (0, 0, 0, 1).
"""

from __future__ import annotations

import math
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 100_000
SCHEMA = "compound double, pos double, neg double, neu double"

# The weights of the published rules.
CAPITALS, NEGATED, STRESSED, LIKELY = 0.733, -0.74, 0.293, 15
EXCLAMATION, QUESTION, QUESTIONS = 0.292, 0.18, 0.96
FADING = (1, 0.95, 0.9)
# Words that strengthen and that weaken what follows.
STRONGER = "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually utterly very".split()
WEAKER = "almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly somewhat sorta sortof sort-of".split()
# Words that turn what follows round; words with n't do as well.
TURNING = "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh uh-uh wasnt werent without wont wouldnt rarely seldom despite".split()
# Phrases with a valence of their own.
PHRASES = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0}

STEP = dict.fromkeys(STRONGER, STRESSED) | dict.fromkeys(WEAKER, -STRESSED)
TURNED = frozenset(TURNING)


def _turns(word: str) -> bool:
    return word in TURNED or "n't" in word


def _words(text: str) -> list[str]:
    """Words without the signs around them, as first published: an emoticon stays whole, a single letter is no word."""
    out = []
    for raw in text.split():
        bare = raw.strip(string.punctuation)
        out.append(bare if len(bare) > 2 or bare == raw else raw if len(bare) < 2 or not bare.isalpha() else bare)
    return [w for w in out if len(w) > 1]


def _valence(i: int, words: list[str], low: list[str], lexicon: dict[str, float], mixed: bool) -> float:
    """The valence of word i after what stands before it."""
    v = lexicon.get(low[i], 0.0)
    if not v or low[i] in STEP or low[i : i + 2] == ["kind", "of"]:
        return 0.0
    if mixed and words[i].isupper():
        v += math.copysign(CAPITALS, v)
    for back in range(1, min(3, i) + 1):
        j = i - back
        if low[j] in lexicon:
            continue
        step = math.copysign(1, v) * STEP.get(low[j], 0.0)
        if step and mixed and words[j].isupper():
            step += math.copysign(CAPITALS, v)
        v += step * FADING[back - 1]
        between = low[j + 1 : i]
        if back > 1 and low[j] == "never" and {"so", "this"} & set(between):
            v *= 1.25
        elif not (low[j] == "without" and "doubt" in between) and _turns(low[j]):
            v *= NEGATED
    if i > 2 and low[i - 3] not in lexicon:
        near = [" ".join(low[a:b]) for a, b in ((i - 1, i + 1), (i - 2, i + 1), (i - 2, i), (i - 3, i), (i - 3, i - 1), (i, i + 2), (i, i + 3))]
        v = next((PHRASES[p] for p in near if p in PHRASES), v)
    if i and low[i - 1] == "least" and "least" not in lexicon and (i == 1 or low[i - 2] not in ("at", "very")):
        v *= NEGATED
    return v


def judge(text: str | None, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
    """compound (-1 to 1) and the shares of positive, negative and neutral words."""
    words = _words(text or "")
    if not words:
        return 0.0, 0.0, 0.0, 1.0
    low = [w.lower() for w in words]
    mixed = 0 < sum(w.isupper() for w in words) < len(words)
    values = [_valence(i, words, low, lexicon, mixed) for i in range(len(words))]
    if "but" in low:
        at = low.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
    asked = text.count("?")
    stress = min(text.count("!"), 4) * EXCLAMATION + (0 if asked < 2 else asked * QUESTION if asked < 4 else QUESTIONS)
    total = sum(values)
    total += math.copysign(stress, total) if total else 0
    compound = total / math.sqrt(total * total + LIKELY)
    good, bad = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0)
    good, bad = good + stress * (good > bad), bad + stress * (bad > good)
    plain = sum(not v for v in values)
    whole = good + bad + plain
    return round(compound, 4), round(good / whole, 3), round(bad / whole, 3), round(plain / whole, 3)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """token and valence, the first two columns of a tab-separated file."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.lower(parts[0]).alias("token"), F.get(parts, F.lit(1)).try_cast("double").alias("valence")).filter("token <> '' and valence is not null")


def with_sentiment(m: DataFrame, lexicon: DataFrame, text: str = "content", skip: Column | None = None) -> DataFrame:
    """m with compound, pos, neg and neu; of a token's valences the largest counts."""
    rows = lexicon.groupBy("token").agg(F.max("valence").alias("valence")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"the lexicon has more than {MOST} tokens")
    shared = m.sparkSession.sparkContext.broadcast({r["token"]: r["valence"] for r in rows})

    @F.pandas_udf(SCHEMA)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, shared.value) for t in texts], columns=["compound", "pos", "neg", "neu"], dtype="float64")

    body = F.col(text).cast("string")
    return m.withColumn("__judged", judged(body if skip is None else F.when(~F.coalesce(skip, F.lit(False)), body))).select(*m.columns, "__judged.*")
