"""Cleaning of texts that needs Unicode normal forms and named entities, which Spark has no functions for."""

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words are cut to this many characters.
LONGEST_WORD = 128
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_LINK = re.compile(r"http\S+")
_OUTSIDE = re.compile(r"[^\w'\-]")


def clean_one(text: str | None) -> str:
    """Doubly encoded UTF-8 repaired, compatibility forms composed, entities resolved, control characters removed."""
    if not text:
        return ""
    try:
        text = text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass  # text with wider characters, or Latin-1 in its own right
    return _CONTROL.sub("", html.unescape(unicodedata.normalize("NFKC", text)))


def words_one(text: str | None) -> list[str]:
    """Lower-case words of two characters or more that are not numbers; links go, and so does what Latin-1 cannot hold."""
    if not text:
        return []
    narrow = text.encode("latin-1", "ignore").decode("utf-8", "ignore")
    plain = _LINK.sub("", unicodedata.normalize("NFKC", html.unescape(narrow)))
    return [w[:LONGEST_WORD].lower() for w in _OUTSIDE.sub(" ", plain).split() if len(w) > 1 and not w.isnumeric()]


@F.pandas_udf(StringType())
def cleaned(texts: pd.Series) -> pd.Series:
    return texts.map(clean_one)


@F.pandas_udf(ArrayType(StringType()))
def cleaned_words(texts: pd.Series) -> pd.Series:
    return texts.map(words_one)


# The code points of the first generation's emoji.
EMOJI_RUN = r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F004}-\x{1F0CF}]+"


def emoji_runs(text: str) -> Column:
    """Stretches of emoji, however many signs each has."""
    return F.regexp_count(F.col(text), F.lit(EMOJI_RUN))


def tag(text: str) -> Column:
    """A lower-case label of letters, digits and underscores, of 50 characters at most."""
    return F.left(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]", "_"), F.lit(50))


def folder_title(folder: str) -> Column:
    """The words of a folder's name, less a number at its end, with capitals."""
    return F.initcap(F.replace(F.regexp_replace(folder, r"_\d+$", ""), F.lit("_"), F.lit(" ")))
