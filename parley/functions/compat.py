"""Column builders whose results follow the semantics of chat analytics: rounding, buckets, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a system message.
SYSTEM_MARKERS = (
    "sent an attachment", "sent a photo", "sent a video", "reacted to your message", "reacted to a message", "liked a message",
    "started a call", "ended the call", "missed call", "missed a call", "changed the group photo", "named the group",
    "left the group", "removed a message", "sent a voice message", "shared a link", "gamepigeon",
)
# Patterns of the same kind.
SYSTEM_PATTERN = r"\bsent\s+\d+\s+photos?\b|\bsent\s+\d+\s+videos?\b|\breacted\b.*\bto\b.*\b(your|a)\s+message\b|\bremoved\s+.*\s+from\s+the\s+group\b"
# Upper bound (exclusive, ms) and label of reply latencies; upper bound (words) and label of lengths.
LATENCIES = ((10_000, "0-10s"), (30_000, "10-30s"), (60_000, "30-60s"), (300_000, "1-5m"), (900_000, "5-15m"), (3_600_000, "15-60m"), (None, ">1h"))
LENGTHS = ((2, "1-2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (None, "50+"))


def js_round(x: Column, digits: int = 0) -> Column:
    """Round half up, towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def mean_score(score: Column) -> Column:
    """The mean of scores of four digits, summed as whole numbers: it does not depend on the order of addition."""
    return F.try_divide(F.sum(F.round(score * 10_000).cast("long")), F.count(score) * F.lit(1e4))


def is_system(content: Column, flag: Column) -> Column:
    """Flagged, empty, very short, internal, or worded like a notice."""
    low = F.lower(F.trim(content))
    # one search for all of it; a chain of conditions would lower the text again for each
    return flag | content.isNull() | low.rlike("|".join([r"^(?s:.{0,2})\z", "^__", *SYSTEM_MARKERS, SYSTEM_PATTERN]))


def bucket(x: Column, bounds: tuple, inclusive: bool) -> Column:
    """The label of the first bound that x is below (or at, if inclusive)."""
    out = F.lit(bounds[-1][1])
    for top, label in reversed(bounds[:-1]):
        out = F.when(x <= top if inclusive else x < top, label).otherwise(out)
    return out


def bucket_sql(x: str, bounds: tuple, inclusive: bool) -> str:
    return "case " + " ".join(f"when {x} {'<=' if inclusive else '<'} {top} then '{label}'" for top, label in bounds[:-1]) + f" else '{bounds[-1][1]}' end"


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
