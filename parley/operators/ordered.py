"""Operators on the ordered messages of a conversation: replies, turns, bursts, sessions, bubbles.

A conversation is cut into slices of time, so that one with a third of all rows is sorted by many
tasks.  Only what crosses the edge of a slice goes through a window over the whole conversation, one
row for each slice: its last message, which heads the next slice as a ghost, and its number of runs.
Ties in time are broken by message_id.  Rows without a time come first; rows without a conversation
have no order and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

NARROW = ["conversation_id", "message_id", "sender", "timestamp_ms"]
TIME = ["timestamp_ms", "message_id"]
# Fixed value: what stands between the bubbles of a reply.
MARK = " <<<BUBBLE>>> "
#: Length of a slice of time.
SLICE_MS = 86_400_000
_SLICE, _GHOST, _START, _OFFSET = "__slice", "__ghost", "__start", "__offset"


def _within(*order: str) -> WindowSpec:
    return Window.partitionBy("conversation_id", _SLICE).orderBy(*order)


def _over_slices() -> WindowSpec:
    return Window.partitionBy("conversation_id").orderBy(_SLICE)


def _lags(rows: DataFrame, slices: Column, order: list[str], lags: dict[str, str]) -> DataFrame:
    rows = rows.filter("conversation_id is not null").withColumn(_SLICE, F.coalesce(slices.cast("long"), F.lit(-(2**62))))
    held = list(dict.fromkeys([*order, *lags.values()]))
    ends = rows.groupBy("conversation_id", _SLICE).agg(F.max(F.struct(*held)).alias("end"))
    ghosts = ends.select("conversation_id", F.lead(_SLICE).over(_over_slices()).alias(_SLICE), "end.*").filter(F.col(_SLICE).isNotNull())
    both = rows.withColumn(_GHOST, F.lit(False)).unionByName(ghosts.withColumn(_GHOST, F.lit(True)), allowMissingColumns=True)
    return both.withColumns({new: F.lag(old).over(_within(*order)) for new, old in lags.items()}).filter(~F.col(_GHOST)).drop(_GHOST)


def with_lags(rows: DataFrame, slices: Column, order: list[str], **lags: str) -> DataFrame:
    """Columns of the row before in the conversation (new name = column), null in its first row.

    ``slices`` numbers the parts that a conversation is sorted in and never falls along ``order``.
    """
    return _lags(rows, slices, order, lags).drop(_SLICE)


def _previous(m: DataFrame, **more: str) -> DataFrame:
    lags = {"prev_id": "message_id", "prev_sender": "sender", "gap_ms": "timestamp_ms"} | more
    p = _lags(m, F.floor(F.col("timestamp_ms") / SLICE_MS), TIME, lags)
    return p.withColumn("gap_ms", F.col("timestamp_ms") - F.col("gap_ms"))


def with_previous(m: DataFrame, **more: str) -> DataFrame:
    """The message before: its id, its sender, the time since, and ``more`` (new name = column)."""
    return _previous(m, **more).drop(_SLICE)


def responses(m: DataFrame) -> DataFrame:
    """Adjacent messages of different senders, one second to a day apart."""
    p = with_previous(m.select(*NARROW))
    return p.filter("sender != prev_sender and gap_ms between 1000 and 86400000").select("conversation_id", F.col("prev_id").alias("from_message_id"), F.col("message_id").alias("to_message_id"), F.col("sender").alias("responder"), F.col("gap_ms").alias("latency_ms"))


def islands(m: DataFrame, begins: Column, **more: str) -> DataFrame:
    """Number the runs of messages; ``begins`` says which message (after the first) starts one.

    Runs are numbered in their slice and moved up by the runs of the slices before.
    """
    p = _previous(m, **more).withColumn(_START, F.when(F.col("prev_id").isNull() | begins, 1).otherwise(0))
    before = F.sum(_OFFSET).over(_over_slices().rowsBetween(Window.unboundedPreceding, -1))
    offsets = p.groupBy("conversation_id", _SLICE).agg(F.sum(_START).alias(_OFFSET)).withColumn(_OFFSET, F.coalesce(before, F.lit(0)))
    numbered = p.withColumn("island", F.sum(_START).over(_within(*TIME))).join(offsets, ["conversation_id", _SLICE])
    return numbered.withColumn("island", F.col("island") + F.col(_OFFSET)).drop(_SLICE, _START, _OFFSET)


def turns(m: DataFrame) -> DataFrame:
    """Maximal runs of one sender."""
    runs = islands(m.select(*NARROW), F.col("sender") != F.col("prev_sender"))
    return runs.groupBy("conversation_id", F.col("island").alias("turn_no")).agg(F.first("sender").alias("participant"), F.count("*").alias("message_count"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))


def gap_islands(m: DataFrame, gap_ms: int, min_len: int = 1) -> DataFrame:
    """Runs without a gap of more than ``gap_ms``, with their starter and number of senders."""
    runs = islands(m.select(*NARROW), F.col("gap_ms") > gap_ms)
    out = runs.groupBy("conversation_id", F.col("island").alias("island_no")).agg(
        F.min_by("sender", F.struct("timestamp_ms", "message_id")).alias("starter"), F.count("*").alias("message_count"), F.count_distinct("sender").alias("n_senders"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms")
    )
    return out.filter(F.col("message_count") >= min_len)


def session_starters(m: DataFrame, gap_ms: int = 4 * 3_600_000) -> DataFrame:
    """First messages and messages after a gap of ``gap_ms`` or more."""
    return with_previous(m.select(*NARROW)).filter(F.col("prev_id").isNull() | (F.col("gap_ms") >= gap_ms)).select(*NARROW)


def _bubbles(m: DataFrame, breaker: Column, gap_ms: int) -> DataFrame:
    begins = F.coalesce(F.col("after"), F.lit(True)) | F.col("breaks") | (F.col("sender") != F.col("prev_sender")) | (F.col("gap_ms") > gap_ms)
    return islands(m.select(*NARROW, "content", breaker.alias("breaks")), begins, after="breaks").filter("not breaks")


def reply_turns(m: DataFrame, breaker: Column, gap_ms: int = 90_000) -> DataFrame:
    """Bubbles sent in one go: same sender, each within ``gap_ms``; a breaker row ends a run and is left out."""
    runs = _bubbles(m, breaker, gap_ms)
    return runs.groupBy("conversation_id", "island").agg(F.first("sender").alias("sender"), F.count("*").alias("n_bubbles"), F.max("timestamp_ms").alias("end_ms"), F.sum(F.length("content")).alias("n_chars")).drop("island")


def reply_texts(m: DataFrame, breaker: Column, gap_ms: int = 90_000, most: int = 500, mark: str = MARK) -> DataFrame:
    """The text of each reply turn: as many whole bubbles, from the first, as ``most`` characters hold with marks between.

    A first bubble longer than that is cut and ends in an ellipsis.  Bubbles beyond are dropped before they are gathered.
    """
    run = Window.partitionBy("conversation_id", "island").orderBy(*TIME)
    held = _bubbles(m, breaker, gap_ms).withColumn("content", F.coalesce("content", F.lit(""))).withColumns({"at": F.row_number().over(run), "size": F.sum(F.length("content") + len(mark)).over(run) - len(mark)})
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda b: b["content"])
    whole = held.filter((F.col("at") == 1) | (F.col("size") <= most)).groupBy("conversation_id", "island").agg(F.min(F.when(F.col("at") == 1, F.col("message_id"))).alias("first_id"), F.array_join(parts, mark).alias("text"))
    return whole.select("conversation_id", "first_id", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most - 1), F.lit("…"))).otherwise(F.col("text")).alias("text"))


# What stands in the place of an attachment.
PLACEHOLDER = r"(?i)sent \d+ photo|sent a voice message|shared a link"


def breaker() -> Column:
    """Rows that end a reply turn and belong to none: notices, blank texts and stand-ins for attachments."""
    blank = F.coalesce(F.trim("content") == "", F.lit(True))
    return F.col("is_system") | blank | F.col("content").rlike(PLACEHOLDER)


def turn_texts(m: DataFrame, breaks: Column, gap_ms: int = 90_000, most_context: int = 400, most_reply: int = 550, mark: str = MARK) -> DataFrame:
    """Reply turns with their texts: as the context of an answer, bubbles joined by spaces and cut; as a reply, whole bubbles joined by marks.

    Only bubbles that reach into either text are gathered.
    """
    run = Window.partitionBy("conversation_id", "turn_no").orderBy(*TIME)
    said = F.trim("content")
    held = _bubbles(m, breaks, gap_ms).withColumnRenamed("island", "turn_no").withColumns({"said": said, "n_words": F.size(F.filter(F.split(said, r"\s+"), lambda w: w != ""))})
    held = held.withColumns({"at": F.row_number().over(run), "upto": F.sum(F.length("said") + 1).over(run), "size": F.sum(F.length("said") + len(mark)).over(run) - len(mark)})
    early, whole = F.col("upto") - F.length("said") - 1 < most_context, (F.col("at") == 1) | (F.col("size") <= most_reply)
    keep = F.when(early | whole, F.struct("at", "said", early.alias("early"), whole.alias("whole")))
    part = lambda b, flag: F.transform(F.filter(b, lambda x: x[flag]), lambda x: x["said"])
    out = held.groupBy("conversation_id", "turn_no").agg(
        F.first("sender").alias("sender"), F.count("*").alias("n_bubbles"), F.min_by("message_id", F.struct(*TIME)).alias("first_id"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"),
        F.sum("n_words").alias("words"), F.sum(F.length("said")).alias("chars"), F.min(F.length("said")).alias("shortest"), F.max(F.length("said")).alias("longest"), F.array_sort(F.collect_list(keep)).alias("b"),
    )
    reply = F.array_join(part(F.col("b"), "whole"), mark)
    reply = F.when(F.length(reply) > most_reply, F.concat(F.substring(reply, 1, most_reply - 1), F.lit("…"))).otherwise(reply)
    return out.withColumns({"context": F.substring(F.array_join(part(F.col("b"), "early"), " "), 1, most_context), "reply": reply}).drop("b")


#: Turns of a conversation that one task sorts.
TURNS_A_SLICE = 1_000_000


def reply_pairs(turns: DataFrame, least: int = 2) -> DataFrame:
    """A turn and the one before it in the conversation by another sender, whose context has ``least`` characters."""
    lagged = with_lags(turns, F.floor(F.col("turn_no") / TURNS_A_SLICE), ["turn_no"], partner="sender", prev_id="first_id", prev_chars="chars", prev_end_ms="end_ms", asked="context")
    pairs = lagged.filter((F.col("partner") != F.col("sender")) & (F.length("asked") >= least))
    return pairs.select("conversation_id", "turn_no", "partner", F.col("sender").alias("persona"), "prev_id", "first_id", "words", "n_bubbles", "chars", "shortest", "longest", "prev_chars", "start_ms", "end_ms", "prev_end_ms", F.col("asked").alias("context"), "reply")


def counts_after(m: DataFrame, within_ms: int) -> DataFrame:
    """For each message with a time, the messages of others in the ``within_ms`` after it.

    A row is counted in its own slice of that length and, for the rows before it, in the last one;
    two range windows, over the conversation and over the sender in it, give the count without a join.
    Each is the difference of two running counts: a frame that moves at both ends is counted anew for every row.
    """
    own = F.floor(F.col("timestamp_ms") / within_ms)
    near = m.select(*NARROW).filter("conversation_id is not null and timestamp_ms is not null").withColumn("own", own).withColumn(_SLICE, F.explode(F.array(F.col("own"), F.col("own") - 1)))
    upto = lambda end, *k: F.count("*").over(Window.partitionBy("conversation_id", _SLICE, *k).orderBy("timestamp_ms").rangeBetween(Window.unboundedPreceding, end))
    later = lambda *k: upto(within_ms, *k) - upto(Window.currentRow, *k)
    return near.withColumn("n_after", later() - later("sender")).filter(F.col("own") == F.col(_SLICE)).drop("own", _SLICE)
