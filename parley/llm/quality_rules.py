"""Quality rules: a threshold table compiled into one projection of built-in expressions.

``measure`` adds the counts of a text, ``RULES`` states which ratios of them are acceptable, and
``compile_rules`` turns the table into a single boolean column.  Nothing here runs user code on
the executors and nothing is shuffled: every document is judged on its own row.

Defined results for odd input: a null, empty or blank text has no words and fails the length
rule; a null in another column is kept as it is; repeated rows are judged one by one; an empty
table gives an empty table; extra columns pass through ``apply_rules`` unless they carry the name
of a measure, in which case the measure replaces them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

# Frequent function words of the four languages, in natural order.
STOP_WORDS = (
    "the of and to in a is that for on with as was by this are from or an at be it "
    "der die und das den von zu im ist mit ein eine nicht auf des sich dem "
    "de la le et les des en un une que est pour dans qui par sur au avec du "
    "el los y se con por las para del una su al lo como"
).split()


class Rule(NamedTuple):
    """A ratio of two measures (in percent) and the range in which a document passes."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


#: The production thresholds, in percent of ``whole``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 30),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 50),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_stop_words"]


def _repeated_window_words(words: str, n: int) -> str:
    """SQL for the number of words inside an ``n``-word window that occurs twice or more.

    Windows are compared by a 64-bit hash within one text.  Only a text that has a repeated
    window sorts its windows; sorting keeps the work at n log n for very long texts.
    """
    hashes = f"transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64(slice({words}, i, {n})))"
    starts = """array_sort(filter(transform(s, (x, j) ->
        if((j > 0 and get(s, j - 1).h = x.h) or (j + 1 < size(s) and get(s, j + 1).h = x.h), x.i, null)), x -> x is not null))"""
    covered = f"aggregate(transform(f, (x, j) -> if(j + 1 < size(f), least({n}, get(f, j + 1) - x), {n})), 0L, (a, x) -> a + x)"
    # get(transform(array(x), ...), 0) names an intermediate value once
    return f"""case when size({words}) <= {n} then 0L else
        get(transform(array({hashes}), h -> if(size(array_distinct(h)) = size(h), 0L,
            get(transform(array(array_sort(transform(h, (x, j) -> struct(x as h, j as i)))), s ->
                get(transform(array({starts}), f -> {covered}), 0)), 0))), 0) end"""


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all of df) with the measures of each whole text added."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in MEASURES]
    kept = [F.col(f"`{c}`") for c in keep]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    parts = df.select(
        *kept,
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("!")).cast("long").alias("n_exclaims"),
    )
    return parts.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeated_window_words("__words", WINDOW)).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        "n_exclaims",
        F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds; the table becomes one expression."""
    passed = F.lit(True)
    for r in rules:
        if r.least is not None:
            passed = passed & (100 * F.col(r.part) >= r.least * F.col(r.whole))
        if r.most is not None:
            passed = passed & (100 * F.col(r.part) <= r.most * F.col(r.whole))
    return passed


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``measure`` with base_failed and kept; kept is false if base_failed."""
    return measure(df, text, keep).withColumns({"base_failed": base_failed()}).withColumns({"kept": ~F.col("base_failed") & compile_rules(rules)})


def keep_clean(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass, with df's columns."""
    taken = [f"__c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*taken)
    judged = apply_rules(renamed, taken[df.columns.index(text)], rules)
    # exploding a null drops the row; a filter would be pushed below the measures and repeat their work
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(True)))).alias("__kept")
    return judged.select(*taken, once).select(*taken).toDF(*df.columns)


def _ratios(rules: tuple[Rule, ...]) -> str:
    low = [f"100 * {r.part} >= {r.least} * {r.whole}" for r in rules if r.least is not None]
    high = [f"100 * {r.part} <= {r.most} * {r.whole}" for r in rules if r.most is not None]
    return " and ".join(low + high)


def oracle_sql(table: str = "documents") -> str:
    """The rows of ``op5`` in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from {table}),
w as (select *, regexp_extract_all(t, '{WORD}') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
win as (select r, i, hash(ws[i:i + {WINDOW - 1}]) h from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, h) n from win) where n > 1),
cov as (select r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) n from (select r, i, lead(i) over (partition by r order by i) nx from rep) group by r),
m as (select doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
        len(regexp_extract_all(t, '{SYMBOLS}'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(cov.n, 0)::bigint n_repeat_words, len(ls) n_lines, len(regexp_extract_all(t, '!')) n_exclaims,
        len(list_filter(ws, lambda x: lower(x) in ({stop}))) n_stop_words
      from w left join cov using (r)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_ratios(RULES)} kept from f"""
