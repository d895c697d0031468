"""Queries of retrieval, with oracles written from the rules.

Keyword search and example selection run on ``conversations``: a user's opening message asks the assistant's
messages, with the next two conversations preferred.  Vector search runs on ``embeddings``, a vector
being that of the message of its id: every vector whose id is divisible by 20 asks the messages of its sender.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import ordered, relationships, retrieval
from parley.plans import tables
from parley.plans.registry import register
from parley.sources.adapters import messages_from_conversations

MODEL = "current"
EVERY = 20

_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9'']{{3,}}'), lambda w: w not in ({_STOPS}))"


def _overlap(asked: str, found: str) -> str:
    hits = f"len(list_distinct(list_filter({found}, lambda w: list_contains({asked}, w))))"
    return f"case when {hits} > 0 then {hits} + {hits} / sqrt(len({found})) else 0 end"


def _over_messages(sql: str) -> str:
    """SQL that begins with CTEs over m, the messages of events."""
    return tables.oracle("m", sql.replace("{", "{{").replace("}", "}}"), more=True)


#: The messages of conversations and the queries on them, for the oracle.
_ASKED = f"""c as (select 'meta:c' || conv_id conversation_id, conv_id, conv_id * 1000 + turn message_id, role sender, text "content", 1704067200000 + conv_id * 86400000 + turn * 60000 timestamp_ms, role = 'system' is_system, {_tokens("coalesce(text, '')")} toks from conversations),
q as (select message_id query_id, 'assistant' persona, conversation_id, "content" asked_text, ['meta:c' || (conv_id + 1), 'meta:c' || (conv_id + 2)] preferred, list_distinct(toks) unordered, toks from c where sender = 'user' and message_id % {EVERY} = 0)"""


def _keyword_sql(ctes: str, limit: int) -> str:
    """From tables q (query_id, persona, conversation_id, preferred, toks) and c (messages with toks)."""
    longest = "(select query_id, persona, tok, row_number() over (partition by query_id order by length(tok) desc, first) + 1 stage from (select query_id, persona, tok, min(pos) first from (select query_id, persona, unnest(toks) tok, generate_subscripts(toks, 1) pos from q) group by all))"
    newest = "row_number() over (partition by {by} order by timestamp_ms desc, message_id desc)"
    score = f"round({_overlap('q.toks', 'c.toks')} + bonus + case when list_contains(preferred, c.conversation_id) then {retrieval.PREFERENCE} else 0 end, 9)"
    return f"""with {ctes},
spoken as (select * from c where not is_system and trim("content") <> ''),
s0 as (select query_id, message_id, 0 stage, case when len(toks) > 0 then 0.5 else 0.1 end bonus from (select q.query_id, q.toks, message_id, {newest.format(by="q.query_id")} n from q join spoken c on c.conversation_id = q.conversation_id and c.sender = q.persona) where n <= 120),
s1 as (select query_id, message_id, 1 stage, case when len(toks) > 0 then 0.35 else 0.15 end bonus from (select q.query_id, q.toks, message_id, {newest.format(by="q.query_id")} n from q join spoken c on list_contains(q.preferred[1:8], c.conversation_id) and c.sender = q.persona) where n <= 200),
s2 as (select query_id, message_id, stage, case when same then 0.3 else 0 end bonus from (select a.query_id, message_id, a.stage, c.conversation_id = (select conversation_id from q where q.query_id = a.query_id) same, {newest.format(by="a.query_id, a.stage")} n from {longest} a join spoken c on c.sender = a.persona and contains(lower(c."content"), a.tok) where a.stage <= 4) where n <= 20),
sc as (select a.query_id, a.message_id, a.stage, c.timestamp_ms, {score} score from (select * from s0 union all select * from s1 union all select * from s2) a join c using (message_id) join q using (query_id) where bonus > 0 or {_overlap("q.toks", "c.toks")} > 0),
k as (select * from sc where stage <> 1 or (select count(*) from sc x where x.query_id = sc.query_id and x.stage = 0 and x.score >= 1) < {limit}),
good as (select query_id, message_id, min(stage) pos from k where score >= 1.2 group by all),
n as (select query_id, count(*) filter (pos <= 1) g1, count(*) filter (pos <= 2) g2, count(*) filter (pos <= 3) g3 from good group by 1),
best as (select query_id, message_id, timestamp_ms, max(score) score from k left join n using (query_id) where stage < 2 or coalesce(g1, 0) < {min(3, limit)} and (stage < 3 or coalesce(g2, 0) < {limit}) and (stage < 4 or coalesce(g3, 0) < {limit}) group by all),
late as (select query_id, message_id, timestamp_ms, 0.05 score from (select q.query_id, message_id, timestamp_ms, {newest.format(by="q.query_id")} n from q join c on c.conversation_id = q.conversation_id and c.sender = q.persona and not is_system and "content" is not null where q.query_id not in (select query_id from best)) where n <= {limit}),
kw as (select query_id, message_id, round(score, 6) score, rank from (select *, row_number() over (partition by query_id order by score desc, timestamp_ms desc, message_id) rank from (select * from best union all select * from late)) where rank <= {limit})"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = messages_from_conversations(spark, sf_dir)
    chat = F.regexp_extract("conversation_id", r"(\d+)$", 1).cast("long")
    near = F.array(*(F.concat(F.lit("meta:c"), chat + i) for i in (1, 2)))
    q = m.filter((F.col("sender") == "user") & (F.col("message_id") % EVERY == 0)).select(F.col("message_id").alias("query_id"), F.lit("assistant").alias("persona"), F.col("content").alias("text"), "conversation_id", near.alias("preferred"))
    return m, q


@register("per16_keyword_memories", f"{_keyword_sql(_ASKED, 6)} select * from kw")
def per16_keyword_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q = _asked(spark, sf_dir)
    return retrieval.keyword_memories(m, q)


@register("fn29_overlap_scores", f"with {_ASKED} select query_id, message_id, round({_overlap('q.toks', 'c.toks')}, 6) score from q join c using (conversation_id) where c.sender = q.persona and {_overlap('q.toks', 'c.toks')} > 0")
def fn29_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q = _asked(spark, sf_dir)
    both = q.join(m.select("conversation_id", "message_id", F.col("sender").alias("persona"), "content"), ["conversation_id", "persona"])
    return both.select("query_id", "message_id", F.round(retrieval.overlap(retrieval.tokens(F.col("text")), retrieval.tokens(F.col("content"))), 6).alias("score")).filter("score > 0")


# -- vectors
def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = tables.make("m", spark, sf_dir, {})
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("message_id"), F.when(F.col("label") % 4 == 3, "old").otherwise(MODEL).alias("model"), "embedding")
    q = v.filter(F.col("message_id") % EVERY == 0).join(m.select("message_id", "sender", "conversation_id", "content"), "message_id")
    q = q.select(F.col("message_id").alias("query_id"), F.col("message_id").alias("own"), F.col("sender").alias("persona"), "conversation_id", F.col("content").alias("text"), F.array().cast("array<string>").alias("preferred"), "embedding")
    return m, v, q


_VECTORS = f"""v as (select vec_id message_id, case when "label" % 4 = 3 then 'old' else '{MODEL}' end model, embedding from embeddings),
qv as (select m.message_id query_id, m.sender persona, m.conversation_id, m."content" asked_text, v.embedding from v join m using (message_id) where v.message_id % {EVERY} = 0),
sv as (select m.*, v.embedding from m join v using (message_id) where v.model = '{MODEL}' and not is_system and trim("content") <> ''),
enough as (select m.sender from v join m using (message_id) where not is_system group by 1 having count(*) >= 5),
c1 as (select query_id, message_id from (select q.query_id, s.message_id, row_number() over (partition by q.query_id order by s.timestamp_ms desc, s.message_id desc) n from qv q join sv s on s.conversation_id = q.conversation_id and s.sender = q.persona) where n <= 800),
c2 as (select query_id, message_id, n from (select q.query_id, s.message_id, row_number() over (partition by q.query_id order by s.timestamp_ms desc, s.message_id desc) n from qv q join sv s on s.sender = q.persona) where n <= 1200 and (query_id, message_id) not in (select (query_id, message_id) from c1)),
cand as (select query_id, message_id, 0 tier from c1 union all select query_id, message_id, 1 from (select *, row_number() over (partition by query_id order by n) k from c2) d where k <= 1200 - (select count(*) from c1 where c1.query_id = d.query_id))"""


def _vector_sql(limit: int) -> str:
    cosine = "list_cosine_similarity(s.embedding::double[], q.embedding::double[])"
    return f"""vm as (select query_id, message_id, round(score, 6) score, rank from (select *, row_number() over (partition by query_id order by score desc, timestamp_ms desc, message_id) rank from
(select query_id, s.message_id, s.timestamp_ms, round({cosine} + case when s.conversation_id = q.conversation_id then 0.04 else 0 end, 9) score from cand join qv q using (query_id) join sv s using (message_id) where q.persona in (select sender from enough) and s.message_id <> query_id) where score >= 0.28) where rank <= {limit})"""


@register("join16_vector_candidates", _over_messages(f"{_VECTORS} select query_id, message_id, tier from cand"))
def join16_vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v, q = _vectors(spark, sf_dir)
    return retrieval.vector_candidates(m, v, q, MODEL).select("query_id", "message_id", "tier")


@register("per17_vector_memories", _over_messages(f"{_VECTORS}, {_vector_sql(12)} select * from vm"))
def per17_vector_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_memories(*_vectors(spark, sf_dir), MODEL)


def _hybrid_sql() -> str:
    words = f"""c as (select *, {_tokens("coalesce(content, '')")} toks from m), q as (select query_id, persona, conversation_id, []::varchar[] preferred, {_tokens("coalesce(asked_text, '')")} toks from qv)"""
    keyword = _keyword_sql(words, 6).removeprefix("with ")
    return f"""{_VECTORS}, {_vector_sql(6)}, {keyword},
both_kinds as (select query_id, message_id, score, 'vector' found_by, rank from vm union all select query_id, message_id, score, 'keyword', 6 + rank from kw where rank <= 6 - (select count(*) from vm where vm.query_id = kw.query_id) and (query_id, message_id) not in (select (query_id, message_id) from vm))
select query_id, message_id, score, found_by, case when bool_or(found_by = 'vector') over (partition by query_id) then 'vector' else 'keyword' end "mode", row_number() over (partition by query_id order by rank)::int rank from both_kinds"""


@register("per18_hybrid_memories", _over_messages(_hybrid_sql()))
def per18_hybrid_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v, q = _vectors(spark, sf_dir)
    return retrieval.hybrid(retrieval.vector_memories(m, v, q, MODEL, limit=6), retrieval.keyword_memories(m, q))


# -- examples
def _pool(m: DataFrame) -> DataFrame:
    """The first 80 pairs of each persona in turn over its conversations; every third conversation is with the account holder."""
    pairs = ordered.reply_pairs(ordered.turn_texts(m, ordered.breaker()))
    chat = F.regexp_extract("conversation_id", r"(\d+)$", 1).cast("long")
    ranked = pairs.withColumn("nth", F.expr("row_number() over (partition by persona, conversation_id order by turn_no)"))
    ranked = ranked.withColumn("example_id", F.expr("row_number() over (partition by persona order by nth, conversation_id)")).filter("example_id <= 80")
    return ranked.select("persona", "example_id", "conversation_id", "context", "reply", (chat % 3 == 0).alias("with_you"))


_EXAMPLES = f"""{_ASKED}, w as (select *, trim("content") said, is_system or coalesce(trim("content"), '') = '' or regexp_matches(lower("content"), 'sent [0-9]+ photo|sent a voice message|shared a link') breaks from c),
tn as (select *, sum(case when coalesce(lag_breaks, true) or breaks or sender <> lag_sender then 1 else 0 end) over (partition by conversation_id order by timestamp_ms, message_id) turn_no from (select *, lag(breaks) over z lag_breaks, lag(sender) over z lag_sender from w window z as (partition by conversation_id order by timestamp_ms, message_id))),
tt as (select conversation_id, conv_id, turn_no, any_value(sender) sender, string_agg(said, ' ' order by timestamp_ms, message_id)[1:400] context, string_agg(said, '{ordered.MARK}' order by timestamp_ms, message_id) whole, first(said order by timestamp_ms, message_id) head from tn where not breaks group by all),
pr as (select *, case when length(head) > 550 then head[1:549] || '…' else head end reply from (select *, lag(sender) over y partner, lag(context) over y asked from tt window y as (partition by conversation_id order by turn_no)) where partner <> sender and length(asked) >= 2),
pool as (select * from (select *, row_number() over (partition by sender order by nth, conversation_id) example_id from (select *, row_number() over (partition by sender, conversation_id order by turn_no) nth from pr)) where example_id <= 80),
es as (select query_id, example_id, p.conversation_id = q.conversation_id scoped, p.conv_id % 3 = 0 with_you, p.conversation_id, len(list_filter(regexp_split_to_array(trim(coalesce(asked_text, '')), '\\s+'), lambda x: x <> '')) q_words, trim(coalesce(asked_text, '')) query, len(list_filter(regexp_split_to_array(replace(reply, '<<<BUBBLE>>>', ' '), '\\s+'), lambda x: x <> '')) r_words, reply,
  {_overlap("q.toks", _tokens("asked"))} + 0.25 * len(list_distinct(list_filter({_tokens("reply")}, lambda t: list_contains(q.toks, t)))) alike from q join pool p on p.sender = q.persona),
ev as (select *, round(alike + case when scoped then 0.55 else 0 end + case when with_you then 0.7 else 0 end + case when q_words <= 2 then 0 when regexp_matches(trim(reply), '{retrieval.ACK}') then -0.8 when r_words >= 8 then 0.45 when r_words >= 4 then 0.2 else -0.15 end, 9) score from es)"""


@register("fn30_example_likeness", f"with {_EXAMPLES} select query_id, example_id, round(score, 6) score from ev")
def fn30_example_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q = _asked(spark, sf_dir)
    rows = q.withColumnRenamed("conversation_id", "open").join(_pool(m), "persona")
    score = retrieval.likeness(F.col("text"), F.col("context"), F.col("reply")) + F.when(F.col("open") == F.col("conversation_id"), 0.55).otherwise(0.0) + F.when(F.col("with_you"), 0.7).otherwise(0.0) + retrieval.substance(F.trim("text"), F.col("reply"))
    return rows.select("query_id", "example_id", F.round(score, 6).alias("score"))


#: The oracle goes through the pairs of a query one by one, as a fold over them in order of score.
_PICKED = """steps as (select query_id, list({e: example_id, c: conversation_id, s: score} order by score desc, example_id) rows, max(score) best from ev group by 1),
walk as (select query_id, best, rows, list_reduce(list_prepend([]::struct(e bigint, c varchar, s double)[], list_transform(rows, lambda x: [x])), lambda got, x: case when len(got) >= 12 or (len(got) < 10 and len(list_filter(got, lambda g: g.c = x[1].c)) >= 4) then got else list_concat(got, x) end) first_pass from steps),
full_walk as (select query_id, list_concat(first_pass, list_filter(rows, lambda r: not list_contains(list_transform(first_pass, lambda g: g.e), r.e)))[1:12] picks from walk where best >= 0.15),
flat as (select query_id, list_concat(list({e: example_id, s: score} order by example_id) filter (scoped), list({e: example_id, s: score} order by example_id) filter (with_you), list({e: example_id, s: score} order by example_id) filter (not with_you))[1:12] picks from ev where query_id not in (select query_id from full_walk) group by 1)
select query_id, unnest(list_transform(picks, lambda p: p.e)) example_id, round(unnest(list_transform(picks, lambda p: p.s)), 6) score, unnest(generate_series(1, len(picks)))::int pick from full_walk union all select query_id, unnest(list_transform(picks, lambda p: p.e)), round(unnest(list_transform(picks, lambda p: p.s)), 6), unnest(generate_series(1, len(picks)))::int from flat"""


@register("per21_select_examples", f"with {_EXAMPLES}, {_PICKED}")
def per21_select_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q = _asked(spark, sf_dir)
    return retrieval.select_examples(_pool(m), q)


# -- pairs
_COMMON = ", ".join(f"'{w}'" for w in retrieval.COMMON)
_DISTINCT = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']{{2,}}'), lambda w: w not in ({_COMMON})))"
_BARE = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda z: z <> '')"


@register("fn25_pair_likeness", tables.oracle("rp", f"""x as (select first_id, {_DISTINCT("context")} a, {_DISTINCT("reply")} b, greatest(1, len({_BARE("context")})) n, greatest(1, len({_BARE("reply")})) k from rp)
select first_id, round(case when len(a) + len(b) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) jaccard, round(least(n, k) / greatest(n, k), 6) length_ratio from x""".replace("{", "{{").replace("}", "}}"), more=True))
def fn25_pair_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a reply shares with the turn before it, and how their lengths compare."""
    pairs = tables.make("rp", spark, sf_dir, {})
    return pairs.select("first_id", *(f(F.col("context"), F.col("reply")) for f in (retrieval.token_jaccard, retrieval.length_ratio)))


# -- relationship cards
_LINES = """, mb as (select distinct conversation_id, sender from m where not is_system), sc as (select conversation_id, sender persona from mb where sender not in (select sender from me) and conversation_id in (select conversation_id from mb where sender in (select sender from me))),
l0 as (select *, row_number() over (partition by sender order by timestamp_ms desc, message_id desc) newest from m where not is_system and trim(content) <> '' and (conversation_id, sender) in (select (conversation_id, persona) from sc)),
ln as (select *, trim(content) said, lower(trim(content)) low, string_split(trim(content), chr(10))[1][1:80] head from l0 where newest <= 3000 and sender in (select sender from l0 group by 1 having count(*) >= 8)),
ps as (select list_distinct([regexp_split_to_array(lower(trim(sender)), '\\s+')[1], regexp_split_to_array(lower(trim(sender)), '\\s+')[-1]]) parts from me)"""
_FOND = "[" + ", ".join(f"'{e}'" for e in relationships.ENDEARMENTS) + "]"
_NAMED = f"lower(regexp_extract(head, '{relationships.GREETING}', 1))".replace("a-z']", "a-z'']")
_GREETS = f"regexp_matches(head, '{relationships.GREETING}')".replace("a-z']", "a-z'']")
_PHRASES = f"""f as (select sender persona, 'address' kind, unnest(list_concat(list_filter([case when {_NAMED} <> '' and (len(list_filter(parts, lambda p: starts_with({_NAMED}, p[1:3]) or starts_with(p, {_NAMED}[1:3]))) > 0 or list_contains({_FOND}, {_NAMED})) then {_NAMED} else '' end], lambda z: length(z) >= 2),
  list_filter({_FOND}, lambda e: regexp_matches(low, '\\b' || e || '\\b')), list_filter(parts, lambda p: length(p) >= 3 and (length(said) < 40 or {_GREETS}) and regexp_matches(low, '\\b' || regexp_escape(p) || '\\b')))) item from ln, ps
union all select sender, 'opener', lower(regexp_extract(said, '{relationships.OPENER}', 1)) from ln union all select sender, 'closer', lower(regexp_extract(said, '{relationships.CLOSER}', 1)) from ln where word_count <= 6)"""


def _card_query(name: str, sql: str, query) -> None:
    for source in tables.SOURCES:
        def made(spark: SparkSession, sf_dir: str, source: str = source) -> DataFrame:
            held = {"m": tables.messages(spark, sf_dir, source)}
            return query(held["m"], tables.make("me", spark, sf_dir, held))

        whole = tables.oracle("m me", (_LINES[2:] + sql).replace("{", "{{").replace("}", "}}"), more=True, source=source) if sql else None
        register(name if source == "events" else f"{name}_of_{source}", whole)(made)


_card_query("per09_relationship_phrases", f", {_PHRASES} select persona, kind, item, n, rank from (select *, row_number() over (partition by persona, kind order by n desc, item) rank from (select persona, kind, item, count(*) n from f where item <> '' group by all)) where rank <= 6", relationships.phrases)
_card_query("per09_relationship_mentions", "", relationships.mentions)
_card_query("per09_relationship_teasing", f", t as (select sender persona, said line, least(20, word_count) words, newest, row_number() over (partition by sender, low order by least(20, word_count) desc, newest) again from ln where length(said) between 8 and 120 and regexp_matches(said, '{relationships.TEASE}')) select persona, line, rank from (select *, row_number() over (partition by persona order by words desc, newest) rank from t where again = 1) where rank <= 5", relationships.teasing)
_card_query("per09_relationship_cards", """, a as (select sender persona, count(*) shared_messages, floor(avg(word_count) * 10 + 0.5) / 10 words_with_you, floor(avg(case when contains(content, '?') then 1.0::double else 0 end) * 1000 + 0.5) / 1000 question_rate from ln group by 1), b as (select persona, count(*) shared_chats from sc group by 1),
d as (select sender persona, sum(cast(round(compound * 10000) as bigint)) / (1e4::double * nullif(count(compound), 0)) v, avg(case when compound > 0.05 then 1.0::double else 0 end) p, avg(case when compound < -0.05 then 1.0::double else 0 end) q from m where not is_system and (conversation_id, sender) in (select (conversation_id, persona) from sc) group by 1), e as (select sender persona, floor(avg(word_count) * 10 + 0.5) / 10 words_everywhere from m where not is_system group by 1)
select persona, shared_messages, shared_chats, case when v is null then 'tone with you is hard to pin down from available data' when v > 0.2 and p > 0.35 then 'usually warm / upbeat with you' when v < -0.1 or q > 0.3 then 'often blunt or cooler with you than average' when v > 0.05 then 'mildly positive / friendly with you' else 'fairly neutral with you' end tone, question_rate, words_with_you, words_everywhere from a join b using (persona) join d using (persona) join e using (persona)""", relationships.cards)  # fmt: skip
