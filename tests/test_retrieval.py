"""Retrieval, example selection, reply turns and relationship cards against plain Python."""

import math
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from parley.operators import ordered, relationships, retrieval, texts

WORDS = "meeting tomorrow projector trip beach the and hello party parties work ok sunset garden river".split()
M = "message_id long, conversation_id string, sender string, content string, timestamp_ms long, is_system boolean, compound double, word_count long"
Q = "query_id long, persona string, text string, conversation_id string, preferred array<string>"


def made(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "  ", *[" ".join(rng.choices(WORDS, k=rng.randint(1, 9)))] * 12])
        rows.append((i, f"c{rng.randint(0, 5)}", rng.choice("AB"), text, rng.randint(0, 150), rng.random() < 0.05, 0.0, len((text or "").split())))
    return rows


def tokens(text):
    return [t for t in re.findall("[a-z0-9']{3,}", (text or "").lower()) if t not in retrieval.STOP_WORDS]


def overlap(asked, found):
    hits = len(set(found) & set(asked))
    return hits + hits / math.sqrt(len(found)) if hits else 0


def keyword(rows, q, limit=6):
    """One query, tier after tier."""
    _, persona, text, chat, preferred = q
    asked = list(dict.fromkeys(tokens(text)))
    preferred = preferred or []
    spoken = sorted((r for r in rows if r[2] == persona and not r[5] and (r[3] or "").strip()), key=lambda r: (-r[4], -r[0]))
    found = {}

    def add(r, bonus):
        base = overlap(asked, tokens(r[3]))
        if base > 0 or bonus > 0:
            score = round(base + bonus + (0.4 if r[1] in preferred else 0), 9)
            found[r[0]] = max(found.get(r[0], (score, 0)), (score, r[4]))

    for r in [r for r in spoken if r[1] == chat][: retrieval.OPEN_ROWS]:
        add(r, 0.5 if asked else 0.1)
    if preferred and sum(s >= 1.0 for s, _ in found.values()) < limit:
        for r in [r for r in spoken if r[1] in preferred[:8]][: retrieval.PREFERRED_ROWS]:
            add(r, 0.35 if asked else 0.15)
    if asked and sum(s >= 1.2 for s, _ in found.values()) < min(3, limit):
        for token in sorted(asked, key=lambda t: -len(t))[:3]:
            for r in [r for r in spoken if token in r[3].lower()][: retrieval.WORD_ROWS]:
                add(r, 0.3 if r[1] == chat else 0)
            if sum(s >= 1.2 for s, _ in found.values()) >= limit:
                break
    if not found:
        latest = sorted((r for r in rows if r[1] == chat and r[2] == persona and not r[5] and r[3] is not None), key=lambda r: (-r[4], -r[0]))
        found = {r[0]: (0.05, r[4]) for r in latest[:limit]}
    best = sorted(((-s, -t, i) for i, (s, t) in found.items()))[:limit]
    return [(q[0], i, round(-s, 6), n) for n, (s, _, i) in enumerate(best, 1)]


@pytest.mark.parametrize("small", [False, True])
def test_keyword_tiers_against_one_query_at_a_time(spark, monkeypatch, tmp_path, small):
    if small:
        for name, value in (("OPEN_ROWS", 3), ("PREFERRED_ROWS", 4), ("WORD_ROWS", 2)):
            monkeypatch.setattr(retrieval, name, value)
    rows, rng = made(), random.Random(8)
    asked = [(k, rng.choice("AB"), rng.choice([None, "", "the and ok", *[" ".join(rng.choices([*WORDS, "art", "none such"], k=rng.randint(1, 5)))] * 4]), rng.choice([None, "c0", "c1", "c9"]), rng.choice([None, [], ["c2", "c3"], ["c9"]])) for k in range(40)]
    m, q = spark.createDataFrame(rows, M).repartition(3), spark.createDataFrame(asked, Q)
    want = sorted(x for a in asked for x in keyword(rows, a))
    assert sorted(map(tuple, retrieval.keyword_memories(m, q).collect())) == want
    retrieval.index(m).write.parquet(str(tmp_path / "index"))
    again = retrieval.keyword_memories(m, q, postings=spark.read.parquet(str(tmp_path / "index")))
    assert sorted(map(tuple, again.collect())) == want


def test_vector_quotas(spark, monkeypatch):
    for name, value in (("OPEN_CHAT", 4), ("CANDIDATES", 7)):
        monkeypatch.setattr(retrieval, name, value)
    rng, rows = random.Random(2), made(120, 5)
    vectors = [(r[0], rng.choice(["now", "now", "old"]), [rng.gauss(0, 1) for _ in range(4)]) for r in rows if rng.random() < 0.7]
    asked = [(i, who, chat, [rng.gauss(0, 1) for _ in range(4)], rng.choice([None, i])) for i, (who, chat) in enumerate([("A", "c0"), ("B", "c1"), ("A", None), ("nobody", "c0")] * 5)]
    by, want = {r[0]: r for r in rows}, set()
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y)
    for i, who, chat, v, own in asked:
        if sum(by[j][2] == who and not by[j][5] for j, _, _ in vectors) < 5:
            continue
        stored = sorted(((by[j], e) for j, model, e in vectors if model == "now" and by[j][2] == who and not by[j][5] and (by[j][3] or "").strip()), key=lambda x: (-x[0][4], -x[0][0]))
        held = [x for x in stored if x[0][1] == chat][:4]
        held += [x for x in stored[:7] if x not in held][: 7 - len(held)]
        scored = [(-round(cosine(v, e) + (0.04 if r[1] == chat else 0), 9), -r[4], r[0]) for r, e in held if r[0] != own]
        want |= {(i, j, round(-s, 6), n) for n, (s, _, j) in enumerate(sorted(x for x in scored if -x[0] >= 0.28)[:12], 1)}
    q = spark.createDataFrame([(i, who, chat, v, own) for i, who, chat, v, own in asked], "query_id long, persona string, conversation_id string, embedding array<double>, own long")
    got = retrieval.vector_memories(spark.createDataFrame(rows, M), spark.createDataFrame(vectors, "message_id long, model string, embedding array<double>"), q, "now")
    assert {tuple(r) for r in got.collect()} == want and want


def test_hybrid_fills_up(spark):
    found = "query_id long, message_id long, score double, rank int"
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], found)
    k = spark.createDataFrame([(1, 11, 2.0, 1), (1, 12, 1.0, 2), (2, 13, 1.0, 1)], found)
    got = {(r.query_id, r["rank"]): (r.message_id, r.found_by, r.mode) for r in retrieval.hybrid(v, k, limit=4).collect()}
    assert got == {(1, 1): (10, "vector", "vector"), (1, 2): (11, "vector", "vector"), (1, 3): (12, "keyword", "vector"), (2, 1): (13, "keyword", "keyword")}


def greedy(pool, q, most):
    """Example selection for one query, pair by pair."""
    i, persona, text, chat, _ = q
    query, rows = (text or "").strip(), [p for p in pool if p[0] == persona]

    def score(p):
        asked, ctx, reply = tokens(query), tokens(p[3]), tokens(p[4])
        s = overlap(asked, ctx) + 0.25 * len(set(reply) & set(asked)) + (0.55 if p[2] == chat else 0) + (0.7 if p[5] else 0)
        n = len(p[4].replace("<<<BUBBLE>>>", " ").split())
        return round(s + (0 if len(query.split()) <= 2 else -0.8 if re.search(retrieval.ACK, p[4].strip()) else 0.45 if n >= 8 else 0.2 if n >= 4 else -0.15), 9)

    order = sorted(((-score(p), p[1], p) for p in rows), key=lambda x: x[:2])
    if not query or not order or -order[0][0] < 0.15:
        flat = [p for p in rows if p[2] == chat] + [p for p in rows if p[5]] + [p for p in rows if not p[5]]
        return [(i, p[1], k) for k, p in enumerate(flat[:most], 1)]
    picked, per, cap = [], {}, max(3, math.ceil(most / 3))
    for _, _, p in order:
        if len(picked) >= most:
            break
        if per.get(p[2], 0) >= cap and len(picked) < most - 2:
            continue
        picked.append(p)
        per[p[2]] = per.get(p[2], 0) + 1
    picked += [p for _, _, p in order if p not in picked][: most - len(picked)]
    return [(i, p[1], k) for k, p in enumerate(picked, 1)]


@pytest.mark.parametrize("most", [3, 8, 12])
def test_example_selection_against_a_greedy_loop(spark, most):
    rng = random.Random(most)
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    pool = [(p, k, f"c{rng.randint(0, 2)}", say(rng.randint(1, 6)), rng.choice(["ok", "lol!", say(3), say(6), f"{say(5)} <<<BUBBLE>>> {say(5)}"]), rng.random() < 0.3) for p, n in (("A", 40), ("B", 5), ("C", 11)) for k in range(1, n + 1)]
    asked = [(k, rng.choice("ABCD"), rng.choice([None, " ", "zzz qqq", "zzz qqq xxx www", *[say(5)] * 4]), rng.choice([None, "c0", "c1"]), None) for k in range(60)]
    got = retrieval.select_examples(spark.createDataFrame(pool, "persona string, example_id long, conversation_id string, context string, reply string, with_you boolean"), spark.createDataFrame(asked, Q), most)
    assert sorted((r.query_id, r.example_id, r.pick) for r in got.collect()) == sorted(x for a in asked for x in greedy(pool, a, most))


def test_turns_break_at_notices_and_pair_across_them(spark):
    s = lambda i, who, text, t, sys=False: (i, "c", who, text, t * 1000, sys, 0.0, 1)
    rows = [s(1, "A", "hi", 0), s(2, "A", "no", 2), s(3, "X", "A changed the photo", 3, True), s(4, "A", "again", 4), s(5, "A", " ", 5), s(6, "A", "after a blank", 6), s(7, "B", "sent 2 photos", 7), s(8, "B", "an answer", 8), s(9, "B", "x" * 600, 9), s(10, "B", "late", 200)]
    turns = ordered.turn_texts(spark.createDataFrame(rows, M), ordered.breaker())
    got = [(r.sender, r.n_bubbles, r.context[:20], len(r.reply)) for r in turns.orderBy("turn_no").collect()]
    assert got == [("A", 2, "hi no", 2 + 2 + len(ordered.MARK)), ("A", 1, "again", 5), ("A", 1, "after a blank", 13), ("B", 2, "an answer " + "x" * 10, 9), ("B", 1, "late", 4)]
    (pair,) = ordered.reply_pairs(turns).collect()
    assert (pair.partner, pair.persona, pair.context, pair.reply, pair.prev_id, pair.first_id) == ("A", "B", "after a blank", "an answer", 6, 8)


def test_names_are_no_words(spark):
    rows = [(1, "whatsapp:ellu_radhu guys", "Ann O'Neil", "ann and radhu talk about photos, ONeil o'neil dinner", 1, False, 0.0, 9), (2, "other", "Bo B", "ann likes dinner bo", 1, False, 0.0, 4)]
    m = spark.createDataFrame(rows, M).withColumn("sys", F.lit(False))
    assert {(r.conversation_id, r.word) for r in texts.name_blocklist(m).collect()} == {("whatsapp:ellu_radhu guys", w) for w in ("ann", "o'neil", "ellu", "radhu", "guys")} | {("other", "bo"), ("other", "other")}
    assert sorted((r.message_id, r.word) for r in texts.words(m).collect()) == [(1, "about"), (1, "dinner"), (1, "oneil"), (2, "ann"), (2, "dinner"), (2, "likes")]
    assert {r.word for r in texts.vocabulary(m).collect()} == {"about", "photos", "oneil", "dinner", "ann", "likes"}


def test_relationship_cards(spark):
    me, lines = "Finn Morris", ["hey finn how are you", "Finn!", "love you babe haha", "we met Priya Shah at the cafe", "and then Priya Shah left for Melbourne", "ok", "night night", "so what? is it on in the Garden", "Tia said so", "with Tia again", "lol", "a longer line without any of it, finn is in it but nothing else is said here"]
    rows = [(i, "dm", "Zoe Lee", t, i, False, 0.5, len(t.split())) for i, t in enumerate(lines)] + [(50, "dm", me, "hello", 50, False, 0.0, 1), (60, "other", "Zoe Lee", "one two three four", 60, False, -1.0, 4)]
    rows += [(70 + i, "dm", "Tia", "x y z", 70 + i, False, 0.0, 3) for i in range(3)] + [(80, "far", "Nobody", "hey finn", 80, False, 0.0, 2)]
    m, you = spark.createDataFrame(rows, M), spark.createDataFrame([(me,)], "sender string")
    got = {(r.persona, r.kind, r["item"]): r.n for r in relationships.phrases(m, you).collect()}
    assert got == {("Zoe Lee", "address", k): n for k, n in {"finn": 3, "babe": 1, "love": 1}.items()} | {("Zoe Lee", "opener", k): 1 for k in ("hey", "so", "lol")} | {("Zoe Lee", "closer", k): n for k, n in {"ok": 1, "night": 1, "love you": 1}.items()}
    people, places = {}, {}
    skip = {"finn", "morris", "zoe", "lee", me.lower(), "zoe lee", "instagram", "user"}
    for t in lines:
        for p in relationships.PLACES:
            places[p] = places.get(p, 0) + (p in t.lower())
        for x in regex.findall(relationships.MENTION, t):
            if x.lower() in relationships.PLACES:
                places[x.lower()] = places.get(x.lower(), 0) + 1
            elif x.lower() not in skip and x.lower() not in relationships.ENDEARMENTS and (" " in x or len(x) >= 4):
                people[x] = people.get(x, 0) + 1
    people["Tia"] = people.get("Tia", 0) + 2
    found = {(r.kind, r["item"]): r.n for r in relationships.mentions(m, you).filter("persona = 'Zoe Lee'").collect()}
    assert found == {("person", k): n for k, n in people.items()} | {("place", k): n for k, n in places.items() if n}
    assert [r.line for r in relationships.teasing(m, you).orderBy("rank").collect()] == ["love you babe haha"]
    card = {r.persona: r for r in relationships.cards(m, you.select("sender")).collect()}["Zoe Lee"]
    assert (card.shared_messages, card.shared_chats, card.tone, card.question_rate) == (12, 1, "usually warm / upbeat with you", round(1 / 12, 3))
    assert relationships.phrases(m.limit(0), you).count() == 0


def test_a_token_of_many_queries_is_looked_up_once(spark, monkeypatch):
    seen, holding = [], retrieval._holding
    monkeypatch.setattr(retrieval, "_holding", lambda asked, words: seen.append(asked.count()) or holding(asked, words))
    m = spark.createDataFrame(made(), M)
    q = spark.createDataFrame([(k, "A", "party music garden", "c9", None) for k in range(30)], Q)
    assert retrieval.keyword_memories(m, q).count() and seen == [3]


def test_words_are_compared_with_tokens_they_begin_to_hold(spark):
    words = [f"{a}{b}ing" for a in ("und", "pre") for b in ("erstand", "ertain", "fer", "tend", "er")] + ["a" * 40, "und", "the'prefering"]
    tokens = ["understand", "prefer", "und", "ing", "undertaking", "undertaining", "aaaaaaaaaaaaaa", "tend", "none"]
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = sorted(map(tuple, retrieval._holding(one("token", tokens), one("word", words)).collect()))
    assert got == sorted((t, w) for t in tokens for w in words if t in w)
    # of 400 words that begin alike few are compared with a longer token
    alike = [f"understand{i}" for i in range(400)]
    assert retrieval._held_pieces(one("token", ["understand7"]), one("word", alike)).count() == 400
    assert retrieval._held_pieces(one("token", ["underway"]), one("word", alike)).count() == 0
