"""Persona and retrieval (PER-01 to PER-24)."""

from parley.operators.statements.mood import MEAN
from parley.operators.statements.text import TIMELINE

#: Of each persona the first 240 pairs in order of conversation and time, then one of each conversation in turn.
_FIRST = "(select * from (select *, row_number() over (partition by persona order by conversation_id, turn_no) place from {rp}) where place <= 240)"
_WITH_YOU = "(select * from (select p.*, row_number() over (partition by persona order by conversation_id, turn_no) place from {rp} p where partner in (select sender from {me})) where place <= 240)"
#: Adjacent messages by different senders, the later one by the persona, with a notice between them none.
_ADJACENT = "(select *, sender persona, substr(prev_content, 1, 400) context, substr(content, 1, 500) reply from {pv} where not is_system and not prev_system and prev_sender <> sender)"
_STARTS = "(select sender, count(*) starts from (select sender, row_number() over (partition by conversation_id, day order by timestamp_ms, message_id) n from {m}) where n = 1 group by sender)"

# Labels of lengths and of emoji rates.
_LENGTH_LABEL = "case when avg_words < 4 then 'very short' when avg_words < 10 then 'short' when avg_words < 25 then 'medium' else 'long' end"
_EMOJI_LABEL = "case when avg_emojis >= 4e-1 then 'often' when avg_emojis < 5e-2 then 'rarely' else 'sparingly' end"

STATEMENTS = {
    "per01_base_stats": ("m", "select sender, count(*) n, round(avg(word_count), 6) avg_words, round(avg(emoji_count), 6) avg_emojis from {m} where not sys group by sender having count(*) >= 5"),
    "per02_vocabulary": ("vw", "select sender, word, n, rank from (select *, row_number() over (partition by sender order by n desc, word) rank from (select sender, word, count(*) n from {vw} group by sender, word)) where rank <= 25"),
    "per03_sentiment_ratios": ("m", "select sender, round(avg(compound), 6) avg_compound, round(100e0 * count(case when compound >= 5e-2 then 1 end) / count(*), 6) positive_ratio, round(100e0 * count(case when compound <= -5e-2 then 1 end) / count(*), 6) negative_ratio from {m} where not sys group by sender"),
    "per05_start_ratio": ("m", f"select a.sender, coalesce(starts, 0) starts, round(coalesce(starts, 0) / cast(n_days as double), 6) start_ratio from (select sender, count(distinct concat(conversation_id, day)) n_days from {{m}} group by sender) a left join {_STARTS} s on s.sender = a.sender"),
    "per06_style_summary": ("m", f"select sender, concat(case when w < 5 then 'short' when w < 12 then 'medium' else 'long' end, ' messages, ', case when e > 5e-1 then 'many emojis' when e > 0 then 'some emojis' else 'no emojis' end, ', ', case when v > 5e-2 then 'warm' when v < -5e-2 then 'cool' else 'neutral' end, ' tone') summary from (select sender, avg(word_count) w, avg(emoji_count) e, {MEAN} v from {{m}} where not sys group by sender)"),
    "win08_reply_pairs": ("rp", "select conversation_id, partner, persona, prev_id, first_id, words, n_bubbles, context, reply from {rp}"),
    "per07_few_shot_pairs": ("rp", f"""select persona, first_id, pick from (select *, row_number() over (partition by persona order by rn, conversation_id) pick from (select *, row_number() over (partition by persona, conversation_id order by turn_no) rn from {_FIRST})) where pick <= 80"""),
    "per07_with_you_pairs": ("rp me", f"""select persona, first_id, pick from (select *, row_number() over (partition by persona order by rn, first_at) pick from (select *, row_number() over (partition by persona, conversation_id order by score desc, place) rn, min(spot) over (partition by persona, conversation_id) first_at from
        (select *, row_number() over (partition by persona order by score desc, conversation_id, place) spot from (select *, words + case when n_bubbles > 1 then 2 else 0 end score from (select *, row_number() over (partition by persona order by rn0, conversation_id) kept from (select *, row_number() over (partition by persona, conversation_id order by turn_no) rn0 from {_WITH_YOU})) where kept <= 80)))) where pick <= 40"""),
    "per07_ranked_pairs": ("rp", "select persona, partner, first_id, rank from (select *, row_number() over (partition by persona, partner order by words + case when n_bubbles > 1 then 2 else 0 end desc, first_id) rank from {rp}) where rank <= 40"),
    "per10_conversation_voices": ("m k", f"""select v.conversation_id, v.sender, n, avg_words, avg_emojis, people, {_LENGTH_LABEL} length_label, case when people <= 2 then 'dm' when people <= 5 then 'small_group' else 'group' end chat_type, {_EMOJI_LABEL} emoji_label, rank from (select *, row_number() over (partition by sender order by n desc, conversation_id) rank from
        (select conversation_id, sender, count(*) n, floor(avg(word_count) * 10 + 5e-1) / 10 avg_words, floor(avg(emoji_count) * 100 + 5e-1) / 100 avg_emojis from {{m}} where not is_system and trim(content) <> '' group by conversation_id, sender having count(*) >= 25)) v join (select conversation_id, count(*) people from {{k}} group by conversation_id) p on p.conversation_id = v.conversation_id where rank <= 20"""),
    "per10_platform_voices": ("m k", f"""select sender, source, n, chats, avg_words, avg_emojis, {_LENGTH_LABEL} length_label, {_EMOJI_LABEL} emoji_label, dm_share, case when dm_share >= 6e-1 then 'mostly 1:1' when dm_share <= 35e-2 then 'often groups' else '' end where_mostly from (select m.sender, m.source, count(*) n, count(distinct m.conversation_id) chats, floor(avg(m.word_count) * 10 + 5e-1) / 10 avg_words, floor(avg(m.emoji_count) * 100 + 5e-1) / 100 avg_emojis,
        floor(1000e0 * count(case when coalesce(p.people, 0) <= 2 then 1 end) / count(*) + 5e-1) / 1000 dm_share from {{m}} m left join (select conversation_id, count(*) people from {{k}} group by conversation_id) p on p.conversation_id = m.conversation_id where not m.is_system and trim(m.content) <> '' and trim(m.source) <> '' group by m.sender, m.source having count(*) >= 40)"""),
    "per11_bubble_habits": ("rt", """select sender, turns, floor(1000 * multi / cast(turns as double) + 5e-1) / 1000 multi_rate, floor(100 * bubbles / cast(turns as double) + 5e-1) / 100 avg_bubbles, most, coalesce(middle, 1e0) median_when_multi from (select sender, count(*) turns, count(case when n_bubbles > 1 then 1 end) multi, sum(n_bubbles) bubbles, max(n_bubbles) most, median(case when n_bubbles > 1 then n_bubbles end) middle from {rt} group by sender) where turns >= 10"""),
    "per11_bubble_triggers": ("rp", """select persona, samples, case when kinds = '' then 'separate thoughts that do not fit in one text' else substr(kinds, 3) end triggers from (select persona, count(*) samples, concat(case when avg(asks) >= 25e-2 then ', follow-up questions' else '' end, case when avg(plans) >= 2e-1 then ', plans/logistics' else '' end, case when avg(reacts) >= 15e-2 then ', reactions + a second thought' else '' end) kinds from
        (select persona, case when contains(reply, '?') then 1e0 else 0e0 end asks, case when regexp_like(lower(reply), '(^|[^a-z0-9_])(time|when|where|meet|friday|saturday|sunday|tomorrow|tonight|free|plans?)([^a-z0-9_]|$)') then 1e0 else 0e0 end plans, case when regexp_like(lower(reply), '^(omg|wait|haha|lol|lmao|no way|dude|bro)([^a-z0-9_]|$)') then 1e0 else 0e0 end reacts from
        (select *, row_number() over (partition by persona order by conversation_id, turn_no) nth from {rp} where n_bubbles between 2 and 5 and shortest >= 2 and longest <= 160 and length(trim(context)) between 2 and 280) where nth <= 8) group by persona)"""),
    "per11_bubble_samples": ("rt", "select sender, first_id, reply, nth from (select *, row_number() over (partition by sender order by conversation_id, turn_no) nth from {rt} where n_bubbles between 2 and 5 and shortest >= 2 and longest <= 160) where nth <= 6"),
    "per12_turn_habits": ("pv", """select sender persona, n messages, floor(1000 * coalesce(reply_questions / cast(nullif(replies, 0) as double), questions / cast(n as double)) + 5e-1) / 1000 question_rate, floor(1000 * doubles / cast(n as double) + 5e-1) / 1000 double_text_rate, floor(1000 * expands / cast(greatest(replies, 1) as double) + 5e-1) / 1000 expands_rate,
        floor(1000 * compresses / cast(greatest(replies, 1) as double) + 5e-1) / 1000 compresses_rate, cast(floor(latency + 5e-1) as bigint) avg_reply_latency_ms from (select sender, count(*) n, count(case when contains(content, '?') then 1 end) questions, count(case when prev_sender = sender and not prev_system and gap_ms <= 90000 then 1 end) doubles, count(case when answers then 1 end) replies, count(case when answers and contains(content, '?') then 1 end) reply_questions,
        count(case when answers and word_count > 115e-2 * prev_words then 1 end) expands, count(case when answers and word_count < 7e-1 * prev_words then 1 end) compresses, avg(case when answers and gap_ms > 0 and gap_ms < 86400000 then gap_ms end) latency from (select *, coalesce(prev_sender <> sender and not prev_system, false) answers from {pv} where not is_system) group by sender) where n >= 20"""),
    "per13_shared_timeline": ("m me", f"""select persona, day, k, message_id, score, place from (select *, count(*) over (partition by persona) facts from (select *, row_number() over (partition by persona order by score desc, day desc, message_id) place from (select *, row_number() over (partition by persona, k order by score desc, day desc, message_id) again from
        (select sender persona, day, message_id, lower(substr(trim(content), 1, 60)) k, round({TIMELINE}, 6) score from (select *, count(*) over (partition by sender) rows_of, row_number() over (partition by sender order by timestamp_ms desc, message_id desc) newest from {{m}} where not is_system and trim(content) <> ''
        and conversation_id in (select conversation_id from {{m}} where sender in (select sender from {{me}})) and sender not in (select sender from {{me}})) where rows_of >= 20 and newest <= 4000) where score >= 35e-1) where again = 1) where place <= 12) where facts >= 3"""),
    "per19_memory_snippets": ("m", "select message_id, concat(coalesce(before_text, ''), ' -> ', content) snippet from (select message_id, content, lag(content) over (partition by conversation_id order by timestamp_ms, message_id) before_text from {m}) where contains(lower(content), 'trip')"),
    "per20_thread_seed": ("m", """select k.conversation_id, k.persona, m.message_id, case when m.sender = k.persona then 'assistant' else 'user' end chat_role, m.place from (select distinct conversation_id, sender persona from {m} where conversation_id in (select conversation_id from {m} group by conversation_id having count(distinct sender) = 2)) k
        join (select conversation_id, message_id, sender, row_number() over (partition by conversation_id order by timestamp_ms desc, message_id desc) place from {m} where not is_system and trim(content) <> '') m on m.conversation_id = k.conversation_id where m.place <= 80"""),
    "per23_held_out_pairs": ("pv rp", f"""select persona, message_id, pick from (select *, row_number() over (partition by persona order by rn, first_at) pick from (select *, min(spot) over (partition by persona, conversation_id) first_at, row_number() over (partition by persona, conversation_id order by spot) rn from (select *, row_number() over (partition by persona order by length(reply) desc, conversation_id, timestamp_ms, message_id) spot from {_ADJACENT} a
        where length(content) >= 8 and prev_chars >= 4 and not regexp_like(lower(content), 'sent [0-9]+ photo|sent a voice message|shared a link') and persona in (select sender from {{pv}} where not is_system group by sender having count(*) >= 80)
        and not exists (select 1 from (select distinct persona, trim(context) context, trim(reply) reply from {_FIRST}) f where f.context = trim(a.context) and f.reply = trim(a.reply))))) where pick <= 40"""),
    "per24_fine_tune_rows": ("pv me", f"""select persona, message_id, rank from (select *, row_number() over (partition by persona order by case when prev_sender in (select sender from {{me}}) then 0 else 1 end, length(reply) desc, message_id) rank from {_ADJACENT} where length(content) >= 4 and prev_chars >= 2) where rank <= 200
        and persona in (select sender from (select sender, count(*) n from {{pv}} where not is_system group by sender having count(*) >= 100) order by n desc, sender limit 20)"""),
}
