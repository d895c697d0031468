"""Media and reactions (AGG-20, AGG-24 to AGG-34)."""

#: Each media message with the answers of others in the two hours after it.
_EACH = """(select a.message_id, a.conversation_id, a.sender, a.hour, a.kind, coalesce(responses, 0) responses, coalesce(avg_ms, 0) avg_ms, coalesce(reactions, 0) reactions, coalesce(medias, 0) medias, coalesce(texts, 0) texts, coalesce(immediate, 0) immediate, coalesce(quick, 0) quick, coalesce(delayed, 0) delayed, coalesce(late, 0) late from {mp} a
    left join (select message_id, count(*) responses, avg(after_ms) avg_ms, count(case when reply_kind = 'reaction' then 1 end) reactions, count(case when reply_kind = 'media' then 1 end) medias, count(case when reply_kind = 'text' then 1 end) texts, count(case when after_ms < 300000 then 1 end) immediate,
    count(case when after_ms >= 300000 and after_ms < 1800000 then 1 end) quick, count(case when after_ms >= 1800000 and after_ms < 7200000 then 1 end) delayed, count(case when after_ms >= 7200000 then 1 end) late from {ma} group by message_id) b on b.message_id = a.message_id)"""

STATEMENTS = {
    "agg24_media_with_attachments": ("m", "select conversation_id, sender, count(case when has_photos then 1 end) photos, count(case when has_videos then 1 end) videos, count(case when content ilike '%sent an attachment%' then 1 end) attachments, count(*) messages, count(case when media then 1 end) media_messages from {m} group by conversation_id, sender"),
    "agg25_media_types": ("m", "select conversation_id, photos, videos, attachments, round(100e0 * media_messages / messages, 6) media_ratio from (select conversation_id, count(case when has_photos then 1 end) photos, count(case when has_videos then 1 end) videos, count(case when content ilike '%sent an attachment%' then 1 end) attachments, count(*) messages, count(case when media then 1 end) media_messages from {m} group by conversation_id)"),
    "agg26_media_by_month": ("m", "select conversation_id, month, sender, count(case when media then 1 end) media_messages, count(*) messages from {m} group by conversation_id, month, sender having count(case when media then 1 end) > 0"),
    "agg26_most_active_month": ("m", "select conversation_id, month, n from (select conversation_id, month, n, row_number() over (partition by conversation_id order by n desc, month) rn from (select conversation_id, month, count(*) n from {m} where media group by conversation_id, month)) where rn = 1"),
    "agg27_media_engagement": ("mp ma", f"select message_id, kind, responses, round(avg_ms, 4) avg_ms, reactions, medias, texts, immediate, quick, delayed, late, responses * 10 + reactions * 2 + medias * 5 score from {_EACH}"),
    "agg28_media_kinds": ("mp ma", f"select kind, count(*) messages, round(avg(responses), 6) avg_responses, round(100e0 * count(case when responses > 0 then 1 end) / count(*), 6) response_rate, round(sum(avg_ms * responses) / greatest(sum(responses), 1), 4) avg_ms, cast(sum(immediate) as bigint) immediate, cast(sum(quick) as bigint) quick, cast(sum(delayed) as bigint) delayed, cast(sum(late) as bigint) late from {_EACH} group by kind"),
    "agg28_top_responders": ("ma", "select kind, responder, n, rank from (select *, row_number() over (partition by kind order by n desc, responder) rank from (select kind, responder, count(*) n from {ma} group by kind, responder)) where rank <= 5"),
    "agg29_media_of_senders": ("mp ma", f"select coalesce(g.sender, s.sender) sender, coalesce(shared, 0) shared, coalesce(received, 0) received, coalesce(given, 0) given from (select responder sender, count(*) given from {{ma}} group by responder) g full join (select sender, count(*) shared, cast(sum(responses) as bigint) received from {_EACH} group by sender) s on s.sender = g.sender"),
    "agg30_media_by_hour": ("mp ma", f"select hour, count(*) media_count, round(avg(responses * 10 + reactions * 2 + medias * 5), 6) avg_engagement, round(100e0 * count(case when responses > 0 then 1 end) / count(*), 6) response_rate from {_EACH} group by hour"),
    "agg31_reactions_by_emoji": ("x", "select emoji_key, max_by(emoji, n * 10 + length(emoji)) display, cast(sum(n) as bigint) n, round(100e0 * sum(n) / max(total), 6) percentage, max(conversations) conversations from (select emoji_key, emoji, n, sum(n) over () total, conversations from (select replace(emoji, '️', '') emoji_key, emoji, count(*) n from {x} group by replace(emoji, '️', ''), emoji) join (select replace(emoji, '️', '') kk, count(distinct conversation_id) conversations from {x} group by replace(emoji, '️', '')) on kk = emoji_key) group by emoji_key"),
    "agg31_top_reactors": ("x", "select emoji_key, actor, n, rank from (select *, row_number() over (partition by emoji_key order by n desc, actor) rank from (select replace(emoji, '️', '') emoji_key, actor, count(*) n from {x} group by replace(emoji, '️', ''), actor)) where rank <= 5"),
    "agg31_top_targets": ("x", "select emoji_key, target, n, rank from (select *, row_number() over (partition by emoji_key order by n desc, target) rank from (select replace(emoji, '️', '') emoji_key, target, count(*) n from {x} group by replace(emoji, '️', ''), target)) where rank <= 5"),
    "agg32_reactions_by_sender": ("x", "select person, cast(sum(g) as bigint) given, cast(sum(v) as bigint) received, round(sum(g) / greatest(sum(v), 1), 6) ratio from (select actor person, 1e0 g, 0e0 v from {x} union all select target, 0e0, 1e0 from {x}) group by person"),
    "agg32_top_emojis_given": ("x", "select actor, emoji_key, n, rank from (select *, row_number() over (partition by actor order by n desc, emoji_key) rank from (select actor, replace(emoji, '️', '') emoji_key, count(*) n from {x} group by actor, replace(emoji, '️', ''))) where rank <= 5"),
    "agg32_top_emojis_received": ("x", "select target, emoji_key, n, rank from (select *, row_number() over (partition by target order by n desc, emoji_key) rank from (select target, replace(emoji, '️', '') emoji_key, count(*) n from {x} group by target, replace(emoji, '️', ''))) where rank <= 5"),
    "agg33_reactions_by_conversation": ("x", "select conversation_id, emoji_key, n, total, rank from (select conversation_id, emoji_key, n, cast(sum(n) over (partition by conversation_id) as bigint) total, row_number() over (partition by conversation_id order by n desc, emoji_key) rank from (select conversation_id, replace(emoji, '️', '') emoji_key, count(*) n from {x} group by conversation_id, replace(emoji, '️', ''))) where rank <= 50"),
    "agg33_senders_by_conversation": ("x", "select conversation_id, person, cast(sum(g) as bigint) given, cast(sum(v) as bigint) received from (select conversation_id, actor person, 1 g, 0 v from {x} union all select conversation_id, target, 0, 1 from {x}) group by conversation_id, person"),
    "agg34_reaction_summary": ("x m", "select count(*) reactions, count(distinct actor) actors, round(count(*) / max(messages), 6) rate, min(ms) first_ms, max(ms) last_ms from (select x.actor, case when x.reaction_ts > 1000000000000 then x.reaction_ts when x.reaction_ts > 0 then x.reaction_ts * 1000 else x.timestamp_ms end ms from {x} x), (select count(*) messages from {m})"),
}
