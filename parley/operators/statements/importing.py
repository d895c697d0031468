"""Import rules, stored tables, scopes and joins (SRC, SNK, FLT, JOIN, SET)."""

STATEMENTS = {
    # -- sources
    "src07_source_inference": ("pages", "select page_id, case when contains(lower(url), 'facebook') then 'messenger' else 'instagram' end source from {pages}"),
    "src09_whatsapp_date": ("m", """select message_id, case when a > 12 then a when b > 12 then b else a end dom, case when a > 12 then b when b > 12 then a else b end mon,
        case when y < 100 then y + 2000 else y end yr from (select message_id, cast(split_part(d, '/', 1) as int) a, cast(split_part(d, '/', 2) as int) b, cast(split_part(d, '/', 3) as int) y from
        (select message_id, case when message_id % 2 = 0 then concat(substr(day, 9, 2), '/', substr(day, 6, 2), '/', substr(day, 3, 2)) else concat(substr(day, 6, 2), '/', substr(day, 9, 2), '/', substr(day, 1, 4)) end d from {m}))"""),
    "src10_chat_name": ("m", """select message_id, case when stem in ('_chat', 'chat') then 'WhatsApp Chat' else stem end chat from (select message_id, replace(replace(file, 'WhatsApp Chat with ', ''), '.txt', '') stem from
        (select message_id, case when message_id % 3 = 0 then '_chat.txt' else concat('WhatsApp Chat with ', sender, '.txt') end file from {m}))"""),
    "src12_apple_epoch": ("m", """select message_id, cast(case when raw = 0 then 0 when raw > 1000000000000000 then floor(raw / 1000000) + 978307200000 when raw > 1000000000000 then floor(raw / 1000) + 978307200000
        when raw < 100000000000 then raw * 1000 + 978307200000 else raw + 978307200000 end as bigint) ms from (select message_id, case message_id % 5 when 0 then a * 1000000 when 1 then a * 1000 when 2 then cast(floor(a / 1000) as bigint) when 3 then a else 0 end raw from
        (select message_id, timestamp_ms - 978307200000 a from {m}))"""),
    "src14_imessage_system": ("m", """select message_id from (select message_id, is_system, message_id % 9 item, case when message_id % 10 = 0 then concat('Loved “', content, '”') else content end body from {m})
        where is_system or item in (1, 2, 3) or body like 'Loved %' or body like 'Liked %' or body like 'Disliked %' or body like 'Laughed at %' or body like 'Emphasized %' or body like 'Questioned %'"""),
    "src19_rejected_rows": ("m", """select message_id, case when sender is null then 'no sender' when ms is null then 'no time' else 'time out of range' end reason from
        (select message_id, case when message_id % 23 = 0 then null else sender end sender, case when message_id % 29 = 0 then null when message_id % 31 = 0 then timestamp_ms * 1000 else timestamp_ms end ms from {m})
        where sender is null or ms is null or ms < 946684800000 or ms > 2145916800000"""),
    # -- stored tables
    "snk03_namespaced_ids": ("m", """select conversation_id, case when raw like 'instagram:_%' or raw like 'messenger:_%' or raw like 'whatsapp:_%' or raw like 'imessage:_%' or raw like 'meta:_%' then raw else concat(source, ':', raw) end named
        from (select distinct conversation_id, source, case when source = 'whatsapp' then replace(conversation_id, 'whatsapp:', '') else conversation_id end raw from {m})"""),
    # -- filters
    "flt02_conversation_scope": ("m", "select message_id from {m} where conversation_id in (select conversation_id from {m} group by conversation_id having count(*) >= 50)"),
    "flt04_participant_union": ("k", "select distinct participant from {k} where conversation_id in ('whatsapp:group_1', 'whatsapp:group_2')"),
    "flt05_senders_in_scope": ("m k", """select a.conversation_id, a.sender, a.n from (select conversation_id, sender, count(*) n from {m} group by conversation_id, sender) a
        join {k} k on k.conversation_id = a.conversation_id and k.participant = a.sender"""),
    "flt07_attachment_candidates": ("m", "select message_id from {m} where has_photos or has_videos or has_audio or has_share or content ilike '%sent an attachment%' or content ilike '%sent a gif%' or content ilike '%sent a sticker%' or content ilike '%sent a file%'"),
    "flt08_media_placeholders": ("m", """select message_id, regexp_like(lower(body), 'sent [0-9]+ photo|sent a voice message|shared a link') placeholder from
        (select message_id, case message_id % 4 when 0 then concat(sender, ' sent ', message_id % 7, ' photos') when 1 then concat(sender, ' Shared a link') else content end body from {m})"""),
    "flt09_length_guards": ("m", "select count(*) n, count(case when length(content) > 2 then 1 end) for_sentiment, count(case when length(content) > 5 then 1 end) for_words, count(case when length(trim(content)) >= 8 then 1 end) for_vectors from {m} where content is not null and trim(content) <> ''"),
    "flt10_thresholds": ("m", """select sender, n, n >= 5 persona, n >= 20 vectors, n >= 80 evaluation, n >= 100 tuning from (select sender, count(*) n from {m} where not sys group by sender) where n >= 3"""),
    "flt11_conversation_list": ("m", """select conversation_id, n, last_ms from (select conversation_id, source, count(*) n, max(timestamp_ms) last_ms, max(case when contains(lower(sender), 'user_1') then 1 else 0 end) hit from {m} group by conversation_id, source)
        where n > 5 and source = 'instagram' and (hit = 1 or contains(lower(conversation_id), 'user_1')) and conversation_id <> 'instagram:dm_3'"""),
    "flt13_literal_search": ("m", "select message_id from {m} where contains(lower(content), lower('?x=1')) or contains(content, '_') or contains(content, '%')"),
    # -- joins
    "join01_with_metrics": ("m", "select a.message_id, a.sender, b.word_count, b.emoji_count from {m} a join (select message_id, word_count, emoji_count from {m} where content is not null) b on a.message_id = b.message_id"),
    "join02_sentiment_or_zero": ("m", "select a.message_id, coalesce(s.compound, 0) compound from {m} a left join (select message_id, compound from {m} where message_id % 3 <> 0) s on a.message_id = s.message_id"),
    "join03_scored": ("m", "select a.message_id, s.compound from {m} a join (select message_id, compound from {m} where message_id % 3 <> 0) s on a.message_id = s.message_id"),
    "join04_unscored": ("m", "select a.message_id from {m} a left anti join (select message_id from {m} where message_id % 3 <> 0) s on a.message_id = s.message_id where length(a.content) > 2"),
    "join05_reactions_to_messages": ("m x", "select x.actor, x.emoji, m.message_id, m.sender target from {x} x join {m} m on m.message_id = x.message_id"),
    "join08_conversations_of_sender": ("m", "select message_id from {m} where conversation_id in (select distinct conversation_id from {m} where sender = 'user_1')"),
    "join10_attachment_counts": ("m", "select a.conversation_id, cast(sum(coalesce(p.n, 0)) as bigint) photos from {m} a left join (select message_id, message_id % 3 + 1 n from {m} where has_photos) p on p.message_id = a.message_id group by a.conversation_id"),
    "join11_after_media": ("ma", "select message_id, reply_id, after_ms from {ma}"),
    "join14_message_before": ("m", "select message_id, before_text from (select message_id, content, lag(content) over (partition by conversation_id order by timestamp_ms, message_id) before_text from {m}) where contains(lower(content), 'meeting')"),
    "join15_trigger_window": ("pw", "select peak_id, count(*) n from {pw} group by peak_id"),
    "join17_scores_of_members": ("m", "select a.conversation_id, round(avg(s.score), 6) score from (select distinct conversation_id, sender from {m}) a join (select sender, avg(compound) score from {m} group by sender having count(*) >= 60) s on s.sender = a.sender group by a.conversation_id"),
    "join18_message_chat_handle": ("m", """select m.message_id, c.conversation_id, coalesce(h.handle, 'Unknown') handle from {m} m join (select message_id, conversation_id from {m}) c on c.message_id = m.message_id
        left join (select distinct sender, concat('+', substr(sender, 6)) handle from {m} where cast(substr(sender, 6) as int) % 2 = 0) h on h.sender = m.sender"""),
    "join19_words_less_names": ("w", "select conversation_id, word, count(*) n from {w} group by conversation_id, word"),
    # -- sets
    "set03_unscored_ids": ("m", "select message_id from {m} except select message_id from {m} where message_id % 3 <> 0"),
    "set04_priority_union": ("m", """select message_id, tier from (select message_id, tier, row_number() over (partition by message_id order by tier) n from
        (select message_id, 1 tier from {m} where media union all select message_id, 2 from {m} where emoji_count > 0 union all select message_id, 3 from {m} where word_count > 8)) where n = 1"""),
    "set06_jaccard": ("w", """select a.sender s1, b.sender s2, round(cast(count(*) as double) / (max(a.k) + max(b.k) - count(*)), 6) jaccard from
        (select sender, word, count(*) over (partition by sender) k from (select distinct sender, word from {w})) a join
        (select sender, word, count(*) over (partition by sender) k from (select distinct sender, word from {w})) b on a.word = b.word and a.sender < b.sender group by a.sender, b.sender"""),
}
