"""Emotional peaks (AGG-61 to AGG-72, WIN-11, WIN-12)."""

_RECOVERY = f"""(select e.day, e.type, e.v, coalesce(min(d.i) - e.i, -1) recovery from {{ev}} e left join {{de}} d on d.i > e.i and (e.type = 'peak' and d.v <= 7e-1 * e.v or e.type = 'valley' and d.v >= 13e-1 * e.v) group by e.day, e.type, e.v, e.i)"""
#: The causes of each event by score, and the first of each; ties in the order of the causes.
_CAUSES = "(select day, cause, place, sum(weight) score from {tk} group by day, cause, place)"
BEST = f"(select e.day, e.type, e.v, e.timestamp_ms, coalesce(cause, 'unknown') cause, coalesce(floor(100e0 * score / whole + 5e-1), 0e0) confidence from {{ev}} e left join (select * from (select *, sum(score) over (partition by day) whole, row_number() over (partition by day order by score desc, place) rn from {_CAUSES}) where rn = 1) c on c.day = e.day)"
#: The keywords of each event's first cause.
SAID = f"(select distinct b.day, b.cause, k.kind, k.keyword from {BEST} b join {{tk}} k on k.day = b.day and k.cause = b.cause)"
#: Days that an event's feeling lasts: itself and at most 29 that follow.
_LASTS = "(select e.day, least(coalesce(min(d.i) - e.i, max(e.days) - e.i + 1), 30) as days from (select *, (select max(i) from {de}) as days from {ev}) e left join {de} d on d.i > e.i and (e.type = 'peak' and d.v <= 1e-1 or e.type = 'valley' and d.v >= -1e-1) group by e.day, e.i)"
#: The mean feeling of each sender among an event's messages.
SHARES = "(select e.day, b.sender, avg(b.compound) contribution, count(*) n from {ev} e join {m} b on b.day = e.day where not b.sys and abs(b.compound) >= 1e-1 group by e.day, b.sender)"
_WINDOWS = f"(select day, var_pop(v) over (order by i rows between current row and 6 following) variance, count(*) over (order by i rows between current row and 6 following) n from {{de}})"

STATEMENTS = {
    "agg61_daily_extremes": ("de", f"select day, v sentiment, n, message_id from {{de}}"),
    "agg62_peak_events": ("ev", f"select day, v, type, prev, next, round(v - prev, 6) change from {{ev}}"),
    "win11_local_extrema": ("de", f"select day, v from (select day, v, lag(v) over (order by i) prev, lead(v) over (order by i) next from {{de}}) where v > prev and v > next or v < prev and v < next"),
    "agg63_intensity": ("de ev", f"select e.day, case when abs(e.v) > 25e-2 then 'extreme' when abs(e.v) > 15e-2 then 'high' else 'moderate' end intensity, l.days duration_days from {{ev}} e join {_LASTS} l on l.day = e.day"),
    "agg64_recovery": ("de ev", f"select day, type, v, recovery from {_RECOVERY}"),
    "agg65_triggers": ("ev tk", f"""select b.day, b.type, b.cause, b.confidence, coalesce(f.factors, case when b.cause = 'unknown' then 'insufficient_context' else '' end) factors, coalesce(f.keywords, '') keywords from {BEST} b left join
        (select day, array_join(array_sort(collect_set(case when kind <> 'general' then concat(kind, '_', keyword) end)), ',') factors, array_join(array_sort(collect_set(keyword)), ',') keywords from {SAID} group by day) f on f.day = b.day"""),
    "agg65_trigger_scores": ("tk", f"select day, cause, score from {_CAUSES}"),
    "agg66_event_messages": ("m ev", f"""select day, message_id, sender, rank from (select e.day, b.message_id, b.sender, row_number() over (partition by e.day order by abs(b.compound) desc, b.message_id) rank from {{ev}} e join {{m}} b on b.day = e.day where not b.sys) where rank <= 5"""),
    "agg66_event_participants": ("m ev", f"select e.day, count(distinct b.sender) participants, count(*) messages from {{ev}} e join {{m}} b on b.day = e.day where not b.sys group by e.day"),
    "agg67_volatility": ("de ev tk", f"""select case when change > 2e-1 then 'volatility' else 'stability' end pattern, round(change, 6) mean_change, frequency, round(avg_intensity, 6) avg_intensity, round(hours, 6) typical_duration_hours, round(recovery_time, 6) recovery_time, common_triggers from
        (select avg(abs(v - prev)) change from (select v, lag(v) over (order by i) prev from {{de}}) where prev is not null),
        (select count(*) frequency, avg(abs(e.v)) avg_intensity, avg(24e0 * l.days) as hours, sum(case when r.recovery > 0 then cast(r.recovery as double) else 0e0 end) / count(*) recovery_time from {{ev}} e join {_LASTS} l on l.day = e.day join {_RECOVERY} r on r.day = e.day),
        (select max(case when rn = 1 then cause else '' end) || max(case when rn = 2 then concat(',', cause) else '' end) || max(case when rn = 3 then concat(',', cause) else '' end) common_triggers from (select cause, row_number() over (order by count(*) desc, cause) rn from {BEST} group by cause))"""),
    "agg68_trigger_patterns": ("de ev tk", f"""select a.cause, frequency, round(impact, 6) impact, round(recovery, 6) recovery, coalesce(keywords, '') keywords from (select b.cause, count(*) frequency, avg(abs(b.v)) impact, coalesce(avg(case when r.recovery > 0 then cast(r.recovery as double) end), 0e0) recovery from {BEST} b join {_RECOVERY} r on r.day = b.day group by b.cause) a
        left join (select cause, array_join(array_sort(collect_set(keyword)), ',') keywords from (select cause, keyword, row_number() over (partition by cause order by keyword) rn from (select distinct cause, keyword from {SAID})) where rn <= 10 group by cause) k on k.cause = a.cause"""),
    "agg68_trigger_times": ("m ev tk", f"""select cause, hour, dow, n, rank from (select *, row_number() over (partition by cause order by n desc, hour, dow) rank from (select b.cause, m.hour, m.dow, count(*) n from {BEST} b join {{ev}} e on e.day = b.day join {{m}} m on m.message_id = e.message_id group by b.cause, m.hour, m.dow)) where rank <= 5"""),
    "agg68_trigger_sensitivity": ("m ev tk", f"""select cause, sender, sensitivity, rank from (select *, row_number() over (partition by cause order by sensitivity desc, sender) rank from (select b.cause, s.sender, round(avg(s.contribution), 6) sensitivity from {BEST} b join {SHARES} s on s.day = b.day group by b.cause, s.sender)) where rank <= 10"""),
    "agg69_by_hour": ("m", "select h.hour, coalesce(n, 0) n, round(coalesce(v, 0), 6) v from (select explode(sequence(0, 23)) as hour) h left join (select hour, count(*) n, avg(compound) v from {m} where not sys and abs(compound) >= 1e-1 group by hour) a on a.hour = h.hour"),
    "agg69_hourly_events": ("m ev", "select h.hour, round(coalesce(v, 0), 6) avg_volatility, coalesce(peaks, 0) peaks, coalesce(valleys, 0) valleys from (select explode(sequence(0, 23)) as hour) h left join (select m.hour, avg(abs(e.v)) v, count(case when e.type = 'peak' then 1 end) peaks, count(case when e.type = 'valley' then 1 end) valleys from {ev} e join {m} m on m.message_id = e.message_id group by m.hour) a on a.hour = h.hour"),
    "agg69_by_day_of_week": ("m", "select d.dow, coalesce(n, 0) n, round(coalesce(v, 0), 6) v from (select explode(sequence(0, 6)) dow) d left join (select dow, count(*) n, avg(compound) v from {m} where not sys and abs(compound) >= 1e-1 group by dow) a on a.dow = d.dow"),
    "agg69_monthly_stability": ("de", f"select substr(day, 1, 7) as month, round(1 - least(var_pop(v), 1e0), 6) stability from {{de}} group by substr(day, 1, 7)"),
    "agg70_recovery_analysis": ("de ev", f"select type, round(avg(case when recovery >= 0 then cast(recovery as double) end), 6) avg_recovery, min(case when recovery >= 0 then recovery end) fastest, max(case when recovery >= 0 then recovery end) slowest, count(case when recovery < 0 then 1 end) never from {_RECOVERY} group by type"),
    "win12_moving_variance": ("de", f"select day, round(variance, 6) variance from {_WINDOWS} where n = 7"),
    "agg71_volatile_windows": ("de", f"""select kind, day from (select kind, day, row_number() over (partition by kind order by place, day) rn from (select 'most volatile' kind, day, -round(variance, 6) place, n from {_WINDOWS} union all
        select 'most stable', day, round(variance, 6), n from {_WINDOWS}) where n = 7) where rn = 1"""),
    "agg72_summary": ("de ev", f"select count(*) events, count(case when type = 'peak' then 1 end) n_peaks, count(case when type = 'valley' then 1 end) n_valleys, round(avg(abs(v)), 6) avg_intensity, round(avg(cast(recovery as double)), 6) avg_recovery_ref from {_RECOVERY}"),
}
