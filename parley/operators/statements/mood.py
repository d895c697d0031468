"""Sentiment timelines, mood and emotions (AGG-19, AGG-35 to AGG-47, WIN-13 to WIN-15)."""

# Scores have four digits.  They are summed as whole numbers, a day's mood is held in whole billionths, and means are
# one division, so that no bound, sign or tie in rounding depends on the order of addition.
UNITS = "cast(round(compound * 10000) as bigint)"
#: The mean score of a group.
MEAN = f"(sum({UNITS}) / (1e4 * nullif(count(compound), 0)))"


def six(x: str) -> str:
    """x to six digits, half up."""
    return f"(floor(({x}) * 1000000 + 5e-1) / 1000000)"


_DAILY = f"(select sender, day, conversation_id, {MEAN} v, sum({UNITS}) total, count(compound) scored, count(*) n from {{m}} where not sys group by sender, day, conversation_id having count(*) >= 3)"
#: A sender's day over all conversations, weighted by messages, also as whole billionths.
_MOOD = f"(select *, cast(floor(v * 1000000000 + 5e-1) as bigint) nano from (select sender, day, sum(total) total, sum(total) / (1e4 * nullif(sum(scored), 0)) v, sum(n) n from {_DAILY} group by sender, day))"
_mean = lambda part: f"(sum({part}) / (1e9 * nullif(count({part}), 0)))"
_CHANGE = f"{_mean('case when rn > h then nano end')} - {_mean('case when rn <= h then nano end')}"
_SPREAD = "sqrt(greatest(0e0, count(nano) * cast(sum(cast(nano * nano as decimal(38, 0))) as double) - cast(sum(nano) as double) * cast(sum(nano) as double))) / (1e9 * nullif(count(nano), 0))"

STATEMENTS = {
    "agg19_sentiment_by_sender": ("m", "select sender, conversation_id, floor(avg(compound) * 1000 + 50001e-5) / 1000 avg_sentiment, floor(avg(pos) * 1000 + 50001e-5) / 1000 avg_positive, floor(avg(neg) * 1000 + 50001e-5) / 1000 avg_negative, floor(avg(neu) * 1000 + 50001e-5) / 1000 avg_neutral, count(*) n from {m} group by sender, conversation_id having count(*) >= 10"),
    "agg35_timeline_averages": ("m", f"select day, round(avg(compound), 6) avg_compound, round(avg(pos), 6) avg_positive, round(avg(neg), 6) avg_negative, round(avg(neu), 6) avg_neutral, count(*) n, case when {MEAN} > 1e-1 then 'positive' when {MEAN} < -1e-1 then 'negative' else 'neutral' end label from {{m}} where not sys group by day"),
    "agg36_sender_timelines": ("m", """select sender, day, round(avg(compound), 6) avg_compound, round(avg(pos), 6) avg_positive, round(avg(neg), 6) avg_negative, round(avg(neu), 6) avg_neutral, count(*) n from {m} where not sys
        and sender in (select sender from {m} where not sys group by sender order by count(*) desc, sender limit 10) group by sender, day"""),
    "agg38_daily_sums": ("m", "select conversation_id, day, round(sum(compound), 6) compound_sum, round(sum(pos), 6) positive_sum, round(sum(neg), 6) negative_sum, round(sum(neu), 6) neutral_sum, count(*) n from {m} where not sys group by conversation_id, day"),
    "agg39_daily_sums_by_sender": ("m", "select sender, conversation_id, day, round(sum(compound), 6) compound_sum, round(sum(pos), 6) positive_sum, round(sum(neg), 6) negative_sum, round(sum(neu), 6) neutral_sum, count(*) n from {m} where not sys group by sender, conversation_id, day"),
    "agg40_timeline_summary": ("m", f"select min(day) first_day, max(day) last_day, round(avg(v), 6) mean_of_days, max_by(day, v) best_day, min_by(day, v) worst_day from (select day, {MEAN} v from {{m}} where not sys group by day)"),
    "agg41_mood_daily": ("m", f"select sender, day, conversation_id, {six('v')} avg_compound, n from {_DAILY}"),
    "agg43_mood_patterns": ("m", f"""select sender, {six(_mean('nano'))} mean, {six(_SPREAD)} variability, case when {_mean('nano')} > 5e-2 then 'positive' when {_mean('nano')} < -5e-2 then 'negative' else 'neutral' end dominant,
        case when {_CHANGE} > 5e-2 then 'improving' when {_CHANGE} < -5e-2 then 'declining' else 'stable' end trend from
        (select sender, nano, row_number() over (partition by sender order by day) rn, floor(count(*) over (partition by sender) / 2) h, count(*) over (partition by sender) points from {_MOOD}) where points >= 5 group by sender"""),
    "agg44_mood_series": ("m", f"select day, sender, {six('v')} v from {_MOOD} where day in (select day from {_MOOD} group by day order by day desc limit 365)"),
    "win13_streaks": ("m", f"""select sender, max(case when sign_of = 1 then n else 0 end) positive_streak, max(case when sign_of = -1 then n else 0 end) negative_streak from (select sender, sign_of, island, count(*) n from
        (select sender, sign_of, rn - row_number() over (partition by sender, sign_of order by day) island from (select sender, day, case when total > 0 then 1 when total < 0 then -1 else 0 end sign_of, row_number() over (partition by sender order by day) rn from {_MOOD})) group by sender, sign_of, island) group by sender"""),
    "win14_half_trend": ("m", f"select sender, {six(_CHANGE)} change from (select sender, nano, row_number() over (partition by sender order by day) rn, floor(count(*) over (partition by sender) / 2) h from {_MOOD}) group by sender"),
    "win15_month_trend": ("m", """select conversation_id, month, cast(n as bigint) n, case when prev is null then 'stable' when n > prev * 11e-1 then 'increasing' when n < prev * 9e-1 then 'decreasing' else 'stable' end trend, case when i >= 3 then round(greatest(0e0, least(100e0, (1 - sd / mean3) * 100)), 6) else 0e0 end consistency from
        (select conversation_id, month, n, lag(n) over (partition by conversation_id order by month) prev, row_number() over (partition by conversation_id order by month) i, stddev_pop(n) over (partition by conversation_id order by month rows between 2 preceding and current row) sd, avg(n) over (partition by conversation_id order by month rows between 2 preceding and current row) mean3
        from (select conversation_id, month, cast(count(*) as double) n from {m} group by conversation_id, month))"""),
    "win15_half_trends": ("m", """select conversation_id, case when later - earlier > 15e-2 * earlier and earlier > 0 then 'increasing' when later - earlier < -15e-2 * earlier and earlier > 0 then 'decreasing' else 'stable' end trend from (select conversation_id, coalesce(avg(case when i <= floor(months / 2e0) then n end), 0e0) earlier, coalesce(avg(case when i > floor(months / 2e0) then n end), 0e0) later from
        (select *, row_number() over (partition by conversation_id order by month) i, count(*) over (partition by conversation_id) as months from (select conversation_id, month, cast(count(*) as double) n from {m} group by conversation_id, month)) group by conversation_id)"""),
    # the same rule on weeks, since the events cover a month
    "win15_week_trend": ("m", """select conversation_id, wk, cast(n as bigint) n, case when prev is null then 'stable' when n > prev * 11e-1 then 'increasing' when n < prev * 9e-1 then 'decreasing' else 'stable' end trend, case when i >= 3 then round(greatest(0e0, least(100e0, (1 - sd / mean3) * 100)), 6) else 0e0 end consistency from
        (select conversation_id, wk, n, lag(n) over (partition by conversation_id order by wk) prev, row_number() over (partition by conversation_id order by wk) i, stddev_pop(n) over (partition by conversation_id order by wk rows between 2 preceding and current row) sd, avg(n) over (partition by conversation_id order by wk rows between 2 preceding and current row) mean3
        from (select conversation_id, cast(floor(timestamp_ms / 604800000) as bigint) wk, cast(count(*) as double) n from {m} group by conversation_id, cast(floor(timestamp_ms / 604800000) as bigint)))"""),
    "agg46_emotion_totals": ("e", "select emotion, round(total, 4) total, round(100 * total / (joy + sadness + anger + fear + surprise), 4) percentage from (select emotion, case emotion when 'joy' then joy when 'sadness' then sadness when 'anger' then anger when 'fear' then fear else surprise end total, joy, sadness, anger, fear, surprise from (select sum(joy) joy, sum(sadness) sadness, sum(anger) anger, sum(fear) fear, sum(surprise) surprise from {e}), (select 'joy' emotion union all select 'sadness' union all select 'anger' union all select 'fear' union all select 'surprise'))"),
    "agg47_emotion_profile": ("e", "select sender, round(sum(joy), 4) joy, round(sum(sadness), 4) sadness, round(sum(anger), 4) anger, round(sum(fear), 4) fear, round(sum(surprise), 4) surprise, count(*) n from {e} group by sender"),
}
