"""Queries of the statistics, with their SQL."""

from __future__ import annotations

from tracelake.operators import statistics as S
from tracelake.plans.logs_sql import SPANS, TRACES, on
from tracelake.sources import logs

DAY = logs.day_log
QUERIES = {
    "start_activities": lambda s, d: S.start_activities(DAY(s, d)),
    "end_activities": lambda s, d: S.end_activities(DAY(s, d)),
    "variants": lambda s, d: S.variant_counts(logs.conversation_log(s, d)),
    "variants_as_tuples": lambda s, d: S.variant_counts(DAY(s, d)).drop("percentage"),
    "variants_top": lambda s, d: S.top_variants(DAY(s, d), 10),
    "variant_durations": lambda s, d: S.variant_durations(DAY(s, d)),
    "event_attributes": lambda s, d: S.event_attributes(DAY(s, d)),
    "case_attributes": lambda s, d: S.case_attributes(DAY(s, d)),
    "attribute_values": lambda s, d: S.attribute_values(DAY(s, d), "props"),
    "activity_values": lambda s, d: S.attribute_values(DAY(s, d), "concept:name"),
    "case_id_values": lambda s, d: DAY(s, d).groupBy("case_id").count().selectExpr("case_id as value", "1L as n"),
    "case_durations": lambda s, d: S.case_durations(DAY(s, d)),
    "rework_times": lambda s, d: S.rework_times(DAY(s, d)),
    "minimum_self_distances": lambda s, d: S.minimum_self_distances(DAY(s, d)),
    "rework_per_activity": lambda s, d: S.rework_per_activity(DAY(s, d)),
    "rework_cases_strict": lambda s, d: S.rework_per_activity(DAY(s, d), strict=True),
    "case_overlap": lambda s, d: S.case_overlap(DAY(s, d)),
    "prefixes": lambda s, d: S.prefixes(DAY(s, d)),
    "performance_stats": lambda s, d: S.performance_stats(DAY(s, d)),
    "case_arrival": lambda s, d: S.case_arrival(logs.order_log(s, d)),
    "case_arrival_strict": lambda s, d: S.case_arrival(logs.order_log(s, d), strict=True),
    "log_stats": lambda s, d: S.log_stats(DAY(s, d)),
    "activities": lambda s, d: S.activities(DAY(s, d)),
}

_DURATIONS = SPANS + ", durations AS (SELECT case_id, last_ms - first_ms AS d FROM spans WHERE n >= 2 AND first_ms >= 0 AND last_ms >= 0)"
_ARRIVAL = "SELECT CASE WHEN count({v}) >= 2 AND max({v}) > min({v}) THEN round(count(*) / ((max({v}) - min({v})) / 3600000.0), 6) ELSE 0.0 END AS rate FROM spans"
ORACLES = {
    "start_activities": on("day", "SELECT activity, count(*) AS n FROM log WHERE event_idx = 0 GROUP BY 1"),
    "end_activities": on("day", "SELECT activity, count(*) AS n FROM (SELECT arg_max(activity, event_idx) AS activity FROM log GROUP BY case_id) GROUP BY 1"),
    "variants": on("conversation", "SELECT variant, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percentage FROM traces GROUP BY 1", TRACES),
    "variants_as_tuples": on("day", "SELECT variant, count(*) AS n FROM traces GROUP BY 1", TRACES),
    "variants_top": on("day", "SELECT variant, count(*) AS n, (100.0 * count(*) / (SELECT count(*) FROM traces)) / 100 AS frequency FROM traces GROUP BY 1 ORDER BY n DESC, variant LIMIT 10", TRACES),
    "variant_durations": on("day", "SELECT variant, count(*) AS n, CAST(coalesce(sum(d), 0) AS BIGINT) AS total_ms, coalesce(round(avg(d), 3), 0.0) AS avg_ms, coalesce(min(d), 0) AS min_ms, coalesce(max(d), 0) AS max_ms FROM (SELECT variant, CASE WHEN last_ms > first_ms THEN last_ms - first_ms END AS d FROM traces JOIN spans USING (case_id)) GROUP BY 1", TRACES, SPANS),
    "event_attributes": on("day", "SELECT 'value' AS attribute, count(value) AS occurrences, count(DISTINCT value) AS distinct_values FROM log UNION ALL SELECT 'props', count(props), count(DISTINCT props) FROM log"),
    "case_attributes": on("day", "SELECT 'case_id' AS attribute, count(*) AS occurrences, count(*) AS distinct_values FROM traces UNION ALL SELECT 'event_count', count(*), count(DISTINCT n) FROM traces", TRACES),
    "attribute_values": on("day", "SELECT props AS value, count(*) AS n FROM log WHERE props IS NOT NULL GROUP BY 1"),
    "activity_values": on("day", "SELECT activity AS value, count(*) AS n FROM log GROUP BY 1"),
    "case_id_values": on("day", "SELECT DISTINCT case_id AS value, CAST(1 AS BIGINT) AS n FROM log"),
    "case_durations": on("day", "SELECT case_id, d AS duration_ms FROM durations", _DURATIONS),
    "rework_times": on("day", "SELECT * FROM (SELECT case_id, activity, ts_ms - lag(ts_ms) OVER (PARTITION BY case_id, activity ORDER BY event_idx) AS gap_ms FROM log) WHERE gap_ms > 0"),
    "minimum_self_distances": on("day", "SELECT activity, min(g) AS min_ms FROM (SELECT activity, lead(activity) OVER w AS next, lead(ts_ms) OVER w - ts_ms AS g FROM log WINDOW w AS (PARTITION BY case_id ORDER BY event_idx)) WHERE activity = next AND g > 0 GROUP BY 1"),
    "rework_per_activity": on("day", "SELECT activity, count(*) - count(DISTINCT case_id) AS rework, count(*) AS total FROM log GROUP BY 1"),
    "rework_cases_strict": on("day", "SELECT activity, count(*) FILTER (n > 1) AS rework, count(*) AS total FROM (SELECT activity, case_id, count(*) AS n FROM log GROUP BY ALL) GROUP BY 1"),
    "case_overlap": on("day", "SELECT round(sum(pow(c / (SELECT count(*) FROM traces), 2)), 9) AS overlap FROM (SELECT acts[1:(SELECT min(n) FROM traces)] AS head, count(*) AS c FROM traces GROUP BY 1)", TRACES),
    "prefixes": on("day", "SELECT array_to_string(acts[1:k], '>') AS prefix, count(*) AS n FROM (SELECT acts, unnest(generate_series(1, n)) AS k FROM traces) GROUP BY 1", TRACES),
    "performance_stats": on("day", "SELECT (SELECT count(*) FROM spans) AS cases, (SELECT count(*) FROM log) AS events, round(avg(d), 3) AS avg_ms, min(d) AS min_ms, max(d) AS max_ms, CAST(median(d) AS DOUBLE) AS median_ms, (SELECT max(n) FROM spans) AS max_events, (SELECT round(avg(n), 6) FROM spans) AS events_per_case FROM durations", _DURATIONS),
    "case_arrival": on("order", _ARRIVAL.format(v="CASE WHEN n >= 2 THEN last_ms - first_ms END"), SPANS),
    "case_arrival_strict": on("order", _ARRIVAL.format(v="first_ms"), SPANS),
    "log_stats": on("day", "SELECT count(*) AS traces, CAST(sum(n) AS BIGINT) AS events, count(DISTINCT variant) AS variants, round(avg(n), 6) AS avg_len, min(n) AS min_len, max(n) AS max_len, (SELECT count(DISTINCT activity) FROM log) AS activities FROM traces", TRACES),
    "activities": on("day", "SELECT DISTINCT activity FROM log"),
}
