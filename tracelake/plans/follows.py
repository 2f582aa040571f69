"""Queries of the directly-follows family and the declarative patterns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.operators import correlation as X
from tracelake.operators import follows as G
from tracelake.operators import patterns as P
from tracelake.plans.logs_sql import EDGES, PAIRS, REVERSE, SEEN, TRACES, on
from tracelake.sources import logs

USER, DAY = logs.user_log, logs.day_log
#: A reference model's pairs for the footprint comparison.
MODEL = [("click", "view"), ("view", "purchase"), ("signup", "click"), ("view", "nothing")]


def _temporal(s, d):
    log = DAY(s, d)
    profile = G.temporal_profile(log).select("source", "target", "mean_ms", "stdev_ms", "n")
    return G.temporal_conformance(log, profile, 1.5)


def _profile(s, d):
    return G.temporal_profile(USER(s, d)).selectExpr("source", "target", "round(mean_ms, 2) as mean_ms", "round(stdev_ms, 1) as stdev_ms", "n")


def spans(s, d):
    """The day log's events as executions that last from the event before them in the case."""
    return logs.day_log(s, d).withColumn("start_ms", F.lag("ts_ms").over(Window.partitionBy("case_id").orderBy("event_idx")))


QUERIES = {
    "dfg": lambda s, d: G.dfg(USER(s, d)),
    "dfg_days": lambda s, d: G.dfg(DAY(s, d)),
    "performance_dfg": lambda s, d: G.performance_dfg(USER(s, d)),
    "eventually_follows": lambda s, d: G.eventually_follows(USER(s, d)),
    "footprints": lambda s, d: G.footprints(logs.conversation_log(s, d)),
    "causal_alpha": lambda s, d: G.causal_alpha(logs.conversation_log(s, d)),
    "causal_heuristic": lambda s, d: G.causal_heuristic(USER(s, d), 0.5),
    "dependencies": lambda s, d: G.dependencies(USER(s, d), 0.01),
    "transition_system": lambda s, d: G.transition_system(DAY(s, d), 1),
    "transition_system_back": lambda s, d: G.transition_system(DAY(s, d), 2, "backward"),
    "prefix_tree": lambda s, d: G.prefix_tree(DAY(s, d), 4),
    "performance_spectrum": lambda s, d: G.performance_spectrum(USER(s, d), "click"),
    "temporal_profile": _profile,
    "temporal_conformance": _temporal,
    "footprint_conformance": lambda s, d: G.footprint_conformance(DAY(s, d), s.createDataFrame(MODEL, "source string, target string")),
    "log_skeleton": lambda s, d: P.log_skeleton(logs.conversation_log(s, d)),
    "log_skeleton_noise": lambda s, d: P.log_skeleton(DAY(s, d), 0.7),
    "activity_frequencies": lambda s, d: P.activity_frequencies(DAY(s, d)),
    "declare": lambda s, d: P.declare(DAY(s, d)),
    "declare_thresholds": lambda s, d: P.declare(logs.conversation_log(s, d), 0.2, 0.8),
    "declare_reduced": lambda s, d: P.without_implied(P.declare(logs.conversation_log(s, d), 0.1, 0.3)),
    "activity_frequencies_noise": lambda s, d: P.activity_frequencies(DAY(s, d), 0.2),
    "batches": lambda s, d: P.batches(logs.day_log(s, d)),
    "batches_spans": lambda s, d: P.batches(spans(s, d), 60, start_ms="start_ms"),
    "correlation_durations": lambda s, d: X.correlation_durations(logs.day_log(s, d), 600),
    "correlation": lambda s, d: X.correlate(logs.day_log(s, d), 600),
    "prefix_nodes": lambda s, d: G.prefix_nodes(logs.user_log(s, d)),
    "sessions": lambda s, d: P.sessions(USER(s, d)),
    "stream_sessions": lambda s, d: P.stream_sessions(DAY(s, d), 240_000),
    "correlation_precedes": lambda s, d: P.precedes(DAY(s, d)),
}

_STATES = "states AS (SELECT case_id, event_idx, activity, array_to_string(list(activity) OVER (PARTITION BY case_id ORDER BY event_idx ROWS BETWEEN {frame}), ', ') AS target FROM log)"
_MOVES = "SELECT source, target, activity, count(*) AS n FROM (SELECT lag(target) OVER (PARTITION BY case_id ORDER BY event_idx) AS source, target, activity FROM states) WHERE source IS NOT NULL GROUP BY ALL"
_SKELETON = """SELECT relation, a, b FROM (
  SELECT a, b, unnest(list_filter([CASE WHEN equal >= events * {share} THEN 'equivalence' END, CASE WHEN aft >= cases * {share} THEN 'always_after' END,
    CASE WHEN bef >= cases * {share} THEN 'always_before' END, CASE WHEN coalesce(e.n, 0) >= events * {share} THEN 'directly_follows' END], lambda x: x IS NOT NULL)) AS relation
  FROM (SELECT x.activity AS a, y.activity AS b, sum(CASE WHEN x.n = y.n THEN x.n * y.n - CASE WHEN x.activity = y.activity THEN x.n ELSE 0 END ELSE 0 END) AS equal,
      count(*) FILTER (x.f < y.l) AS aft, count(*) FILTER (y.f < x.l) AS bef FROM seen x JOIN seen y USING (case_id) GROUP BY ALL)
  JOIN (SELECT activity AS a, count(*) AS cases, sum(n) AS events FROM seen GROUP BY 1) USING (a) LEFT JOIN edges e ON e.source = a AND e.target = b)
UNION ALL SELECT 'never_together', x.activity, y.activity FROM (SELECT DISTINCT activity FROM log) x JOIN (SELECT DISTINCT activity FROM log) y ON x.activity < y.activity
WHERE NOT EXISTS (SELECT 1 FROM seen p JOIN seen q USING (case_id) WHERE p.activity = x.activity AND q.activity = y.activity)"""
_DECLARE = """, total AS (SELECT count(DISTINCT case_id) AS t FROM log), nexts AS (SELECT case_id, source AS a, target AS b, count(*) AS nx FROM pairs WHERE source <> target GROUP BY ALL),
w AS (SELECT activity, count(*) AS c FROM seen GROUP BY 1),
marks AS (SELECT x.case_id, x.activity AS a, y.activity AS b, string_agg(CASE l.activity WHEN x.activity THEN 'A' WHEN y.activity THEN 'B' ELSE '-' END, '' ORDER BY l.event_idx) AS s
  FROM seen x JOIN seen y ON x.case_id = y.case_id AND x.activity <> y.activity JOIN log l ON l.case_id = x.case_id GROUP BY 1, 2, 3),
met AS (SELECT x.activity AS a, y.activity AS b, count(*) AS both_n, count(*) FILTER (x.l < y.f) AS resp, count(*) FILTER (x.f < y.f) AS prec,
  count(*) FILTER (nx = x.n) AS cr, count(*) FILTER (nx = y.n) AS cp, count(*) FILTER (NOT regexp_matches(s, 'A[^B]*A|A[^B]*$')) AS ar, count(*) FILTER (NOT regexp_matches(s, 'B[^A]*B|^[^A]*B')) AS ap
  FROM seen x JOIN seen y ON x.case_id = y.case_id AND x.activity <> y.activity
  LEFT JOIN nexts k ON k.case_id = x.case_id AND k.a = x.activity AND k.b = y.activity
  JOIN marks g ON g.case_id = x.case_id AND g.a = x.activity AND g.b = y.activity GROUP BY 1, 2),
m AS (SELECT met.*, wa.c AS wa, wb.c AS wb, t FROM met JOIN w wa ON wa.activity = a JOIN w wb ON wb.activity = b, total),
one AS (SELECT activity, count(*) AS c, count(*) FILTER (n = 1) AS once, any_value(s) AS s, any_value(t) AS t FROM seen LEFT JOIN (SELECT activity, count(*) AS s FROM log WHERE event_idx = 0 GROUP BY 1) USING (activity), total GROUP BY 1),
rules AS (SELECT 'existence' AS template, activity AS a, '' AS b, 1.0::DOUBLE AS support, c / t AS confidence FROM one
UNION ALL SELECT 'absence', activity, '', 1.0, (t - c) / t FROM one UNION ALL SELECT 'exactly_one', activity, '', 1.0, once / t FROM one UNION ALL SELECT 'init', activity, '', 1.0, coalesce(s, 0) / t FROM one
UNION ALL SELECT 'responded_existence', a, b, wa / t, both_n / wa FROM m UNION ALL SELECT 'response', a, b, wa / t, resp / wa FROM m UNION ALL SELECT 'precedence', a, b, wb / t, prec / wb FROM m
UNION ALL SELECT 'alternate_response', a, b, wa / t, ar / wa FROM m UNION ALL SELECT 'alternate_precedence', a, b, wb / t, ap / wb FROM m
UNION ALL SELECT 'alternate_succession', a, b, least(wa, wb) / t, least(ar / wa, ap / wb) FROM m UNION ALL SELECT 'chain_succession', a, b, least(wa, wb) / t, least(cr / wa, cp / wb) FROM m
UNION ALL SELECT 'non_coexistence', wa.activity, wb.activity, (wa.c + wb.c - coalesce(both_n, 0)) / t, 1 - coalesce(both_n, 0) / (wa.c + wb.c - coalesce(both_n, 0)) FROM w wa JOIN w wb ON wa.activity < wb.activity LEFT JOIN met ON met.a = wa.activity AND met.b = wb.activity, total
UNION ALL SELECT 'chain_response', a, b, wa / t, cr / wa FROM m UNION ALL SELECT 'chain_precedence', a, b, wb / t, cp / wb FROM m
UNION ALL SELECT 'succession', a, b, least(wa, wb) / t, least(resp / wa, prec / wb) FROM m UNION ALL SELECT 'coexistence', a, b, least(wa, wb) / t, least(both_n / wa, both_n / wb) FROM m)"""
_RULES = "SELECT template, a, b, round(support, 9) AS support, round(confidence, 9) AS confidence FROM rules"
_MODEL = "model AS (SELECT * FROM (VALUES " + ", ".join(map(str, MODEL)) + ") v(source, target))"
def _batches(start: str, gap: int) -> str:
    return f"""execs AS (SELECT activity, case_id, event_idx, {start} // 1000 AS s, ts_ms // 1000 AS e FROM log),
swept AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY activity ORDER BY s, e, case_id, event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS new FROM execs),
islands AS (SELECT *, sum(new) OVER (PARTITION BY activity ORDER BY s, e, case_id, event_idx ROWS UNBOUNDED PRECEDING) AS island FROM swept),
found AS (SELECT activity, island, min(s) AS start_s, max(e) AS end_s, count(DISTINCT case_id) AS cases, count(*) AS events FROM islands GROUP BY ALL HAVING count(DISTINCT case_id) >= 2),
held AS (SELECT m.activity, m.island, x.s, x.e, lag(x.e) OVER (PARTITION BY m.activity, m.island ORDER BY x.s, x.e, x.case_id, x.event_idx) AS previous
  FROM (SELECT DISTINCT activity, island, case_id FROM islands) m JOIN execs x USING (activity, case_id)),
kinds AS (SELECT activity, island, min(s) = max(s) AS one_start, min(e) = max(e) AS one_end, bool_and(coalesce(previous = s, true)) AS chained FROM held GROUP BY ALL)"""


_BATCH = """SELECT activity, start_s, end_s, cases, events, CASE WHEN one_start AND one_end THEN 'parallel' WHEN one_start OR one_end THEN 'concurrent' WHEN chained THEN 'sequential' WHEN cases >= 5 THEN 'disruptive' ELSE 'concurrent' END AS kind
FROM found JOIN kinds USING (activity, island)"""
#: Matches in order of time, and in the order turned round (sign -1): the k-th event takes the one numbered k + the running maximum of (events not later, less k).
_MET = """, signs(sign) AS (VALUES (1), (-1)),
times AS (SELECT sign, activity, s, row_number() OVER (PARTITION BY sign, activity ORDER BY s) - 1 AS k FROM (SELECT sign, activity, sign * (ts_ms // 1000) AS s FROM log, signs)),
sizes AS (SELECT activity, count(*) AS n FROM log GROUP BY 1),
later AS (SELECT a.sign, a.activity AS first, b.activity AS second, b.n, a.s, a.k, coalesce((SELECT max(t.k) + 1 FROM times t WHERE t.sign = a.sign AND t.activity = b.activity AND t.s <= a.s), 0) AS m FROM times a, sizes b WHERE a.activity <> b.activity),
taken AS (SELECT *, k + max(m - k) OVER (PARTITION BY sign, first, second ORDER BY k) AS place FROM later),
met AS (SELECT x.sign, first, second, t.s - x.s AS gap FROM taken x JOIN times t ON t.sign = x.sign AND t.activity = second AND t.k = place WHERE place < n AND t.s - x.s <= 600)
"""
_DURATIONS = """SELECT CASE WHEN sign = 1 THEN first ELSE second END AS source, CASE WHEN sign = 1 THEN second ELSE first END AS target, count(*) FILTER (sign = 1) AS fifo, CAST(coalesce(sum(gap) FILTER (sign = 1), 0) AS BIGINT) AS fifo_s, count(*) FILTER (sign = -1) AS lifo, CAST(coalesce(sum(gap) FILTER (sign = -1), 0) AS BIGINT) AS lifo_s
FROM met GROUP BY 1, 2"""
#: The edges, cheapest first: each takes what both ends have left, kept in lists (o out of, t into the activities).
_GREEDY = f""", durations AS ({_DURATIONS}),
acts AS (SELECT activity, row_number() OVER (ORDER BY activity) AS i, count(*) AS n, max(ts_ms // 1000) AS last FROM log GROUP BY 1),
share AS (SELECT a.activity AS a, b.activity AS b, a.i, b.i AS j, least(a.n, b.n) AS least_n, (SELECT count(*) FROM log l WHERE l.activity = a.activity AND l.ts_ms // 1000 < b.last) / (a.n * b.n) AS p FROM acts a, acts b WHERE a.activity <> b.activity),
took AS (SELECT source, target, least(coalesce(fifo_s / nullif(fifo, 0), 0.0::DOUBLE), coalesce(lifo_s / nullif(lifo, 0), 0.0::DOUBLE)) AS mean FROM durations),
ranked AS (SELECT s.*, r.p AS back, row_number() OVER (ORDER BY coalesce(mean, 0.0::DOUBLE) / s.p / s.least_n, s.a, s.b) AS k FROM share s JOIN share r ON r.a = s.b AND r.b = s.a LEFT JOIN took ON source = s.a AND target = s.b WHERE s.p > 0),
greedy AS (SELECT CAST(0 AS BIGINT) AS k, list(n ORDER BY i) AS o, list(n ORDER BY i) AS t, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(0 AS BIGINT) AS m FROM acts
  UNION ALL SELECT k, list_transform(range(1, len(o) + 1), lambda x: CASE WHEN x = i THEN o[x] - m ELSE o[x] END), list_transform(range(1, len(t) + 1), lambda x: CASE WHEN x = j THEN t[x] - m ELSE t[x] END), a, b, m
  FROM (SELECT r.k, g.o, g.t, r.a, r.b, r.i, r.j, CASE WHEN r.back < 0.8::DOUBLE * r.p THEN least(g.o[r.i], g.t[r.j]) ELSE 0 END AS m FROM greedy g JOIN ranked r ON r.k = g.k + 1)),
edge AS (SELECT a, b, m FROM greedy WHERE m > 0)
SELECT 'edge' AS kind, a AS source, b AS target, m AS n FROM edge UNION ALL SELECT 'start', activity, NULL, n FROM acts WHERE activity NOT IN (SELECT b FROM edge) UNION ALL SELECT 'end', activity, NULL, n FROM acts WHERE activity NOT IN (SELECT a FROM edge)
UNION ALL SELECT 'traces', NULL, NULL, 1 + count(*) FILTER (gap > 600) FROM (SELECT ts_ms // 1000 - lag(ts_ms // 1000) OVER (ORDER BY ts_ms) AS gap FROM log)"""
_BITS = "CAST(('0x' || substr(md5(event_idx || ':' || activity), {}, 10)) AS BIGINT)"
_NODES = f""", bits AS (SELECT *, {_BITS.format(1)} AS own_a, {_BITS.format(11)} AS own_b FROM log),
sums AS (SELECT event_idx, activity, own_a, own_b, sum(own_a) OVER w AS a, sum(own_b) OVER w AS b, lead(activity) OVER w IS NULL AS last FROM bits WINDOW w AS (PARTITION BY case_id ORDER BY event_idx))
SELECT concat_ws('-', event_idx + 1, a, b) AS node, CASE WHEN event_idx > 0 THEN concat_ws('-', event_idx, a - own_a, b - own_b) END AS parent, CAST(event_idx + 1 AS BIGINT) AS depth, activity AS label, count(*) AS n, count(*) FILTER (last) AS final
FROM sums GROUP BY ALL"""

ORACLES = {
    "dfg": on("user", "SELECT * FROM edges", EDGES),
    "dfg_days": on("day", "SELECT * FROM edges", EDGES),
    "performance_dfg": on("user", "SELECT source, target, count(*) AS n, coalesce(round(avg(gap_ms), 3), 0.0) AS avg_ms, coalesce(min(gap_ms), 0) AS min_ms, coalesce(max(gap_ms), 0) AS max_ms FROM pairs GROUP BY ALL", PAIRS),
    "eventually_follows": on("user", "SELECT x.activity AS source, y.activity AS target, count(*) AS n FROM log x JOIN log y ON x.case_id = y.case_id AND x.event_idx < y.event_idx GROUP BY ALL"),
    "footprints": on("conversation", "SELECT CASE WHEN back > 0 THEN 'parallel' ELSE 'sequence' END AS relation, source, target FROM both_ways", REVERSE),
    "causal_alpha": on("conversation", "SELECT source, target FROM both_ways WHERE back = 0", REVERSE),
    "causal_heuristic": on("user", "SELECT source, target, CAST(floor(n / (n + back) * 1000) AS BIGINT) AS strength FROM both_ways WHERE n / (n + back) >= 0.5", REVERSE),
    "dependencies": on("user", "SELECT source, target, round((n - back) / (n + back + 1), 9) AS dependency, n FROM both_ways WHERE (n - back) / (n + back + 1) >= 0.01", REVERSE),
    "transition_system": on("day", _MOVES, _STATES.format(frame="1 PRECEDING AND CURRENT ROW")),
    "transition_system_back": on("day", _MOVES, _STATES.format(frame="CURRENT ROW AND 2 FOLLOWING")),
    "prefix_tree": on("day", "SELECT array_to_string(acts[1:k], '>') AS prefix, array_to_string(acts[1:k-1], '>') AS parent, acts[k] AS label, k AS depth, bool_or(k = least(n, 4)) AS final FROM (SELECT acts, n, unnest(generate_series(1, least(n, 4))) AS k FROM traces) GROUP BY 1, 2, 3, 4", TRACES),
    "performance_spectrum": on("user", "SELECT target AS next, count(*) AS n, min(gap_ms) AS min_ms, max(gap_ms) AS max_ms, round(avg(gap_ms), 3) AS mean_ms, CAST(median(gap_ms) AS DOUBLE) AS median_ms FROM pairs WHERE source = 'click' AND gap_ms IS NOT NULL GROUP BY 1", PAIRS),
    "temporal_profile": on("user", "SELECT source, target, round(avg(gap_ms), 2) AS mean_ms, round(stddev_pop(gap_ms), 1) AS stdev_ms, count(*) AS n FROM pairs WHERE gap_ms > 0 GROUP BY ALL", PAIRS),
    "temporal_conformance": on("day", "SELECT case_id, coalesce(steps, 0) AS steps, coalesce(dev, 0) AS deviations, CASE WHEN steps > 0 THEN round(1 - dev / steps, 9) ELSE 1.0 END AS fitness FROM (SELECT DISTINCT case_id FROM log) LEFT JOIN (SELECT case_id, count(*) AS steps, count(*) FILTER (CASE WHEN sd > 0 THEN abs(gap_ms - m) / sd ELSE 0 END > 1.5) AS dev FROM pairs JOIN (SELECT source, target, avg(gap_ms) AS m, stddev_pop(gap_ms) AS sd FROM pairs WHERE gap_ms > 0 GROUP BY ALL) USING (source, target) WHERE gap_ms > 0 GROUP BY 1) USING (case_id)", PAIRS),
    "footprint_conformance": on("day", "SELECT round(b / l, 9) AS fitness, round(b / l, 9) AS recall, round(b / m, 9) AS precision, round(CASE WHEN b > 0 THEN 2 * (b / l) * (b / m) / (b / l + b / m) ELSE 0 END, 9) AS f1 FROM (SELECT (SELECT count(*) FROM edges) AS l, (SELECT count(*) FROM model) AS m, (SELECT count(*) FROM edges JOIN model USING (source, target)) AS b)", EDGES, _MODEL),
    "log_skeleton": on("conversation", _SKELETON.format(share=1), EDGES, SEEN),
    "log_skeleton_noise": on("day", _SKELETON.format(share="(1 - 0.7::DOUBLE)"), EDGES, SEEN),
    "activity_frequencies": on("day", "SELECT activity, n, count(*) AS cases FROM (SELECT a.activity, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT activity FROM log) a CROSS JOIN (SELECT DISTINCT case_id FROM log) c LEFT JOIN seen s ON s.case_id = c.case_id AND s.activity = a.activity) GROUP BY ALL", SEEN),
    "declare": on("day", _RULES, PAIRS, SEEN + _DECLARE),
    "declare_thresholds": on("conversation", _RULES + " WHERE support >= 0.2 AND confidence >= 0.8", PAIRS, SEEN + _DECLARE),
    "declare_reduced": on("conversation", "SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.a = k.a AND o.b = k.b AND o.template = CASE WHEN k.template = 'existence' THEN 'absence' WHEN k.template IN ('response', 'precedence') THEN 'succession' WHEN k.template IN ('alternate_response', 'alternate_precedence') THEN 'alternate_succession' WHEN k.template IN ('chain_response', 'chain_precedence') THEN 'chain_succession' END)", PAIRS, SEEN + _DECLARE + f", kept AS ({_RULES} WHERE support >= 0.1 AND confidence >= 0.3)"),
    "activity_frequencies_noise": on("day", "SELECT activity, n, cases FROM (SELECT *, sum(cases) OVER (PARTITION BY activity ORDER BY cases DESC, n ROWS UNBOUNDED PRECEDING) - cases AS before, sum(cases) OVER (PARTITION BY activity) AS total FROM (SELECT activity, n, count(*) AS cases FROM (SELECT a.activity, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT activity FROM log) a CROSS JOIN (SELECT DISTINCT case_id FROM log) c LEFT JOIN seen s ON s.case_id = c.case_id AND s.activity = a.activity) GROUP BY ALL)) WHERE before < (1 - 0.2::DOUBLE) * total", SEEN),
    "batches": on("day", _BATCH, _batches("ts_ms", 900)),
    "batches_spans": on("day", _BATCH, _batches("coalesce(lag(ts_ms) OVER (PARTITION BY case_id ORDER BY event_idx), ts_ms)", 60)),
    "correlation": on("day", _MET + _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1),
    "correlation_durations": on("day", _MET + _DURATIONS),
    "prefix_nodes": on("user", _NODES),
    "sessions": on("user", "SELECT case_id, count(*) FILTER (g > 3600000) + 1 AS sessions FROM (SELECT case_id, ts_ms - lag(ts_ms) OVER (PARTITION BY case_id ORDER BY event_idx) AS g FROM log) GROUP BY 1"),
    "stream_sessions": on("day", "SELECT count(*) FILTER (g > 240000) + 1 AS sessions FROM (SELECT ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms) AS g FROM log)"),
    "correlation_precedes": on("day", "SELECT x.activity AS source, y.activity AS target, round(count(*) / (any_value(x.n) * any_value(y.n)), 12) AS share FROM (SELECT activity, ts_ms, count(*) OVER (PARTITION BY activity) AS n FROM log) x JOIN (SELECT activity, max(ts_ms) AS m, count(*) AS n FROM log GROUP BY 1) y ON x.ts_ms < y.m GROUP BY 1, 2"),
}
