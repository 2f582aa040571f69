"""Queries of the filters, with their SQL; results are (case_id, event_idx, activity)."""

from __future__ import annotations

from tracelake.operators import filters as R
from tracelake.plans.logs_sql import TRACES, on
from tracelake.sources import logs

START_MS, END_MS = 1_704_153_600_000, 1_704_240_000_000  # 2024-01-02, one day


def _on_day(keep):
    return lambda s, d: keep(logs.day_log(s, d)).select("case_id", "event_idx", "activity")


QUERIES = {
    "filter_start_activities": _on_day(lambda x: R.start_activities(x, ["click", "view"])),
    "filter_end_activities": _on_day(lambda x: R.end_activities(x, ["click"])),
    "filter_between": _on_day(lambda x: R.between(x, "click", "view")),
    "filter_trim": _on_day(lambda x: R.trim(x, "click", "view")),
    "filter_prefix": _on_day(lambda x: R.prefix(x, ["click", "view"])),
    "filter_suffix": _on_day(lambda x: R.suffix(x, ["click", "view"])),
    "filter_directly_follows": _on_day(lambda x: R.directly_follows(x, "click", "view")),
    "filter_eventually_follows": _on_day(lambda x: R.eventually_follows(x, "click", "view")),
    "filter_case_size": _on_day(lambda x: R.case_size(x, 2, 3)),
    "filter_time_range": _on_day(lambda x: R.time_range(x, START_MS, END_MS)),
    "filter_time_range_iso": _on_day(lambda x: R.time_range(x, "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z")),
    "filter_time_range_events": _on_day(lambda x: R.time_range(x, START_MS, END_MS, grain="event")),
    "filter_variants_top_k": _on_day(lambda x: R.top_variants(x, 7)),
    "filter_variants_coverage": _on_day(lambda x: R.variant_coverage(x, 0.5)),
    "filter_event_attribute": _on_day(lambda x: R.event_attribute(x, "props", ['{"k": 1}', '{"k": 2}'])),
    "filter_event_attribute_out": _on_day(lambda x: R.event_attribute(x, "concept:name", ["error"], positive=False)),
    "filter_case_ids": _on_day(lambda x: R.case_ids(x, ["8-2024-01-01", "16-2024-01-01"])),
    "filter_contains": _on_day(lambda x: R.contains(x, "purchase")),
    "truncate_traces": _on_day(lambda x: R.truncate(x, 2)),
    "project_attributes": lambda s, d: R.project(logs.day_log(s, d), ["props"]).selectExpr("case_id", "event_idx", "activity", "attributes['props'] as props", "attributes['value'] as value"),
    "sort_log": _on_day(R.sort_by_time),
    "relabel": _on_day(lambda x: R.relabel(x, {"click": "press"})),
    "sample_cases": _on_day(lambda x: R.sample_cases(x, 100)),
}

_ENDS = "ends AS (SELECT case_id, min(event_idx) FILTER (activity = 'click') AS f, max(event_idx) FILTER (activity = 'view') AS l, arg_min(activity, event_idx) AS a, arg_max(activity, event_idx) AS z, count(*) AS n FROM log GROUP BY 1)"


def _cases(condition: str, *tables: str) -> str:
    return on("day", f"SELECT case_id, event_idx, activity FROM log WHERE case_id IN ({condition})", *tables)


_RANKED = TRACES + ", ranked AS (SELECT acts, c, row_number() OVER w AS place, sum(c) OVER w - c AS before, sum(c) OVER () AS total FROM (SELECT acts, count(*) AS c FROM traces GROUP BY 1) WINDOW w AS (ORDER BY c DESC, acts ROWS UNBOUNDED PRECEDING))"
ORACLES = {
    "filter_start_activities": _cases("SELECT case_id FROM ends WHERE a IN ('click', 'view')", _ENDS),
    "filter_end_activities": _cases("SELECT case_id FROM ends WHERE z = 'click'", _ENDS),
    "filter_between": on("day", "SELECT case_id, event_idx, activity FROM log JOIN ends USING (case_id) WHERE f <= l AND event_idx BETWEEN f AND l", _ENDS),
    "filter_trim": on("day", "SELECT case_id, event_idx, activity FROM log JOIN ends USING (case_id) WHERE f > l OR event_idx BETWEEN f AND l", _ENDS),
    "filter_prefix": _cases("SELECT case_id FROM traces WHERE acts[1:2] = ['click', 'view']", TRACES),
    "filter_suffix": _cases("SELECT case_id FROM traces WHERE n >= 2 AND acts[n-1:n] = ['click', 'view']", TRACES),
    "filter_directly_follows": _cases("SELECT case_id FROM traces WHERE '>' || variant || '>' LIKE '%>click>view>%'", TRACES),
    "filter_eventually_follows": _cases("SELECT case_id FROM ends WHERE f <= l", _ENDS),
    "filter_case_size": _cases("SELECT case_id FROM ends WHERE n BETWEEN 2 AND 3", _ENDS),
    "filter_time_range": _cases(f"SELECT case_id FROM log WHERE ts_ms BETWEEN {START_MS} AND {END_MS}"),
    "filter_time_range_iso": _cases(f"SELECT case_id FROM log WHERE ts_ms BETWEEN {START_MS} AND {END_MS}"),
    "filter_time_range_events": on("day", f"SELECT case_id, event_idx, activity FROM log WHERE ts_ms BETWEEN {START_MS} AND {END_MS}"),
    "filter_variants_top_k": _cases("SELECT case_id FROM traces JOIN ranked USING (acts) WHERE place <= 7", _RANKED),
    "filter_variants_coverage": _cases("SELECT case_id FROM traces JOIN ranked USING (acts) WHERE before < 0.5 * total", _RANKED),
    "filter_event_attribute": _cases("""SELECT case_id FROM log WHERE props IN ('{"k": 1}', '{"k": 2}')"""),
    "filter_event_attribute_out": on("day", "SELECT case_id, event_idx, activity FROM log WHERE case_id NOT IN (SELECT case_id FROM log WHERE activity = 'error')"),
    "filter_case_ids": _cases("VALUES ('8-2024-01-01'), ('16-2024-01-01')"),
    "filter_contains": _cases("SELECT case_id FROM log WHERE activity = 'purchase'"),
    "sample_cases": _cases("SELECT case_id FROM ends ORDER BY md5('0:' || case_id), case_id LIMIT 100", _ENDS),
    "truncate_traces": on("day", "SELECT case_id, event_idx, activity FROM log WHERE event_idx < 2"),
    "project_attributes": on("day", "SELECT case_id, event_idx, activity, props, CAST(NULL AS VARCHAR) AS value FROM log"),
    "sort_log": on("day", "SELECT case_id, event_idx, activity FROM log"),
    "relabel": on("day", "SELECT case_id, event_idx, CASE activity WHEN 'click' THEN 'press' ELSE activity END AS activity FROM log"),
}
