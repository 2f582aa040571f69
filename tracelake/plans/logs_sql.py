"""Logs of the test tables as SQL, for the comparison of every operator with its SQL."""

_EVENTS = """log AS (SELECT {case} AS case_id, event_type AS activity, epoch_us(ts) // 1000 AS ts_ms, CAST(value AS VARCHAR) AS value, props,
  row_number() OVER (PARTITION BY {case} ORDER BY ts, event_id) - 1 AS event_idx FROM events)"""

LOGS = {
    "user": _EVENTS.format(case="CAST(user_id AS VARCHAR)"),
    "day": _EVENTS.format(case="concat(user_id, '-', strftime(ts, '%Y-%m-%d'))"),
    "conversation": """log AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, CAST(NULL AS BIGINT) AS ts_ms,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS event_idx FROM conversations)""",
    "order": """log AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) // 1000 AS ts_ms,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS event_idx FROM orders)""",
}

#: Common tables of many statements, each on top of ``log``.
TRACES = "traces AS (SELECT case_id, string_agg(activity, '>' ORDER BY event_idx) AS variant, list(activity ORDER BY event_idx) AS acts, count(*) AS n FROM log GROUP BY case_id)"
SPANS = "spans AS (SELECT case_id, arg_min(coalesce(ts_ms, -1), event_idx) AS first_ms, arg_max(coalesce(ts_ms, -1), event_idx) AS last_ms, count(*) AS n FROM log GROUP BY case_id)"
PAIRS = """pairs AS (SELECT * FROM (SELECT case_id, activity AS source, lead(activity) OVER w AS target, lead(ts_ms) OVER w - ts_ms AS gap_ms
  FROM log WINDOW w AS (PARTITION BY case_id ORDER BY event_idx)) WHERE target IS NOT NULL)"""
EDGES = PAIRS + ", edges AS (SELECT source, target, count(*) AS n FROM pairs GROUP BY ALL)"
REVERSE = EDGES + ", both_ways AS (SELECT e.source, e.target, e.n, coalesce(r.n, 0) AS back FROM edges e LEFT JOIN edges r ON r.source = e.target AND r.target = e.source)"
SEEN = "seen AS (SELECT case_id, activity, count(*) AS n, min(event_idx) AS f, max(event_idx) AS l FROM log GROUP BY ALL)"


def on(log: str, body: str, *tables: str) -> str:
    return "WITH " + ",\n".join([LOGS[log], *tables]) + "\n" + body
