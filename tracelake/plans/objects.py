"""Queries of the object-centric log, the series and the predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions import control as C
from tracelake.operators import forecasts as T
from tracelake.operators import objects as O
from tracelake.operators import relations as R
from tracelake.plans.logs_sql import on
from tracelake.sources import logs


def series(s, d):
    """Events a day of each type."""
    rows = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))
    return rows.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("day")) - 1).cast("long").alias("pos"), "value")


DAY = logs.day_log
#: The reach of an anomaly's neighbours; small enough that the test tables hold some.
ANOMALY = 0.2


def links(s, d):
    """Which object points to which: orders to customers, customers and suppliers to nations, those to regions."""
    read = lambda table, a, b, of, to: s.read.parquet(f"{d}/{table}.parquet").select(F.concat(F.lit(of), a).alias("a"), F.concat(F.lit(to), b).alias("b"))
    return read("orders", "o_orderkey", "o_custkey", "o:", "c:").unionByName(read("customer", "c_custkey", "c_nationkey", "c:", "n:")).unionByName(read("supplier", "s_suppkey", "s_nationkey", "s:", "n:")).unionByName(read("nation", "n_nationkey", "n_regionkey", "n:", "r:"))


QUERIES = {
    "object_closure": lambda s, d: R.closure(links(s, d)),
    "object_reduction": lambda s, d: R.reduction(R.closure(links(s, d))),
    "ocel_flatten": lambda s, d: O.flatten(O.sales(s, d), "order"),
    "ocel_flatten_customer": lambda s, d: O.flatten(O.sales(s, d), "customer"),
    "ocel_flattened_cases": lambda s, d: O.flattened_cases(O.sales(s, d), "customer"),
    "ocel_etot": lambda s, d: O.etot(O.sales(s, d)),
    "ocel_types_of_activity": lambda s, d: O.types_of_activity(O.sales(s, d), "Ship"),
    "ocel_activities_of_type": lambda s, d: O.activities_of_type(O.sales(s, d), "order"),
    "ocel_object_types": lambda s, d: O.object_types(O.sales(s, d)),
    "ocel_event_types": lambda s, d: O.event_types(O.sales(s, d)),
    "ocel_summary": lambda s, d: O.summary(O.sales(s, d)),
    "ocel_objects_of_event": lambda s, d: O.objects_of_event(O.sales(s, d), "o:1"),
    "ocel_events_of_object": lambda s, d: O.events_of_object(O.sales(s, d), "c:1"),
    "trace_features": lambda s, d: T.trace_features(DAY(s, d)),
    "remaining_time": lambda s, d: T.remaining_time(DAY(s, d)),
    "duration_trend": lambda s, d: T.duration_trend(DAY(s, d)),
    "arrivals": lambda s, d: T.arrivals(DAY(s, d)),
    "arrival_forecast": lambda s, d: T.arrival_forecast(DAY(s, d)),
    "seasonality": lambda s, d: T.seasonality(DAY(s, d)),
    "anomalies": lambda s, d: T.anomalies(DAY(s, d), ANOMALY),
    "cluster_traces": lambda s, d: T.cluster(DAY(s, d)),
    "next_activity": lambda s, d: T.next_activity(DAY(s, d)),
    "smooth_ewma": lambda s, d: C.ewma(series(s, d)).withColumn("ewma", F.round("ewma", 6)),
    "smooth_sma": lambda s, d: C.moving_average(series(s, d)),
    "extrema": lambda s, d: C.extrema(series(s, d)),
    "rate_of_change": lambda s, d: C.rate_of_change(series(s, d)),
    "control_limits": lambda s, d: C.limits(series(s, d), 20).selectExpr("key", "round(center, 6) as center", "round(upper, 6) as upper", "round(lower, 6) as lower"),
    "drift": lambda s, d: C.drift(series(s, d), 20),
}

_SERIES = "series AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) - 1 AS pos, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type, CAST(ts AS DATE))"
_LINES = "lines AS (SELECT l_orderkey, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag, l_shipdate AS shipped, 'l:' || l_orderkey || '-' || l_linenumber || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_returnflag) AS k FROM lineitem))"
_OCEL = f"""WITH {_LINES},
e AS (SELECT 'o:' || o_orderkey AS event_id, 'Place' AS activity, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders UNION ALL SELECT line, CASE flag WHEN 'R' THEN 'Return' ELSE 'Ship' END, epoch_us(shipped) // 1000 FROM lines),
o AS (SELECT DISTINCT 'o:' || o_orderkey AS object_id, 'order' AS type FROM orders UNION ALL SELECT DISTINCT 'c:' || o_custkey, 'customer' FROM orders UNION ALL SELECT DISTINCT 'p:' || part, 'part' FROM lines UNION ALL SELECT DISTINCT 's:' || supp, 'supplier' FROM lines),
r AS (SELECT 'o:' || o_orderkey AS event_id, unnest(['o:' || o_orderkey, 'c:' || o_custkey]) AS object_id FROM orders UNION ALL SELECT line, unnest(['o:' || l_orderkey, 'p:' || part, 's:' || supp]) FROM lines)
"""
_FLAT = "SELECT object_id AS case_id, row_number() OVER (PARTITION BY object_id ORDER BY ts_ms, event_id) - 1 AS event_idx, activity, ts_ms FROM o JOIN (SELECT DISTINCT * FROM r) USING (object_id) JOIN e USING (event_id) WHERE type = '{}'"
_ETOT = "SELECT activity, type, count(*) AS n FROM r JOIN e USING (event_id) JOIN o USING (object_id) GROUP BY ALL"
_FEATURES = "features AS (SELECT case_id, count(*) AS length, count(DISTINCT activity) AS distinct_acts, arg_max(ts_ms, event_idx) - arg_min(ts_ms, event_idx) AS duration_ms, arg_min(idx, event_idx) AS first_idx, arg_max(idx, event_idx) AS last_idx FROM log JOIN (SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS idx FROM (SELECT DISTINCT activity FROM log)) USING (activity) GROUP BY 1)"
_ARRIVALS = "arrivals AS (SELECT s // 3600000 AS bucket, count(*) AS n FROM (SELECT min(ts_ms) AS s FROM log GROUP BY case_id) GROUP BY 1)"
_LINE = "hours AS (SELECT n, row_number() OVER (ORDER BY bucket) - 1 AS x FROM arrivals)"
_LIMITS = "limits AS (SELECT key, avg(value) AS center, avg(value) + 3 * stddev_pop(value) AS upper, greatest(0.0, avg(value) - 3 * stddev_pop(value)) AS lower FROM series WHERE pos < 20 GROUP BY 1 HAVING count(*) = 20)"


def _of(body: str, *tables: str) -> str:
    return "WITH " + ", ".join(tables) + " " + body


_W = "WINDOW w AS (PARTITION BY key ORDER BY pos)"
_DRIFT = """, p AS (SELECT key, pos, value, CASE WHEN upper > lower THEN (value - center) / ((upper - lower) / 6) ELSE 0 END AS d, sign(value - lag(value) OVER w) AS step FROM series JOIN limits USING (key) WINDOW w AS (PARTITION BY key ORDER BY pos)),
q AS (SELECT *, step * lag(step) OVER (PARTITION BY key ORDER BY pos) < 0 AS turn FROM p),
f AS (SELECT *, count(*) FILTER (d > 2) OVER w3 AS u2, count(*) FILTER (d < -2) OVER w3 AS l2, count(*) FILTER (d > 1) OVER w5 AS u1, count(*) FILTER (d < -1) OVER w5 AS l1, count(*) FILTER (d > 0) OVER w8 AS u0, count(*) FILTER (d < 0) OVER w8 AS l0,
  count(*) FILTER (step = 1) OVER w5 AS up, count(*) FILTER (step = -1) OVER w5 AS down, count(*) FILTER (turn) OVER w12 AS turns FROM q
  WINDOW w3 AS (PARTITION BY key ORDER BY pos ROWS 2 PRECEDING), w5 AS (PARTITION BY key ORDER BY pos ROWS 4 PRECEDING), w8 AS (PARTITION BY key ORDER BY pos ROWS 7 PRECEDING), w12 AS (PARTITION BY key ORDER BY pos ROWS 11 PRECEDING)),
g AS (SELECT key, pos, round(d, 6) AS distance, concat_ws(',', CASE WHEN abs(d) > 3 THEN '1' END, CASE WHEN d > 2 AND u2 >= 2 OR d < -2 AND l2 >= 2 THEN '2' END, CASE WHEN d > 1 AND u1 >= 4 OR d < -1 AND l1 >= 4 THEN '3' END, CASE WHEN u0 = 8 OR l0 = 8 THEN '4' END, CASE WHEN pos >= 7 AND (up = 5 OR down = 5) THEN '5' END, CASE WHEN turns = 12 THEN '6' END) AS rules,
  CASE WHEN abs(d) > 4 THEN 'critical' WHEN abs(d) > 3 THEN 'severe' WHEN abs(d) > 2 THEN 'moderate' ELSE 'minor' END AS severity FROM f)"""
_SCALED = "scaled AS (SELECT case_id, " + ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END AS {c}" for c in ("length", "distinct_acts", "duration_ms", "first_idx", "last_idx")) + " FROM features)"
_LINKS = """links AS (SELECT 'o:' || o_orderkey AS a, 'c:' || o_custkey AS b FROM orders UNION SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

ORACLES = {
    "object_closure": f"WITH RECURSIVE {_LINKS} SELECT a, b FROM reach",
    "object_reduction": f"WITH RECURSIVE {_LINKS} SELECT a, b FROM reach r WHERE NOT EXISTS (SELECT 1 FROM reach x JOIN reach y ON x.b = y.a WHERE x.a = r.a AND y.b = r.b)",
    "ocel_flatten": _OCEL + _FLAT.format("order"),
    "ocel_flatten_customer": _OCEL + _FLAT.format("customer"),
    "ocel_flattened_cases": _OCEL + "SELECT object_id AS case_id, count(event_id) AS events FROM o LEFT JOIN (SELECT DISTINCT * FROM r) USING (object_id) WHERE type = 'customer' GROUP BY 1",
    "ocel_etot": _OCEL + _ETOT,
    "ocel_types_of_activity": _OCEL + f"SELECT type FROM ({_ETOT}) WHERE activity = 'Ship'",
    "ocel_activities_of_type": _OCEL + f"SELECT activity FROM ({_ETOT}) WHERE type = 'order'",
    "ocel_object_types": _OCEL + "SELECT type, count(*) AS n FROM o GROUP BY 1",
    "ocel_event_types": _OCEL + "SELECT activity, count(*) AS n FROM e GROUP BY 1",
    "ocel_summary": _OCEL + "SELECT (SELECT count(*) FROM e) AS events, (SELECT count(DISTINCT activity) FROM e) AS event_types, (SELECT count(*) FROM o) AS objects, (SELECT count(DISTINCT type) FROM o) AS object_types, (SELECT count(*) FROM r) AS relations, (SELECT string_agg(DISTINCT activity, ',' ORDER BY activity) FROM e) AS event_type_names, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM o) AS object_type_names, false AS is_ocel20",
    "ocel_objects_of_event": _OCEL + "SELECT object_id, type FROM o WHERE object_id IN (SELECT object_id FROM r WHERE event_id = 'o:1')",
    "ocel_events_of_object": _OCEL + "SELECT event_id, activity, ts_ms FROM e WHERE event_id IN (SELECT event_id FROM r WHERE object_id = 'c:1')",
    "trace_features": on("day", "SELECT * FROM features", _FEATURES),
    "remaining_time": on("day", "SELECT case_id, event_idx, round(greatest(0.0, b + m * passed), 3) AS predicted_s FROM rows_, (SELECT regr_slope(rest, passed) AS m, regr_intercept(rest, passed) AS b FROM rows_)", "rows_ AS (SELECT case_id, event_idx, (ts_ms - s) / (e - s) AS passed, (e - ts_ms) / 1000.0 AS rest FROM (SELECT *, min(ts_ms) OVER w AS s, max(ts_ms) OVER w AS e FROM log WINDOW w AS (PARTITION BY case_id)) WHERE e > s)"),
    "duration_trend": on("day", "SELECT step, round(b + m * (n + step - 1), 2) AS predicted_s, round(m, 4) AS slope, round(q, 6) AS r2, CASE WHEN m > 0 THEN 'increasing' WHEN m < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM (SELECT regr_slope(v, x) AS m, regr_intercept(v, x) AS b, regr_r2(v, x) AS q, count(*) AS n FROM (SELECT (e - s) / 1000.0 AS v, row_number() OVER (ORDER BY s, case_id) - 1 AS x FROM (SELECT case_id, min(ts_ms) AS s, max(ts_ms) AS e FROM log GROUP BY 1))), range(1, 6) t(step)"),
    "arrivals": on("day", "SELECT * FROM arrivals", _ARRIVALS),
    "arrival_forecast": on("day", "SELECT round(regr_slope(n, x), 9) AS slope, round(regr_intercept(n, x), 6) AS intercept, round(greatest(0.0, regr_intercept(n, x) + regr_slope(n, x) * count(*)), 6) AS next FROM hours", _ARRIVALS, _LINE),
    "seasonality": on("day", "SELECT phase, round(v - avg(v) OVER (), 6) AS seasonal FROM (SELECT x % p AS phase, avg(n - trend) AS v FROM (SELECT h.x, h.n, p, sum(o.n * CASE WHEN p % 2 = 0 AND abs(o.x - h.x) = p // 2 THEN 0.5 ELSE 1.0 END) / p AS trend FROM hours h, size_ JOIN hours o ON abs(o.x - h.x) <= p // 2 WHERE h.x >= p // 2 AND h.x < k - p // 2 GROUP BY h.x, h.n, p) GROUP BY 1)", _ARRIVALS, _LINE, "size_ AS (SELECT count(*) AS k, greatest(2, count(*) // 4) AS p FROM hours)"),
    "anomalies": on("day", "SELECT case_id FROM scaled p WHERE NOT EXISTS (SELECT 1 FROM scaled q WHERE q.case_id <> p.case_id AND " + " + ".join(f"pow(p.{c} - q.{c}, 2)" for c in ("length", "distinct_acts", "duration_ms", "first_idx", "last_idx")) + " <= {eps}::DOUBLE * {eps}::DOUBLE)".format(eps=ANOMALY), _FEATURES, _SCALED),
    "smooth_ewma": _of("SELECT key, pos, value, round(list_reduce(list(value) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING), lambda a, b: 0.2::DOUBLE * b + (1 - 0.2::DOUBLE) * a), 6) AS ewma FROM series", _SERIES),
    "smooth_sma": _of("SELECT key, pos, value, round(avg(value) OVER (PARTITION BY key ORDER BY pos ROWS 4 PRECEDING), 9) AS average FROM series", _SERIES),
    "extrema": _of(f"SELECT key, pos, value, kind FROM (SELECT *, CASE WHEN value > lag(value) OVER w AND value > lead(value) OVER w THEN 'peak' WHEN value < lag(value) OVER w AND value < lead(value) OVER w THEN 'trough' END AS kind FROM series {_W}) WHERE kind IS NOT NULL", _SERIES),
    "rate_of_change": _of(f"SELECT key, pos, value, CASE WHEN lag(value) OVER w <> 0 THEN round((value - lag(value) OVER w) / lag(value) OVER w, 9) END AS change FROM series {_W}", _SERIES),
    "control_limits": _of("SELECT key, round(center, 6) AS center, round(upper, 6) AS upper, round(lower, 6) AS lower FROM limits", _SERIES, _LIMITS),
    "drift": _of("SELECT * FROM g WHERE rules <> ''", _SERIES, _LIMITS + _DRIFT),
}
