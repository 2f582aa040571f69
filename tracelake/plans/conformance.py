"""Queries of replay, discovery and running conformance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions import running as U
from tracelake.operators import conformance as K
from tracelake.operators import discovery as M
from tracelake.operators import inductive as I
from tracelake.operators import nets
from tracelake.plans.logs_sql import EDGES, REVERSE, TRACES, on
from tracelake.sources import logs

DAY = logs.day_log
#: A reference net: every transition takes from one place and gives to one, so SQL can follow it.
STEPS = {"view": ("start", "shop"), "click": ("shop", "shop"), "error": ("shop", "fault"), "signup": ("fault", "shop"), "purchase": ("shop", "end")}


def model(s):
    return nets.net(s, {f"t_{a}": (a, [p], [q]) for a, (p, q) in STEPS.items()}, ["start"], ["end"])


def mined(log, measure):
    """``log`` held against the net that is mined from it."""
    return measure(log, I.inductive_net(log))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def arrivals(s, d):
    """Cases of the day log in order of case id, by weekday-like group of their user."""
    rows = K.replay(DAY(s, d), model(s))
    key = F.concat(F.lit("p"), (F.split("case_id", "-")[0].cast("long") % 3).cast("string"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("case_id")) - 1
    return rows.select(key.alias("key"), place.cast("long").alias("pos"), "produced", "consumed", "missing", "remaining", "fit")


def _smoothed(s, d):
    return U.smoothed(U.running(arrivals(s, d)))


QUERIES = {
    "replay": lambda s, d: _rounded(K.replay(DAY(s, d), model(s)).drop("fired"), "fitness"),
    "replay_events": lambda s, d: _rounded(K.replay_events(DAY(s, d), model(s)), "fitness"),
    "replay_fitness": lambda s, d: K.fitness(DAY(s, d), model(s)),
    "precision": lambda s, d: K.precision(DAY(s, d), model(s)),
    "generalization": lambda s, d: K.generalization(DAY(s, d), model(s)),
    "transition_firings": lambda s, d: K.firings(DAY(s, d), model(s)),
    "filter_fitness": lambda s, d: K.filter_by_fitness(DAY(s, d), model(s), 0.7).select("case_id", "event_idx", "activity"),
    "partition_fitness": lambda s, d: _rounded(K.partition_by_fitness(DAY(s, d), model(s), 0.7), "fitness"),
    "activity_fitness": lambda s, d: K.activity_fitness(DAY(s, d), model(s)),
    "fitness_histogram": lambda s, d: K.fitness_histogram(DAY(s, d), model(s)),
    "align": lambda s, d: _rounded(K.align(DAY(s, d), model(s)).drop("moves"), "fitness"),
    "alpha": lambda s, d: M.alpha(logs.conversation_log(s, d)),
    "alpha_days": lambda s, d: M.alpha(DAY(s, d)),
    "alpha_plus": lambda s, d: M.alpha_plus(DAY(s, d)),
    "inductive": lambda s, d: I.inductive(logs.conversation_log(s, d)),
    "inductive_fits": lambda s, d: mined(logs.conversation_log(s, d), K.align).select("case_id", (F.col("cost") < 10_000).alias("fits")),
    "inductive_replay": lambda s, d: mined(logs.conversation_log(s, d), K.replay).select("case_id", "missing", "remaining", "fit"),
    "inductive_days_fits": lambda s, d: mined(DAY(s, d), K.align).select("case_id", (F.col("cost") < 10_000).alias("fits")),
    "streaming_fitness": lambda s, d: _rounded(U.running(arrivals(s, d)).drop("nth"), "fitness", "windowed_fitness", "perfect_rate", "avg_missing"),
    "streaming_alerts": lambda s, d: U.alerts(_smoothed(s, d)).withColumn("value", F.round("value", 6)),
}

_PLACES = ("start", "shop", "fault", "end")


def _case(of) -> str:
    return "CASE l.activity " + " ".join(f"WHEN '{a}' THEN {of(p, q)}" for a, (p, q) in STEPS.items()) + " END"


def _place(x: str) -> str:
    return f"s.m_{x} + " + _case(lambda p, q: f"(CASE WHEN s.m_{x} = 0 AND '{p}' = '{x}' THEN 1 ELSE 0 END) - {int(p == x)} + {int(q == x)}")


#: The marking after every event: m_* tokens in each place, and what the replay has counted.
_REPLAY = f"""states AS (
  SELECT case_id, CAST(-1 AS BIGINT) AS i, {", ".join(f"{int(x == 'start')} AS m_{x}" for x in _PLACES)}, 0 AS missing, 0 AS escaping FROM (SELECT DISTINCT case_id FROM log)
  UNION ALL
  SELECT case_id, i, m_start, m_shop, m_fault, m_end, missing,
    escaping + {" + ".join(f"CASE WHEN m_{p} > 0 AND activity <> '{a}' THEN 1 ELSE 0 END" for a, (p, _) in STEPS.items())}
  FROM (SELECT l.case_id, l.event_idx AS i, l.activity, {", ".join(f"{_place(x)} AS m_{x}" for x in _PLACES)},
    s.missing + {_case(lambda p, q: f"CASE WHEN s.m_{p} = 0 THEN 1 ELSE 0 END")} AS missing, s.escaping
    FROM states s JOIN log l ON l.case_id = s.case_id AND l.event_idx = s.i + 1)
), replays AS (
  SELECT case_id, CAST(1 + n + missing AS BIGINT) AS produced, CAST(n + 1 AS BIGINT) AS consumed, CAST(missing AS BIGINT) AS missing, CAST(m_start + m_shop + m_fault AS BIGINT) AS remaining, CAST(escaping AS BIGINT) AS escaping
  FROM states JOIN (SELECT case_id, count(*) AS n FROM log GROUP BY 1) USING (case_id) WHERE i = n - 1
), fits AS (SELECT *, greatest(0.0, least(1.0, 0.5 * (1 - missing / consumed) + 0.5 * (1 - remaining / produced))) AS f, missing = 0 AND remaining = 0 AS fit FROM replays)"""


def _on_replay(body: str, *tables: str) -> str:
    return on("day", body, _REPLAY, *tables).replace("WITH ", "WITH RECURSIVE ", 1)


_SUMS = "sum(produced) AS p, sum(consumed) AS c, sum(missing) AS m, sum(remaining) AS r"
_RUNNING = """arrived AS (SELECT *, 'p' || (CAST(split_part(case_id, '-', 1) AS BIGINT) % 3) AS key, row_number() OVER (PARTITION BY CAST(split_part(case_id, '-', 1) AS BIGINT) % 3 ORDER BY case_id) - 1 AS pos FROM fits),
run AS (SELECT key, pos, 0.5 * (1 - sum(missing) OVER a / sum(consumed) OVER a) + 0.5 * (1 - sum(remaining) OVER a / sum(produced) OVER a) AS fitness,
  0.5 * (1 - sum(missing) OVER l / sum(consumed) OVER l) + 0.5 * (1 - sum(remaining) OVER l / sum(produced) OVER l) AS windowed_fitness,
  avg(CASE WHEN fit THEN 1.0 ELSE 0.0 END) OVER a AS perfect_rate, avg(missing) OVER a AS avg_missing
  FROM arrived WINDOW a AS (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY key ORDER BY pos ROWS 99 PRECEDING))"""
_SMOOTH = "smooth AS (SELECT key, pos, {}, 0 AS x FROM run)".format(", ".join(f"list_reduce(list({c}) OVER (PARTITION BY key ORDER BY pos ROWS 250 PRECEDING), lambda a, b: 0.2::DOUBLE * b + 0.8::DOUBLE * a) AS {c}" for c in ("fitness", "perfect_rate", "avg_missing")))

def _named(kind: str, *parts: str) -> str:
    return f"CAST(to_json(['{kind}'{''.join(', ' + p for p in parts)}]) AS VARCHAR)"


_NAMES = "names AS (SELECT source AS a FROM edges UNION SELECT target FROM edges)"
_CAUSAL = "causal AS (SELECT source AS a, target AS b FROM both_ways WHERE back = 0 AND source <> target)"
_ROW = "SELECT '{}' AS kind, {} AS name, {} AS label, {} AS target, CAST({} AS INTEGER) AS n FROM {}"
_DO = _named("do", "a")


def _row(kind: str, name: str, source: str, label: str = "CAST(NULL AS VARCHAR)", target: str = "CAST(NULL AS VARCHAR)", n: str = "NULL") -> str:
    return _ROW.format(kind, name, label, target, n, source)


def _through(kind: str, source: str, a: str = "a", b: str = "b", named: tuple[str, str] = ("a", "b")) -> list[str]:
    place = _named(kind, *named)
    return [_row("place", place, source), _row("arc", _named("do", a), source, target=place), _row("arc", place, source, target=_named("do", b))]


_ALPHA = [
    _row("transition", _DO, "names", label="a"), *_through("then", "causal"),
    *(_row(kind, _named(place), "(SELECT 1 FROM log LIMIT 1)", n=n) for kind, place, n in (("place", "begin", "NULL"), ("place", "end", "NULL"), ("initial", "begin", "1"), ("final", "end", "1"))),
    _row("arc", _named("begin"), "(SELECT DISTINCT activity AS a FROM log WHERE event_idx = 0) JOIN names USING (a)", target=_DO),
    _row("arc", _DO, "(SELECT DISTINCT arg_max(activity, event_idx) AS a FROM log GROUP BY case_id) JOIN names USING (a)", target=_named("end")),
]
_LOOPS = """looping AS (SELECT source AS a FROM edges WHERE source = target), parallel AS (SELECT source AS a, target AS b FROM both_ways WHERE back > 0 AND source <> target),
inside AS (SELECT * FROM (SELECT case_id, event_idx, activity, lag(activity) OVER w AS prev, lead(activity) OVER w AS next FROM log WINDOW w AS (PARTITION BY case_id ORDER BY event_idx)) WHERE event_idx > 0 AND (coalesce(prev = activity, false) OR coalesce(next = activity, false))),
second AS (SELECT DISTINCT x.activity AS a, x.prev AS b FROM inside x JOIN inside y ON y.activity = x.prev AND y.next = x.activity)"""
_LOOP, _AGAIN = _named("loop", "a"), _named("again", "a")
_PLUS = [
    *_ALPHA, *_through("both", "parallel"), *_through("both", "parallel", "b", "a", ("b", "a")),
    _row("transition", _AGAIN, "looping", label=_AGAIN), _row("place", _LOOP, "looping"), _row("initial", _LOOP, "looping", n="1"),
    *(_row("arc", x, "looping", target=y) for x, y in ((_LOOP, _AGAIN), (_AGAIN, _LOOP), (_DO, _LOOP), (_LOOP, _DO))),
    *_through("short", "second"),
]

_FAR = 1 << 40


def _moves() -> dict[tuple[str, str], int]:
    """What it costs the model alone to bring its token from one place to another."""
    cost = {(p, q): 0 if p == q else _FAR for p in _PLACES for q in _PLACES} | {(p, q): 10_000 for p, q in STEPS.values() if p != q}
    for via in _PLACES:
        cost |= {(p, q): min(cost[p, q], cost[p, via] + cost[via, q]) for p in _PLACES for q in _PLACES}
    return cost


def _best(target: str) -> str:
    return f"least({', '.join(f's.c_{p} + {_moves()[p, target]}' for p in _PLACES)})"


#: The least cost of the trace up to an event with the token in each place: the event is a move of the log alone, or of both.
_ALIGNED = f"""costs AS (
  SELECT case_id, CAST(-1 AS BIGINT) AS i, {", ".join(f"CAST({0 if x == 'start' else _FAR} AS BIGINT) AS c_{x}" for x in _PLACES)} FROM (SELECT DISTINCT case_id FROM log)
  UNION ALL
  SELECT l.case_id, l.event_idx, {", ".join(f"least(s.c_{x} + 10000, CASE l.activity " + "".join(f"WHEN '{a}' THEN {_best(p)} " for a, (p, q) in STEPS.items() if q == x) + f"ELSE {_FAR} END)" if any(q == x for _, q in STEPS.values()) else f"s.c_{x} + 10000" for x in _PLACES)}
  FROM costs s JOIN log l ON l.case_id = s.case_id AND l.event_idx = s.i + 1
), aligned AS (SELECT case_id, n, {_best("end")} AS cost FROM costs s JOIN (SELECT case_id, count(*) AS n FROM log GROUP BY 1) USING (case_id) WHERE i = n - 1)"""

#: The tree of conversations, worked out by hand for logs of which these relations, and no others, are seen: a system's turn may come first, then
#: a user's and mostly an assistant's, again and again.
_TALK = """SELECT * FROM (VALUES ('0', 'sequence', NULL), ('0.0', 'xor', NULL), ('0.0.0', NULL, NULL), ('0.0.1', NULL, 'system'), ('0.1', 'loop', NULL), ('0.1.0', 'sequence', NULL),
  ('0.1.0.0', NULL, 'user'), ('0.1.0.1', 'xor', NULL), ('0.1.0.1.0', NULL, NULL), ('0.1.0.1.1', NULL, 'assistant'), ('0.1.1', NULL, NULL)) t(path, operator, label)
WHERE (SELECT list(DISTINCT source || '>' || target ORDER BY source || '>' || target) FROM edges) = ['assistant>user', 'system>user', 'user>assistant']
  AND (SELECT count(DISTINCT activity) FROM log WHERE event_idx = 0) = 2 AND (SELECT count(DISTINCT last) FROM (SELECT arg_max(activity, event_idx) AS last FROM log GROUP BY case_id)) = 2"""

ORACLES = {
    "replay": _on_replay("SELECT case_id, produced, consumed, missing, remaining, round(f, 9) AS fitness, fit FROM fits"),
    "replay_events": _on_replay("SELECT case_id, produced, consumed, missing, remaining, round(f, 9) AS fitness, fit FROM fits"),
    "replay_fitness": _on_replay(f"SELECT round(0.5 * (1 - m / c) + 0.5 * (1 - r / p), 9) AS fitness, round(mean, 9) AS mean_fitness, fitting, cases FROM (SELECT {_SUMS}, avg(f) AS mean, count(*) FILTER (fit) AS fitting, count(*) AS cases FROM fits)"),
    "precision": _on_replay("SELECT round(1 - e / (e + c), 9) AS precision, CAST(e AS BIGINT) AS escaping, CAST(c AS BIGINT) AS consumed FROM (SELECT sum(escaping) AS e, sum(consumed) AS c FROM replays)"),
    "generalization": on("day", "SELECT round(1 - avg(1 / sqrt(n)), 9) AS generalization FROM (SELECT activity, count(*) AS n FROM log GROUP BY 1)"),
    "transition_firings": on("day", "SELECT 't_' || activity AS transition, count(*) AS n FROM log GROUP BY 1"),
    "filter_fitness": _on_replay("SELECT case_id, event_idx, activity FROM log JOIN fits USING (case_id) WHERE f >= 0.7"),
    "partition_fitness": _on_replay("SELECT case_id, round(f, 9) AS fitness, f >= 0.7 AS fitting FROM fits"),
    "activity_fitness": _on_replay("SELECT activity, round(avg(f), 9) AS fitness FROM (SELECT DISTINCT case_id, activity FROM log) JOIN fits USING (case_id) GROUP BY 1"),
    "fitness_histogram": _on_replay("SELECT b AS bin, b / 10 AS low, (b + 1) / 10 AS high, coalesce(k, 0) AS n FROM range(10) t(b) LEFT JOIN (SELECT least(CAST(floor(round(f * 10, 9)) AS BIGINT), 9) AS b, count(*) AS k FROM fits GROUP BY 1) USING (b)"),
    "align": on("day", "SELECT case_id, 'optimal' AS status, cost, cost AS bound, round(greatest(0.0, 1 - cost / (10000.0 * n)), 9) AS fitness, cost = 0 AS fit FROM aligned", _ALIGNED).replace("WITH ", "WITH RECURSIVE ", 1),
    "inductive": on("conversation", _TALK, EDGES),
    "inductive_fits": on("conversation", "SELECT DISTINCT case_id, true AS fits FROM log"),
    "inductive_replay": on("conversation", "SELECT DISTINCT case_id, 0::BIGINT AS missing, 0::BIGINT AS remaining, true AS fit FROM log"),
    "inductive_days_fits": on("day", "SELECT DISTINCT case_id, true AS fits FROM log"),
    "alpha": on("conversation", "\nUNION ".join(_ALPHA), REVERSE, _NAMES, _CAUSAL),
    "alpha_days": on("day", "\nUNION ".join(_ALPHA), REVERSE, _NAMES, _CAUSAL),
    "alpha_plus": on("day", "\nUNION ".join(_PLUS), REVERSE, _NAMES, _CAUSAL, _LOOPS),
    "streaming_fitness": _on_replay("SELECT key, pos, round(fitness, 9) AS fitness, round(windowed_fitness, 9) AS windowed_fitness, round(perfect_rate, 9) AS perfect_rate, round(avg_missing, 9) AS avg_missing FROM run", _RUNNING),
    "streaming_alerts": _on_replay("SELECT key, pos, kind, round(value, 6) AS value, threshold FROM (SELECT key, pos, 'fitness_below_threshold' AS kind, fitness AS value, 0.8::DOUBLE AS threshold FROM smooth WHERE fitness < 0.8 UNION ALL SELECT key, pos, 'perfect_rate_below_threshold', perfect_rate, 0.5 FROM smooth WHERE perfect_rate < 0.5 UNION ALL SELECT key, pos, 'missing_above_threshold', avg_missing, 5.0 FROM smooth WHERE avg_missing > 5)", _RUNNING, _SMOOTH),
}
