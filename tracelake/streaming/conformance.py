"""Conformance of a stream of traces, by process: replay is stateless, its running totals are the state of a key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions.running import ALPHA, WINDOW, alert_kinds
from tracelake.operators.nets import net_of, replayed

#: Fixed values of the control chart: traces that set the limits, their width in deviations, values remembered.
CALIBRATION, SIGMAS, HISTORY = 30, 3.0, 14
_COUNTS = "key string, case_id string, seq long, produced long, consumed long, missing long, remaining long, fit boolean"
SNAPSHOT = "key string, case_id string, seq long, pos long, fitness double, windowed_fitness double, smooth_fitness double, smooth_perfect_rate double, smooth_avg_missing double, distance double, rules string"


def replay_stream(stream: DataFrame, model: DataFrame) -> DataFrame:
    """``stream`` (key, case_id, seq, acts) with the token counts of each trace on the net ``model``."""
    net = net_of(model)

    def run(batches):
        for batch in batches:
            rows = [replayed(net, acts) for acts in batch.column("acts").to_pylist()]
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "case_id", "seq")), *counts, pa.array([not r[2] and not r[3] for r in rows], pa.bool_())], ["key", "case_id", "seq", "produced", "consumed", "missing", "remaining", "fit"])

    return stream.select("key", "case_id", "seq", "acts").mapInArrow(run, _COUNTS)


def _fitness(produced: float, consumed: float, missing: float, remaining: float) -> float:
    share = 0.5 * (1 - (missing / consumed if consumed else 0)) + 0.5 * (1 - (remaining / produced if produced else 0))
    return min(1.0, max(0.0, share))


def broken_rules(history: list[float]) -> list[int]:
    """The Western Electric rules that the last of ``history`` breaks, values as distances from the centre in deviations."""
    d = history[-1]
    side = (lambda bound, last: sum(x > bound for x in history[-last:])) if d > 0 else (lambda bound, last: sum(x < -bound for x in history[-last:]))
    steps = [(b > a) - (b < a) for a, b in zip(history, history[1:])]
    turns = [a * b < 0 for a, b in zip(steps, steps[1:])]
    one_side = len(history) >= 8 and (all(x > 0 for x in history[-8:]) or all(x < 0 for x in history[-8:]))
    trend = len(history) >= 8 and (all(s == 1 for s in steps[-5:]) or all(s == -1 for s in steps[-5:]))
    found = [abs(d) > 3, abs(d) > 2 and side(2, 3) >= 2, abs(d) > 1 and side(1, 5) >= 4, one_side, trend, len(turns) >= 12 and all(turns[-12:])]
    return [k for k, broken in enumerate(found, 1) if broken]


class Running:
    """A process's state: totals, the last traces, smoothed values and the control chart of the fitness; of bounded size."""

    def __init__(self, kept: str | None = None):
        self.__dict__.update(json.loads(kept) if kept else {"n": 0, "totals": [0] * 4, "perfect": 0, "last": [], "smooth": None, "first": [], "history": []})

    def push(self, counts: list[int], fit: bool, window: int = WINDOW, alpha: float = ALPHA, calibration: int = CALIBRATION, sigmas: float = SIGMAS) -> tuple[float, float, list[float], float | None, str]:
        """(fitness, windowed fitness, smoothed fitness, perfect rate and missing, distance, rules) with one more trace."""
        self.n += 1
        self.totals = [a + b for a, b in zip(self.totals, counts)]
        self.perfect += fit
        self.last = [*self.last, counts][-window:]
        fitness = _fitness(*self.totals)
        raw = [fitness, self.perfect / self.n, self.totals[2] / self.n]
        self.smooth = raw if self.smooth is None else [alpha * x + (1 - alpha) * s for x, s in zip(raw, self.smooth)]
        distance, rules = None, ""
        if len(self.first) < calibration:
            self.first.append(fitness)
        else:
            centre = sum(self.first) / len(self.first)
            deviation = (sum((x - centre) ** 2 for x in self.first) / len(self.first)) ** 0.5
            upper, lower = centre + sigmas * deviation, max(0.0, centre - sigmas * deviation)
            distance = (self.smooth[0] - centre) / ((upper - lower) / (2 * sigmas)) if upper > lower else 0.0
            self.history = [*self.history, distance][-HISTORY:]
            rules = ",".join(map(str, broken_rules(self.history)))
        return fitness, _fitness(*map(sum, zip(*self.last))), self.smooth, distance, rules


def conformance(replayed: DataFrame) -> DataFrame:
    """A row after each trace of :func:`replay_stream`: running, windowed and smoothed measures, and the rules of drift that break.

    The first traces of a process set the limits of its chart, later ones are held against them. Within a trigger a process's traces
    are put in order of ``seq``; a trigger's size bounds what is sorted. State is kept in the query's checkpoint.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Running(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["seq", "case_id"], kind="stable")
        out = []
        for x in rows.itertuples():
            fitness, windowed, smooth, distance, rules = own.push([int(x.produced), int(x.consumed), int(x.missing), int(x.remaining)], bool(x.fit))
            out.append((key[0], x.case_id, x.seq, own.n - 1, fitness, windowed, *smooth, distance, rules))
        state.update((json.dumps(own.__dict__),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    return replayed.groupBy("key").applyInPandasWithState(update, SNAPSHOT, "kept string", "append", GroupStateTimeout.NoTimeout)


def alerts(snapshots: DataFrame) -> DataFrame:
    """(key, case_id, seq, kind, value, threshold): broken thresholds, and ``drift`` with the number of rules broken."""
    drift = F.when(F.col("rules") != "", F.struct(F.lit("drift").alias("kind"), F.col("distance").alias("value"), F.lit(SIGMAS).alias("threshold")))
    kinds = F.array_compact(F.concat(alert_kinds(F.col("smooth_fitness"), F.col("smooth_perfect_rate"), F.col("smooth_avg_missing")), F.array(drift)))
    return snapshots.select("key", "case_id", "seq", F.explode(kinds).alias("alert")).select("key", "case_id", "seq", "alert.*")


def deliver(found: DataFrame, send: Callable[[Iterator], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start sending ``found``'s rows: ``send`` is called on executors with an iterator of each partition's rows.

    A trigger that failed is sent again, so a receiver should know rows by key and seq. ``trigger`` is that of ``DataStreamWriter.trigger``.
    """
    return found.writeStream.foreachBatch(lambda batch, _: batch.foreachPartition(send)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
