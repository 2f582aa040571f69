"""Running conformance of traces in order of arrival: rows (key, pos, produced, consumed, missing, remaining, fit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.control import folded
from tracelake.functions.scans import SUM, blocks, scanned
from tracelake.operators.conformance import token_fitness
from tracelake.sources.tables import stored

#: Traces of the window, the weight of a new value, and what raises an alert.
WINDOW, ALPHA = 100, 0.2
LEAST_FITNESS, LEAST_PERFECT, MOST_MISSING = 0.8, 0.5, 5.0
_TOKENS = ("produced", "consumed", "missing", "remaining")


def running(arrivals: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, pos, nth, fitness, windowed_fitness, perfect_rate, avg_missing) after each trace, the nth of its key: over all so far, or the last ``window``.

    Sums run over blocks of a key (:mod:`scans`); those of the last traces are differences to the sums ``window`` traces before. ``arrivals`` are worked out and stored once.
    """
    rows = blocks(arrivals.select("key", "pos", *_TOKENS, "fit"), ["key"], ["pos"])
    sums = scanned(rows, ["key"], ["pos"], nth=(SUM, F.lit(1).cast("long")), perfect=(SUM, F.col("fit").cast("long")), **{f"all_{c}": (SUM, F.col(c)) for c in _TOKENS})
    sums = stored(sums.select("key", "pos", "nth", "perfect", *(f"all_{c}" for c in _TOKENS)), "running")
    before = sums.select("key", (F.col("nth") + window).alias("nth"), *(F.col(f"all_{c}").alias(f"old_{c}") for c in _TOKENS))
    both = sums.join(before, ["key", "nth"], "left")
    last = token_fitness(*(F.col(f"all_{c}") - F.coalesce(f"old_{c}", F.lit(0)) for c in _TOKENS))
    return both.select("key", "pos", "nth", token_fitness(*(F.col(f"all_{c}") for c in _TOKENS)).alias("fitness"), last.alias("windowed_fitness"), (F.col("perfect") / F.col("nth")).alias("perfect_rate"), (F.col("all_missing") / F.col("nth")).alias("avg_missing"))


def smoothed(found: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """:func:`running` with ``fitness``, ``perfect_rate`` and ``avg_missing`` smoothed in one pass, as smooth_fitness and so on."""
    names = ("fitness", "perfect_rate", "avg_missing")
    return folded(stored(found.withColumn("_nth", F.col("nth")), "running"), {c: f"smooth_{c}" for c in names}, alpha).drop("_nth")


def alert_kinds(fitness: Column, perfect: Column, missing: Column) -> Column:
    """array<struct<kind,value,threshold>> of the thresholds that smoothed values break."""
    alert = lambda name, value, bound, broken: F.when(broken, F.struct(F.lit(name).alias("kind"), value.cast("double").alias("value"), F.lit(bound).alias("threshold")))
    return F.array_compact(F.array(
        alert("fitness_below_threshold", fitness, LEAST_FITNESS, fitness < LEAST_FITNESS),
        alert("perfect_rate_below_threshold", perfect, LEAST_PERFECT, perfect < LEAST_PERFECT),
        alert("missing_above_threshold", missing, MOST_MISSING, missing > MOST_MISSING),
    ))


def alerts(found: DataFrame) -> DataFrame:
    """(key, pos, kind, value, threshold): the thresholds that each row of :func:`smoothed` breaks."""
    rows = found.select("key", "pos", F.explode(alert_kinds(F.col("smooth_fitness"), F.col("smooth_perfect_rate"), F.col("smooth_avg_missing"))).alias("alert"))
    return rows.select("key", "pos", "alert.*")
