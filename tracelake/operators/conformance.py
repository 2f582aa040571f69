"""Replay and alignment of a log on a net, and the measures built on them.

Distinct variants are replayed, by tasks that each hold the small net; the counts go back to cases by a join on the variant,
and measures of the whole log are weighted sums over variants.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.alignments import Aligner
from tracelake.operators.nets import Net, Replay, net_of, replayed
from tracelake.sources.logs import traces, variants

_COUNTS = ("produced", "consumed", "missing", "remaining", "escaping", "precise_consumed")
_SCHEMA = "acts array<string>, count long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", fired array<string>"


def token_fitness(produced: Column, consumed: Column, missing: Column, remaining: Column) -> Column:
    """The mean of the shares of tokens that were neither missing nor left, between 0 and 1; 1 without any token."""
    share = 0.5 * (1 - F.when(consumed > 0, missing / consumed).otherwise(0.0)) + 0.5 * (1 - F.when(produced > 0, remaining / produced).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def replay_variants(found: DataFrame, model: Net) -> DataFrame:
    """``found`` (acts, count) with each variant's token counts and the transitions it fires.

    ``precise_consumed`` leaves out what silent transitions take, as precision does.
    """
    size = {t.name: len(t.pre) for t in model.transitions}
    final = sum(model.final.values())

    def run(batches):
        for batch in batches:
            rows = [replayed(model, acts) for acts in batch.column("acts").to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            visible = pa.array([sum(size[t] for t in r[5]) + final for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("acts"), batch.column("count"), *columns, visible, pa.array([r[5] for r in rows], pa.list_(pa.string()))], ["acts", "count", *_COUNTS, "fired"])

    return found.select("acts", "count").mapInArrow(run, _SCHEMA)


def replay(log: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, produced, consumed, missing, remaining, fitness, fit, fired): token replay of every case.

    The final marking's tokens count as consumed whether they are there or not; tokens left in places outside it remain.
    """
    cases = traces(log).select("case_id", "acts")
    counts = replay_variants(cases.groupBy("acts").agg(F.count("*").alias("count")), net_of(model)).drop("count")
    rows = cases.join(counts, "acts")
    fitness = token_fitness(*(F.col(c) for c in _COUNTS[:4]))
    return rows.select("case_id", *_COUNTS[:4], fitness.alias("fitness"), ((F.col("missing") == 0) & (F.col("remaining") == 0)).alias("fit"), "fired")


def replay_events(log: DataFrame, model: DataFrame) -> DataFrame:
    """:func:`replay` without ``fired``, for cases of any length: a case's events pass a task in order, which holds its marking alone.

    Cases are dealt out by hash and sorted within tasks; no trace becomes a row. Where cases are short and alike, :func:`replay` does less.
    """
    net = net_of(model)
    schema = "case_id string, produced long, consumed long, missing long, remaining long"

    def run(batches):
        case, state = None, None
        for batch in batches:
            rows = []
            for key, activity in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or key != case:
                    if state is not None:
                        rows.append((case, *state.finish()[:4]))
                    case, state = key, Replay(net)
                state.push(activity)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["case_id", *_COUNTS[:4]])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (case, *state.finish()[:4])], ["case_id", *_COUNTS[:4]])

    ordered = log.select("case_id", "activity", "event_idx").repartition("case_id").sortWithinPartitions("case_id", "event_idx").select("case_id", "activity")
    fitness = token_fitness(*(F.col(c) for c in _COUNTS[:4]))
    return ordered.mapInArrow(run, schema).select("*", fitness.alias("fitness"), ((F.col("missing") == 0) & (F.col("remaining") == 0)).alias("fit"))


def _weighted(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*(F.coalesce(F.sum(F.col("count") * F.col(c)), F.lit(0)).alias(c) for c in columns), F.coalesce(F.sum("count"), F.lit(0)).alias("cases"), F.coalesce(F.sum(F.col("count") * token_fitness(*(F.col(c) for c in _COUNTS[:4]))), F.lit(0.0)).alias("fitnesses"), F.coalesce(F.sum(F.when((F.col("missing") == 0) & (F.col("remaining") == 0), F.col("count"))), F.lit(0)).alias("fitting"))


def fitness(log: DataFrame, model: DataFrame) -> DataFrame:
    """One row (fitness, mean_fitness, fitting, cases): from summed tokens, as the mean over cases, and cases without a fault; 1 for an empty log."""
    total = _weighted(replay_variants(variants(log), net_of(model)), *_COUNTS[:4])
    mean = F.when(F.col("cases") > 0, F.col("fitnesses") / F.col("cases")).otherwise(1.0)
    return total.select(F.round(token_fitness(*(F.col(c) for c in _COUNTS[:4])), 9).alias("fitness"), F.round(mean, 9).alias("mean_fitness"), "fitting", "cases")


def precision(log: DataFrame, model: DataFrame) -> DataFrame:
    """One row (precision, escaping, consumed): 1 - escaping / (escaping + consumed); 1 for an empty log."""
    total = _weighted(replay_variants(variants(log), net_of(model)).withColumn("consumed", F.col("precise_consumed")), *_COUNTS[:5])
    e, c = F.col("escaping"), F.col("consumed")
    return total.select(F.round(F.when(e + c > 0, 1 - e / (e + c)).otherwise(1.0), 9).alias("precision"), "escaping", "consumed")


def firings(log: DataFrame, model: DataFrame) -> DataFrame:
    """(transition, n): how often the log fires each visible transition, 0 included."""
    rows = replay_variants(variants(log), net_of(model)).select("count", F.explode("fired").alias("transition"))
    counted = rows.groupBy("transition").agg(F.sum("count").alias("n"))
    visible = model.where("kind = 'transition' and label is not null").select(F.col("name").alias("transition"))
    return visible.join(counted, "transition", "left").fillna(0, ["n"])


def generalization(log: DataFrame, model: DataFrame) -> DataFrame:
    """One row: 1 less the mean over visible transitions of 1 / sqrt(times fired), 1 for those never fired; 1 for a net without any."""
    found = firings(log, model).agg(F.avg(F.when(F.col("n") > 0, 1 / F.sqrt("n")).otherwise(1.0)).alias("penalty"))
    return found.select(F.round(1 - F.coalesce("penalty", F.lit(0.0)), 9).alias("generalization"))


def filter_by_fitness(log: DataFrame, model: DataFrame, least: float = 0.8) -> DataFrame:
    """Cases whose replay fitness is ``least`` or more."""
    return log.join(replay(log, model).where(F.col("fitness") >= least).select("case_id"), "case_id", "left_semi")


def partition_by_fitness(log: DataFrame, model: DataFrame, least: float = 1.0) -> DataFrame:
    """(case_id, fitness, fitting): which side of ``least`` a case is on."""
    return replay(log, model).select("case_id", "fitness", (F.col("fitness") >= least).alias("fitting"))


def activity_fitness(log: DataFrame, model: DataFrame) -> DataFrame:
    """(activity, fitness): the mean fitness of the cases that hold the activity, from weighted variants."""
    rows = replay_variants(variants(log), net_of(model)).withColumn("fitness", token_fitness(*(F.col(c) for c in _COUNTS[:4])))
    held = rows.select(F.explode(F.array_distinct("acts")).alias("activity"), "count", "fitness")
    return held.groupBy("activity").agg(F.round(F.sum(F.col("count") * F.col("fitness")) / F.sum("count"), 9).alias("fitness"))


def fitness_histogram(log: DataFrame, model: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): cases in even bins of fitness, the last one closed; empty bins too."""
    rows = replay_variants(variants(log), net_of(model))
    # a fitness of exactly one bin's edge must not fall below it by rounding
    place = F.least(F.floor(F.round(token_fitness(*(F.col(c) for c in _COUNTS[:4])) * bins, 9)), F.lit(bins - 1))
    counted = rows.groupBy(place.alias("bin")).agg(F.sum("count").alias("n"))
    every = log.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counted, "bin", "left").fillna(0, ["n"]).select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "n")


def align(log: DataFrame, model: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(case_id, status, cost, bound, fitness, fit, moves): a cheapest alignment of every case with a run of the model.

    A move on both costs 0, on the log or a labelled transition alone 10,000, on a silent transition 1. Fitness is 1 less
    cost over 10,000 an event, at least 0; an empty case fits; fit means cost 0. ``moves`` are (log, model) with >> where one stands still.

    ``status`` is ``optimal``; or ``impossible`` where no run of the model ends: cost and bound are null then, fitness 0. A search of more
    than ``most`` states is ``unfinished``: cost, fitness, fit and moves are null, and ``bound`` is what any alignment costs at least. Variants that share
    a task share what was worked out for the net.
    """
    found = net_of(model)

    def run(batches):
        move = pa.struct([("log", pa.string()), ("model", pa.string())])
        own = Aligner(found)
        for batch in batches:
            rows = [own.align(acts, most) for acts in batch.column("acts").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("acts"), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([None if r[0] == "impossible" else r[2] for r in rows], pa.int64()),
                pa.array([None if r[3] is None else [{"log": a, "model": b} for a, b in r[3]] for r in rows], pa.list_(move)),
            ], ["acts", "status", "cost", "bound", "moves"])

    cases = traces(log).select("case_id", "acts")
    context = log.sparkSession.sparkContext
    # searches are long and rows are short, so variants are dealt out by number and not by size
    made = cases.select("acts").distinct().repartition(2 * context.defaultParallelism).mapInArrow(run, "acts array<string>, status string, cost long, bound long, moves array<struct<log:string,model:string>>")
    share = F.when(F.col("status") == "impossible", 0.0).when(F.col("status") == "unfinished", None).when(F.size("acts") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("cost") / (10_000.0 * F.size("acts"))))
    fit = F.when(F.col("status") != "unfinished", F.coalesce(F.col("cost") == 0, F.lit(False)))
    return cases.join(made, "acts").select("case_id", "status", "cost", "bound", share.alias("fitness"), fit.alias("fit"), "moves")
