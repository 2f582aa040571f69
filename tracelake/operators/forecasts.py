"""Features and simple predictions over cases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.sources.tables import stored


def trace_features(log: DataFrame) -> DataFrame:
    """(case_id, length, distinct_acts, duration_ms, first_idx, last_idx): indexes in the sorted alphabet."""
    names = log.select("activity").distinct().withColumn("idx", F.row_number().over(Window.orderBy("activity")) - 1)  # the alphabet
    rows = log.join(names, "activity")
    return rows.groupBy("case_id").agg(F.count("*").alias("length"), F.count_distinct("activity").alias("distinct_acts"), F.coalesce(F.max_by("ts_ms", "event_idx") - F.min_by("ts_ms", "event_idx"), F.lit(0)).alias("duration_ms"), F.min_by("idx", "event_idx").cast("long").alias("first_idx"), F.max_by("idx", "event_idx").cast("long").alias("last_idx"))


def remaining_time(log: DataFrame) -> DataFrame:
    """(case_id, event_idx, predicted_s): least squares of the rest on the share of the case's time that has passed, over all
    events of cases that take time, for each of those events; at least 0."""
    case = Window.partitionBy("case_id")
    rows = log.select("case_id", "event_idx", "ts_ms", F.min("ts_ms").over(case).alias("start"), F.max("ts_ms").over(case).alias("end")).where("end > start and ts_ms is not null")
    rows = rows.select("case_id", "event_idx", ((F.col("ts_ms") - F.col("start")) / (F.col("end") - F.col("start"))).alias("passed"), ((F.col("end") - F.col("ts_ms")) / 1000.0).alias("rest"))
    line = rows.agg(F.regr_slope("rest", "passed").alias("slope"), F.regr_intercept("rest", "passed").alias("base"))
    return rows.join(F.broadcast(line)).select("case_id", "event_idx", F.round(F.greatest(F.lit(0.0), F.col("base") + F.col("slope") * F.col("passed")), 3).alias("predicted_s"))


def duration_trend(log: DataFrame, steps: int = 5) -> DataFrame:
    """(step, predicted_s, slope, r2, direction): a line through the durations by rank of the cases' start, its next ``steps`` values.

    Cases rank by start, then id, within their hour, after the cases of all hours before, so no task ranks them all.
    """
    cases = log.groupBy("case_id").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end")).where("start is not null")
    cases = cases.withColumn("hour", F.floor(F.col("start") / 3_600_000))
    hours = cases.groupBy("hour").agg(F.count("*").alias("n"))
    hours = hours.select("hour", (F.sum("n").over(Window.orderBy("hour")) - F.col("n")).alias("before"))  # one row an hour
    within = F.row_number().over(Window.partitionBy("hour").orderBy("start", "case_id")) - 1
    ranked = cases.withColumn("within", within).join(hours, "hour").select((F.col("before") + F.col("within")).cast("double").alias("x"), ((F.col("end") - F.col("start")) / 1000.0).alias("value"))
    line = ranked.agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("base"), F.regr_r2("value", "x").alias("r2"), F.count("*").alias("n"))
    way = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    ahead = line.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    return ahead.select("step", F.round(F.col("base") + F.col("slope") * (F.col("n") + F.col("step") - 1), 2).alias("predicted_s"), F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), way.alias("direction"))


def arrivals(log: DataFrame) -> DataFrame:
    """(bucket, n): cases that start in each hour that has any."""
    cases = log.groupBy("case_id").agg(F.min("ts_ms").alias("start"))
    return cases.groupBy(F.floor(F.col("start") / 3_600_000).alias("bucket")).agg(F.count("*").alias("n"))


def arrival_forecast(log: DataFrame) -> DataFrame:
    """(slope, intercept, next): a line through the arrivals by rank of hour, and its next value, at least 0."""
    ranked = arrivals(log).withColumn("x", F.row_number().over(Window.orderBy("bucket")) - 1)  # one row an hour
    line = ranked.agg(F.regr_slope("n", "x").alias("slope"), F.regr_intercept("n", "x").alias("intercept"), F.count("*").alias("hours"))
    return line.select(F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("hours")), 6).alias("next"))


def seasonality(log: DataFrame, period: int | None = None) -> DataFrame:
    """(phase, seasonal): additive decomposition of the arrivals by rank of hour.

    The trend is the centred moving average of ``period`` hours (by default a quarter of them, two at least; an even period takes
    half of both ends), where it fits; what is left over is averaged by phase and centred on 0.
    """
    hours = arrivals(log).withColumn("x", F.row_number().over(Window.orderBy("bucket")) - 1)  # one row an hour
    period = period or max(2, hours.count() // 4)
    half, along = period // 2, Window.orderBy("x")
    mean = lambda first, last: F.avg("n").over(along.rowsBetween(first, last))
    trend = mean(-half, half) if period % 2 else (mean(-half, half - 1) + mean(1 - half, half)) / 2
    hours = hours.withColumn("trend", trend).withColumn("hours", F.count("*").over(Window.partitionBy())).where((F.col("x") >= half) & (F.col("x") < F.col("hours") - half))
    phases = hours.groupBy((F.col("x") % period).cast("long").alias("phase")).agg(F.avg(F.col("n") - F.col("trend")).alias("value"))
    return phases.select("phase", F.round(F.col("value") - F.avg("value").over(Window.partitionBy()), 6).alias("seasonal"))


_FEATURES = ("length", "distinct_acts", "duration_ms", "first_idx", "last_idx")


def anomalies(log: DataFrame, eps: float = 0.5) -> DataFrame:
    """(case_id): cases that stand alone: no other within ``eps`` in the five features of a trace, each scaled to 0 to 1.

    Points fall into cells so small that two in one cell are near. Only a point alone in its cell is compared, with the
    cells around it that any near point could be in; their number follows ``eps``, not the cases. Crowded cells are never paired within.
    """
    edge, n = eps / math.sqrt(len(_FEATURES)), len(_FEATURES)
    rows = stored(trace_features(log), "features")  # the log is read once
    ends = rows.agg(*(f(c).alias(f"{k}_{c}") for c in _FEATURES for k, f in (("lo", F.min), ("hi", F.max))))
    scaled = rows.join(F.broadcast(ends)).select("case_id", *(F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0).alias(f"x{k}") for k, c in enumerate(_FEATURES)))
    celled = scaled.select("*", *(F.floor(F.col(f"x{k}") / edge).alias(f"c{k}") for k in range(n)))
    celled = stored(celled, "cells")
    cells = [f"c{k}" for k in range(n)]
    alone = celled.groupBy(*cells).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("case_id", *(f"x{k}" for k in range(n))))).where("n = 1").drop("n")
    # cells around, one feature after the other, each only as long as its nearest corner is within reach
    near = alone.select(F.col("case_id").alias("alone"), *(F.col(f"x{k}").alias(f"a{k}") for k in range(n))).withColumn("least", F.lit(0.0))
    for k in range(n):
        reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col(f"a{k}") - eps) / edge)), F.least(F.floor(F.lit(1 / edge)), F.floor((F.col(f"a{k}") + eps) / edge)))
        near = near.withColumn(f"c{k}", F.explode(reach))
        short = F.greatest(F.lit(0.0), F.col(f"c{k}") * edge - F.col(f"a{k}"), F.col(f"a{k}") - (F.col(f"c{k}") + 1) * edge)
        near = near.withColumn("least", F.col("least") + short * short).where(F.col("least") <= eps * eps * (1 + 1e-9))
    gap = sum((F.pow(F.col(f"a{k}") - F.col(f"x{k}"), 2) for k in range(1, n)), F.pow(F.col("a0") - F.col("x0"), 2))
    # equal points of a cell are one
    points = celled.groupBy(*cells, *(f"x{k}" for k in range(n))).agg(F.min("case_id").alias("case_id"))
    met = near.join(points, cells).where((F.col("alone") != F.col("case_id")) & (gap <= eps * eps)).select(F.col("alone").alias("case_id")).distinct()
    return alone.select("case_id").join(met, "case_id", "left_anti")


def cluster(log: DataFrame, k: int = 3, seed: int = 1) -> DataFrame:
    """(case_id, cluster) by k-means over the unscaled features, at most as many clusters as there are different ones; no rows for an empty log."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = trace_features(log)
    k = min(k, rows.select(rows.columns[1:]).distinct().limit(k).count())
    if k < 2:
        return rows.select("case_id", F.lit(0).alias("cluster"))
    made = VectorAssembler(inputCols=rows.columns[1:], outputCol="features").transform(rows)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(made).transform(made).select("case_id", "cluster")


def next_activity(log: DataFrame, depth: int = 8) -> DataFrame:
    """(case_id, predicted) for the last event of each case, by a decision tree on place, activity and share of the case; no rows where no case has two events."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    order = Window.partitionBy("case_id").orderBy("event_idx")
    rows = log.select("case_id", "activity", "event_idx", (F.col("event_idx") / F.count("*").over(Window.partitionBy("case_id"))).alias("share"), F.lead("activity").over(order).alias("next"))
    if rows.where("next is not null").isEmpty():
        return rows.select("case_id", F.lit(None).cast("string").alias("predicted")).limit(0)
    names = StringIndexer(inputCol="activity", outputCol="idx", stringOrderType="alphabetAsc").fit(rows)
    rows = VectorAssembler(inputCols=["event_idx", "idx", "share"], outputCol="features").transform(names.transform(rows))
    known = names.setInputCol("next").setOutputCol("label").transform(rows.where("next is not null"))
    tree = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(known)
    said = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels).transform(tree.transform(rows.where("next is null")))
    return said.select("case_id", "predicted")
