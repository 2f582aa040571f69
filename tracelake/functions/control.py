"""Smoothing and control charts over series (key, pos, value), as window expressions."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions.scans import SUM, blocks, scanned


def order():
    return Window.partitionBy("key").orderBy("pos")


#: Values folded one after the other; longer series are folded block by block.
BLOCK = 64


def folded(rows: DataFrame, columns: dict[str, str], alpha: float) -> DataFrame:
    """``rows`` (key, pos, _nth) with columns smoothed under other names; ``_nth`` counts a key's values so far, from 1, 0 before the first.

    A key is cut into blocks. Each row folds its own block from its beginning; each block's end goes to the blocks after it, as far as a double holds
    its weight, and is folded there. So no key is gathered or walked by one task, and nothing that a double can tell is left out, whatever ``alpha`` in (0, 1].
    """
    keep = 1 - alpha
    whole = keep**BLOCK
    on = 1 if whole < 2.0**-60 else ceil(60 * log(2) / -log(whole)) + 1
    fold = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: x + keep * s)
    rows = rows.withColumn("_group", F.floor(F.greatest(F.col("_nth") - 1, F.lit(0)) / BLOCK))
    within = Window.partitionBy("key", "_group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.when(F.col("_nth") == 1, 1.0).otherwise(alpha)
    rows = rows.withColumns({out: fold(F.collect_list(F.col(c).cast("double") * weight).over(within)) for c, out in columns.items()})
    ends = rows.groupBy("key", "_group").agg(F.max_by(F.struct(*columns.values()), "pos").alias("end"))
    later = ends.select("key", "end.*", F.explode(F.sequence(F.lit(1), F.lit(on))).alias("far"), "_group").withColumn("_group", F.col("_group") + F.col("far"))
    before = later.groupBy("key", "_group").agg(*(F.sum(F.col(out) * F.pow(F.lit(whole), F.col("far") - 1)).alias(f"_{out}") for out in columns.values()))
    both = rows.join(before, ["key", "_group"], "left")
    left = F.pow(F.lit(keep), F.col("_nth") - F.col("_group") * BLOCK)
    return both.withColumns({out: F.when(F.col("_nth") > 0, F.col(out) + left * F.coalesce(f"_{out}", F.lit(0.0))) for out in columns.values()}).drop("_group", *(f"_{out}" for out in columns.values()))


def ewma(series: DataFrame, alpha: float = 0.2) -> DataFrame:
    """``series`` with ``ewma``: the first value starts it, null values are passed over (null before the first). See :func:`folded`."""
    rows = scanned(blocks(series, ["key"], ["pos"]), ["key"], ["pos"], _nth=(SUM, F.col("value").isNotNull().cast("long")))
    return folded(rows, {"value": "ewma"}, alpha).select(*series.columns, "ewma")


def moving_average(series: DataFrame, width: int = 5) -> DataFrame:
    return series.withColumn("average", F.round(F.avg("value").over(order().rowsBetween(1 - width, 0)), 9))


def extrema(series: DataFrame) -> DataFrame:
    """(key, pos, value, kind): values above (peak) or below (trough) both neighbours."""
    before, after = F.lag("value").over(order()), F.lead("value").over(order())
    kind = F.when((F.col("value") > before) & (F.col("value") > after), "peak").when((F.col("value") < before) & (F.col("value") < after), "trough")
    return series.withColumn("kind", kind).where("kind is not null")


def rate_of_change(series: DataFrame) -> DataFrame:
    before = F.lag("value").over(order())
    return series.withColumn("change", F.when(before != 0, F.round((F.col("value") - before) / before, 9)))


def limits(series: DataFrame, sample: int = 30, sigmas: float = 3.0) -> DataFrame:
    """(key, center, upper, lower) from the first ``sample`` values, keys with fewer left out; the lower limit is at least 0."""
    found = series.where(F.col("pos") < sample).groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("center"), F.stddev_pop("value").alias("sd")).where(F.col("n") == sample)
    return found.select("key", "center", (F.col("center") + sigmas * F.col("sd")).alias("upper"), F.greatest(F.lit(0.0), F.col("center") - sigmas * F.col("sd")).alias("lower"))


def _runs(condition: Column, width: int) -> Column:
    return F.count_if(condition).over(order().rowsBetween(1 - width, 0))


def drift(series: DataFrame, sample: int = 30, sigmas: float = 3.0) -> DataFrame:
    """(key, pos, distance, rules, severity) of values that break a Western Electric rule.

    1: beyond 3 sigma. 2: two of three beyond 2 on the point's side. 3: four of five beyond 1 on its side. 4: eight on
    one side. 5: six strictly rising or falling, from the eighth value on. 6: fourteen alternating.
    """
    rows = series.join(limits(series, sample, sigmas), "key")
    width = (F.col("upper") - F.col("lower")) / (2 * sigmas)
    rows = rows.withColumn("distance", F.when(width > 0, (F.col("value") - F.col("center")) / width).otherwise(0.0))
    step = F.signum(F.col("value") - F.lag("value").over(order()))
    rows = rows.withColumn("step", step).withColumn("turn", F.col("step") * F.lag("step").over(order()) < 0)
    d, up = F.col("distance"), F.col("distance") > 0
    side = lambda far, width: F.when(up, _runs(d > far, width)).otherwise(_runs(d < -far, width))
    rules = F.array_compact(F.array(
        F.when(F.abs(d) > 3, 1), F.when((F.abs(d) > 2) & (side(2, 3) >= 2), 2), F.when((F.abs(d) > 1) & (side(1, 5) >= 4), 3), F.when(F.greatest(_runs(d > 0, 8), _runs(d < 0, 8)) == 8, 4),
        F.when((F.col("pos") >= 7) & (F.greatest(_runs(F.col("step") == 1, 5), _runs(F.col("step") == -1, 5)) == 5), 5), F.when(_runs(F.col("turn"), 12) == 12, 6),
    ))
    far = F.abs(d)
    severity = F.when(far > 4, "critical").when(far > 3, "severe").when(far > 2, "moderate").otherwise("minor")
    rows = rows.select("key", "pos", F.round(d, 6).alias("distance"), F.array_join(rules, ",").alias("rules"), severity.alias("severity"))
    return rows.where("rules != ''")
