"""Running totals along an order, spread over tasks: within blocks by windows, and over the blocks before by their totals.

A window from the first row of a key on is one task for the key, however many rows it has. Here rows are range-partitioned by key and order, so a key of
many rows lies in many blocks; windows run within blocks, and the totals of blocks, one row for each key and block, are summed up in a second, small window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.sources.tables import stored

#: What a running value is made of: the aggregate, and how two of them go together.
SUM: tuple[Callable, Callable] = (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
MAX: tuple[Callable, Callable] = (F.max, F.greatest)
MIN: tuple[Callable, Callable] = (F.min, F.least)


def blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` stored in blocks that follow the order of keys and ``order``; rows alike in both are in one block."""
    return stored(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()), "blocks")


def scanned(rows: DataFrame, keys: list[str], order: list[str], peers: bool = False, before_only: bool = False, **values: tuple[tuple[Callable, Callable], Column]) -> DataFrame:
    """``rows`` of :func:`blocks` with running values: each a kind (SUM, MAX or MIN) of a column from the key's first row to this one.

    With ``peers`` rows alike in ``order`` (then one number) have the value of the last of them; with ``before_only`` a row's own value
    does not count, so the first has null (a sum 0). Nulls are passed over.
    """
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    within = within.rangeBetween(Window.unboundedPreceding, 0) if peers else within.rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*(kind[0](column).alias(name) for name, (kind, column) in values.items()))
    earlier = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_at"), *(values[name][0][0](name).over(before).alias(f"_{name}") for name in values))
    inner = rows.withColumns({name: kind[0](column).over(within) for name, (kind, column) in values.items()})
    on = F.col("_block") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = inner.join(earlier, on)
    return both.withColumns({name: kind[1](F.col(f"_{name}"), F.col(name)) for name, (kind, _) in values.items()}).drop("_at", *(f"_{k}" for k in keys), *(f"_{name}" for name in values))


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median): the exact median of the values that are not null, the mean of the middle two of an even number.

    Equal values are counted ahead of the shuffle; the middle ones are found by running counts, so no group is held in one place.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    places = scanned(blocks(counted, keys, ["_value"]), keys, ["_value"], _to=(SUM, F.col("_n")))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("n"))
    named = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), "n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = places.join(named, on)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda place: (F.col("_to") >= place) & (F.col("_to") - F.col("_n") < place)
    middle = both.where(holds(low) | holds(high)).withColumn("_times", holds(low).cast("int") + holds(high).cast("int"))
    return middle.groupBy(*keys, "n").agg((F.sum(F.col("_value").cast("double") * F.col("_times")) / 2).alias("median"))
