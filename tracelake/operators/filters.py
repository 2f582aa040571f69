"""Filters that keep or cut whole cases.

Conditions on a case's events are window aggregates over the partitioning by case, so a chain of filters
adds no shuffle to the one that formed the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.sources.logs import parsed_millis, traces


def case():
    return Window.partitionBy("case_id")


def _where(log: DataFrame, condition: Column) -> DataFrame:
    return log.withColumn("_keep", condition).where("_keep").drop("_keep")


def start_activities(log: DataFrame, names: list[str]) -> DataFrame:
    return _where(log, F.min_by("activity", "event_idx").over(case()).isin(*names))


def end_activities(log: DataFrame, names: list[str]) -> DataFrame:
    return _where(log, F.max_by("activity", "event_idx").over(case()).isin(*names))


def _ends(log: DataFrame, a: str, b: str) -> DataFrame:
    first = F.min(F.when(F.col("activity") == a, F.col("event_idx"))).over(case())
    last = F.max(F.when(F.col("activity") == b, F.col("event_idx"))).over(case())
    return log.withColumn("_first", first).withColumn("_last", last)


def between(log: DataFrame, a: str, b: str) -> DataFrame:
    """From the first ``a`` to the last ``b``; cases without both in that order go. Places stay as they were."""
    return _ends(log, a, b).where("_first <= _last and event_idx between _first and _last").drop("_first", "_last")


def trim(log: DataFrame, a: str, b: str) -> DataFrame:
    """As :func:`between`, but a case with its last ``b`` before its first ``a`` stays whole."""
    return _ends(log, a, b).where("_first > _last or event_idx between _first and _last").drop("_first", "_last")


def prefix(log: DataFrame, names: list[str]) -> DataFrame:
    """Cases that begin with ``names``."""
    keep = [F.count_if((F.col("event_idx") == k) & (F.col("activity") == name)).over(case()) for k, name in enumerate(names)]
    return _where(log, sum(keep, F.lit(0)) == len(names))


def suffix(log: DataFrame, names: list[str]) -> DataFrame:
    """Cases that end with ``names``."""
    from_end = F.max("event_idx").over(case()) - F.col("event_idx")
    rows = log.withColumn("_end", from_end)
    keep = [F.count_if((F.col("_end") == k) & (F.col("activity") == name)).over(case()) for k, name in enumerate(reversed(names))]
    return _where(rows, sum(keep, F.lit(0)) == len(names)).drop("_end")


def directly_follows(log: DataFrame, a: str, b: str) -> DataFrame:
    """Cases where ``b`` comes right after an ``a``."""
    rows = log.withColumn("_next", F.lead("activity").over(case().orderBy("event_idx")))
    return _where(rows, F.max((F.col("activity") == a) & F.coalesce(F.col("_next") == b, F.lit(False))).over(case())).drop("_next")


def eventually_follows(log: DataFrame, a: str, b: str) -> DataFrame:
    """Cases with a ``b`` at or after their first ``a``."""
    return _ends(log, a, b).where("_first <= _last").drop("_first", "_last")


def case_size(log: DataFrame, least: int, most: int = 0) -> DataFrame:
    """Cases of ``least`` to ``most`` events (0: no upper bound)."""
    n = F.count("*").over(case())
    return _where(log, (n >= least) & (n <= most) if most else n >= least)


def _ms(moment: int | str) -> Column:
    return parsed_millis(F.lit(moment)) if isinstance(moment, str) else F.lit(moment)


def time_range(log: DataFrame, start_ms: int | str, end_ms: int | str, grain: str = "case") -> DataFrame:
    """Cases with any event in the closed range, whole; with ``grain="event"`` those events alone. Bounds are epoch
    milliseconds or ISO timestamps; one that cannot be read keeps nothing."""
    inside = F.col("ts_ms").between(_ms(start_ms), _ms(end_ms))
    return log.where(inside) if grain == "event" else _where(log, F.max(F.coalesce(inside, F.lit(False))).over(case()))


def event_attribute(log: DataFrame, key: str, values: list[str], positive: bool = True) -> DataFrame:
    """Cases with (or, not positive, without) an event whose attribute is among ``values``."""
    value = F.col("activity") if key == "concept:name" else F.col("attributes")[key]
    found = F.max(F.coalesce(value.isin(*values), F.lit(False))).over(case())
    return _where(log, found if positive else ~found)


def contains(log: DataFrame, activity: str) -> DataFrame:
    return event_attribute(log, "concept:name", [activity])


def case_ids(log: DataFrame, values: list[str], positive: bool = True) -> DataFrame:
    return log.where(F.col("case_id").isin(*values) if positive else ~F.col("case_id").isin(*values))


def truncate(log: DataFrame, k: int) -> DataFrame:
    """The first ``k`` events of each case."""
    return log.where(F.col("event_idx") < k)


def sample_cases(log: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` cases: those of the smallest MD5 of seed and id, so a run can be repeated anywhere."""
    chosen = log.select("case_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "case_id")), "case_id").limit(n)
    return log.join(chosen, "case_id", "left_semi")


def top_variants(log: DataFrame, k: int) -> DataFrame:
    """Cases of the ``k`` most frequent variants, ties in order of the variant."""
    cases = traces(log).select("case_id", "acts")
    best = cases.groupBy("acts").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "acts").limit(k)
    return log.join(cases.join(best, "acts", "left_semi"), "case_id", "left_semi")


def variant_coverage(log: DataFrame, share: float) -> DataFrame:
    """Cases of the most frequent variants that together first reach ``share`` of all cases.

    Counts are few: variants of one count are summed before the running total, and only those of the
    count where the share is reached are put in order.
    """
    cases = traces(log).select("case_id", "acts")
    counted = cases.groupBy("acts").agg(F.count("*").alias("n"))
    by_count = counted.groupBy("n").agg(F.sum("n").alias("cases"))
    running = by_count.select("n", (F.sum("cases").over(Window.orderBy(F.desc("n"))) - F.col("cases")).alias("before"), F.sum("cases").over(Window.partitionBy()).alias("total"))
    ranked = counted.join(running, "n").where(F.col("before") < share * F.col("total"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("acts")) - 1
    best = ranked.withColumn("place", place).where((F.col("before") + F.col("place") * F.col("n") < share * F.col("total")) | ((F.col("before") == 0) & (F.col("place") == 0)))
    return log.join(cases.join(best, "acts", "left_semi"), "case_id", "left_semi")


def project(log: DataFrame, names: list[str]) -> DataFrame:
    """Only the attributes ``names``."""
    return log.withColumn("attributes", F.map_filter("attributes", lambda k, _: k.isin(*names)))


def relabel(log: DataFrame, names: dict[str, str]) -> DataFrame:
    new = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return log.withColumn("activity", F.coalesce(F.try_element_at(new, F.col("activity")), "activity"))


def sort_by_time(log: DataFrame) -> DataFrame:
    """Places anew in order of time, unknown times last, else as before."""
    place = F.row_number().over(case().orderBy(F.asc_nulls_last("ts_ms"), "event_idx")) - 1
    return log.withColumn("event_idx", place.cast("long"))
