"""Statistics of a log, each one or two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions.scans import exact_median
from tracelake.sources.logs import traces, variants


def in_case():
    return Window.partitionBy("case_id").orderBy("event_idx")


def variant():
    return F.array_join("acts", ">").alias("variant")


def start_activities(log: DataFrame) -> DataFrame:
    return log.where("event_idx = 0").groupBy("activity").agg(F.count("*").alias("n"))


def end_activities(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.max_by("activity", "event_idx").alias("activity")).groupBy("activity").agg(F.count("*").alias("n"))


def variant_counts(log: DataFrame) -> DataFrame:
    """(variant, n, percentage): activities joined by >."""
    return _counted(log).select(variant(), "n", "percentage")


def _counted(log: DataFrame) -> DataFrame:
    found = variants(log).select("acts", F.col("count").alias("n"))
    return found.join(F.broadcast(found.agg(F.sum("n").alias("total")))).select("acts", "n", (100.0 * F.col("n") / F.col("total")).alias("percentage"))


def top_variants(log: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent, ties in order of the variant."""
    return _counted(log).orderBy(F.desc("n"), "acts").limit(k).select(variant(), "n", (F.col("percentage") / 100).alias("frequency"))


def _spans(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.min_by("ts_ms", "event_idx").alias("first"), F.max_by("ts_ms", "event_idx").alias("last"), F.count("*").alias("n"))


def case_durations(log: DataFrame) -> DataFrame:
    """(case_id, duration_ms): last minus first event by place, of cases with two events and both times."""
    return _spans(log).where("n >= 2 and first is not null and last is not null").select("case_id", (F.col("last") - F.col("first")).alias("duration_ms"))


def variant_durations(log: DataFrame) -> DataFrame:
    """(variant, n, total_ms, avg_ms, min_ms, max_ms): durations above 0 alone, 0 where there are none."""
    acts = F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "activity"))), lambda e: e["activity"])
    rows = log.groupBy("case_id").agg(acts.alias("acts"), F.min_by("ts_ms", "event_idx").alias("first"), F.max_by("ts_ms", "event_idx").alias("last"))
    long = F.when(F.col("last") > F.col("first"), F.col("last") - F.col("first"))
    none = F.lit(0).cast("long")
    found = rows.groupBy("acts").agg(F.count("*").alias("n"), F.coalesce(F.sum(long), none).alias("total_ms"), F.coalesce(F.round(F.avg(long), 3), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.min(long), none).alias("min_ms"), F.coalesce(F.max(long), none).alias("max_ms"))
    return found.select(variant(), "n", "total_ms", "avg_ms", "min_ms", "max_ms")


def event_attributes(log: DataFrame) -> DataFrame:
    """(attribute, occurrences, distinct_values)."""
    return log.select(F.explode("attributes").alias("attribute", "value")).where("value is not null").groupBy("attribute").agg(F.count("*").alias("occurrences"), F.count_distinct("value").alias("distinct_values"))


def case_attributes(log: DataFrame) -> DataFrame:
    """(attribute, occurrences, distinct_values) of the case id and of the number of events."""
    sizes = log.groupBy("case_id").agg(F.count("*").alias("n"))
    both = sizes.agg(F.count("*").alias("cases"), F.count_distinct("n").alias("sizes"))
    rows = F.array(F.struct(F.lit("case_id").alias("attribute"), F.col("cases").alias("occurrences"), F.col("cases").alias("distinct_values")), F.struct(F.lit("event_count").alias("attribute"), F.col("cases").alias("occurrences"), F.col("sizes").alias("distinct_values")))
    return both.select(F.inline(rows))


def attribute_values(log: DataFrame, key: str) -> DataFrame:
    """(value, n) of one attribute; ``concept:name`` is the activity."""
    value = F.col("activity") if key == "concept:name" else F.col("attributes")[key]
    return log.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def rework_times(log: DataFrame) -> DataFrame:
    """(case_id, activity, gap_ms): times above 0 between successive events of one activity in a case."""
    before = F.lag("ts_ms").over(Window.partitionBy("case_id", "activity").orderBy("event_idx"))
    return log.select("case_id", "activity", (F.col("ts_ms") - before).alias("gap_ms")).where("gap_ms > 0")


def minimum_self_distances(log: DataFrame) -> DataFrame:
    """(activity, min_ms): the least time above 0 between neighbouring equal activities."""
    rows = log.select("activity", "ts_ms", F.lead("activity").over(in_case()).alias("next"), F.lead("ts_ms").over(in_case()).alias("next_ms"))
    return rows.where("activity = next and next_ms > ts_ms").groupBy("activity").agg(F.min(F.col("next_ms") - F.col("ts_ms")).alias("min_ms"))


def rework_per_activity(log: DataFrame, strict: bool = False) -> DataFrame:
    """(activity, rework, total): repeated events among all events; ``strict``: cases with a repeat among cases."""
    per_case = log.groupBy("activity", "case_id").agg(F.count("*").alias("n"))
    if strict:
        return per_case.groupBy("activity").agg(F.count_if(F.col("n") > 1).alias("rework"), F.count("*").alias("total"))
    return per_case.groupBy("activity").agg((F.sum("n") - F.count("*")).alias("rework"), F.sum("n").alias("total"))


def case_overlap(log: DataFrame) -> DataFrame:
    """(overlap): the sum of squared shares of the prefixes as long as the shortest case; 1 for one case."""
    found = variants(log)
    least = found.agg(F.min(F.size("acts")).alias("least"), F.sum("count").alias("total"))
    heads = found.join(F.broadcast(least)).groupBy(F.slice("acts", 1, F.col("least")).alias("head"), "total").agg(F.sum("count").alias("n"))
    return heads.agg(F.round(F.coalesce(F.sum(F.pow(F.col("n") / F.col("total"), 2)), F.lit(1.0)), 9).alias("overlap"))


def prefixes(log: DataFrame) -> DataFrame:
    """(prefix, n): every prefix of every case, made from weighted variants."""
    rows = variants(log).select("acts", "count", F.explode(F.sequence(F.lit(1), F.size("acts"))).alias("k"))
    found = rows.groupBy(F.slice("acts", 1, F.col("k")).alias("acts")).agg(F.sum("count").alias("n"))
    return found.select(F.array_join("acts", ">").alias("prefix"), "n")


def performance_stats(log: DataFrame) -> DataFrame:
    """One row: cases, events, mean, least, greatest and median duration, largest case, events per case; the median is found by ranks over blocks."""
    spans = _spans(log).withColumn("took", F.when(F.col("n") >= 2, F.col("last") - F.col("first")))
    known = F.col("took")
    found = spans.agg(F.count("*").alias("cases"), F.sum("n").alias("events"), F.round(F.avg(known), 3).alias("avg_ms"), F.min(known).alias("min_ms"), F.max(known).alias("max_ms"), F.max("n").alias("max_events"), F.round(F.avg("n"), 6).alias("events_per_case"))
    middle = exact_median(spans.select("took", F.lit(0).alias("all")), ["all"], "took").select("all", F.col("median").alias("median_ms"))
    return found.withColumn("all", F.lit(0)).join(middle, "all", "left").drop("all")


def case_arrival(log: DataFrame, strict: bool = False) -> DataFrame:
    """(rate): cases an hour over the span between the shortest and longest duration; ``strict``: of start times."""
    spans = _spans(log)
    value = F.col("first") if strict else F.when(F.col("n") >= 2, F.col("last") - F.col("first"))
    found = spans.agg(F.count("*").alias("cases"), F.count(value).alias("known"), (F.max(value) - F.min(value)).alias("span"))
    return found.select(F.when((F.col("known") >= 2) & (F.col("span") > 0), F.round(F.col("cases") / (F.col("span") / 3_600_000.0), 6)).otherwise(0.0).alias("rate"))


def log_stats(log: DataFrame) -> DataFrame:
    """One row: traces, events, activities, variants, average, least and greatest length."""
    cases = traces(log)
    distinct = log.agg(F.count_distinct("activity").alias("activities"))
    found = cases.agg(F.count("*").alias("traces"), F.sum("n").alias("events"), F.count_distinct("acts").alias("variants"), F.round(F.avg("n"), 6).alias("avg_len"), F.min("n").alias("min_len"), F.max("n").alias("max_len"))
    return found.join(F.broadcast(distinct))


def activities(log: DataFrame) -> DataFrame:
    return log.select("activity").distinct()
