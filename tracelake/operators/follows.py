"""Directly-follows family: neighbouring events of a case, counted and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions.scans import exact_median
from tracelake.sources.logs import variants


def in_case():
    return Window.partitionBy("case_id").orderBy("event_idx")


def pairs(log: DataFrame) -> DataFrame:
    """(case_id, source, target, gap_ms) of neighbouring events: one window over the case."""
    rows = log.select("case_id", F.col("activity").alias("source"), F.lead("activity").over(in_case()).alias("target"), (F.lead("ts_ms").over(in_case()) - F.col("ts_ms")).alias("gap_ms"))
    return rows.where("target is not null")


def dfg(log: DataFrame) -> DataFrame:
    """(source, target, n)."""
    return pairs(log).groupBy("source", "target").agg(F.count("*").alias("n"))


def performance_dfg(log: DataFrame) -> DataFrame:
    """(source, target, n, avg_ms, min_ms, max_ms): all pairs counted; times over pairs with both stamps, 0 where none has."""
    zero = F.lit(0).cast("long")
    return pairs(log).groupBy("source", "target").agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg("gap_ms"), 3), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.min("gap_ms"), zero).alias("min_ms"), F.coalesce(F.max("gap_ms"), zero).alias("max_ms"))


#: Running counts of so many activities are kept in one pass over the log.
_AT_ONCE = 64


def eventually_follows(log: DataFrame) -> DataFrame:
    """(source, target, n): every ordered pair of places of a case counts.

    Not pairs but running counts: a window over the case counts the events of every activity before each event, and those
    counts are summed by the event's activity. Activities are taken so many a pass, so work follows events times activities.
    """
    names = sorted(r.activity for r in log.select("activity").distinct().collect())  # the alphabet
    before = in_case().rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    for k in range(0, max(len(names), 1), _AT_ONCE):
        some = names[k : k + _AT_ONCE]
        counts = F.array(*(F.count_if(F.col("activity") == a).over(before) for a in some)) if some else F.array().cast("array<bigint>")
        rows = log.select("activity", counts.alias("counts"))
        summed = rows.groupBy(F.col("activity").alias("target")).agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(len(some)))) if some else rows.select(F.col("activity").alias("target")).distinct()
        pairs = F.array(*(F.struct(F.lit(a).alias("source"), F.col(f"n{i}").alias("n")) for i, a in enumerate(some))) if some else F.array().cast("array<struct<source:string,n:bigint>>")
        parts.append(summed.select("target", F.inline(pairs)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0").select("source", "target", "n")


def footprints(log: DataFrame) -> DataFrame:
    """(relation, source, target): ``parallel`` where both orders are seen (a loop is its own reverse), else ``sequence``."""
    edges = dfg(log).select("source", "target")
    back = edges.select(F.col("source").alias("target"), F.col("target").alias("source"), F.lit(True).alias("both"))
    return edges.join(back, ["source", "target"], "left").select(F.when(F.col("both"), "parallel").otherwise("sequence").alias("relation"), "source", "target")


def _with_reverse(log: DataFrame) -> DataFrame:
    edges = dfg(log)
    back = edges.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("n").alias("back"))
    return edges.join(back, ["source", "target"], "left").withColumn("back", F.coalesce("back", F.lit(0)))


def causal_alpha(log: DataFrame) -> DataFrame:
    """(source, target) seen in one order alone."""
    return _with_reverse(log).where("back = 0").select("source", "target")


def causal_heuristic(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, target, strength): share of this order among both, in floored thousandths, from ``threshold`` on."""
    share = F.col("n") / (F.col("n") + F.col("back"))
    return _with_reverse(log).where(share >= threshold).select("source", "target", F.floor(share * 1000).cast("long").alias("strength"))


def dependencies(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, target, dependency, n): (ab - ba) / (ab + ba + 1), from ``threshold`` on; 0 for loops."""
    value = (F.col("n") - F.col("back")) / (F.col("n") + F.col("back") + 1)
    return _with_reverse(log).where(value >= threshold).select("source", "target", F.round(value, 9).alias("dependency"), "n")


def transition_system(log: DataFrame, window: int = 1, direction: str = "forward") -> DataFrame:
    """(source, target, activity, n): states are ``window`` + 1 neighbouring activities, up to (forward) or from the event on; their names are joined when they are counted."""
    frame = in_case().rowsBetween(-window, 0) if direction == "forward" else in_case().rowsBetween(0, window)
    rows = log.select("case_id", "event_idx", "activity", F.collect_list("activity").over(frame).alias("target"))
    rows = rows.select(F.lag("target").over(in_case()).alias("source"), "target", "activity").where("source is not null")
    return rows.groupBy("source", "target", "activity").agg(F.count("*").alias("n")).select(F.array_join("source", ", ").alias("source"), F.array_join("target", ", ").alias("target"), "activity", "n")


def prefix_nodes(log: DataFrame, longest: int | None = None) -> DataFrame:
    """(node, parent, depth, label, n, final): the tree of the cases' prefixes, a row a node; n cases pass it, ``final`` of them end there (or are cut at ``longest``).

    A node is named by its depth and two sums, over the places of its prefix, of 40 bits of a hash of activity and place each (null parent: the root). They are running
    sums within the case, so rows follow events, not the squares of lengths. Prefixes of equal length share both sums with a probability of 2^-80.
    """
    bits = lambda at: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("event_idx").cast("string"), "activity")), at, 10), 16, 10).cast("long")
    so_far = in_case().rowsBetween(Window.unboundedPreceding, 0)
    rows = log if longest is None else log.where(F.col("event_idx") < longest)
    rows = rows.select("case_id", "event_idx", "activity", F.sum(bits(1)).over(so_far).alias("a"), F.sum(bits(11)).over(so_far).alias("b"), bits(1).alias("own_a"), bits(11).alias("own_b"), F.lead("activity").over(in_case()).isNull().alias("last"))
    depth = (F.col("event_idx") + 1).alias("depth")
    found = rows.groupBy(depth, "a", "b").agg(F.first("activity").alias("label"), F.first("own_a").alias("own_a"), F.first("own_b").alias("own_b"), F.count("*").alias("n"), F.count_if("last").alias("final"))
    name = lambda d, a, b: F.concat_ws("-", d, a, b)
    parent = F.when(F.col("depth") > 1, name(F.col("depth") - 1, F.col("a") - F.col("own_a"), F.col("b") - F.col("own_b")))
    return found.select(name(F.col("depth"), F.col("a"), F.col("b")).alias("node"), parent.alias("parent"), F.col("depth").cast("long").alias("depth"), "label", "n", "final")


def prefix_tree(log: DataFrame, longest: int | None = None) -> DataFrame:
    """(prefix, parent, label, depth, final): a node per distinct prefix; final where a (cut) trace ends."""
    cut = F.slice("acts", 1, longest) if longest else F.col("acts")
    rows = variants(log).select(cut.alias("acts")).distinct()
    rows = rows.select("acts", F.explode(F.sequence(F.lit(1), F.size("acts"))).alias("depth"))
    rows = rows.groupBy(F.slice("acts", 1, F.col("depth")).alias("node")).agg(F.max(F.size("acts") == F.col("depth")).alias("final"))
    parent = F.array_join(F.slice("node", 1, F.size("node") - 1), ">")
    return rows.select(F.array_join("node", ">").alias("prefix"), parent.alias("parent"), F.element_at("node", -1).alias("label"), F.size("node").cast("long").alias("depth"), "final")


def performance_spectrum(log: DataFrame, activity: str) -> DataFrame:
    """(next, n, min_ms, max_ms, mean_ms, median_ms) from ``activity`` to what follows it at once; medians are found by ranks over blocks."""
    rows = pairs(log).where((F.col("source") == activity) & F.col("gap_ms").isNotNull()).select(F.col("target").alias("next"), "gap_ms")
    found = rows.groupBy("next").agg(F.count("*").alias("n"), F.min("gap_ms").alias("min_ms"), F.max("gap_ms").alias("max_ms"), F.round(F.avg("gap_ms"), 3).alias("mean_ms"))
    return found.join(exact_median(rows, ["next"], "gap_ms").select("next", F.col("median").alias("median_ms")), "next")


def temporal_profile(log: DataFrame) -> DataFrame:
    """(source, target, mean_ms, stdev_ms, n) over neighbouring pairs with a gap above 0; population deviation."""
    return pairs(log).where("gap_ms > 0").groupBy("source", "target").agg(F.avg("gap_ms").alias("mean_ms"), F.stddev_pop("gap_ms").alias("stdev_ms"), F.count("*").alias("n"))


def temporal_conformance(log: DataFrame, profile: DataFrame, zeta: float = 2.0) -> DataFrame:
    """(case_id, steps, deviations, fitness) against a profile (one row a pair of activities, broadcast by Spark where small)."""
    steps = pairs(log).where("gap_ms > 0").join(profile.drop("n"), ["source", "target"])
    far = F.when(F.col("stdev_ms") > 0, F.abs(F.col("gap_ms") - F.col("mean_ms")) / F.col("stdev_ms")).otherwise(0.0) > zeta
    found = steps.groupBy("case_id").agg(F.count("*").alias("steps"), F.count_if(far).alias("deviations"))
    rows = log.select("case_id").distinct().join(found, "case_id", "left").fillna(0, ["steps", "deviations"])
    return rows.withColumn("fitness", F.when(F.col("steps") > 0, F.round(1 - F.col("deviations") / F.col("steps"), 9)).otherwise(1.0))


def footprint_conformance(log: DataFrame, model: DataFrame) -> DataFrame:
    """(fitness, precision, recall, f1): pairs of the log against those (source, target) of a model, as sets; recall is fitness."""
    seen = dfg(log).select("source", "target", F.lit(1).alias("in_log"))
    both = seen.join(model.select("source", "target").distinct().withColumn("in_model", F.lit(1)), ["source", "target"], "full")
    n = both.agg(F.count("in_log").alias("log"), F.count("in_model").alias("model"), F.count_if(F.col("in_log").isNotNull() & F.col("in_model").isNotNull()).alias("both"))
    ratio = lambda of: F.when(F.col(of) > 0, F.col("both") / F.col(of)).otherwise(1.0)
    n = n.select(ratio("log").alias("fitness"), ratio("model").alias("precision"))
    total = F.col("fitness") + F.col("precision")
    return n.withColumn("f1", F.round(F.when(total > 0, 2 * F.col("fitness") * F.col("precision") / total).otherwise(0.0), 9)).withColumn("fitness", F.round("fitness", 9)).withColumn("precision", F.round("precision", 9)).withColumn("recall", F.col("fitness"))
