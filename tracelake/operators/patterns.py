"""Declarative relations, batches and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions.scans import MAX, SUM, blocks, scanned
from tracelake.sources.logs import variants
from tracelake.sources.tables import stored


def _held(acts: Column) -> Column:
    """array<struct(activity, n, first, last)> of a trace's distinct activities."""
    places = lambda a: F.filter(F.transform(acts, lambda x, i: F.when(x == a, i)), lambda i: i.isNotNull())
    of = lambda a: F.transform(F.array(places(a)), lambda at: F.struct(a.alias("activity"), F.size(at).cast("long").alias("n"), F.get(at, F.lit(0)).cast("long").alias("first"), F.element_at(at, -1).cast("long").alias("last")))[0]
    return F.transform(F.array_distinct(acts), of)


def _occurrences(found: DataFrame) -> DataFrame:
    """(count, activity, n, first, last) of variants (acts, count): one row per variant and activity that it holds, ``count`` its cases."""
    return found.select("count", F.inline(_held(F.col("acts"))))


def _couples(found: DataFrame) -> DataFrame:
    """(count, acts, a, b, ...) for each two activities of a variant, itself included: the alphabet squared a variant, no shuffle."""
    left = found.select("count", "acts", _held(F.col("acts")).alias("held"))
    left = left.select("count", "acts", "held", F.explode("held").alias("x")).select("count", "acts", F.col("x.activity").alias("a"), F.col("x.n").alias("na"), F.col("x.first").alias("fa"), F.col("x.last").alias("la"), F.explode("held").alias("y"))
    return left.select("count", "acts", "a", "na", "fa", "la", F.col("y.activity").alias("b"), F.col("y.n").alias("nb"), F.col("y.first").alias("fb"), F.col("y.last").alias("lb"))


def _cases_if(condition: Column) -> Column:
    """Cases of the variants where the condition holds."""
    return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))


def log_skeleton(log: DataFrame, noise: float = 0.0) -> DataFrame:
    """(relation, a, b): equivalence, always_after, always_before, never_together (a < b) and directly_follows.

    always_after: in the share 1 - noise of cases with a, some b comes after some a; always_before alike.
    equivalence: places where a and b occur equally often, against all events of a. never_together takes
    no noise.
    """
    cases = stored(variants(log), "variants")  # read by every part, the log once
    seen = _occurrences(cases)
    totals = seen.groupBy(F.col("activity").alias("a")).agg(F.sum("count").alias("cases"), F.sum(F.col("count") * F.col("n")).alias("events"))
    per = _couples(cases).groupBy("a", "b").agg(
        F.sum(F.col("count") * F.when(F.col("na") == F.col("nb"), F.col("na") * F.col("nb") - F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(0)).otherwise(0)).alias("equal"),
        _cases_if(F.col("fa") < F.col("lb")).alias("after"),
        _cases_if(F.col("fb") < F.col("la")).alias("before"),
    )
    per = stored(per, "couples")  # a row for each two activities
    size = F.size("acts")
    next_to = F.zip_with(F.slice("acts", 1, size - 1), F.slice("acts", 2, size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = cases.where(size > 1).select("count", F.inline(next_to)).groupBy("a", "b").agg(F.sum("count").alias("follows"))
    rows = per.join(totals, "a").join(edges, ["a", "b"], "left")
    share = 1 - noise
    kinds = F.array_compact(F.array(
        F.when(F.col("equal") >= F.col("events") * share, "equivalence"),
        F.when(F.col("after") >= F.col("cases") * share, "always_after"),
        F.when(F.col("before") >= F.col("cases") * share, "always_before"),
        F.when(F.col("follows") >= F.col("events") * share, "directly_follows"),
    ))
    found = rows.select(F.explode(kinds).alias("relation"), "a", "b")
    names = totals.select("a")
    every = names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))  # of the alphabet, not of events
    never = every.join(per.select("a", "b"), ["a", "b"], "left_anti").select(F.lit("never_together").alias("relation"), "a", "b")
    return found.unionByName(never)


def activity_frequencies(log: DataFrame, noise: float | None = None) -> DataFrame:
    """(activity, n, cases): in how many cases an activity occurs n times, 0 included.

    With ``noise``, of each activity only the most frequent numbers (ties: the smaller first) that together first reach
    the share 1 - noise of all cases.
    """
    found = stored(variants(log), "variants")
    seen = _occurrences(found)
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    some = seen.groupBy("activity", "n").agg(F.sum("count").alias("cases"))
    zero = seen.groupBy("activity").agg(F.sum("count").alias("with")).join(F.broadcast(total)).where("total > with").select("activity", F.lit(0).cast("long").alias("n"), (F.col("total") - F.col("with")).alias("cases"))
    every = some.unionByName(zero)
    if noise is None:
        return every
    ranked = Window.partitionBy("activity").orderBy(F.desc("cases"), "n")  # as many rows as an activity has numbers
    before = F.sum("cases").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cases")
    return every.withColumn("before", before).join(F.broadcast(total)).where(F.col("before") < (1 - noise) * F.col("total")).select("activity", "n", "cases")


def _alternates(acts: Column, a: Column, b: Column) -> Column:
    """Whether between any two of a trace's ``a``, and after the last, there is a ``b``."""
    start = F.struct(F.lit(False).alias("open"), F.lit(True).alias("ok"))
    step = lambda s, x: F.when(x == a, F.struct(F.lit(True).alias("open"), (s["ok"] & ~s["open"]).alias("ok"))).when(x == b, F.struct(F.lit(False).alias("open"), s["ok"].alias("ok"))).otherwise(s)
    return F.aggregate(acts, start, step, lambda s: s["ok"] & ~s["open"])


def declare(log: DataFrame, min_support: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """(template, a, b, support, confidence): rules as shares; b is empty for rules on one activity.

    support: cases where the rule is activated among all; confidence: those of them that satisfy it.
    existence, absence, exactly_one and init are activated in every case; responded_existence, response
    (last a before first b), coexistence and succession by a; precedence by b (first a before first b).
    alternate and chain rules look at every occurrence: a b between any two a's and after the last (alternate_response),
    right after each a (chain_response), and the same backwards from b for the two precedences. The alternate and chain
    successions are the weaker of both. non_coexistence: no case with both, among cases with either.
    Pairs are looked at in weighted variants.
    """
    found = stored(variants(log), "variants")  # read by every part, the log once
    both = _couples(found).where("a != b")
    seen = _occurrences(found)
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    starts = found.groupBy(F.element_at("acts", 1).alias("activity")).agg(F.sum("count").alias("starts"))
    one = seen.groupBy("activity").agg(F.sum("count").alias("with"), _cases_if(F.col("n") == 1).alias("once")).join(starts, "activity", "left").join(F.broadcast(total))
    rule = lambda name, yes: F.struct(F.lit(name).alias("template"), F.lit(1.0).alias("support"), (yes / F.col("total")).alias("confidence"))
    single = one.select("activity", F.inline(F.array(rule("existence", F.col("with")), rule("absence", F.col("total") - F.col("with")), rule("exactly_one", F.col("once")), rule("init", F.coalesce("starts", F.lit(0))))))
    single = single.select("template", F.col("activity").alias("a"), F.lit("").alias("b"), "support", "confidence")

    cases = seen.groupBy("activity").agg(F.sum("count").alias("with"))
    next_is = F.size(F.filter(F.transform("acts", lambda x, i: (x == F.col("a")) & (F.get("acts", i + 1) == F.col("b"))), lambda x: x))
    met = both.withColumn("next", next_is).groupBy("a", "b").agg(
        F.sum("count").alias("both"), _cases_if(F.col("la") < F.col("fb")).alias("response"), _cases_if(F.col("fa") < F.col("fb")).alias("precedence"),
        _cases_if(F.col("next") == F.col("na")).alias("chain_response"), _cases_if(F.col("next") == F.col("nb")).alias("chain_precedence"),
        _cases_if(_alternates(F.col("acts"), F.col("a"), F.col("b"))).alias("alternate_response"), _cases_if(_alternates(F.reverse("acts"), F.col("b"), F.col("a"))).alias("alternate_precedence"),
    )
    met = stored(met, "couples")  # a row for each two activities
    with_a, with_b = cases.select(F.col("activity").alias("a"), F.col("with").alias("wa")), cases.select(F.col("activity").alias("b"), F.col("with").alias("wb"))
    pair = met.join(with_a, "a").join(with_b, "b").join(F.broadcast(total))
    two = lambda name, active, yes: F.struct(F.lit(name).alias("template"), (active / F.col("total")).alias("support"), (yes / active).alias("confidence"))
    wa, wb, yes = F.col("wa"), F.col("wb"), F.col("both")
    weaker = lambda name, response, precedence: F.struct(F.lit(name).alias("template"), (F.least(wa, wb) / F.col("total")).alias("support"), F.least(response / wa, precedence / wb).alias("confidence"))
    rules = F.array(
        two("responded_existence", wa, yes), two("response", wa, F.col("response")), two("precedence", wb, F.col("precedence")),
        two("alternate_response", wa, F.col("alternate_response")), two("alternate_precedence", wb, F.col("alternate_precedence")),
        two("chain_response", wa, F.col("chain_response")), two("chain_precedence", wb, F.col("chain_precedence")),
        weaker("succession", F.col("response"), F.col("precedence")), weaker("alternate_succession", F.col("alternate_response"), F.col("alternate_precedence")),
        weaker("chain_succession", F.col("chain_response"), F.col("chain_precedence")), weaker("coexistence", yes, yes),
    )
    double = pair.select("a", "b", F.inline(rules)).select("template", "a", "b", "support", "confidence")
    # of the alphabet, not of events
    apart = with_a.join(with_b, F.col("a") < F.col("b")).join(met.select("a", "b", "both"), ["a", "b"], "left").fillna(0, ["both"]).join(F.broadcast(total))
    either = wa + wb - yes
    apart = apart.select(F.lit("non_coexistence").alias("template"), "a", "b", (either / F.col("total")).alias("support"), (1 - yes / either).alias("confidence"))
    found = single.unionByName(double).unionByName(apart).where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    return found.select("template", "a", "b", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"))


def without_implied(rules: DataFrame) -> DataFrame:
    """``rules`` of :func:`declare` without those that others among them stand for: the response and precedence of each
    kind of succession that is there, and existence where there is an absence."""
    implied = [("existence", "absence")] + [(kind + part, kind + "succession") for kind in ("", "alternate_", "chain_") for part in ("response", "precedence")]
    by = F.create_map(*(F.lit(x) for pair in implied for x in pair))
    named = rules.withColumn("stands", F.try_element_at(by, F.col("template")))
    kept = rules.select(F.col("template").alias("stands"), "a", "b")
    return named.join(kept, ["stands", "a", "b"], "left_anti").select("template", "a", "b", "support", "confidence")


def batches(log: DataFrame, gap_s: int = 900, least_cases: int = 2, many: int = 5, start_ms: str | None = None) -> DataFrame:
    """(activity, start_s, end_s, cases, events, kind): executions of one activity that overlap or follow one another within ``gap_s`` seconds, of ``least_cases`` cases or more.

    An execution lasts from the column ``start_ms`` (its own time, if none is named or it is null) to its event's time; both in whole seconds, events without a time left out.
    A sweep over starts keeps the latest end so far, a running maximum over blocks, so no activity is one task's. The kind is read off all executions of the activity in
    the cases of the batch: ``parallel`` if all begin and end alike, ``concurrent`` if all begin or all end alike, ``sequential`` if each begins when the one before ends, else
    ``disruptive`` from ``many`` cases on and ``concurrent`` below.
    """
    second = lambda c: F.floor(c / 1000)
    end = F.col("ts_ms")
    start = F.least(end, F.coalesce(F.col(start_ms), end)) if start_ms else end
    rows = log.where("ts_ms is not null").select("activity", "case_id", "event_idx", second(start).alias("s"), second(end).alias("e"))
    order = ["s", "e", "case_id", "event_idx"]
    rows = blocks(rows, ["activity"], order)
    swept = stored(scanned(rows, ["activity"], order, before_only=True, reach=(MAX, F.col("e"))), "swept")
    swept = swept.withColumn("new", F.when(F.col("s") - F.col("reach") <= gap_s, 0).otherwise(1))
    islands = stored(scanned(swept, ["activity"], order, island=(SUM, F.col("new"))).select("activity", "island", "case_id", "s", "e"), "islands")
    found = islands.groupBy("activity", "island").agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.count_distinct("case_id").alias("cases"), F.count("*").alias("events")).where(F.col("cases") >= least_cases)
    members = islands.join(found.select("activity", "island"), ["activity", "island"], "left_semi").select("activity", "island", "case_id").distinct()
    held = blocks(members.join(rows.drop("_block"), ["activity", "case_id"]), ["activity", "island"], order)
    chain = scanned(held, ["activity", "island"], order, before_only=True, previous=(MAX, F.struct(*order)))
    kinds = chain.groupBy("activity", "island").agg(
        (F.min("s") == F.max("s")).alias("one_start"), (F.min("e") == F.max("e")).alias("one_end"), F.bool_and(F.coalesce(F.col("previous.e") == F.col("s"), F.lit(True))).alias("chained")
    )
    kind = F.when(F.col("one_start") & F.col("one_end"), "parallel").when(F.col("one_start") | F.col("one_end"), "concurrent").when(F.col("chained"), "sequential").when(F.col("cases") >= many, "disruptive").otherwise("concurrent")
    return found.join(kinds, ["activity", "island"]).select("activity", "start_s", "end_s", "cases", "events", kind.alias("kind"))


def sessions(log: DataFrame, gap_ms: int = 3_600_000) -> DataFrame:
    """(case_id, sessions): 1 and the gaps over ``gap_ms`` between a case's events."""
    before = F.lag("ts_ms").over(Window.partitionBy("case_id").orderBy("event_idx"))
    rows = log.select("case_id", (F.col("ts_ms") - before > gap_ms).alias("new"))
    return rows.groupBy("case_id").agg((F.count_if("new") + 1).alias("sessions"))


def stream_sessions(log: DataFrame, gap_ms: int = 3_600_000) -> DataFrame:
    """(sessions): 1 and the gaps over ``gap_ms`` between all events in order of time, whatever their case; 0 without a timed event.

    Gaps are counted within each hour, and between the last and first events of hours that follow one another, one row an hour.
    """
    rows = log.where("ts_ms is not null").select("ts_ms", F.floor(F.col("ts_ms") / 3_600_000).alias("hour"))
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("hour").orderBy("ts_ms"))
    hours = rows.withColumn("wide", gap > gap_ms).groupBy("hour").agg(F.count_if("wide").alias("inside"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    between = F.col("first") - F.lag("last").over(Window.orderBy("hour")) > gap_ms
    found = hours.withColumn("between", between).agg(F.count("*").alias("hours"), (F.coalesce(F.sum("inside"), F.lit(0)) + F.count_if("between")).alias("gaps"))
    return found.select(F.when(F.col("hours") > 0, F.col("gaps") + 1).otherwise(0).cast("long").alias("sessions"))


#: Activities whose pairs are looked at in one pass over the events.
_MOST_ACTIVITIES = 2_000


def precedes(log: DataFrame) -> DataFrame:
    """(source, target, share): events of source before the last of target, over the product of both counts; case ids are not read. Pairs without any have no row.

    The last times of all targets, one a target, go along with the pass, and each task counts ahead.
    """
    last = log.groupBy("activity").agg(F.max("ts_ms").alias("last"), F.count("*").alias("n")).limit(_MOST_ACTIVITIES + 1).collect()
    if len(last) > _MOST_ACTIVITIES:
        raise ValueError(f"more than {_MOST_ACTIVITIES} activities: their pairs are too many to be counted")
    targets = sorted((r.activity, r.last, r.n) for r in last if r.last is not None)
    counts = F.array(*(F.struct(F.lit(a).alias("target"), F.lit(n).cast("long").alias("nt"), F.count_if(F.col("ts_ms") < at).alias("n")) for a, at, n in targets)) if targets else F.lit(None).cast("array<struct<target:string,nt:bigint,n:bigint>>")
    counted = log.groupBy(F.col("activity").alias("source")).agg(F.count("*").alias("ns"), counts.alias("counts"))
    return counted.select("source", "ns", F.inline("counts")).where("n > 0").select("source", "target", F.round(F.col("n") / (F.col("ns") * F.col("nt")), 12).alias("share"))
