"""The correlation miner: which activity leads to which, by times alone; case ids are not read.

Of two activities the events of one are matched in order of time with later events of the other, each used once. In that order the k-th event
of the first takes the one whose number is the larger of "one after what the event before took" and "the first one later than it". Written out, its number less k is a running
maximum, so events are matched by running counts and running maxima over blocks of the time line, and no stream of events is gathered.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions.scans import MAX, SUM, blocks, scanned
from tracelake.sources.tables import stored

#: Activities whose pairs may come to the driver.
MOST_ACTIVITIES = 1_000


class Activity(NamedTuple):
    name: str
    n: int
    last: int


def _seconds(log: DataFrame) -> DataFrame:
    """(activity, s): the timed events."""
    return log.where("ts_ms is not null").select("activity", F.floor(F.col("ts_ms") / 1000).alias("s"))


def _alphabet(events: DataFrame) -> list[Activity]:
    rows = events.groupBy("activity").agg(F.count("*").alias("n"), F.max("s").alias("last")).limit(MOST_ACTIVITIES + 1).collect()
    if len(rows) > MOST_ACTIVITIES:
        raise ValueError(f"more than {MOST_ACTIVITIES} activities: their pairs are too many to be held against each other")
    return sorted(Activity(r.activity, r.n, r.last) for r in rows)


def _matched(events: DataFrame, alphabet: list[Activity], threshold: int) -> DataFrame:
    """(first, second, matched, total): matches at most ``threshold`` seconds apart of events of ``first`` with later ones of ``second``, in order of time."""
    counts = {f"c{k}": (SUM, (F.col("activity") == a.name).cast("long")) for k, a in enumerate(alphabet)}
    lines = blocks(events.withColumn("all", F.lit(0)), ["all"], ["s"])
    # how many events of every activity there are up to each time, and each event's own number in its activity
    upto = scanned(lines, ["all"], ["s"], peers=True, **counts).select("activity", "s", "_block", F.array(*counts).alias("upto"))
    numbered = scanned(blocks(events, ["activity"], ["s"]), ["activity"], ["s"], nth=(SUM, F.lit(1).cast("long"))).select("activity", "s", (F.col("nth") - 1).alias("k"))
    numbered = stored(numbered, "numbered")
    times = upto.groupBy("s").agg(F.first("upto").alias("upto"))  # one at a time, the same for all of its events
    firsts = numbered.join(times, "s")
    others = F.array(*(F.struct(F.lit(a.name).alias("second"), F.lit(a.n).cast("long").alias("n_second"), F.get("upto", F.lit(k)).alias("later")) for k, a in enumerate(alphabet)))
    pairs = firsts.select(F.col("activity").alias("first"), "s", "k", F.inline(others)).where("first <> second")
    ordered = blocks(pairs, ["first", "second"], ["k"])
    taken = scanned(ordered, ["first", "second"], ["k"], ahead=(MAX, F.col("later") - F.col("k"))).withColumn("place", F.col("k") + F.col("ahead")).where("place < n_second")
    met = taken.join(numbered.select(F.col("activity").alias("second"), F.col("k").alias("place"), F.col("s").alias("at")), ["second", "place"])
    gap = F.col("at") - F.col("s")
    return met.where(gap <= threshold).groupBy("first", "second").agg(F.count("*").alias("matched"), F.sum(gap).alias("total"))


def correlation_durations(log: DataFrame, threshold: int = 86_400) -> DataFrame:
    """(source, target, fifo, fifo_s, lifo, lifo_s): matches of each two activities within ``threshold`` seconds, and their seconds in all.

    ``fifo`` takes the source's events from the first on, each with the first target later than it that is left; ``lifo`` the target's from the last on, each with the
    last source earlier than it that is left: the same, with time turned round. Pairs without a match have no row; events without a time are left out.
    """
    events = _seconds(log)
    alphabet = _alphabet(events)
    if len(alphabet) < 2:
        return events.select(F.lit("").alias("source"), F.lit("").alias("target"), *(F.lit(0).cast("long").alias(c) for c in ("fifo", "fifo_s", "lifo", "lifo_s"))).limit(0)
    forth = _matched(events, alphabet, threshold).select(F.col("first").alias("source"), F.col("second").alias("target"), F.col("matched").alias("fifo"), F.col("total").alias("fifo_s"))
    back = _matched(events.withColumn("s", -F.col("s")), alphabet, threshold).select(F.col("second").alias("source"), F.col("first").alias("target"), F.col("matched").alias("lifo"), F.col("total").alias("lifo_s"))
    return forth.join(back, ["source", "target"], "full").fillna(0, ["fifo", "fifo_s", "lifo", "lifo_s"])


def _chosen(alphabet: list[Activity], share: dict[tuple[str, str], float], took: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """How many events go along each edge: the cheapest pairs first, as many as both ends have left; pairs whose other direction is nearly as likely are passed over."""
    count = {a.name: a.n for a in alphabet}
    costs = sorted((took.get(e, 0.0) / p / min(count[e[0]], count[e[1]]), e) for e, p in share.items() if p > 0)
    out, into, edges = dict(count), dict(count), {}
    for _, (a, b) in costs:
        n = min(out[a], into[b])
        if n and share.get((b, a), 0.0) < 0.8 * share[a, b]:
            out[a] -= n
            into[b] -= n
            edges[a, b] = n
    return edges


def correlate(log: DataFrame, threshold: int = 86_400, least: int = 1) -> DataFrame:
    """(kind, source, target, n): edges with ``least`` events or more; starts and ends, the activities without an edge into or out of them, with their events; traces, 1 and the gaps over ``threshold`` seconds.

    An edge's cost is the lesser of both mean durations (0 without a match), over the share of source events before the last target over the targets, over the lesser count. What
    comes to the driver has a row for each two activities. A log with fewer than two timed events gives 0 traces alone.
    """
    events = stored(_seconds(log), "seconds")
    alphabet = _alphabet(events)
    rows: list[tuple[str, str | None, str | None, int]] = []
    if sum(a.n for a in alphabet) < 2:
        return log.sparkSession.createDataFrame([("traces", None, None, 0)], _ROWS)
    before = events.groupBy("activity").agg(F.array(*(F.count_if(F.col("s") < a.last) for a in alphabet)).alias("before"))
    share = {(r.activity, b.name): n / (a.n * b.n) for r in before.collect() for a in alphabet if a.name == r.activity for b, n in zip(alphabet, r.before) if a is not b}
    mean = lambda total, n: total / n if n else 0.0
    took = {(r.source, r.target): min(mean(r.fifo_s, r.fifo), mean(r.lifo_s, r.lifo)) for r in correlation_durations(log, threshold).collect()}
    edges = {e: n for e, n in _chosen(alphabet, share, took).items() if n >= least}
    rows += [("edge", a, b, n) for (a, b), n in edges.items()]
    rows += [("start", a.name, None, a.n) for a in alphabet if all(b != a.name for _, b in edges)] + [("end", a.name, None, a.n) for a in alphabet if all(b != a.name for b, _ in edges)]
    timed = blocks(events.withColumn("all", F.lit(0)), ["all"], ["s"])
    before_block = timed.groupBy("_block").agg(F.min("s").alias("first"), F.max("s").alias("end"))
    inner = F.col("s") - F.lag("s").over(Window.partitionBy("_block").orderBy("s")) > threshold
    between = F.col("first") - F.lag("end").over(Window.orderBy("_block")) > threshold  # a row a block
    gaps = timed.select(inner.alias("gap")).where("gap").count() + before_block.select(between.alias("gap")).where("gap").count()
    return log.sparkSession.createDataFrame([*rows, ("traces", None, None, gaps + 1)], _ROWS)


_ROWS = "kind string, source string, target string, n long"
