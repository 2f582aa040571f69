"""Running values, matches and islands over blocks, against plain loops."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tracelake.functions import running as U
from tracelake.functions.scans import MAX, MIN, SUM, blocks, exact_median, scanned
from tracelake.operators import correlation, follows


@pytest.fixture
def many_blocks(spark):
    """More blocks than partitions by default, so that a key lies in several."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "9")
    spark.conf.set(names[1], "false")
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_scanned(many_blocks):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), k // 2, rng.choice([None, rng.randrange(100)])) for k in range(900)]
    held = blocks(many_blocks.createDataFrame(rows, "key string, at long, v long"), ["key"], ["at"])
    assert held.where("key = 'hot'").select("_block").distinct().count() > 2
    got = scanned(held, ["key"], ["at"], peers=True, total=(SUM, F.col("v")), most=(MAX, F.col("v")), least=(MIN, F.col("v"))).collect()
    assert len(got) == 900
    for r in got:
        seen = [v for k, at, v in rows if k == r.key and at <= r.at and v is not None]
        assert (r.total or 0, r.most, r.least) == (sum(seen), max(seen, default=None), min(seen, default=None))


def test_median(many_blocks):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, rng.randrange(30)])) for g in ["x"] * 301 + ["y"] * 50 + [None] * 7]
    got = {r.g: (r.n, r["median"]) for r in exact_median(many_blocks.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    for g in ("x", "y", None):
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == (len(values), median(values))
    assert exact_median(many_blocks.createDataFrame([], "g string, v long"), ["g"], "v").count() == 0


def test_running_and_smoothed(many_blocks):
    rng = random.Random(3)
    rows = [("k" if k < 500 else "l", k, rng.randrange(9), rng.randrange(1, 9), rng.randrange(3), rng.randrange(3), rng.random() < 0.5) for k in range(650)]
    arrivals = many_blocks.createDataFrame(rows, "key string, pos long, produced long, consumed long, missing long, remaining long, fit boolean")
    got = {(r.key, r.pos): r for r in U.smoothed(U.running(arrivals, 7)).collect()}
    share = lambda p, c, m, r: max(0.0, min(1.0, 0.5 * (1 - (m / c if c else 0)) + 0.5 * (1 - (r / p if p else 0))))
    for key in "kl":
        own, smooth = [r for r in rows if r[0] == key], None
        for n in range(1, len(own) + 1):
            r = got[key, own[n - 1][1]]
            sums = lambda part: [sum(x[k] for x in part) for k in range(2, 6)]
            raw = (share(*sums(own[:n])), sum(x[6] for x in own[:n]) / n, sum(x[4] for x in own[:n]) / n)
            assert abs(r.fitness - raw[0]) < 1e-9 and abs(r.windowed_fitness - share(*sums(own[max(0, n - 7) : n]))) < 1e-9 and r.nth == n
            smooth = raw if smooth is None else tuple(U.ALPHA * x + (1 - U.ALPHA) * s for x, s in zip(raw, smooth))
            assert all(abs(a - b) < 1e-9 for a, b in zip(smooth, (r.smooth_fitness, r.smooth_perfect_rate, r.smooth_avg_missing)))


def log_of(spark, rows):
    return spark.createDataFrame([(f"c{k % 5}", k, a, None if s is None else s * 1000) for k, (a, s) in enumerate(rows)], "case_id string, event_idx long, activity string, ts_ms long")


def fifo(firsts, seconds, threshold):
    found, z = [], 0
    for t in firsts:
        while z < len(seconds) and seconds[z] <= t:
            z += 1
        if z < len(seconds):
            if seconds[z] - t <= threshold:
                found.append(seconds[z] - t)
            z += 1
    return len(found), sum(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_correlation(many_blocks, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("AABCD"), rng.choice([None, rng.randrange(400), rng.randrange(400)])) for _ in range(150)]
    times = {a: sorted(s for b, s in rows if b == a and s is not None) for a in "ABCD"}
    log = log_of(many_blocks, rows)
    got = {(r.source, r.target): tuple(r)[2:] for r in correlation.correlation_durations(log, 9).collect()}
    want = {}
    for a in times:
        for b in times:
            forth = fifo(times[a], times[b], 9)
            back = fifo([-s for s in times[b][::-1]], [-s for s in times[a][::-1]], 9)
            if a != b and (forth[0] or back[0]):
                want[a, b] = (*forth, *back)
    assert got == want
    # the edges, from those durations
    n = {a: len(x) for a, x in times.items()}
    share = {(a, b): sum(t < times[b][-1] for t in times[a]) / (n[a] * n[b]) for a in times for b in times if a != b}
    took = {e: min(f[1] / f[0] if f[0] else 0, f[3] / f[2] if f[2] else 0) for e, f in want.items()}
    out, into, edges = dict(n), dict(n), {}
    for e in sorted((e for e in share if share[e] > 0), key=lambda e: (took.get(e, 0) / share[e] / min(n[e[0]], n[e[1]]), e)):
        if share[e[::-1]] < 0.8 * share[e] and (k := min(out[e[0]], into[e[1]])):
            out[e[0]] -= k
            into[e[1]] -= k
            edges[e] = k
    line = sorted(s for x in times.values() for s in x)
    found = correlation.correlate(log, 9).collect()
    assert {(r.source, r.target): r.n for r in found if r.kind == "edge"} == edges
    assert {r.source for r in found if r.kind == "start"} == set(times) - {b for _, b in edges} and {r.source for r in found if r.kind == "end"} == set(times) - {a for a, _ in edges}
    assert [r.n for r in found if r.kind == "traces"] == [1 + sum(b - a > 9 for a, b in zip(line, line[1:]))]


def test_correlation_of_a_plain_process(spark):
    rows = [(a, 10 * k + i) for k in range(3) for i, a in enumerate("ABC")]
    found = {(r.kind, r.source, r.target): r.n for r in correlation.correlate(log_of(spark, rows), 5).collect()}
    assert found["edge", "A", "B"] >= 2 and found["edge", "B", "C"] >= 2 and found["start", "A", None] == 3 and found["end", "C", None] == 3 and found["traces", None, None] == 3
    assert [tuple(r) for r in correlation.correlate(log_of(spark, []), 5).collect()] == [("traces", None, None, 0)]
    assert {r.kind for r in correlation.correlate(log_of(spark, [("A", 1), ("A", 2)]), 5).collect()} == {"start", "end", "traces"}
    assert correlation.correlation_durations(log_of(spark, [("A", 1), ("A", 2)])).count() == 0


def test_prefixes_of_a_long_trace(spark):
    """Rows follow events: a trace of 100,000 events is a chain of as many nodes."""
    log = spark.range(100_000).select(F.lit("c").alias("case_id"), F.col("id").alias("event_idx"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("activity"), F.lit(None).cast("long").alias("ts_ms"))
    nodes = follows.prefix_nodes(log.unionByName(log.where("event_idx < 50000").withColumn("case_id", F.lit("d")))).cache()
    assert nodes.count() == 100_000 and nodes.where("n = 2").count() == 50_000 and nodes.where("final > 0").count() == 2
    assert nodes.alias("x").join(nodes.alias("y"), F.col("x.parent") == F.col("y.node")).where("x.depth = y.depth + 1").count() == 99_999
    nodes.unpersist()
