"""Replay, alignment and discovery on small logs, against figures worked out by hand or by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import conformance as K
from tracelake.operators import discovery as M
from tracelake.operators import inductive as I
from tracelake.operators import nets
from tracelake.operators.alignments import Aligner, aligned


def log_of(spark, *traces):
    rows = [(f"c{k:03d}", i, a) for k, acts in enumerate(traces) for i, a in enumerate(acts)]
    return spark.createDataFrame(rows, "case_id string, event_idx long, activity string").withColumn("ts_ms", F.lit(None).cast("long"))


def sequential(spark):
    return nets.net(spark, {"t_A": ("A", ["start"], ["p1"]), "t_B": ("B", ["p1"], ["end"])}, ["start"], ["end"])


@pytest.mark.parametrize(
    "trace, counts, fitness",
    [("AB", (3, 3, 0, 0), 1.0), ("A", (2, 2, 0, 1), 0.75), ("B", (3, 2, 1, 1), 0.583333), ("BA", (4, 3, 1, 1), 0.708333), ("AXB", (3, 3, 0, 0), 1.0), ("ABB", (5, 4, 1, 0), 0.875), ("", (1, 1, 0, 1), 0.5)],
)
def test_replayed(spark, trace, counts, fitness):
    found = nets.replayed(nets.net_of(sequential(spark)), list(trace))
    assert found[:4] == counts
    p, c, m, r = counts
    assert abs(0.5 * (1 - m / c) + 0.5 * (1 - r / p) - fitness) < 1e-6


def test_measures_of_a_sequence(spark):
    model, log = sequential(spark), log_of(spark, "AB", "AB")
    assert K.precision(log_of(spark, "AB"), model).first().precision == 0.75
    assert K.precision(log_of(spark), model).first().precision == 1.0 and K.fitness(log_of(spark), model).first().fitness == 1.0
    assert round(K.generalization(log, model).first().generalization, 6) == 0.292893
    mixed = log_of(spark, "AB", "A", "B", "BA", "AB")
    got = {r.case_id: r for r in K.replay(mixed, model).collect()}
    assert [round(got[f"c{k:03d}"].fitness, 4) for k in range(5)] == [1, 0.75, 0.5833, 0.7083, 1] and got["c000"].fit and got["c000"].fired == ["t_A", "t_B"]
    assert {r.case_id for r in K.filter_by_fitness(mixed, model, 0.75).collect()} == {"c000", "c001", "c004"}
    assert [r.n for r in K.fitness_histogram(mixed, model).orderBy("bin").collect()] == [0, 0, 0, 0, 0, 1, 0, 2, 0, 2]


def test_silent_transitions(spark):
    tau = nets.net(spark, {"split": (None, ["i"], ["a", "b"]), "A": ("A", ["a"], ["x"]), "B": ("B", ["b"], ["y"]), "join": (None, ["x", "y"], ["o"])}, ["i"], ["o"])
    got = [(r.fit, r.produced, r.consumed) for r in K.replay(log_of(spark, "AB", "BA", "A"), tau).orderBy("case_id").collect()]
    assert got == [(True, 6, 6), (True, 6, 6), (False, 4, 3)]
    endless = nets.net_of(nets.net(spark, {"spin": (None, ["i"], ["i"]), "A": ("A", ["i"], ["o"])}, ["i"], ["o"]))
    assert nets.replayed(endless, ["A"])[2] == 0  # the silent budget ends


def runs(net, longest):
    """Every run of ``net`` up to so many transitions: (labels and silent steps)."""
    found, states = [], [(dict(net.initial), ())]
    for _ in range(longest + 1):
        new = []
        for marking, run in states:
            if {p: n for p, n in marking.items() if n} == net.final:
                found.append(run)
            for t in net.transitions:
                if all(marking.get(p, 0) for p in t.pre):
                    after = dict(marking)
                    for p in t.pre:
                        after[p] -= 1
                    for p in t.post:
                        after[p] = after.get(p, 0) + 1
                    new.append((after, (*run, t.label)))
        states = new
    return found


def edit_cost(acts, run):
    row = [0]
    for label in run:
        row.append(row[-1] + (1 if label is None else 10_000))
    for a in acts:
        new = [row[0] + 10_000]
        for k, label in enumerate(run):
            new.append(min(row[k + 1] + 10_000, new[k] + (1 if label is None else 10_000), row[k] if label == a else 1 << 60))
        row = new
    return row[-1]


def test_alignments_are_cheapest(spark):
    model = nets.net_of(nets.net(spark, {"split": (None, ["i"], ["a", "b"]), "A": ("A", ["a"], ["x"]), "B": ("B", ["b"], ["y"]), "join": (None, ["x", "y"], ["m"]), "C": ("C", ["m"], ["o"]), "back": (None, ["o"], ["i"])}, ["i"], ["o"]))
    every = runs(model, 11)
    random.seed(3)
    for _ in range(40):
        acts = [random.choice("ABCX") for _ in range(random.randint(0, 5))]
        cost, moves = aligned(model, acts)
        assert cost == min(edit_cost(acts, run) for run in every), acts
        assert [a for a, _ in moves if a != ">>"] == acts


def test_align(spark):
    got = {r.case_id: r for r in K.align(log_of(spark, "AB", "A", "AB"), sequential(spark)).collect()}
    assert (got["c000"].cost, got["c000"].fitness, got["c000"].fit) == (0, 1.0, True) and (got["c001"].cost, got["c001"].fitness, got["c001"].fit) == (10_000, 0.0, False)
    stuck = nets.net(spark, {"t": ("A", ["i"], ["p"])}, ["i"], ["o"])  # cannot end
    row = K.align(log_of(spark, "A"), stuck).first()
    assert row.cost is None and row.fitness == 0.0 and not row.fit


def test_wide_nets_and_unfinished_searches(spark):
    names = [f"a{k:02d}" for k in range(16)]
    wide = {"split": (None, ["i"], [f"{a}<" for a in names]), "join": (None, [f"{a}>" for a in names], ["o"])} | {a: (a, [f"{a}<"], [f"{a}>"]) for a in names}
    wide = nets.net(spark, wide, ["i"], ["o"])
    net = nets.net_of(wide)
    assert aligned(net, ["a03", "a11", "a07"], 2_000)[0] == 13 * 10_000 + 2
    assert aligned(net, [*names[::-1], "x", "a00"], 2_000)[0] == 2 * 10_000 + 2
    rows = {r.case_id: r for r in K.align(log_of(spark, ["a03", "a11"], ["x"]), wide, 3).collect()}
    assert rows["c000"].status == "unfinished" and rows["c000"].cost is None and rows["c000"].fit is None and rows["c000"].bound == 14 * 10_000 + 2
    assert Aligner(nets.net_of(nets.net(spark, {"t": ("A", ["i"], ["p"])}, ["i"], ["o"]))).align(["A"], 9)[0] == "impossible"


def random_tree(rng, names, depth=3):
    if len(names) == 1:
        return rng.choice([I.Tree(None, names[0])] * 3 + [I.Tree("xor", None, (I.TAU, I.Tree(None, names[0]))), I.Tree("loop", None, (I.Tree(None, names[0]), I.TAU))])
    cut = rng.randrange(1, len(names))
    return I.Tree(rng.choice(["sequence", "sequence", "xor", "parallel", "loop"]), None, tuple(random_tree(rng, part, depth - 1) for part in (names[:cut], names[cut:])))


def run_of(rng, tree):
    if tree.operator is None:
        return [tree.label] if tree.label else []
    if tree.operator == "xor":
        return run_of(rng, rng.choice(tree.children))
    if tree.operator == "loop":
        out = run_of(rng, tree.children[0])
        while rng.random() < 0.4:
            out += run_of(rng, rng.choice(tree.children[1:])) + run_of(rng, tree.children[0])
        return out
    parts = [run_of(rng, c) for c in tree.children]
    if tree.operator == "sequence":
        return sum(parts, [])
    order = [k for k, p in enumerate(parts) for _ in p]
    rng.shuffle(order)
    rest = [iter(p) for p in parts]
    return [next(rest[k]) for k in order]


def labels_of(tree):
    return {tree.label} if tree.operator is None else set().union(*map(labels_of, tree.children))


def test_best_first_equals_blind_search(spark):
    """Costs on nets of random trees are those of the search without a bound."""
    rng = random.Random(11)
    for _ in range(25):
        net = nets.net_of(I.tree_net(log_of(spark), random_tree(rng, list("ABCDE"))))
        own, blind = Aligner(net), Aligner(net)
        blind.worths = lambda left: [0.0] * blind.size
        for _ in range(4):
            acts = [rng.choice("ABCDEX") for _ in range(rng.randrange(6))]
            assert own.align(acts, 10**6)[:2] == blind.align(acts, 10**6)[:2], (acts, net)


@pytest.mark.parametrize(
    "traces, tree",
    [
        ((), "tau"), (("A", "A"), "A"), (("AB", "AB"), "sequence(A, B)"), (("A", "B"), "xor(A, B)"), (("AB", "BA"), "parallel(A, B)"), (("ABC", "ABC"), "sequence(A, B, C)"), (("AA", "A"), "loop(A, tau)"),
        (("ABD", "ACD"), "sequence(A, xor(B, C), D)"), (("ABCD", "ACBD"), "sequence(A, parallel(B, C), D)"), (("A", "ABA"), "loop(A, B)"), (("AC", "CA", "B"), "xor(parallel(A, C), B)"), (("AB", "ABC", "AC"), "sequence(A, xor(tau, B), xor(tau, C))"),
        (("AB", "BA", "ACB", "BCA"), "parallel(A, xor(tau, C), B)"), (("ABAB", "AB"), "loop(sequence(A, B), tau)"), (("ABCAB", "AB", "ABDAB"), "loop(sequence(A, B), C, D)"), (("AB", "A"), "sequence(A, xor(tau, B))"),
        (("ABCB", "CBAA", "BACC"), "parallel(loop(A, tau), loop(C, tau), loop(B, tau))"), (("ABCABDCA", "ACBDDCBA"), "loop(A, loop(sequence(xor(tau, B), xor(tau, loop(D, tau)), xor(tau, C)), tau))"),
    ],
)
def test_inductive(spark, traces, tree):
    log = log_of(spark, *traces)
    found = I.inductive_tree(log)
    assert str(found) == tree
    if traces:
        assert labels_of(found) - {None} == set("".join(traces))
        assert all(r.cost < 10_000 for r in K.align(log, I.tree_net(log, found)).collect())
        assert all(r.fit for r in K.replay(log, I.tree_net(log, found)).collect())


def test_flower():
    """Where nothing cuts and no trace starts again: any order."""
    facts = I.Facts(tuple("ABC"), frozenset({("A", "B"), ("B", "A"), ("A", "C"), ("C", "B"), ("B", "C"), ("A", "A")}), frozenset("A"), frozenset("B"), False, frozenset())
    facts = facts._replace(edges=facts.edges - {("B", "A")} | {("C", "A")})
    assert str(I.step_of(facts)) == "loop(tau, A, B, C)"


def test_inductive_models_fit_their_logs(spark):
    """Every case of random logs has an alignment with silent moves alone; no activity is lost."""
    rng = random.Random(5)
    for k in range(8):
        names = list("ABCDEFG")[: rng.randrange(2, 8)]
        if k % 2:
            log = log_of(spark, *([rng.choice(names) for _ in range(rng.randrange(1, 7))] for _ in range(12)))
        else:
            tree = random_tree(rng, names)
            log = log_of(spark, *(run_of(rng, tree) for _ in range(25)))
        if log.isEmpty():
            continue
        found = I.inductive_tree(log)
        assert labels_of(found) - {None} == {r.activity for r in log.collect()}, found
        rows = K.align(log, I.tree_net(log, found)).collect()
        assert all(r.status == "optimal" and r.cost < 10_000 for r in rows), found


def test_flat_trees_and_nets_of_trees(spark):
    T, leaf = I.Tree, lambda a: I.Tree(None, a)
    assert str(I.simplified(T("sequence", None, (T("sequence", None, (leaf("A"), leaf("B"))), T("xor", None, (leaf("C"),)))))) == "sequence(A, B, C)"
    nested = T("loop", None, (leaf("A"), T("loop", None, (leaf("B"), leaf("C")))))
    assert I.simplified(nested) == nested  # another language than loop(A, B, C)
    log = log_of(spark, "ABD", "ACD", "ABCD", "ACBD")
    loops = log_of(spark, "A", "ABA", "ABABA")
    net = I.tree_net(loops, T("loop", None, (leaf("A"), leaf("B"))))
    assert [r.cost < 10_000 for r in K.align(loops, net).collect()] == [True] * 3  # silent moves alone
    assert {r.path for r in I.tree_rows(log, T("loop", None, (leaf("A"), leaf(None)))).collect()} == {"0", "0.0", "0.1"}


def test_alpha_nets_replay_their_logs(spark):
    log = log_of(spark, "ABC", "ABC")
    assert K.fitness(log, M.alpha(log)).first().fitting == 2
    assert M.alpha(log_of(spark)).count() == 0
    plus = {(r.kind, r.name, r.target) for r in M.alpha_plus(log_of(spark, "AAB", "AAB")).collect()}
    assert ("transition", '["again","A"]', None) in plus and ("initial", '["loop","A"]', None) in plus and ("arc", '["loop","A"]', '["do","A"]') in plus


def test_alpha_places_are_one_for_each_pair(spark):
    """Whatever marks the activities' names hold."""
    log = log_of(spark, ["a_b", "c"], ["a", "b_c"], ['a","b', "c"])
    net = M.alpha(log)
    assert net.where("kind = 'place'").count() == 5
    assert K.align(log_of(spark, ["a", "c"]), net).first().cost == 20_000
    pairs = M.alpha_plus(log_of(spark, *(["x", "x"], ["x_loop", "y"])))
    assert pairs.where("kind = 'transition'").count() == 4


def test_names_with_the_mark_between_activities(spark):
    from tracelake.operators import filters, follows, statistics

    log = log_of(spark, ["a>b"], ["a", "b"], ["a", "b"])
    assert {r.case_id for r in filters.top_variants(log, 1).select("case_id").distinct().collect()} == {"c001", "c002"}
    assert sorted((r.variant, r.n) for r in statistics.variant_durations(log).collect()) == [("a>b", 1), ("a>b", 2)]
    assert sorted((r.prefix, r.n) for r in statistics.prefixes(log).collect()) == [("a", 2), ("a>b", 1), ("a>b", 2)]
    assert follows.prefix_tree(log).count() == 3
    assert sorted((r.variant, r.n) for r in statistics.variant_counts(log).collect()) == [("a>b", 1), ("a>b", 2)]


def test_ewma_folds_the_whole_series(spark):
    from tracelake.functions.control import ewma

    for alpha, n in ((0.01, 700), (0.2, 130), (1.0, 70), (0.001, 300)):
        random.seed(n)
        values = [None if random.random() < 0.1 else random.random() * 100 for _ in range(n)]
        rows = spark.createDataFrame([("k", k, v) for k, v in enumerate(values)], "key string, pos long, value double")
        got = [r.ewma for r in ewma(rows, alpha).orderBy("pos").collect()]
        state, want = None, []
        for v in values:
            state = state if v is None else v if state is None else alpha * v + (1 - alpha) * state
            want.append(state)
        assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-9) for g, w in itertools.zip_longest(got, want)), alpha


def brute_batches(rows, gap):
    out = []
    for name in sorted({r[0] for r in rows}):
        own = sorted((s, e, c) for a, c, s, e in rows if a == name)
        islands, reach = [], None
        for x in own:
            if reach is None or x[0] - reach > gap:
                islands.append([])
            islands[-1].append(x)
            reach = max(x[1], reach if reach is not None else x[1])
        for island in islands:
            cases = {c for *_, c in island}
            if len(cases) < 2:
                continue
            held = [x for x in own if x[2] in cases]
            starts, ends = {x[0] for x in held}, {x[1] for x in held}
            if len(starts) == 1 or len(ends) == 1:
                kind = "parallel" if len(starts) == len(ends) == 1 else "concurrent"
            elif all(a[1] == b[0] for a, b in zip(held, held[1:])):
                kind = "sequential"
            else:
                kind = "disruptive" if len(cases) >= 5 else "concurrent"
            out.append((name, min(x[0] for x in island), max(x[1] for x in island), len(cases), len(island), kind))
    return sorted(out)


def test_batches_of_executions(spark):
    from tracelake.operators.patterns import batches

    random.seed(9)
    rows, at = [], 0
    for k in range(400):
        at += random.choice([0, 10, 300, 899, 900, 901, 5000, 30_000])
        rows.append((random.choice("AB"), f"c{k % 90}", at, at + random.choice([0, 0, 10, 2000])))
    rows += [("S", f"s{k}", 10 * k, 10 * k + 10) for k in range(4)] + [("P", f"p{k}", 7, 9) for k in range(3)] + [("Q", f"p{k}", 7, 7) for k in range(3)] + [("R", f"p{k}", 7, 9 + k) for k in range(3)] + [("T", "alone", 1, 2), ("T", "alone", 2, 3)]
    log = spark.createDataFrame([(c, k, a, e * 1000, s * 1000) for k, (a, c, s, e) in enumerate(rows)], "case_id string, event_idx long, activity string, ts_ms long, start_ms long")
    got = sorted(tuple(r) for r in batches(log, start_ms="start_ms").collect())
    assert got == brute_batches(rows, 900)
    assert {"parallel", "concurrent", "sequential", "disruptive"} == {r[-1] for r in got}
    points = [(a, c, e, e) for a, c, _, e in rows]
    assert sorted(tuple(r) for r in batches(log).collect()) == brute_batches(points, 900)
    assert batches(log.limit(0)).count() == 0 and batches(log.withColumn("ts_ms", F.lit(None).cast("long"))).count() == 0


def test_sample_clusters_and_next_activity(spark):
    from tracelake.operators import filters, forecasts

    log = log_of(spark, *(["ABC"] * 12 + ["AD" * 20] * 6))
    assert filters.sample_cases(log, 5).select("case_id").distinct().count() == 5
    assert {r.case_id for r in filters.sample_cases(log, 5, 1).collect()} == {r.case_id for r in filters.sample_cases(log.repartition(7), 5, 1).collect()}
    groups = {r.case_id: r.cluster for r in forecasts.cluster(log.withColumn("ts_ms", F.col("event_idx") * 1000), 2).collect()}
    assert len({groups[f"c{k:03d}"] for k in range(12)}) == 1 == len({groups[f"c{k:03d}"] for k in range(12, 18)}) and groups["c000"] != groups["c017"]
    timed = lambda *acts: log_of(spark, *acts).withColumn("ts_ms", F.col("event_idx") * 1000)
    assert {r.cluster for r in forecasts.cluster(timed("AB", "AB"), 3).collect()} == {0} and len({r.cluster for r in forecasts.cluster(timed("AB", "ABC"), 3).collect()}) == 2
    assert forecasts.cluster(timed()).count() == 0 == forecasts.next_activity(log_of(spark)).count() == forecasts.next_activity(log_of(spark, "A", "B")).count()
    said = {r.predicted for r in forecasts.next_activity(log_of(spark, *["ABABAB"] * 6)).collect()}
    assert said == {"A"}


def test_closure_and_reduction(spark):
    from tracelake.operators import relations as R

    rng = random.Random(3)
    of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    held = lambda df: {(r.a, r.b) for r in df.collect()}

    def brute(pairs):
        found = set(pairs)
        while more := {(a, d) for a, b in found for c, d in found if b == c} - found:
            found |= more
        return found

    loops = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)}
    assert held(R.closure(of([*loops, *loops, (None, 1), (1, None)]))) == brute(loops)
    order = {tuple(sorted(rng.sample(range(15), 2))) for _ in range(40)}
    whole, least = brute(order), held(R.reduction(of(list(order))))
    assert brute(least) == whole and all(brute(least - {e}) != whole for e in least)
    chain = [(k, k + 1) for k in range(60)]
    assert R.closure(of(chain)).count() == 60 * 61 // 2 and held(R.reduction(of(list(brute(chain))))) == set(chain)
    assert R.closure(of([])).count() == 0 == R.reduction(of([])).count()
    with pytest.raises(ValueError, match="cycle"):
        R.reduction(of([(1, 2), (2, 1)]))


def test_replay_of_events_in_passing(spark):
    model = sequential(spark)
    log = log_of(spark, *("AB", "A", "B", "BA", "AXB", "ABB") * 5)
    names = ["case_id", "produced", "consumed", "missing", "remaining", "fitness", "fit"]
    assert sorted(map(tuple, K.replay_events(log, model).select(names).collect())) == sorted(map(tuple, K.replay(log, model).select(names).collect()))
    loop = nets.net(spark, {"A": ("A", ["p"], ["q"]), "B": ("B", ["q"], ["p"])}, ["p"], ["p"])
    long = spark.range(400_000).select(F.lit("c").alias("case_id"), F.col("id").alias("event_idx"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("activity"))
    row = K.replay_events(long, loop).first()
    assert row.fit and row.produced == 400_001 and K.replay_events(long.limit(0), loop).count() == 0
