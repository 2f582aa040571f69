"""The inductive miner on split logs: every model it finds can replay its whole log.

The log of a part of the model is cut with the part: each child gets the traces that are left for it, so what begins, ends or is skipped in
a part is read off its own log. The splits run on executors, those of all open parts at once, one round for each level of the tree. What
comes to the driver is each part's directly-follows relation; parts share no activity, so the pairs are those of the whole alphabet at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.sources.logs import variants
from tracelake.sources.tables import release, stored

#: Rows of relations that may come to the driver in a round.
MOST_ROWS = 2_000_000


class Tree(NamedTuple):
    """A leaf (operator None; label None where it is silent) or an operator: sequence, xor, parallel or loop (do, redo, ...)."""

    operator: str | None
    label: str | None = None
    children: tuple[Tree, ...] = ()

    def __str__(self) -> str:
        return f"{self.operator}({', '.join(map(str, self.children))})" if self.operator else self.label or "tau"


TAU = Tree(None)


class Facts(NamedTuple):
    """What a part's log says: its activities in order, its relation, whether it has empty traces."""

    names: tuple[str, ...]
    edges: frozenset[tuple[str, str]]
    starts: frozenset[str]
    ends: frozenset[str]
    empty: bool
    once: frozenset[str]  # activities that stand exactly once in every trace


class Step(NamedTuple):
    """How a part goes on: an operator over children that get logs, ``fixed`` children beside them, and how the log is split."""

    operator: str
    split: str  # whole, project, segments or restarts
    groups: tuple[frozenset[str], ...]
    fixed: tuple[Tree, ...] = ()


def _grouped(names: Iterable[str], together: Callable[[str, str], bool]) -> list[set[str]]:
    """Connected groups of names, where ``together`` says whether two are neighbours; in order of their first names."""
    left, groups = sorted(names), []
    while left:
        group, new = set(), {left[0]}
        while new:
            group |= new
            new = {b for b in left if b not in group and any(together(a, b) for a in new)}
        groups.append(group)
        left = [a for a in left if a not in group]
    return groups


def _reach(facts: Facts) -> dict[str, set[str]]:
    """What each activity leads to over one edge or more."""
    place = {a: k for k, a in enumerate(facts.names)}
    after = [0] * len(place)  # sets as bits
    for a, b in facts.edges:
        after[place[a]] |= 1 << place[b]
    for via in range(len(after)):
        through = after[via]
        after = [x | through if x >> via & 1 else x for x in after]
    return {a: {b for b in facts.names if after[k] >> place[b] & 1} for a, k in place.items()}


def _choice(facts: Facts) -> list[set[str]]:
    linked = {frozenset(e) for e in facts.edges}
    return _grouped(facts.names, lambda a, b: frozenset((a, b)) in linked)


def _order(facts: Facts) -> list[set[str]]:
    """Activities that lead to each other, or neither to the other, belong together; what is left is in one order."""
    after = _reach(facts)
    groups = _grouped(facts.names, lambda a, b: (b in after[a]) == (a in after[b]))
    return sorted(groups, key=lambda g: -len(after[min(g)] - g))


def _concurrency(facts: Facts) -> list[set[str]]:
    """Groups whose activities follow those of all others both ways; each must begin and end the part's traces."""
    groups = _grouped(facts.names, lambda a, b: (a, b) not in facts.edges or (b, a) not in facts.edges)
    whole = [g for g in groups if g & facts.starts and g & facts.ends]
    rest = set().union(*(g for g in groups if g not in whole))
    if not rest:
        return groups
    if rest & facts.starts and rest & facts.ends:
        return [*whole, rest]
    return [whole[0] | rest, *whole[1:]] if whole else [rest]


def _repetition(facts: Facts) -> list[set[str]]:
    """The body and what leads from all of its ends back to all of its starts."""
    body, redo = set(facts.starts | facts.ends), []
    others = set(facts.names) - body
    linked = {frozenset(e) for e in facts.edges if others.issuperset(e)}
    groups = _grouped(others, lambda a, b: frozenset((a, b)) in linked)
    for group in groups:
        into = {(a, b) for a, b in facts.edges if b in group and a not in group}
        out = {(a, b) for a, b in facts.edges if a in group and b not in group}
        entered, left = {b for _, b in into}, {a for a, _ in out}
        if into == {(a, b) for a in facts.ends for b in entered} and out == {(a, b) for a in left for b in facts.starts}:
            redo.append(group)
        else:
            body |= group
    return [body, *redo]


def step_of(facts: Facts) -> Tree | Step:
    """A part's leaf, or how it goes on: empty traces first, then a choice, a sequence, concurrency, a loop; else what always fits."""
    if not facts.names:
        return TAU
    if facts.empty:
        return Step("xor", "whole", (frozenset(facts.names),), (TAU,))
    if len(facts.names) == 1:
        leaf = Tree(None, facts.names[0])
        return leaf if facts.once else Tree("loop", None, (leaf, TAU))
    cuts = (("xor", "project", _choice), ("sequence", "project", _order), ("parallel", "project", _concurrency), ("loop", "segments", _repetition))
    for operator, split, cut in cuts:
        if len(groups := cut(facts)) > 1:
            return Step(operator, split, tuple(map(frozenset, groups)))
    if facts.once:  # beside all others
        one = min(facts.once)
        return Step("parallel", "project", (frozenset({one}), frozenset(facts.names) - {one}))
    if any(a in facts.ends and b in facts.starts for a, b in facts.edges):
        return Step("loop", "restarts", (frozenset(facts.names),), (TAU,))
    return Tree("loop", None, (TAU, *(Tree(None, a) for a in facts.names)))  # any order, any number of times


def _facts_of(parts: DataFrame) -> dict[str, Facts]:
    """The facts of every part of ``parts`` (part, acts): (part, kind, a, b, n) rows, counted on executors."""
    acts = F.col("acts")
    last = F.size("acts")
    text = lambda c: F.lit(None).cast("string") if c is None else c
    row = lambda kind, a=None, b=None: F.struct(F.lit(kind).alias("kind"), text(a).alias("a"), text(b).alias("b"))
    distinct = F.array_distinct("acts")
    pairs = F.when(last > 1, F.array_distinct(F.zip_with(F.slice("acts", 1, last - 1), F.slice("acts", 2, last - 1), lambda a, b: row("edge", a, b))))
    single = F.transform(F.filter(distinct, lambda a: F.size(F.filter(acts, lambda x: x == a)) == 1), lambda a: row("once", a))
    ends = F.array(row("trace"), F.when(last == 0, row("empty")), F.when(last > 0, row("start", F.element_at("acts", 1))), F.when(last > 0, row("end", F.element_at("acts", -1))))
    every = F.concat(F.array_compact(ends), F.coalesce(pairs, F.array().cast("array<struct<kind:string,a:string,b:string>>")), F.transform(distinct, lambda a: row("name", a)), single)
    counted = parts.select("part", F.inline(every)).groupBy("part", "kind", "a", "b").agg(F.count("*").alias("n"))
    rows = counted.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} pairs of activities: the alphabet is too large to be mined")
    held: dict[str, dict[str, list]] = {}
    for r in rows:
        held.setdefault(r.part, {}).setdefault(r.kind, []).append(r)
    of = lambda kinds, kind: frozenset(r.a for r in kinds.get(kind, ()))
    return {
        part: Facts(tuple(sorted(of(k, "name"))), frozenset((r.a, r.b) for r in k.get("edge", ())), of(k, "start"), of(k, "end"), "empty" in k, frozenset(r.a for r in k.get("once", ()) if r.n == k["trace"][0].n))
        for part, k in held.items()
    }


_STEPS = "part string, operator string, split string, home map<string,int>, starts array<string>, ends array<string>"


def _children(parts: DataFrame, steps: dict[str, tuple[Step, Facts]]) -> DataFrame:
    """(part, acts) of the children: each trace of a part that goes on, split as its step says; alike ones once."""
    rows = [(p, s.operator, s.split, {a: k for k, g in enumerate(s.groups) for a in g}, sorted(f.starts), sorted(f.ends)) for p, (s, f) in steps.items()]
    how = parts.sparkSession.createDataFrame(rows, _STEPS)  # an entry an activity
    own = parts.join(F.broadcast(how), "part").withColumn("homes", F.transform("acts", lambda a: F.element_at("home", a)))
    # where pieces of consecutive activities begin, from 1
    other_home = lambda i: F.get("homes", i - 1) != F.get("homes", i - 2)
    restart = lambda i: F.array_contains("ends", F.get("acts", i - 2)) & F.array_contains("starts", F.get("acts", i - 1))
    begins = lambda i: (i == 1) | F.when(F.col("split") == "segments", other_home(i)).otherwise(restart(i))
    places = F.when(F.col("split").isin("segments", "restarts"), F.filter(F.sequence(F.lit(1), F.size("acts")), begins))
    own = own.withColumn("places", places)
    piece = lambda child, acts: F.struct(child.alias("child"), acts.alias("acts"))
    cut = F.transform("places", lambda i, k: piece(F.get("homes", i - 1), F.slice("acts", i, F.coalesce(F.get("places", k + 1), F.size("acts") + 1) - i)))
    projected = F.transform(F.array_distinct(F.map_values("home")), lambda g: piece(g, F.filter("acts", lambda a: F.element_at("home", a) == g)))
    pieces = F.when(F.col("split") == "project", projected).when(F.col("split") == "whole", F.array(piece(F.lit(0), F.col("acts")))).otherwise(cut)
    split = own.select("part", "operator", F.explode(pieces).alias("p")).where("operator <> 'xor' or size(p.acts) > 0")
    return split.select(F.concat_ws(".", "part", F.col("p.child").cast("string")).alias("part"), "p.acts").distinct()


def simplified(tree: Tree) -> Tree:
    """Children of a sequence, choice or concurrency that are of its own kind taken in its place; an operator with one child replaced by it."""
    if tree.operator is None:
        return tree
    flat: list[Tree] = []
    for child in map(simplified, tree.children):
        flat += child.children if child.operator == tree.operator and tree.operator != "loop" else (child,)
    if tree.operator == "xor":
        flat = [TAU] * (TAU in flat) + [x for x in flat if x != TAU]
    return flat[0] if len(flat) == 1 else Tree(tree.operator, None, tuple(flat))


def inductive_tree(log: DataFrame) -> Tree:
    """The tree of ``log``; tau for a log without events. Each round stores the parts' traces, at most one for each different trace and child."""
    parts = stored(variants(log).select(F.lit("0").alias("part"), "acts"), "parts")
    known: dict[str, Tree | Step] = {}
    while True:
        facts = _facts_of(parts)
        found = {part: step_of(f) for part, f in facts.items()}
        known |= found
        going = {part: (s, facts[part]) for part, s in found.items() if isinstance(s, Step)}
        if not going:
            break
        before, parts = parts, stored(_children(parts, going), "parts")
        release(before)
    release(parts)

    def built(part: str) -> Tree:
        at = known[part]
        if isinstance(at, Tree):
            return at
        children = tuple(built(f"{part}.{k}") for k in range(len(at.groups)))
        return Tree(at.operator, None, (*at.fixed, *children) if at.operator == "xor" else (*children, *at.fixed))

    return simplified(built("0")) if known else TAU


def tree_rows(log: DataFrame, tree: Tree) -> DataFrame:
    """(path, operator, label): one row a node, its path the places of its ancestors and itself among their children."""
    rows: list[tuple[str, str | None, str | None]] = []

    def walk(node: Tree, path: str) -> None:
        rows.append((path, node.operator, node.label))
        for k, child in enumerate(node.children):
            walk(child, f"{path}.{k}")

    walk(tree, "0")
    return log.sparkSession.createDataFrame(rows, "path string, operator string, label string")


def inductive(log: DataFrame) -> DataFrame:
    return tree_rows(log, inductive_tree(log))


def tree_net(log: DataFrame, tree: Tree) -> DataFrame:
    """Rows of a net with the runs of a tree: one source and one sink; silent transitions split, join, skip and repeat."""
    rows: set[tuple[str, str, str | None, str | None, int | None]] = {("place", "source", None, None, None), ("place", "sink", None, None, None), ("initial", "source", None, None, 1), ("final", "sink", None, None, 1)}

    def step(name: str, label: str | None, pre: list[str], post: list[str]) -> None:
        rows.update({("transition", name, label, None, None), *(("arc", p, None, name, None) for p in pre), *(("arc", name, None, p, None) for p in post)})

    def place(name: str) -> str:
        rows.add(("place", name, None, None, None))
        return name

    def build(node: Tree, path: str, source: str, sink: str) -> None:
        if node.operator is None:
            step(f"t{path}", node.label, [source], [sink])
        elif node.operator == "sequence":
            between = [source, *(place(f"p{path}.{k}") for k in range(1, len(node.children))), sink]
            for k, child in enumerate(node.children):
                build(child, f"{path}.{k}", between[k], between[k + 1])
        elif node.operator == "xor":
            for k, child in enumerate(node.children):
                build(child, f"{path}.{k}", source, sink)
        elif node.operator == "parallel":
            firsts, lasts = ([place(f"p{path}.{k}{side}") for k in range(len(node.children))] for side in ("a", "z"))
            step(f"t{path}a", None, [source], firsts)
            step(f"t{path}z", None, lasts, [sink])
            for k, child in enumerate(node.children):
                build(child, f"{path}.{k}", firsts[k], lasts[k])
        else:
            first, last = place(f"p{path}a"), place(f"p{path}z")
            step(f"t{path}a", None, [source], [first])
            step(f"t{path}z", None, [last], [sink])
            build(node.children[0], f"{path}.0", first, last)
            for k, child in enumerate(node.children[1:], 1):
                build(child, f"{path}.{k}", last, first)

    build(tree, "0", "source", "sink")
    return log.sparkSession.createDataFrame(sorted(rows, key=str), "kind string, name string, label string, target string, n int")


def inductive_net(log: DataFrame) -> DataFrame:
    """Rows of the net of the log's tree: it replays every case of the log with silent moves alone."""
    return tree_net(log, inductive_tree(log))
