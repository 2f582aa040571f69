"""Petri nets as small tables of rows, and what replays a trace on one.

A net is rows (kind, name, label, target, n): ``transition`` (its label null where it is silent), ``place``, ``arc`` (from
``name`` to ``target``), ``initial`` and ``final`` (``n`` tokens in place ``name``). Its size follows the alphabet, not the
log, so it is collected, after a check of its size, and sent along with the tasks that replay distinct variants.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Rows of a net that goes along with tasks, and markings that a search for silent transitions looks at.
MOST_ROWS, MOST_MARKINGS = 1_000_000, 10_000
SCHEMA = "kind string, name string, label string, target string, n int"


@dataclass(frozen=True)
class Transition:
    name: str
    label: str | None
    pre: tuple[str, ...]
    post: tuple[str, ...]


@dataclass(frozen=True)
class Net:
    transitions: tuple[Transition, ...]
    initial: dict[str, int]
    final: dict[str, int]
    by_label: dict[str, list[Transition]] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for t in self.transitions:
            if t.label is not None:
                self.by_label.setdefault(t.label, []).append(t)

    @property
    def silent(self) -> list[Transition]:
        return [t for t in self.transitions if t.label is None and t.pre]


def net_of(rows: DataFrame) -> Net:
    """The net of ``rows``, transitions in order of name. Arcs between nodes that are not there are left out."""
    found = rows.limit(MOST_ROWS + 1).collect()  # as many as the alphabet squared at most
    if len(found) > MOST_ROWS:
        raise ValueError(f"a net of more than {MOST_ROWS} rows does not go along with tasks")
    of = lambda kind: [r for r in found if r.kind == kind]
    places, arcs = {r.name for r in of("place")}, sorted({(r.name, r.target) for r in of("arc")})
    transitions = (Transition(r.name, r.label, tuple(a for a, b in arcs if b == r.name and a in places), tuple(b for a, b in arcs if a == r.name and b in places)) for r in sorted(of("transition"), key=lambda r: r.name))
    return Net(tuple(transitions), {r.name: r.n for r in of("initial")}, {r.name: r.n for r in of("final")})


def net(spark: SparkSession, transitions: dict[str, tuple[str | None, list[str], list[str]]], initial: list[str], final: list[str]) -> DataFrame:
    """Rows of a net given as {transition: (label, input places, output places)} and the places marked first and last."""
    places = {p for _, pre, post in transitions.values() for p in (*pre, *post)} | {*initial, *final}
    rows = [("transition", t, label, None, None) for t, (label, *_) in transitions.items()] + [("place", p, None, None, None) for p in sorted(places)]
    rows += [("arc", p, None, t, None) for t, (_, pre, _) in transitions.items() for p in pre] + [("arc", t, None, p, None) for t, (*_, post) in transitions.items() for p in post]
    return spark.createDataFrame(rows + [("initial", p, None, None, 1) for p in initial] + [("final", p, None, None, 1) for p in final], SCHEMA)


def _silent_way(net: Net, marking: dict[str, int], reached: Callable[[dict[str, int]], bool]) -> list[Transition] | None:
    """The shortest list of silent transitions that leads from ``marking`` to one that ``reached`` holds of, first in order first; None if there is none
    among the ``MOST_MARKINGS`` nearest markings."""
    if not net.silent:
        return None
    start = tuple(sorted((p, n) for p, n in marking.items() if n))
    came: dict[tuple, tuple[tuple, Transition] | None] = {start: None}
    queue = deque([start])
    while queue and len(came) <= MOST_MARKINGS:
        key = queue.popleft()
        held = dict(key)
        if reached(held):
            way = []
            while (step := came[key]) is not None:
                key, t = step
                way.append(t)
            return way[::-1]
        for t in net.silent:
            if all(held.get(p, 0) for p in t.pre):
                after = dict(held)
                for p in t.pre:
                    after[p] -= 1
                for p in t.post:
                    after[p] = after.get(p, 0) + 1
                new = tuple(sorted((p, n) for p, n in after.items() if n))
                if new not in came:
                    came[new] = (key, t)
                    queue.append(new)
    return None


class Replay:
    """Token replay of one trace, an event at a time: ``push`` its activities in order, then ``finish``. It holds the marking and the counts alone.

    Silent transitions fire where they lead to a marking that enables the next activity, and at the end where they lead to the
    final marking, the fewest of them. Activities that no transition bears are passed over. Of a label's transitions the first enabled one fires, or else the
    first, and the tokens it lacks are put in and counted as missing. ``escaping`` sums, after each event, the input places of the
    transitions that are enabled and bear another label.
    """

    def __init__(self, net: Net):
        self.net, self.marking = net, dict(net.initial)
        self.produced, self.consumed, self.missing, self.escaping = sum(net.initial.values()), 0, 0, 0

    def _enabled(self, t: Transition) -> bool:
        return all(self.marking.get(p, 0) > 0 for p in t.pre)

    def _fire(self, t: Transition) -> None:
        for p in t.pre:
            self.marking[p] -= 1
        for p in t.post:
            self.marking[p] = self.marking.get(p, 0) + 1
        self.consumed += len(t.pre)
        self.produced += len(t.post)

    def push(self, activity: str) -> str | None:
        """The transition that fires; None for an activity that no transition bears."""
        bearing = self.net.by_label.get(activity)
        if not bearing:
            return None
        if not any(map(self._enabled, bearing)):
            for t in _silent_way(self.net, self.marking, lambda held: any(all(held.get(p, 0) > 0 for p in t.pre) for t in bearing)) or ():
                self._fire(t)
        chosen = next((t for t in bearing if self._enabled(t)), bearing[0])
        lacking = [p for p in chosen.pre if self.marking.get(p, 0) == 0]
        for p in lacking:
            self.marking[p] = 1
        self.missing += len(lacking)
        self.produced += len(lacking)
        self._fire(chosen)
        self.escaping += sum(len(t.pre) for t in self.net.transitions if t.pre and t.label != activity and self._enabled(t))
        return chosen.name

    def finish(self) -> tuple[int, int, int, int, int]:
        """(produced, consumed, missing, remaining, escaping)."""
        held = lambda marking: {p: n for p, n in marking.items() if n}
        final = held(self.net.final)
        if held(self.marking) != final:
            for t in _silent_way(self.net, self.marking, lambda marking: held(marking) == final) or ():
                self._fire(t)
        remaining = sum(n for p, n in self.marking.items() if self.net.final.get(p, 0) == 0)
        return self.produced, self.consumed + sum(self.net.final.values()), self.missing, remaining, self.escaping


def replayed(net: Net, acts: list[str]) -> tuple[int, int, int, int, int, list[str]]:
    """(produced, consumed, missing, remaining, escaping, transitions fired) of one trace, see :class:`Replay`."""
    run = Replay(net)
    fired = [name for a in acts if (name := run.push(a)) is not None]
    return *run.finish(), fired
