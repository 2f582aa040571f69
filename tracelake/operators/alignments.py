"""A cheapest alignment of one trace with a net: best-first search over (place in the trace, marking) with a lower bound of what is left.

The bound adds two parts that no alignment can do without. Every event left whose activity no transition bears costs a move of its own.
And every token has a way to go: a place's worth is the least, over the transitions that take from it, of the transition's cost and the worth of what it
puts out, shared evenly among the places it takes from. Transitions whose activity the rest of the trace still holds count as free there. So shares never add up
to more than any run costs. Where moves are concurrent all their orders are worth the same, and of equal ones the one that came farthest goes on.
"""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import count
from math import inf

from tracelake.operators.nets import Net

ONE_SIDED, SILENT = 10_000, 1
STILL = ">>"
Marking = tuple[int, ...]


class Aligner:
    """One net; what is worked out for it is kept from trace to trace: worths by the activities left, and what is enabled in a marking."""

    def __init__(self, net: Net):
        names = sorted({*net.initial, *net.final}.union(*((*t.pre, *t.post) for t in net.transitions)))
        place = {p: k for k, p in enumerate(names)}
        self.size = len(names)
        self.transitions = [(t.name, t.label, tuple(place[p] for p in t.pre), tuple(place[p] for p in t.post)) for t in net.transitions]
        self.labels = {t.label for t in net.transitions}
        self.initial, self.final = (tuple(of.get(p, 0) for p in names) for of in (net.initial, net.final))
        self._worths: dict[frozenset[str], list[float]] = {}
        self._next: dict[Marking, list[tuple[str, str | None, Marking]]] = {}

    def steps(self, marking: Marking) -> list[tuple[str, str | None, Marking]]:
        """(transition, label, marking after) of what is enabled."""
        found = self._next.get(marking)
        if found is None:
            found = []
            for name, label, pre, post in self.transitions:
                if all(marking[p] for p in pre):
                    after = list(marking)
                    for p in pre:
                        after[p] -= 1
                    for p in post:
                        after[p] += 1
                    found.append((name, label, tuple(after)))
            if len(self._next) > 200_000:
                self._next.clear()
            self._next[marking] = found
        return found

    def worths(self, left: frozenset[str]) -> list[float]:
        """The worth of a token in each place while the activities in ``left`` are still to come; infinite where it cannot leave for the end."""
        worth = self._worths.get(left)
        if worth is None:
            worth = [0.0 if n else inf for n in self.final]
            changed = True
            while changed:
                changed = False
                for _, label, pre, post in self.transitions:
                    if pre:
                        cost = SILENT if label is None else 0 if label in left else ONE_SIDED
                        share = (cost + sum(worth[q] for q in post)) / len(pre)
                        for p in pre:
                            if share < worth[p]:
                                worth[p], changed = share, True
            self._worths[left] = worth
        return worth

    def align(self, acts: list[str], most: int) -> tuple[str, int | None, int, list[tuple[str, str]] | None]:
        """(status, cost, bound, moves): ``optimal`` with a cheapest alignment; ``impossible`` where no run ends; ``unfinished`` after ``most``
        states, then every alignment costs ``bound`` at least."""
        n = len(acts)
        unknown = [0] * (n + 1)  # moves that events after a place cost for want of a transition
        left: list[frozenset[str]] = [frozenset()] * (n + 1)
        for i in range(n - 1, -1, -1):
            unknown[i] = unknown[i + 1] + (0 if acts[i] in self.labels else ONE_SIDED)
            left[i] = left[i + 1] | {acts[i]} if acts[i] in self.labels else left[i + 1]
        worths = [self.worths(x) for x in left]

        def bound(i: int, marking: Marking) -> float:
            worth = worths[i]
            # sums of shares are rounded down a little: the bound must not pass the true cost
            total = sum(k * worth[p] for p, k in enumerate(marking) if k)
            return total if total == inf else unknown[i] + max(0, int(total - 1e-9 * (1 + total) + 0.999999))

        start, goal = (0, self.initial), (n, self.final)
        order, cost = count(), {start: 0}
        came: dict[tuple[int, Marking], tuple[tuple[int, Marking], tuple[str, str]]] = {}
        first = bound(*start)
        heap = [(first, 0, 0, start)] if first < inf else []
        seen = 0
        while heap:
            f, _, _, state = heappop(heap)
            g = cost[state]
            if g + bound(*state) < f:
                continue  # a cheaper way here was found since, and is in the heap
            if state == goal:
                moves = []
                while state != start:
                    state, move = came[state]
                    moves.append(move)
                return "optimal", g, g, moves[::-1]
            if seen >= most:
                return "unfinished", None, int(f), None
            seen += 1
            i, marking = state
            steps = [(ONE_SIDED, (i + 1, marking), (acts[i], STILL))] if i < n else []
            for name, label, after in self.steps(marking):
                steps.append((SILENT if label is None else ONE_SIDED, (i, after), (STILL, name)))
                if i < n and label == acts[i]:
                    steps.append((0, (i + 1, after), (acts[i], name)))
            for price, new, move in steps:
                total = g + price
                if total < cost.get(new, inf) and (rest := bound(*new)) < inf:
                    cost[new], came[new] = total, (state, move)
                    heappush(heap, (total + rest, -new[0], -next(order), new))
        return "impossible", None, 0, None


def aligned(net: Net, acts: list[str], most: int = 1_000_000) -> tuple[int, list[tuple[str, str]]] | None:
    """(cost, moves) of a cheapest alignment; None where there is none, or none after ``most`` states."""
    status, cost, _, moves = Aligner(net).align(acts, most)
    return (cost, moves) if status == "optimal" else None
