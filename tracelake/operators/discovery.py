"""The alpha miners: one pass over the log, then one row for each pair of activities, from which all rows of the net are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.follows import in_case

_FACTS = ("forth", "back", "start", "end", "known", "into", "out", "into_back", "out_back")


def _name(kind: str, *parts: Column) -> Column:
    """A node's name: a JSON list, so that no two nodes share one whatever the activities are called."""
    return F.to_json(F.array(F.lit(kind), *parts))


def _pairs(log: DataFrame) -> DataFrame:
    """(x, y, facts): a row for each two activities seen next to each other (x before y in order of name), and for each activity (x = y).

    ``forth`` is x directly before y, ``back`` the other way; of one activity ``start`` and ``end`` say that it begins or ends a case, ``known``
    that it has a neighbour. ``into`` and ``out`` are y before, and y after, an x that stands in a run of itself.
    """
    before, after = F.lag("activity").over(in_case()), F.lead("activity").over(in_case())
    rows = log.select("activity", "event_idx", before.alias("before"), after.alias("after"))
    a = F.col("activity")
    run = (F.col("event_idx") > 0) & (F.coalesce(F.col("after") == a, F.lit(False)) | F.coalesce(F.col("before") == a, F.lit(False)))

    def fact(condition: Column, p: Column, q: Column, forth: str, back: str) -> Column:
        swap = p > q
        name = F.when(swap, F.lit(back)).otherwise(F.lit(forth))
        return F.when(condition, F.struct(F.least(p, q).alias("x"), F.greatest(p, q).alias("y"), name.alias("fact")))

    facts = F.array(
        fact(F.col("after").isNotNull(), a, F.col("after"), "forth", "back"), fact(F.col("before").isNull(), a, a, "start", "start"), fact(F.col("after").isNull(), a, a, "end", "end"),
        fact(F.col("after").isNotNull() | F.col("before").isNotNull(), a, a, "known", "known"),
        fact(run & F.col("before").isNotNull(), a, F.col("before"), "into", "into_back"), fact(run & F.col("after").isNotNull(), a, F.col("after"), "out", "out_back"),
    )
    return rows.select(F.inline(F.array_compact(facts))).groupBy("x", "y").agg(*(F.bool_or(F.col("fact") == f).alias(f) for f in _FACTS))


def _row(kind: str, name: Column, label: Column | None = None, target: Column | None = None, n: int | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), (none if label is None else label).cast("string").alias("label"), (none if target is None else target).cast("string").alias("target"), F.lit(n).cast("int").alias("n"))


def _between(place: Column, a: Column, b: Column) -> list[Column]:
    return [_row("place", place), _row("arc", _name("do", a), target=place), _row("arc", place, target=_name("do", b))]


def _net(pairs: DataFrame, rows: list[tuple[Column, list[Column]]]) -> DataFrame:
    """Rows of a net: of every pair those whose condition holds."""
    parts = F.array(*(F.when(condition, row) for condition, several in rows for row in several))
    return pairs.select(F.inline(F.array_compact(parts))).distinct()


def _alpha_rows() -> list[tuple[Column, list[Column]]]:
    x, y, one = F.col("x"), F.col("y"), F.col("x") == F.col("y")
    start, end = _name("begin"), _name("end")
    return [
        (one & F.col("known"), [_row("transition", _name("do", x), x)]),
        (one & F.col("start"), [_row("place", start), _row("place", end), _row("initial", start, n=1), _row("final", end, n=1)]),
        (one & F.col("start") & F.col("known"), [_row("arc", start, target=_name("do", x))]),
        (one & F.col("end") & F.col("known"), [_row("arc", _name("do", x), target=end)]),
        (~one & F.col("forth") & ~F.col("back"), _between(_name("then", x, y), x, y)),
        (~one & F.col("back") & ~F.col("forth"), _between(_name("then", y, x), y, x)),
    ]


def alpha(log: DataFrame) -> DataFrame:
    """Rows of a net: a transition for every activity with a neighbour, a place for every pair that follows one way only.

    Pairs are not merged into larger places. Arcs of activities without a neighbour are left out. See :mod:`nets` for the rows. Names
    are JSON lists: ``["do","a"]`` and ``["then","a","b"]``, ``["begin"]`` and ``["end"]``.
    """
    return _net(_pairs(log), _alpha_rows())


def alpha_plus(log: DataFrame) -> DataFrame:
    """:func:`alpha` with loops: two-way pairs share the places ``["both","a","b"]`` and ``["both","b","a"]``; an activity that follows itself gets a transition
    ``["again","a"]`` on a marked place ``["loop","a"]``; ``["short","a","b"]`` joins a to b where b stands before a repeated a, and a after a repeated b.
    """
    x, y, one = F.col("x"), F.col("y"), F.col("x") == F.col("y")
    loop, again, do = _name("loop", x), _name("again", x), _name("do", x)
    both = ~one & F.col("forth") & F.col("back")
    return _net(_pairs(log), [
        *_alpha_rows(),
        (both, [*_between(_name("both", x, y), x, y), *_between(_name("both", y, x), y, x)]),
        (one & F.col("forth"), [_row("transition", again, again), _row("place", loop), _row("initial", loop, n=1), *(_row("arc", a, target=b) for a, b in ((loop, again), (again, loop), (do, loop), (loop, do)))]),
        (F.col("into") & F.col("out_back") | one & F.col("into") & F.col("out"), _between(_name("short", x, y), x, y)),
        (~one & F.col("into_back") & F.col("out"), _between(_name("short", y, x), y, x)),
    ])
