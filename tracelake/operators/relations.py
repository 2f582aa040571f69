"""Closure and reduction of relations between objects or activities: rows (a, b) that say a comes before, or points to, b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.sources.tables import release, stored


def _composed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, c) for which some b has (a, b) on the left and (b, c) on the right."""
    return left.select("a", F.col("b").alias("via")).join(right.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()


def closure(pairs: DataFrame) -> DataFrame:
    """(a, b): every pair that a chain of ``pairs`` (a, b) leads from and to, itself included; on a cycle (a, a) too. Rows with a null are left out.

    Each round composes what is new with all there is, from both sides, so chains double: rounds grow with the logarithm of the longest. What is known is kept in the shared folder, and only
    pairs not known yet go on.
    """
    known = stored(pairs.select("a", "b").where("a is not null and b is not null").distinct(), "closure")
    new = known
    while not new.isEmpty():
        both = _composed(new, known).unionByName(_composed(known, new)).distinct()
        fresh = stored(both.join(known, ["a", "b"], "left_anti"), "closure-new")
        before, known = known, stored(known.unionByName(fresh), "closure")
        for table in {id(before): before, id(new): new}.values():
            release(table)
        new = fresh
    return known


def reduction(pairs: DataFrame) -> DataFrame:
    """(a, b): ``pairs`` without those that a chain of others stands for. Only for relations without cycles, where this is the one smallest with the same closure; an error for others."""
    edges = pairs.select("a", "b").where("a is not null and b is not null").distinct()
    whole = closure(edges)
    if not whole.where("a = b").isEmpty():
        raise ValueError("a relation with a cycle has no single reduction")
    return edges.join(_composed(whole, whole), ["a", "b"], "left_anti")
