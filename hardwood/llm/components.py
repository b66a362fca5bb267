"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Up to so many edges, the minima of a step are broadcast (at most this many short rows) and its rows go to FEW tasks.
SMALL, FEW = 250_000, 8


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    Every step is a min aggregation (combined on the map side) and an equi-join that AQE can
    split, so a node with very many links is never gathered in one task. Edges with a null end
    and self-loops are ignored; repeated edges count once; no edges give an empty result.
    Nodes may be of any orderable type. ``discard`` deletes the result's table.
    """
    e = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(e)
    while state[0]:
        few = state[0] <= SMALL
        near = (lambda df: F.broadcast(df.coalesce(FEW))) if few else (lambda df: df)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = near(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = materialize(small.coalesce(FEW) if few else small)
        now = _state(new)
        discard(e)
        e, done, state = new, now == state, now
        if done:
            break
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    found._hardwood_path = e._hardwood_path
    return found
