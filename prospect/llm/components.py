"""Connected components of a graph that is only ever a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (u, v) with the least of u and its (both: all, else smaller) neighbours.

    The minimum is summed up before the shuffle, and Spark may split a hub's
    rows in the join.
    """
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b); a component is its least node.

    Large-star and small-star steps by turns (Kiveris et al., 2014) until
    nothing changes; each writes its edges to the shared folder. A component of
    n nodes has at most n edges from the first small-star on. Nulls and loops
    are left out. An empty table gives an empty one.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "edges")
    seen = None
    for _ in range(rounds):
        last = e
        large = _least(e, True).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _least(large, False)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, "edges")
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
