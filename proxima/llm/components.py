"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join back, so a node with a
very large number of neighbours is never gathered; the edge count does not grow.  Every round is
written to the shared scratch folder and counted while it is written; while the counted edges are
few, the minima are broadcast instead of shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import BROADCAST_ROWS, written_and_seen


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """edges ``(u, v)`` with ``v < u``: every neighbour above a node is linked to the least of the node's
    neighbourhood, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(F.broadcast(least) if small else least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """The neighbours below a node, and the node itself, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(F.broadcast(least) if small else least, "u").where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component_id)`` for every id on an edge; the component is its smallest id.

    Nulls on an edge and self loops are ignored, repeated edges count once, an empty table gives
    no rows.
    """
    e, seen = written_and_seen(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                               .where("u <> v").distinct(), "edges", "u", "v")
    while seen[0]:
        small = seen[0] <= BROADCAST_ROWS
        e, now = written_and_seen(_small_star(_large_star(e, small), small), "edges", "u", "v")
        if now == seen:
            break
        seen = now
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component_id")),
                                      F.struct(F.col("v").alias("id"), F.col("v").alias("component_id")))).alias("x")
                    ).select("x.*").distinct()
