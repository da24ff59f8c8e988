"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node; a hub's rows are pre-aggregated map-side in the
one and split by adaptive execution in the other. Each round is written to the shared folder, and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) to edges of the same components, each nearer to its component's smallest node.

    large: a node's larger neighbours move to its smallest one. Otherwise the node and its smaller
    neighbours do.
    """
    u, v = ("a", "b")
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(u).agg(F.least(F.min(v), F.col(u)).alias("m")).withColumnRenamed(u, "u")
    joined = both.join(least, both[u] == least["u"])
    if large:
        moved = joined.where(F.col(v) > F.col(u)).select(F.col(v).alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col(v).alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) to (node, component: its smallest node), one row per node that has an edge to another.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, old = mark, now
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        release(old)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
