"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.operators.durable import Scratch, durable


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Rows ``(node, component)``, component being the least node reachable.

    Alternates the large-star and small-star steps, so a chain of length n needs O(log^2 n) rounds and
    no node ever gathers its neighbours in one task: each step is a join of the edges with the least
    neighbour per node (a map-side combined minimum).  Rounds end when no edge changes; every round is
    written to the shared folder.  Null ends and self loops are dropped; an empty input gives no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    scratch = Scratch(spark, "components")
    cur = scratch.put(e)
    before = None
    while True:
        # large star: every larger neighbour of u points at the least of u and its neighbours
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u's smaller neighbours and u point at the least of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = hop.union(low.select("u", F.col("m").alias("v"))).distinct()
        cur = scratch.put(nxt)
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    # a star forest: every non-root has one edge, to its root
    out = cur.groupBy("u").agg(F.min("v").alias("v"))
    nodes = out.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = out.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    result = durable(nodes.union(roots), "components-final")
    scratch.clear()
    return result
