"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parquill.runtime import checkpoint


#: Edges that one task reads in a round, about, and tasks at least.
PART_EDGES, LEAST_PARTS = 500_000, 6


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of edges in columns ``a`` and ``b``.

    Labels spread to neighbours and jump to their label's label until none changes; rounds grow with
    the logarithm of a component's width. All joins are plain equi-joins, which Spark may split where a
    node has very many edges; minima are summed up before they are shuffled.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = checkpoint(both)
    n = both.count()
    parts = max(LEAST_PARTS, -(-n // PART_EDGES))  # small tables are read in few tasks, round after round
    both = both.coalesce(parts)
    labels = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")).coalesce(parts)
    changed = n
    while changed:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("before"))
        spread = near.union(labels.select("node", "label", F.col("label").alias("before"))).groupBy("node").agg(F.min("label").alias("label"), F.min("before").alias("before"))
        old = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        jumped = spread.join(old, spread["label"] == old["n"], "left").select("node", F.coalesce(F.least("label", "l"), "label").alias("label"), "before")
        after = checkpoint(jumped).coalesce(parts)
        changed = after.filter("label <> before").limit(1).count()
        labels = after.select("node", "label")
    return labels.select("node", F.col("label").alias("component"))
