"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.scratch import settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component.

    ``nodes`` has ``node`` and ``edges`` ``a`` and ``b``. Each round every node takes the smallest root
    among its neighbours' and then its root's root, so long chains halve each time. Nothing but the two
    tables moves.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    roots = settled(nodes.select("node").distinct().withColumn("root", F.col("node")))
    while True:
        near = (
            both.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("near"))
        )
        lower = roots.join(near, F.col("node") == F.col("at"), "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("old"))
        lower = settled(lower)
        up = lower.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = settled(lower.join(up, F.col("root") == F.col("at")).select("node", F.col("above").alias("root"), "old"))
        changed = not jumped.filter("root <> old").isEmpty()
        roots = jumped.select("node", "root")
        if not changed:
            return roots
