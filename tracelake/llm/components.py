"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), component being the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, hooks the node's old
    label to it and jumps twice; labels are written every round.  Sums are pre-aggregated and a hub's edges
    may be split by AQE, so no task gathers a component."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        seen = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("low"))
        hooks = seen.groupBy(F.col("old").alias("at")).agg(F.min("low").alias("to"))
        moved = seen.join(hooks, F.col("low") == F.col("at"), "left").select(
            "node", "old", F.least("low", F.coalesce("to", "low")).alias("component")
        )
        moved = staged(moved, "labels")
        if moved.where("old <> component").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
