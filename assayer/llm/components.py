"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for ``nodes`` (node) and ``edges`` (a, b): the smallest node that can be reached, itself included.

    Each round takes the smallest label among a node and its neighbours, then follows the labels' own labels, so paths
    shorten by half and more. Minima combine before they are shuffled, and a hub's edges meet its label in a join that Spark
    can split. Rounds are written to the shared folder; the driver sees one count for each.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.select(F.col("a").alias("node")).groupBy("node").agg(F.min("node").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        hooked = written(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(hooked.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"), "was"), "labels")
        moved = new.where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
