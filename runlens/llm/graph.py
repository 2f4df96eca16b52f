"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round takes the least label among neighbours and then the label's own
    label, so paths shorten geometrically; every round is written to the shared
    folder. Grouped minima combine before the shuffle, so a node with any number
    of edges is one row for each task.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("component").alias("near"))
        least = stored(labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "least")
        upper = least.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = stored(least.join(upper.hint("merge"), "component", "left").select("node", "was", F.coalesce("up", "component").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
