"""Connected components of an undirected graph, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each end of ``edges`` (a, b).

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, so paths shorten geometrically. Labels are written to
    the shared folder after each round. A hub costs one row for each edge; the
    minimum is pre-aggregated before the shuffle.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("next"))
        # A label is itself a node, so its own label is known: jump there.
        ahead = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = step.join(ahead, "next").select("id", F.least("next", "far").alias("new"), "label")
        new = stored(new, "cc-step")
        if new.where("new != label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", F.col("new").alias("label"))
