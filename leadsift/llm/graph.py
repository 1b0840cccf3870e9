"""Connected components by joins, for links that only the cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsift.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(`node`, `label`) for every node of the links (`a`, `b`): the smallest node that it reaches.

    A round takes the smallest label among neighbours, then the label of the label. Each step is
    written to the shared folder, so a hub's join reads two plain tables, which adaptive execution
    can split, and a lost executor costs one step. Rounds end when no label changes.
    """
    links = written(links.where("a != b").select("a", "b"), "links")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links-both")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        offers = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        lower = written(offers.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "labels-lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("_above"))
        after = written(lower.join(up, "label").select("node", F.col("_above").alias("label")), "labels")
        before = labels.withColumnRenamed("label", "_before")
        changed = after.join(before, "node").where("label != _before").limit(1).count()
        labels = after
        if not changed:
            return labels
