"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.llm.common import drop, durable


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the smallest node that each linked node can reach.

    Each round takes the least label among neighbours (pre-aggregated before its shuffle) and then the label of that
    label, so a chain of n nodes takes about log n rounds. Each round's labels are a table in the shared folder. Hubs only
    make large join partitions that AQE splits. No links: no rows.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = durable(step.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        drop(labels)
        if step.filter("old <> label").isEmpty():
            drop(both)
            return step.select("node", "label")
        labels = step
