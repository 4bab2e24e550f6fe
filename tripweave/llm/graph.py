"""Connected components of a link table, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.sources.storage import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node that it is connected with.

    Every round takes the smallest label among the neighbours and then the label of that label, so labels travel twice as
    far each time. When nothing changes, neighbours agree, and with them whole components. An empty table gives an empty one.
    """
    edges = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(edges.distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("to"), F.col("label").alias("to_label"))
        moved = hooked.join(target, hooked["label"] == target["to"]).select("node", "old", F.least("label", "to_label").alias("label"))
        moved = stage(moved, "labels")
        unstage(labels)
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            unstage(edges)
            return labels
