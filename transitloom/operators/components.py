"""Connected groups of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transitloom.session import cut, load, store_counted


def connected_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the group.

    Each round takes the smallest label among the neighbours and then follows that label one step
    further, so long chains shrink quickly. Rounds end when no label changes.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a").agg(F.min("label").alias("near"))
        )
        lowered = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        further = lowered.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        updated = lowered.join(further, lowered["label"] == further["_n"], "left").select(
            "node", "old", F.least("label", F.coalesce("_l", "label")).alias("label")
        )
        path, changed = store_counted(updated, F.col("label") != F.col("old"))
        labels = load(nodes.sparkSession, updated.schema, path).select("node", "label")
        if not changed:
            return labels
