"""Groups that may hold a third of all rows: totals without one task per group, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transitloom.session import cut, load, store_counted

SALTS = 32


def with_totals(df: DataFrame, keys: list[str], spread: Column, partial: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """Adds per-key totals to every row.

    ``partial`` aggregates within (key, salt), ``total`` combines those. Rows meet their totals on (key, salt), so the rows
    of a key are spread over ``SALTS`` places.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    totals = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in total.items()])
    placed = parts.select(*keys, "_salt").join(totals, keys)
    return salted.join(placed, [*keys, "_salt"]).drop("_salt")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach. ``nodes``: node; ``links``: a, b, both among the nodes.

    Each round every node takes the smallest label near it and then the label of that label; rounds end when nothing changes.
    Only nodes that have links take part in the rounds.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        heads = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        updated = lowered.join(heads, lowered["label"] == heads["_n"], "left").select("node", "old", F.least("label", F.coalesce("_l", "label")).alias("label"))
        path, changed = store_counted(updated, F.col("label") != F.col("old"))
        labels = load(nodes.sparkSession, updated.schema, path).select("node", "label")
        if not changed:
            break
    found = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return nodes.join(found, nodes["node"] == found["_n"], "left").select("node", F.coalesce("_l", "node").alias("label"))
