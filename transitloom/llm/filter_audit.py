"""Audit of how filters overlap: what each removes in every order of application.

Filters on a row's own text give failing ids in one scan. The duplicate filter is an existential self-join: rows whose hash may
stand twice (a Bloom filter rules out the others) meet, by left-semi join on hash, exact text and smaller id, the smallest id of
each text. Failing ids of all filters are united, and one aggregation turns them into a bit combination per document; orders,
marginal and unique effects and Shapley sums follow from the counts per combination.

Before the self-join the texts of one side are combined map-side, so a group of copies gives one row per text, and hashes that
hold more than 1/``HOT_SHARE`` of all rows (fewer than ``HOT_SHARE`` hashes, whatever the table) are dealt over ``SALTS`` places.

Defined cases: null text counts as empty; a null or repeated id is not smaller than itself, so rows that repeat id and text do
not fail each other, and rows without id neither fail nor make others fail; null language is the part ""; labels of one id are
taken together (any mark counts), rows without label lose nothing; other columns are ignored; an empty table gives an empty
result. Rows that repeat id, text and part are counted each.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from transitloom.llm.bloom import Bloom
from transitloom.session import cut, load, store_counted

DUPLICATE = "E"
HOT_SHARE = 1000
SALTS = 64


def document_filters() -> dict[str, Column]:
    """The failure conditions of the four filters on column ``text``, in the order of their bits."""
    words = F.array_remove(F.split(F.regexp_replace("text", "[\t-\r]", " "), " "), "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def failing_duplicates(docs: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """doc_id, h, part of the rows whose text also stands under a smaller id. ``docs``: doc_id, text, part, h; ``hashes``: h."""
    maybe = docs.where(Bloom(hashes, rows, twice=True).test(F.col("h")))
    heavy = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, rows // HOT_SHARE))
    hot = [row.h for row in heavy.select("h").collect()]  # fewer than HOT_SHARE rows
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    spread = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    first = maybe.groupBy("h", "text").agg(F.min("doc_id").alias("low")).select("h", F.col("text").alias("same"), "low", F.explode(places).alias("place"))
    later = maybe.withColumn("place", spread)
    meets = (later["h"] == first["h"]) & (later["place"] == first["place"]) & (later["text"] == first["same"]) & (first["low"] < later["doc_id"])
    return later.join(first, meets, "left_semi").select("doc_id", "h", "part")


def failure_bits(docs: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, h, part, bits and the number of equal rows n; bit i stands for the i-th filter, the last one for duplicates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    plain = docs.select(F.col(id_col).alias("doc_id"), text, part).withColumn("h", F.xxhash64("text"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    own = plain.select("doc_id", "h", "part", bits.alias("bits"))
    path, rows = store_counted(own)
    own = load(docs.sparkSession, own.schema, path)
    again = failing_duplicates(plain, own.select("h"), rows).select("doc_id", "h", "part", F.lit(1 << len(filters)).alias("bits"))
    failing = own.select("*", F.lit(1).alias("n")).unionByName(again.select("*", F.lit(0).alias("n")))
    return failing.groupBy("doc_id", "h", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, bits, n, good, toxic: documents per combination of failed filters."""
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    per_doc = failure_bits(docs, filters, id_col, text_col, part_col)
    marked = per_doc.join(marks, per_doc["doc_id"] == marks["_id"], "left")
    return marked.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic")
    )


def order_table(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step. ``counts``: part, bits, n, good, toxic; few rows per part."""
    orders = ",".join("".join(p) for p in itertools.permutations(letters))
    value = lambda text: sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    steps = counts.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    ).select(
        "*", value(F.substring("filter_order", F.col("step"), F.lit(1))).alias("own"), value(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("before")
    )
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    # Of all orders, a document with k failures is removed by each of them in a k-th.
    total = len(orders.split(","))
    over = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")
    return steps.groupBy("part", "filter_order", "step").agg(
        over(~fails & ~gone, "n").alias("kept"), over(fails & ~gone, "n").alias("removed"), over(fails & gone, "n").alias("redundant"),
        over(F.col("bits") == F.col("own"), "n").alias("unique_fails"), over(fails & ~gone, "good").alias("good_lost"), over(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.expr(f"n * ({total} div bit_count(bits))")).otherwise(0)).cast("bigint").alias("shapley"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The whole audit. ``filters``: letter -> failure condition on column ``text``; at most four, the duplicate filter comes last."""
    filters = document_filters() if filters is None else filters
    return order_table(cut(combinations(docs, labels, filters, id_col, text_col, part_col)), "".join(filters) + DUPLICATE)
