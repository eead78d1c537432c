"""Token totals kept up to date by signed changes.

A change has the row before (null for an insert) and after (null for a delete); a revision has both. Each image is counted once,
the one before with sign -1, and only sums by source, language and tokenizer version are shuffled and stored. A batch is one
partition of the table of sums, written by dynamic partition overwrite: delivering it again replaces it by itself, so a batch counts
once however often it is committed. Totals are the sums over all batches; ``compact`` folds them into one.

Defined cases: null text counts as empty (0 tokens); null source or language is a group of its own; a revision that moves a row to
another source takes it from the old one; groups whose documents and tokens are all taken back are left out of the totals; repeated
rows count once per row; an empty batch adds nothing, and delivered again in place of a full one it takes that one's sums back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from transitloom.llm import bpe
from transitloom.llm.groups import with_totals
from transitloom.llm.text import blocks, tidy
from transitloom.session import cut, step_folder

WORDS = "words-1"
KEYS = ["source", "lang", "version"]
_SCHEMA = "source string, lang string, version string, documents long, tokens long, batch string"


def _counts(source, bpe_version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.encoder(source)
        for batch in batches:
            texts = batch.column(3)
            words = np.concatenate([np.diff(b.words) for b in blocks(texts)]) if batch.num_rows else np.zeros(0, np.int64)
            pieces = np.fromiter((len(x) for x in tool.column(texts)), np.int64, count=batch.num_rows)
            for version, n in ((WORDS, words), (bpe_version, pieces)):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * batch.num_rows, pa.string()), pa.array(n, pa.int64())], names=["source", "lang", "sign", "version", "tokens"])

    return tidy(run)


def signed_sums(changes: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """source, lang, version, documents, tokens: what the changes add. ``changes``: before, after (structs of source, lang, text)."""
    images = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("row")))).alias("i")).where("i.row IS NOT NULL")
    flat = images.select("i.row.source", "i.row.lang", "i.sign", "i.row.text")
    counted = flat.mapInArrow(_counts(bpe.load_source(changes, tokenizer), version), "source string, lang string, sign int, version string, tokens long")
    return counted.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str, version: str) -> None:
        self.spark, self.path, self.tokenizer, self.version = spark, path, tokenizer, version

    def commit(self, batch: str, changes: DataFrame) -> None:
        sums = signed_sums(changes, self.tokenizer, self.version)
        # A row that adds nothing gives even an empty batch its partition, which replaces what an earlier delivery left.
        mark = self.spark.range(1).select(*[F.lit(None).cast("string").alias(k) for k in KEYS[:2]], F.lit(self.version).alias("version"), *[F.lit(0).cast("long").alias(n) for n in ("documents", "tokens")])
        self._write(sums.union(mark).withColumn("batch", F.lit(batch)))

    def _write(self, sums: DataFrame) -> None:
        sums.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def batches(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def totals(self) -> DataFrame:
        sums = self.batches().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def compact(self, path: str, name: str = "base") -> Rollup:
        """The same totals as one batch in a new folder; the old one stays until readers have moved."""
        new = Rollup(self.spark, path, self.tokenizer, self.version)
        new._write(self.totals().withColumn("batch", F.lit(name)))
        return new


def _image(text: str):
    return F.struct(F.col("source"), F.col("lang"), F.col(text).alias("text"))


def corpus_history(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """Batches as a corpus sees them: all rows come in; mail addresses are masked; copies of a text go (the smallest id stays)."""
    none = F.lit(None).cast("struct<source:string,lang:string,text:string>")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    masked = rows.withColumn("clean", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<mail>"))
    revised = masked.where("clean <> text").select(_image("text").alias("before"), _image("clean").alias("after"))
    keyed = rows.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    copies = cut(with_totals(keyed, ["digest"], F.col("doc_id"), {"_m": F.min("doc_id")}, {"low": F.min("_m")}).where("doc_id > low").select(F.col("doc_id").alias("_id")).distinct())
    gone = masked.join(copies, F.col("doc_id") == F.col("_id"), "left_semi").select(_image("clean").alias("before"), none.alias("after"))
    return [("load", rows.select(none.alias("before"), _image("text").alias("after"))), ("mask", revised), ("copies", gone), ("mask", revised)]


def rollup_report(docs: DataFrame, tokenizer: str, version: str = "byte_bpe_50k") -> DataFrame:
    """Totals after the history of a corpus, one batch of which is delivered twice."""
    spark = docs.sparkSession
    kept = Rollup(spark, f"{step_folder(spark)}/{uuid.uuid4().hex}", tokenizer, version)
    for batch, changes in corpus_history(docs):
        kept.commit(batch, changes)
    return kept.totals()
