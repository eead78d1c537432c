"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transitloom.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from transitloom.llm.queries import tokenizer_path
from transitloom.session import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal apart from the case of A-Z, the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, one stays."""
    return ngram_join.keep_one_per_component(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in a document with a smaller doc_id are cut out."""
    return substring_dedup.remove_repeated_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, one row each."""
    return packing.packing_report(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("ngram_jaccard_join", near_stage),
    ("substring_dedup", passage_stage), ("packing", packing_stage),
]

#: No SQL for the trained scorer and the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
