"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text: each holds the general words of the sample and the
words that its own class uses most in contrast to the other. Every window of a text is compressed with both; where the toxic
dictionary saves bytes over the ordinary one, the window reads like toxic text. A logistic curve over the spread of these savings,
calibrated on other labelled rows, gives the score.

The model is fitted on a bounded sample: at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows for the dictionaries and
``CALIBRATION_ROWS`` for the curve, the first by a hash of the id. Whole texts are scored.

Defined cases: null and blank texts are one empty window and get the score of a text without savings; without labels of both
classes every score is the share of toxic labels (0 without any); repeated rows get equal scores; a null id is held in (not held
out) and its row is scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from transitloom.llm.text import raw_texts, tidy, whole_texts
from transitloom.session import cut

TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS = 1500, 3000, 4000
WORDS, STEP = 6, 3
CONTRAST, GENERAL = 120, 400
LEVEL = 12
FEATURES = 13


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(text: bytes) -> list[bytes]:
    words = _words(text)
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, max(1, len(words) - WORDS + STEP), STEP)]


class Distance:
    """Compressed lengths under the two dictionaries; lives in one task."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self._toxic, self._ordinary = self._with(toxic), self._with(ordinary)

    @staticmethod
    def _with(content: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=settings).compress

    def features(self, text: bytes) -> list[float]:
        saved = np.array([len(self._ordinary(w)) - len(self._toxic(w)) for w in windows(text)], dtype=np.float64)
        saved[::-1].sort()
        n = len(saved)
        counts = [(saved >= k).sum() for k in (1, 2, 3, 4)]
        return [*(saved[min(k, n - 1)] for k in (0, 1, 2, 4)), saved.mean(), *(np.log1p(c) for c in counts), *(c / n for c in counts[:3]), np.log1p(n)]


def dictionary(general: list[bytes], own: list[bytes]) -> bytes:
    """The most telling words stand at the end, where references are cheapest."""
    return b" " + b" ".join([*reversed(general), *reversed(own)]) + b" "


@tidy
def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
            own = list(set(_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([toxic] * len(own), pa.int32())], names=["word", "toxic"])


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Distance(*model.value)
        for batch in batches:
            found = [tool.features(t) for t in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "features"])

    return tidy(run)


def _scores(model, curve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Distance(*model.value)
        mean, spread, weights, bias = curve
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(((np.array(tool.features(t)) - mean) / spread) @ weights + bias, -30, 30))) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return tidy(run)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 3000, rate: float = 0.5, decay: float = 1e-4):
    """(mean, spread, weights, bias) of a logistic fit on standardised features."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        w -= rate * (z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) / len(y) + decay * w)
    return mean, spread, w[:-1], w[-1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame):
    """(broadcast dictionaries, curve) from the labelled rows that are not held out, or the share of toxic labels where they are of one class."""
    spark = docs.sparkSession
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    own = own.withColumn("_h", F.xxhash64(F.lit("toxicity"), "id"))
    first = lambda rows, n: rows.orderBy("_h", "id").limit(n)
    training = F.pmod(F.col("_h"), F.lit(3)) > 0
    named = first(own.where(training & (F.col("toxic") == 1)), TOXIC_ROWS).union(first(own.where(training & (F.col("toxic") == 0)), ORDINARY_ROWS)).withColumn("fit", F.lit(True))
    named = named.union(first(own.where(~training), CALIBRATION_ROWS).withColumn("fit", F.lit(False))).drop("_h")
    # At most TOXIC_ROWS + ORDINARY_ROWS + CALIBRATION_ROWS ids.
    sample = cut(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(named), "id").select("text", "toxic", "fit"))
    sizes = {(r["fit"], r["toxic"]): r["n"] for r in sample.groupBy("fit", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, ordinary = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not toxic or not ordinary:
        total = sum(sizes.values())
        return None, (sum(n for (_, t), n in sizes.items() if t == 1) / total if total else 0.0)
    counted = cut(sample.where("fit").select("text", "toxic").mapInArrow(_word_sets, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.count_if(F.col("toxic") == 0).alias("b")))
    share = (F.col("a") + F.col("b")) / (toxic + ordinary)
    z = (F.col("a") / toxic - F.col("b") / ordinary) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / ordinary) + 1e-12)
    scored = counted.withColumn("z", z)
    pick = lambda order, n: [bytes(r["word"]) for r in scored.orderBy(order, "word").limit(n).collect()]
    tox, plain = pick(F.desc("z"), CONTRAST), pick(F.asc("z"), CONTRAST)
    taken = {*tox, *plain}
    general = [w for w in pick(F.desc(F.col("a") + F.col("b")), GENERAL) if w not in taken]
    model = spark.sparkContext.broadcast((dictionary(general, tox), dictionary(general, plain)))
    both = sizes.get((False, 1), 0) and sizes.get((False, 0), 0)
    rows = (sample.where("NOT fit") if both else sample).select("text", "toxic").mapInArrow(_features(model), "toxic int, features array<double>").collect()
    curve = logistic(np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=np.float64))
    return model, curve


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every row."""
    narrow = whole_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model, curve = fit(narrow, labels)
    if model is None:
        return narrow.select(F.col("doc_id").alias("id"), F.lit(float(curve)).alias("score"))
    return narrow.mapInArrow(_scores(model, curve), f"id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, labels)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
