"""Quality by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns (all documents; at most 3 ** labellers patterns) estimates how often each labeller is right and the posterior of each
pattern. These posteriors label a bounded sample (``SAMPLE`` rows, the first by a hash of the id), on which a linear scorer over
hashed words, word shapes and repetitions is trained; every whole document is then scored by it.

No hand label is used. Defined cases: null and blank texts have no words, get no vote but that of the emptiness labeller, and are
scored like any other; repeated rows get equal scores; an empty table gives an empty result; with a table whose labellers never
disagree the posterior follows the majority.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from transitloom.llm.text import Block, blocks, mix, tidy, whole_texts
from transitloom.session import cut

LABELLERS = ("upper case", "marks in words", "bare marks", "same word again", "few different words", "word length", "empty", "marks among letters", "marks at word ends", "upper case among letters")
STRETCH = 1000  # words
DIMS = 1 << 13
SAMPLE = 6000
KEEP = 0.3  # only what is clearly bad goes
_KIND = np.full(256, 3, dtype=np.int64)  # of bytes: 0 lower, 1 upper, 2 digit, 3 beyond ASCII, 4 sentence mark, 5 other mark
_KIND[:128] = 5
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def votes(block: Block) -> np.ndarray:
    """(texts, labellers): 1 good, -1 bad, 0 no vote."""
    kind, starts, ends, at = _KIND[block.buf], block.starts, block.ends, block.words
    n = np.maximum(np.diff(at), 1)
    hashes = block.hashes()
    by_kind = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (0, 1, 5)]
    lower, upper, marks = (c[ends] - c[starts] for c in by_kind)
    size = ends - starts
    ascii_letters = lower + upper
    text = np.repeat(np.arange(block.n), np.diff(at))
    again = np.zeros(len(starts), dtype=bool)
    for k in (1, 2, 3, 4):
        again[k:] |= (hashes[k:] == hashes[:-k]) & (text[k:] == text[:-k])
    out = np.zeros((block.n, len(LABELLERS)), dtype=np.int64)

    def vote(i: int, value: np.ndarray, bad, good) -> None:
        out[:, i] = np.where(bad(value), -1, np.where(good(value), 1, 0))

    shout = _sums((upper > 1) & (upper > lower), at) / n
    vote(0, shout, lambda v: v > 0.15, lambda v: v < 0.03)
    vote(1, _sums((marks > 0) & (ascii_letters > 0), at) / n, lambda v: v > 0.15, lambda v: v < 0.03)
    vote(2, _sums((marks > 0) & (marks == size), at) / n, lambda v: v > 0.08, lambda v: v < 0.02)
    vote(3, _sums(again, at) / n, lambda v: v > 0.2, lambda v: v < 0.1)
    # Different words per stretch, averaged over the whole text, so that the share does not fall with the length.
    place = np.arange(len(starts)) - np.repeat(at[:-1], np.diff(at))
    stretch = np.cumsum(place % STRETCH == 0)
    order = np.lexsort((hashes, stretch))
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])
    different = np.bincount(text[order][fresh], minlength=block.n) / n
    vote(4, different, lambda v: v < 0.15, lambda v: v > 0.35)
    vote(5, _sums(size, at) / n, lambda v: (v > 14) | (v < 2), lambda v: (v > 3) & (v < 11))
    out[:, 5] = np.where(np.diff(at) == 0, 0, out[:, 5])
    empty = np.diff(at) == 0
    total = np.maximum(_sums(size, at), 1)
    vote(7, _sums(marks, at) / total, lambda v: v > 0.08, lambda v: v < 0.02)
    vote(8, _sums((kind[ends - 1] == 5) & (size > 1), at) / n, lambda v: v > 0.2, lambda v: v < 0.05)
    vote(9, _sums(upper, at) / np.maximum(_sums(ascii_letters, at), 1), lambda v: v > 0.3, lambda v: v < 0.1)
    out[empty] = 0
    out[:, 6] = np.where(empty, -1, np.where(np.diff(at) >= 20, 1, 0))
    return out


def buckets(block: Block) -> np.ndarray:
    """Three hashed features of each word: the word, its shape, and how far back it stood before."""
    kind, starts, ends = _KIND[block.buf], block.starts, block.ends
    hashes = block.hashes()
    last = ends - 1
    shape = ((kind[starts] * 8 + kind[last]) * 8 + kind[np.maximum(last - 1, starts)]) * 16 + np.minimum(ends - starts, 15)
    back = np.zeros(len(starts), dtype=np.int64)
    for k in (4, 3, 2, 1):
        back[k:][hashes[k:] == hashes[:-k]] = k
    spread = lambda x, salt: (mix(x.astype(np.uint64) + np.uint64(salt)) % np.uint64(DIMS)).astype(np.int64)
    return np.stack([spread(hashes, 1), spread(shape, 1 << 40), spread(back, 1 << 41)])


@tidy
def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [((votes(b) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1) for b in blocks(batch.column(1))]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.int64())], names=["id", "pattern"])


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """(posterior of "good" per pattern, accuracy per labeller where it votes) from pattern counts."""
    cast = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3  # 0 bad, 1 none, 2 good
    # Labellers watch for different faults, so a bad text gets few bad votes: a start by majority would take most of them for good.
    post = np.where((cast == 0).any(axis=1), 0.1, 0.9)
    rate = np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        for y in (0, 1):
            for v in range(3):
                rate[y, :, v] = (weight[y][:, None] * (cast == v)).sum(axis=0) + 0.5
        rate /= rate.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        line = np.log(share)[:, None] + np.stack([np.log(rate[y][np.arange(len(LABELLERS)), cast]).sum(axis=1) for y in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(line[0] - line[1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    right = share[1] * rate[1, :, 2] + share[0] * rate[0, :, 0]
    cast_at_all = share[1] * (1 - rate[1, :, 1]) + share[0] * (1 - rate[0, :, 1])
    return post, right / np.maximum(cast_at_all, 1e-12)


@tidy
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most SAMPLE rows (text, posterior) come to this task; it returns the weights."""
    rows, places, values, labels = [], [], [], []
    for batch in batches:
        labels.extend(batch.column(1).to_pylist())
        for block in blocks(batch.column(0)):
            own = buckets(block)
            for a, b in zip(block.words[:-1].tolist(), block.words[1:].tolist()):
                at, n = np.unique(own[:, a:b], return_counts=True)
                places.append(at)
                values.append(n / max(1, b - a))
                rows.append(len(at))
    y, n = np.array(labels), len(labels)
    if not n:
        return
    row, col, val = np.repeat(np.arange(n), rows), np.concatenate(places), np.concatenate(values)
    w, bias, grad2, bias2 = np.zeros(DIMS), 0.0, np.full(DIMS, 1e-8), 1e-8
    for _ in range(300):  # full-batch AdaGrad
        line = np.bincount(row, weights=val * w[col], minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(line, -30, 30))) - y
        grad = np.bincount(col, weights=val * error[row], minlength=DIMS) / n + 1e-6 * w
        grad2 += grad * grad
        w -= 0.5 * grad / np.sqrt(grad2)
        bias2 += error.mean() ** 2
        bias -= 0.5 * error.mean() / np.sqrt(bias2)
    yield pa.RecordBatch.from_arrays([pa.array([np.append(w, bias).tobytes()], pa.binary())], names=["weights"])


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float64)
        for batch in batches:
            scores = []
            for block in blocks(batch.column(1)):
                line = _sums(w[:-1][buckets(block)].sum(axis=0), block.words) / np.maximum(np.diff(block.words), 1) + w[-1]
                scores.append(1 / (1 + np.exp(-np.clip(line, -30, 30))))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.float64())], names=["id", "score"])

    return tidy(run)


def _filter(weights, at: int, least: float):
    score = _score(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["id", "text"])
            yield batch.filter(pc.greater_equal(next(score(iter([text]))).column(1), least))

    return tidy(run)


class Quality:
    """``votes``: id, pattern, posterior of every row. ``accuracy``: labeller to its estimated accuracy."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        spark = docs.sparkSession
        self.docs = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.kind = self.docs.schema["id"].dataType.simpleString()
        voted = cut(self.docs.mapInArrow(patterns, f"id {self.kind}, pattern long"))
        counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()  # at most 3 ** labellers rows
        codes, counts = np.array([r["pattern"] for r in counted], dtype=np.int64), np.array([r["n"] for r in counted], dtype=np.float64)
        post, accuracy = expectation_maximisation(codes, counts) if len(codes) else (np.zeros(0), np.zeros(len(LABELLERS)))
        self.accuracy = dict(zip(LABELLERS, accuracy.tolist()))
        known = F.broadcast(spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "pattern long, posterior double"))
        self.votes = voted.join(known, "pattern").select("id", "pattern", "posterior")
        picked = F.broadcast(self.votes.where("id IS NOT NULL").orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(SAMPLE).select("id", "posterior").distinct())
        trained = self.docs.join(picked, "id").select("text", "posterior").repartition(1).mapInArrow(_train, "weights binary").collect()
        weights = bytes(trained[0]["weights"]) if trained else np.zeros(DIMS + 1).tobytes()
        self._weights = spark.sparkContext.broadcast(weights)

    def scores(self) -> DataFrame:
        return self.docs.mapInArrow(_score(self._weights), f"id {self.kind}, score double")

    def kept(self, rows: DataFrame, text_col: str, at_least: float = KEEP) -> DataFrame:
        """Whole rows whose text scores ``at_least``; rows go through the task as they are."""
        return rows.mapInArrow(_filter(self._weights, rows.columns.index(text_col), at_least), rows.schema)


def quality_report(docs: DataFrame) -> DataFrame:
    found = Quality(docs)
    return found.scores().select(F.col("id").alias("doc_id"), "score", (F.col("score") >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the scorer rejects."""
    return Quality(docs, id_col, text_col).kept(docs, text_col)
