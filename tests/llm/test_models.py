import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from transitloom.llm import quality, toxicity
from transitloom.llm.text import blocks


@pytest.fixture(scope="module")
def judged(spark):
    """Documents with toxic words in a fifth of them, and labels for most; plus edge cases."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(30, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefool", "nastyhead", "vilespeak"]))
        rows.append((i, " ".join(words), "en"))
        if i % 7:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None), (1001, "", "en"), (1002, "word " * 20000, "en"), (None, "plain text", "en"), (5, rows[5][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(judged):
    docs, labels = judged
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    right = [r.predicted == (r.doc_id % 5 == 0) for r in held]
    assert np.mean(right) > 0.95


def test_toxicity_ignores_held_out_labels(judged):
    docs, labels = judged
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a = {r.doc_id: r.score for r in toxicity.score(docs, labels).selectExpr("id AS doc_id", "score").collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs, turned).selectExpr("id AS doc_id", "score").collect()}
    assert a == b


def test_toxicity_without_labels_and_empty(judged):
    docs, labels = judged
    assert {r.score for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


def test_quality_separates_faults(spark, judged):
    rng = random.Random(8)
    good = [prose(rng, 100) for _ in range(300)]
    bad = [prose(rng, 100).upper() for _ in range(20)] + [prose(rng, 2) + " " + "again " * 100 for _ in range(20)] + [prose(rng, 80).replace(" ", "### ") for _ in range(20)] + [prose(rng, 60).replace(" ", " | ") for _ in range(20)]
    rows = list(enumerate(good + bad)) + [(1000, None), (1001, " \n"), (None, prose(rng, 50)), (1002, prose(rng, 30000)), (0, good[0])]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, score string, pattern int").repartition(3)
    got = {r.doc_id: r.keep for r in quality.quality_report(docs).collect()}
    assert all(got[i] for i in range(300)) and got[1002] and not any(got[300 + i] for i in range(80))
    assert quality.quality_report(docs).count() == len(rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.quality_report(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    n, labellers = 20000, len(quality.LABELLERS)
    y = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.95, labellers)
    cast = np.where(rng.random((n, labellers)) < right, y[:, None], ~y[:, None]).astype(int) * 2
    codes, at, counts = np.unique((cast * 3 ** np.arange(labellers)).sum(axis=1), return_inverse=True, return_counts=True)
    post, accuracy = quality.expectation_maximisation(codes, counts.astype(float))
    assert np.abs(accuracy - right).max() < 0.03 and ((post[at] > 0.5) == y).mean() > 0.97


def test_few_words_over_and_over_are_bad_at_every_length():
    rng = random.Random(2)
    few, many = [f"w{i}" for i in range(40)], [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (900, 4900, 5100, 30000) for words in (few, many)]
    got = np.concatenate([quality.votes(b) for b in blocks(pa.array(texts))])[:, 4].tolist()
    assert got == [-1, 1] * 4
