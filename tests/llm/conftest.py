import random

import pytest
from pyspark.sql import types as T

WORDS = [f"w{i}x" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_texts():
    """Nulls, blanks, long texts, ties, copies, near copies and shared passages."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(8)]
    passage = prose(rng, 70)
    texts = [None, "", "   \n\t", "one", "Two words", "three words only", "a b c d", *base]
    for b in base[:5]:
        words = b.split()
        texts += [b, b.upper(), " ".join(words[:-1] + ["changed"]), " ".join(["changed"] + words[1:]), "\n".join(words)]
    for b in base[:4]:
        texts.append(f"{prose(rng, 20)} {passage} {prose(rng, 15)}")
    texts += [passage, "same " * 300, "same " * 310, "été ÉTÉ straße \U0001f600", "x" * 30000, prose(rng, 6000), "<|endoftext|> it's　here"]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    """The texts with clashing extra columns; one row stands twice."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("kept", T.StringType()),
    ])
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src", None if t is None else len(t), "x", 1, "y") for i, t in enumerate(edge_texts())]
    return spark.createDataFrame(rows + [rows[8]], schema).repartition(3)


@pytest.fixture(scope="session")
def unique_docs(docs):
    return docs.dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}
