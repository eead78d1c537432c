"""The bucketed order helpers against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window, functions as F

from transitloom.operators.ordered import exact_quantiles, number_rows, previous_row, trailing_rows


def _events(spark, n=600):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 4 + ["a", "b"]), rng.randrange(0, 5000), i, float(rng.randrange(0, 40))) for i in range(n)]
    return spark.createDataFrame(rows, "k STRING, t BIGINT, id BIGINT, v DOUBLE").withColumn("b", F.floor(F.col("t") / 100))


def test_number_rows(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {(r.id, r.n) for r in df.select("id", F.row_number().over(w).alias("n")).collect()}
    got = {(r.id, r.idx) for r in number_rows(df, ["k"], ["t", "id"], "b").collect()}
    assert got == want


def test_previous_row(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {(r.id, r.p) for r in df.select("id", F.lag("t").over(w).alias("p")).collect()}
    got = {(r.id, r.prev.t if r.prev else None) for r in previous_row(df, ["k"], ["t", "id"], "b", ["t"]).collect()}
    assert got == want


def test_trailing_rows_across_chunks(spark):
    df = number_rows(_events(spark), ["k"], ["t", "id"], "b")
    w = Window.partitionBy("k").orderBy("idx").rowsBetween(-4, 0)
    want = {(r.id, r.s) for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    got = {(r.id, r.s) for r in trailing_rows(df, ["k"], "idx", 4, {"s": F.sum("v")}, chunk=17).collect()}
    assert got == want


def test_exact_quantiles(spark):
    df = _events(spark)
    want = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b")).collect()}
    for splits in (4, 64):
        got = exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}, splits=splits).collect()
        assert {r.k for r in got} == set(want)
        for row in got:
            assert abs(row.a - want[row.k][0]) < 1e-9 and abs(row.b - want[row.k][1]) < 1e-9
