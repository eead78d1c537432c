"""Comparison of a prepared package with the live tables, and duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom.operators.ordered import number_rows


def new_rows(package: DataFrame, live: DataFrame, keys: list[str], only: list[str] | None = None, only_column: str | None = None) -> DataFrame:
    """Package rows whose key is not live, optionally of some corridors only."""
    out = package.join(live.select(*keys), keys, "left_anti")
    return out.filter(F.col(only_column).isin(only)) if only and only_column else out


def normal_value(value: Column) -> Column:
    """Text for comparison: trimmed, whole numbers without a fraction, null as empty."""
    return F.coalesce(F.regexp_replace(F.trim(value.cast("string")), r"\.0+$", ""), F.lit(""))


def key_collisions(package: DataFrame, live: DataFrame, keys: list[str], ignore: list[str] | None = None) -> DataFrame:
    """Rows present on both sides and the columns in which they differ after normalisation."""
    columns = [c for c in package.columns if c in live.columns and c not in keys and c not in (ignore or ["created_at"])]
    other = live.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in columns])
    joined = package.join(other, keys)
    differs = [F.when(~normal_value(F.col(c)).eqNullSafe(normal_value(F.col(f"_l_{c}"))), c) for c in columns]
    return joined.select(*keys, F.array_join(F.array_compact(F.array(*differs)), ",").alias("differing"))


def value_drift(package: DataFrame, live: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    other = live.select(*keys, F.col(value).alias("_live"))
    return package.join(other, keys).filter(F.abs(F.col(value) - F.col("_live")) > tolerance).select(*keys, F.col(value).alias("package_value"), F.col("_live").alias("live_value"))


def id_differences(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """Ids that are missing from some of the tables, with the tables that have them."""
    stacked = None
    for name, df in tables.items():
        part = df.select(F.col(column).cast("string").alias("id")).distinct().withColumn("t", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    per = stacked.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("present_in"), F.count(F.lit(1)).alias("n"))
    return per.filter(F.col("n") < len(tables)).select("id", "present_in")


def schema_differences(package: DataFrame, live: DataFrame) -> DataFrame:
    """Missing, extra and differently typed columns as rows. Compares the two schemas, not the data."""
    a, b = dict(package.dtypes), dict(live.dtypes)
    rows = [(c, "missing", None, b[c]) for c in b if c not in a] + [(c, "extra", a[c], None) for c in a if c not in b]
    rows += [(c, "type", a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return package.sparkSession.createDataFrame(rows, "column STRING, kind STRING, package_type STRING, live_type STRING")


# ---- duplicates ------------------------------------------------------------------------------------


def exact_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Marks rows whose content digest was seen under a smaller key; the smallest key is kept.

    The kept key per digest is a map-side combinable minimum, so a very common content is not
    gathered in one task.
    """
    digested = rows.withColumn("digest", F.sha2(F.col(content), 256))
    first = digested.groupBy("digest").agg(F.min(key).alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    return digested.select(key, "digest").join(first, "digest").withColumn("status", F.when(F.col(key) == F.col("kept_id"), "kept").otherwise("exact_duplicate"))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """64-bit hash: bit i is set when component i is above the median of components 2..64."""
    rest = F.sort_array(F.slice(vector, 2, bits - 1))
    n = bits - 1
    median = F.get(rest, F.lit(n // 2)) if n % 2 else (F.get(rest, F.lit(n // 2 - 1)) + F.get(rest, F.lit(n // 2))) / 2
    flags = F.transform(vector, lambda x: F.when(x > median, "1").otherwise("0"))
    # Two halves, because a 64-bit unsigned value does not fit a signed BIGINT cast.
    half = lambda start: F.conv(F.array_join(F.slice(flags, start, 32), ""), 2, 10).cast("bigint")
    return F.struct(half(1).alias("high"), half(33).alias("low"))


def near_duplicates(rows: DataFrame, key: str, high: str, low: str, threshold: int = 5, window: int = 30) -> DataFrame:
    """Keep rule in key order: a row is dropped when its hash is within ``threshold`` bits of one of the last
    ``window`` kept rows.

    Whether a row is kept depends only on earlier rows, so the rule has one solution, and repeating
    "given who was kept, decide again" reaches it. In each round a row meets only the kept rows of
    two rank cells of ``window`` rows each, by equi-join; nothing is collected. The heavy side is
    spread over 16 salts because many dropped rows may share a cell.
    """
    from transitloom.session import cut, load, store_counted

    base = cut(number_rows(rows.select(F.lit(0).alias("_all"), key, F.col(high).alias("hi"), F.col(low).alias("lo")).withColumn("_b", F.floor(F.col(key) / 4096)), ["_all"], [key], "_b", "idx").drop("_all", "_b"))
    state = base.select("idx", F.lit(True).alias("kept"))
    salts = 16
    while True:
        marked = base.join(state, "idx").withColumn("_b", F.floor(F.col("idx") / 4096))
        sizes = marked.groupBy("_b").agg(F.sum(F.col("kept").cast("bigint")).alias("_n"))
        offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        inner = Window.partitionBy("_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        ranked = marked.withColumn("_in", F.coalesce(F.sum(F.col("kept").cast("bigint")).over(inner), F.lit(0))).join(offsets, "_b").withColumn(
            "rank", F.col("_in") + F.col("_off")
        ).select("idx", key, "hi", "lo", "kept", "rank")
        holders = ranked.filter("kept").select(
            F.floor(F.col("rank") / window).alias("cell"), F.col("rank").alias("krank"), F.col(key).alias("kept_id"), F.col("hi").alias("khi"), F.col("lo").alias("klo"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        )
        cell = F.floor(F.col("rank") / window)
        probes = ranked.withColumn("cell", F.explode(F.array(cell, cell - 1))).withColumn("salt", F.col("idx") % salts)
        bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("khi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("klo")))
        near = probes.join(holders, ["cell", "salt"]).filter((F.col("krank") < F.col("rank")) & (F.col("krank") >= F.col("rank") - window))
        found = near.withColumn("bits", bits).filter(F.col("bits") <= threshold).groupBy("idx").agg(F.min(F.struct("bits", "krank", "kept_id")).alias("n"))
        verdict = ranked.select("idx", key, F.col("kept").alias("was")).join(found, "idx", "left").withColumn("kept", F.col("n").isNull())
        path, changed = store_counted(verdict, F.col("kept") != F.col("was"))
        decided = load(rows.sparkSession, verdict.schema, path)
        if not changed:
            return decided.select(
                key, F.when(F.col("kept"), "kept").otherwise("near_duplicate").alias("status"), F.col("n.kept_id").alias("similar_to"), F.col("n.bits").alias("bits")
            )
        state = decided.select("idx", "kept")
