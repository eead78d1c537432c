"""Inputs: projected scans, feed text, label text, media folders, newest result file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transitloom import constants as C


def scan(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet") -> DataFrame:
    """All rows, only ``columns``; filters added by the caller reach the file scan."""
    return spark.read.format(fmt).load(path).select(*columns)


def scan_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], key: str, low: int, high: int, parts: int) -> DataFrame:
    """Partitioned read of a database table on a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
    )
    return reader.load().select(*columns)


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with a fixed schema; a byte order mark before the header is tolerated."""
    return spark.read.option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").schema(schema).csv(path)


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """Paths, sizes and times of media files below ``path``, by extension in any case (contents are not read)."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(any_case) + "}").option("recursiveFileLookup", True).load(path).select(
        "path", "length", "modificationTime"
    )


def newest_file(spark: SparkSession, path: str, period: Column, kind: Column, pattern: str = "*.json") -> DataFrame:
    """Newest file per (period, kind); both are expressions over the column ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", period.alias("period"), kind.alias("kind")).groupBy("period", "kind").agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path")
    )


def parse_labels(lines: DataFrame) -> DataFrame:
    """Label text (file, line) to class and box with ``problem`` naming the first broken rule (null = valid)."""
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = lines.filter(F.trim("line") != "").select("file", "line", F.size(parts).alias("n"), *[number(i).alias(n) for i, n in enumerate(["cls", "xc", "yc", "w", "h"])])
    values = ["cls", "xc", "yc", "w", "h"]
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    outside = F.lit(False)
    for v in values[1:]:
        outside = outside | (F.col(v) < 0) | (F.col(v) > 1)
    problem = (
        F.when(F.col("n") != 5, "not_five_columns").when(missing, "not_finite").when((F.col("cls") < 0) | (F.col("cls") != F.floor("cls")), "bad_class")
        .when(outside, "out_of_range").when((F.col("w") <= 0) | (F.col("h") <= 0), "empty_box")
    )
    return rows.withColumn("problem", problem)


def label_counts(parsed: DataFrame, target: Column) -> DataFrame:
    """Per file: objects of the target class and number of broken lines."""
    return parsed.groupBy("file").agg(
        F.count_if(F.col("problem").isNull() & (F.col("cls") == target)).alias("objects"), F.count_if(F.col("problem").isNotNull()).alias("broken")
    )


def resolve_class(names: DataFrame, explicit: int | None = None) -> DataFrame:
    """Class id per source: the explicit one if listed, else the first alias with exactly one hit, else the only class.

    ``names`` has source, class_id, class_name. Sources that cannot be resolved get a null.
    """
    aliases = F.array(*[F.lit(n) for n in C.PERSON_NAMES])
    place = F.array_position(aliases, F.lower(F.trim("class_name")))
    hits = names.withColumn("_p", place)
    per_alias = hits.filter("_p > 0").groupBy("source", "_p").agg(F.count(F.lit(1)).alias("c"), F.min("class_id").alias("id"))
    unique = per_alias.filter("c = 1").groupBy("source").agg(F.min_by("id", "_p").alias("by_alias"))
    whole = names.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("class_id").alias("only"),
        F.max(F.when(F.col("class_id") == F.lit(explicit), F.col("class_id"))).alias("by_id"),
    )
    chosen = F.col("by_id") if explicit is not None else F.coalesce("by_alias", F.when(F.col("n") == 1, F.col("only")))
    return whole.join(unique, "source", "left").select("source", chosen.alias("class_id"))


def without_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    return images.select("file").distinct().join(labels.select("file"), "file", "left_anti")
