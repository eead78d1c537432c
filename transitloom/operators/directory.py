"""Stop directory with line lists, letter groups and one entry per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def stop_directory(stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Every stop with its lines; ``shown`` marks the smallest id among stops of the same name."""
    per_stop = lines.groupBy("stop_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cnum", "corridor_id"))), lambda x: x["corridor_id"]), ",").alias("lines")
    )
    key = F.lower(F.trim("name"))
    first = stops.groupBy(key.alias("_key")).agg(F.min("stop_id").alias("_first"))
    return (
        stops.join(per_stop, "stop_id", "left").withColumn("_key", key).join(first, "_key")
        .select(
            "stop_id", "name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("lines", F.lit("")).alias("lines"),
            F.upper(F.substring(F.trim("name"), 1, 1)).alias("letter"), (F.coalesce("n_lines", F.lit(0)) >= 2).alias("transfer_stop"),
            (F.col("stop_id") == F.col("_first")).alias("shown"),
        )
    )
