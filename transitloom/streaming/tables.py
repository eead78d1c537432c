"""Streaming inputs and the keyed upsert table that ``foreachBatch`` maintains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from transitloom.operators import live, telemetry
from transitloom.sources.sinks import merge_upsert


def stream_parquet(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ms: str = "ms", delay: str = "10 minutes") -> DataFrame:
    return df.withColumn("at", F.timestamp_millis(F.col(ms))).withWatermark("at", delay)


class UpsertTable:
    """One row per key, newest wins, kept as numbered versions in a shared folder.

    A batch writes version ``batch id + 1`` from the version before it, so a repeated batch gives the
    same result. The table holds one row per vehicle, which bounds the cost of a version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys, self.order = spark, path, schema, keys, order

    def version(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={number}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        names = self.version(0).columns
        merged = merge_upsert(self.version(batch_id), batch.select(*names), self.keys, self.order)
        merged.select(*names).write.mode("overwrite").parquet(f"{self.path}/v={batch_id + 1}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_of_trigger(batch: DataFrame, key: str) -> DataFrame:
    """Only the newest row per key of one trigger, with the number of rows it replaces."""
    row = F.struct(*[c for c in batch.columns if c != key])
    out = batch.groupBy(key).agg(F.max_by(row, F.struct("ms", "event_id")).alias("r"), (F.count(F.lit(1)) - 1).alias("skipped"))
    return out.select(key, "r.*", "skipped")


def live_schedule_stream(messages: DataFrame, stops: DataFrame, now_secs: int) -> DataFrame:
    """Stream-static join: remaining stops of live vehicles on the static stops."""
    return live.live_schedule(live.parse_messages(messages), stops, now_secs)


def latency_stream(messages: DataFrame) -> DataFrame:
    """Status and latencies of camera messages; stateless, so the batch operator serves as is."""
    return telemetry.latency_rows(messages)
