"""Telemetry, duplicates, resampling and streaming twins."""

import random
import tempfile

from pyspark.sql import functions as F

from transitloom.functions.draws import poisson_cdf
from transitloom.operators import quality, resample, telemetry
from transitloom.sources import readers, sinks
from transitloom.streaming import state, tables


def test_tolerant_timestamp(spark):
    df = spark.createDataFrame([("2026-01-02T03:04:05.12345+00:00",), ("2026-01-02T03:04:05Z",), ("2026-01-02 03:04:05.1234567",), ("2026-01-02T10:04:05+07:00",), ("soon",)], "s STRING")
    got = [r.m for r in df.select(F.unix_micros(telemetry.tolerant_timestamp(F.col("s"))).alias("m")).collect()]
    base = 1767323045000000
    assert got == [base + 123450, base, base + 123456, base, None]


def test_throttle_matches_sequential_rule(spark):
    rng = random.Random(4)
    rows, event = [], 0
    for bus in ["hot"] * 3 + ["b"]:
        t = rng.randrange(0, 5000)
        for _ in range(150):
            t += rng.choice([200, 400, 900, 3000, 9000])
            rows.append((event, bus, t, rng.randrange(0, 80)))
            event += 1
    rows = sorted({(b, t): (e, b, t, p) for e, b, t, p in rows}.values())
    df = spark.createDataFrame(rows, "event_id BIGINT, bus_id STRING, ms BIGINT, passengers BIGINT")
    want, last = set(), {}
    for e, b, t, _ in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        if b not in last or t - last[b] >= 3000:
            last[b] = t
            want.add(e)
    assert {r.event_id for r in telemetry.throttled(df, "bus_id", 3000).collect()} == want


def test_near_duplicates_match_sequential_rule(spark):
    rng = random.Random(9)
    centers = [rng.getrandbits(60) for _ in range(6)]
    rows = []
    for i in range(260):
        value = rng.choice(centers)
        for _ in range(rng.randrange(0, 7)):
            value ^= 1 << rng.randrange(60)
        rows.append((i, value >> 30, value & ((1 << 30) - 1), value))
    recent, want = [], {}
    for i, _, _, value in rows:
        near = [bin(value ^ k).count("1") for k in recent]
        if near and min(near) <= 5:
            want[i] = "near_duplicate"
        else:
            want[i] = "kept"
            recent = (recent + [value])[-4:]
    df = spark.createDataFrame([r[:3] for r in rows], "id BIGINT, hi BIGINT, lo BIGINT")
    got = {r.id: r.status for r in quality.near_duplicates(df, "id", "hi", "lo", 5, 4).collect()}
    assert got == want and "near_duplicate" in want.values()


def test_count_metrics_and_boxes(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 3), ("c", 9), ("d", 1)], "image STRING, predicted INT")
    truth = spark.createDataFrame([("a", 0), ("b", 0), ("c", 3)], "image STRING, actual INT")
    got = {r.image: r for r in telemetry.count_metrics(counts, truth).collect()}
    assert got["a"].accuracy == 100.0 and got["b"].accuracy == 0.0 and abs(got["c"].accuracy + 100.0) < 1e-9 and got["c"].accuracy_bounded == 0.0 and got["d"].missing_truth


def test_poisson_table_and_replication_balance(ctx):
    cdf = poisson_cdf(25.0)
    assert all(a < b for a, b in zip(cdf, cdf[1:])) and abs(cdf[-1] - 1.0) < 1e-9
    from transitloom.operators import demand

    resolved = demand.resolve_ridership(ctx.t.riders, ctx.t.members, "1998-01-05", "x")
    runs = resample.replicated_trip_loads(ctx.instances, resolved, "m", 5)
    sums = runs.filter("riders IS NOT NULL").groupBy("replication", "corridor_id").agg(F.sum("passengers").alias("p"), F.max("riders").alias("r")).collect()
    assert sums and all(abs(s.p - s.r) < 1e-6 * s.r for s in sums)
    seg = resample.replicated_segment_loads(ctx.hops, runs).groupBy("replication", "instance_id").agg(F.avg("segment_load").alias("m"), F.max("base").alias("b")).collect()
    assert seg and all(abs(s.m - s.b) < 1e-9 * max(1.0, s.b) for s in seg)


def test_series_stats_are_exact(spark):
    import numpy as np

    values = [float(i * i % 37) for i in range(200)]
    df = spark.createDataFrame([("k", v) for v in values] + [("one", 3.0)], "k STRING, v DOUBLE")
    got = {r.k: r for r in resample.series_stats(df, ["k"], "v").collect()}
    assert got["one"].std == 0.0 and got["one"].p05 == got["one"].p95 == 3.0
    k = got["k"]
    assert abs(k.p05 - np.quantile(values, 0.05)) < 1e-9 and abs(k.p95 - np.quantile(values, 0.95)) < 1e-9
    assert abs(k.mean - np.mean(values)) < 1e-9 and abs(k.std - np.std(values, ddof=1)) < 1e-9 and (k.min, k.max) == (min(values), max(values))


def test_class_resolution(spark):
    names = spark.createDataFrame([("a", 0, "Car"), ("a", 1, " Person "), ("b", 5, "thing"), ("c", 0, "x"), ("c", 1, "y")], "source STRING, class_id INT, class_name STRING")
    assert {r.source: r.class_id for r in readers.resolve_class(names).collect()} == {"a": 1, "b": 5, "c": None}
    assert {r.source: r.class_id for r in readers.resolve_class(names, 0).collect()} == {"a": 0, "b": None, "c": 0}


def _sliced(spark, df, order, parts):
    """Writes ``df`` as parquet slices in order of ``order`` and returns the folder."""
    folder = tempfile.mkdtemp(prefix="spark-slices-", dir="/tmp")
    bounds = df.approxQuantile(order, [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        low, high = bounds[i], bounds[i + 1]
        last = F.col(order) <= high if i == parts - 1 else F.col(order) < high
        df.filter((F.col(order) >= low) & last).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _run(query_df, mode, name):
    query = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return query_df.sparkSession.table(name)


def test_streaming_throttle_and_inter_arrival_equal_batch(spark, ctx):
    readings = ctx.t.readings.select("event_id", "bus_id", "ms", "passengers")
    folder = _sliced(spark, readings, "ms", 3)
    source = tables.stream_parquet(spark, folder, readings.schema, 1)
    got = {(r.event_id, r.passengers) for r in _run(state.throttled_medians(source, 9 * 3600 * 1000), "append", "t_throttle").collect()}
    passed = telemetry.throttled(readings, "bus_id", 9 * 3600 * 1000).select("event_id")
    want = {(r.event_id, r.median) for r in telemetry.smoothed_counts(readings, "bus_id").join(passed, "event_id", "left_semi").collect()}
    assert got == want
    gaps = {(r.event_id, r.inter_arrival_ms) for r in _run(state.inter_arrivals(tables.stream_parquet(spark, folder, readings.schema, 1)), "append", "t_gaps").collect()}
    assert gaps == {(r.event_id, r.inter_arrival_ms) for r in telemetry.inter_arrival(readings, ["bus_id"], "ms").collect()}


def test_streaming_upsert_table_equals_batch(spark, ctx):
    readings = ctx.t.readings.select("event_id", "bus_id", "ms", "passengers")
    folder = _sliced(spark, readings, "ms", 3)
    out = tempfile.mkdtemp(prefix="spark-table-", dir="/tmp")
    table = tables.UpsertTable(spark, f"{out}/table", readings.schema, ["bus_id"], ["ms", "event_id"])
    query = table.start(tables.stream_parquet(spark, folder, readings.schema, 1), f"{out}/checkpoint")
    query.awaitTermination(180)
    final = table.version(3).collect()
    want = sinks.newest_per_key(readings, ["bus_id"], ["ms", "event_id"]).collect()
    assert {(r.bus_id, r.event_id) for r in final} == {(r.bus_id, r.event_id) for r in want}


def test_streaming_frames_equal_batch(spark, ctx):
    chunks = telemetry.check_chunks(ctx.t.chunks).filter("valid").drop("valid").withColumn("ms", F.col("seen"))
    folder = _sliced(spark, chunks, "seen", 2)
    source = tables.with_event_time(tables.stream_parquet(spark, folder, chunks.schema, 1), "ms")
    rows = _run(state.assemble_frames(source, 10**12), "append", "t_frames").collect()
    batch = telemetry.assemble_chunks(ctx.t.chunks).collect()
    for status in ("completed", "dropped"):
        assert {(r.frame_id, r.body) for r in rows if r.status == status} == {(r.frame_id, r.body) for r in batch if r.status == status}


def test_streaming_ttl(spark, ctx):
    readings = ctx.t.readings.select("event_id", "bus_id", "ms", "passengers")
    folder = _sliced(spark, readings, "ms", 3)
    source = tables.with_event_time(tables.stream_parquet(spark, folder, readings.schema, 1), "ms", "1 minute")
    rows = _run(state.latest_with_ttl(source, 3600 * 1000), "update", "t_ttl").collect()
    newest = {}
    for r in rows:
        newest[r.bus_id] = max(newest.get(r.bus_id, 0), r.ms)
    want = {r.bus_id: r.ms for r in sinks.newest_per_key(readings, ["bus_id"], ["ms", "event_id"]).collect()}
    assert newest == want and any(r.passengers is None for r in rows)


def test_live_streams_plan_without_state(spark, ctx):
    messages = ctx.t.vehicle_messages
    folder = _sliced(spark, messages, "ms", 2)
    schedule = tables.live_schedule_stream(tables.stream_parquet(spark, folder, messages.schema), ctx.t.stops, 28800)
    assert _run(schedule, "append", "t_schedule").count() > 0
