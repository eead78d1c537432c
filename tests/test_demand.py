from pyspark.sql import functions as F

from transitloom.functions.draws import pick
from transitloom.operators import demand, lookup, scenario, telemetry


def test_pick_takes_the_64_bit_seed(spark):
    """Places of the five lines among 30 dates, from the first 16 hex digits of the digest."""
    lines = spark.createDataFrame([(str(i),) for i in range(1, 6)], "corridor_id string")
    got = lines.orderBy("corridor_id").select(pick(F.lit(30).cast("bigint"), F.lit("ridership_sample_30"), F.lit("run-1"), F.col("corridor_id")).alias("p"))
    assert [r.p for r in got.collect()] == [26, 13, 19, 22, 24]


def test_trip_without_matched_hops_loads_all_segments_of_its_line(spark):
    hops = spark.createDataFrame([("i1", "L", 1, "s1", 0, 10), ("i2", "L", 1, None, 0, 10)], "instance_id string, corridor_id string, pos int, segment_id string, dep int, next_arr int")
    loads = spark.createDataFrame([("i1", "L", "t1", 0.5, None), ("i2", "L", "t2", 0.7, None)], "instance_id string, corridor_id string, trip_id string, load double, used_date date")
    matched = spark.createDataFrame([("t1", "L", "s1", False), ("t2", "L", "s1", True), ("t2", "L", "s2", True)], "trip_id string, corridor_id string, segment_id string, fallback boolean")
    rows = demand.segment_loads(hops, loads, "run", matched).collect()
    assert sorted((r.instance_id, r.segment_id) for r in rows) == [("i1", "s1"), ("i2", "s1"), ("i2", "s2")]
    own = [r.segment_load for r in rows if r.instance_id == "i2"]
    assert abs(sum(own) / 2 - 0.7) < 1e-9


def test_only_fresh_readings_are_overlaid(spark):
    readings = spark.createDataFrame([(1, 1000, 7), (2, 5000, 9)], "event_id long, ms long, passengers long")
    assert [r.passengers for r in lookup.fresh_reading(readings, F.max("ms") + 120_000).collect()] == [9]
    assert lookup.fresh_reading(readings, F.max("ms") + 120_001).count() == 0


def test_images_without_boxes_count_as_zero(spark):
    boxes = spark.createDataFrame([("a", 0.9, 100.0, 200.0), ("a", 0.2, 100.0, 200.0), ("b", 0.9, 1.0, 1.0)], "image string, conf double, w double, h double")
    truth = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "image string, actual int")
    got = {r.conf: r for r in telemetry.threshold_sweep(boxes, truth, [0.1, 0.5], [640], 640, 480).collect()}
    assert got[0.1].images == 3 and abs(got[0.1].mae - 1.0) < 1e-9 and abs(got[0.5].mae - 4 / 3) < 1e-9
    counts = telemetry.count_metrics(spark.createDataFrame([("a", 2), ("d", 1)], "image string, predicted int"), truth)
    rows = {r.image: (r.predicted, r.actual, r.missing_truth) for r in counts.collect()}
    assert rows == {"a": (2, 2, False), "b": (0, 0, False), "c": (0, 3, False), "d": (1, None, True)}


def test_chunk_bodies_are_bytes(spark):
    parts = [bytes([255, 216, 0, 128]) * 128, b"\xff\xd9"]
    rows = [(1, i, 2, 514, p, i) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "frame_id long, chunk_index int, total_chunks int, total_len int, body binary, seen long")
    assert bytes(telemetry.assemble_chunks(df).first().body) == b"".join(parts)


def test_every_setting_of_a_configuration_counts(spark, monkeypatch):
    asked = []

    def stand_in(steps, visits, loads, second, extra_wait, eta_minutes, density_weight):
        asked.append((extra_wait, eta_minutes, density_weight))
        return steps

    from transitloom.operators import choice

    monkeypatch.setattr(choice, "recommend", stand_in)
    monkeypatch.setattr(scenario, "success_rows", lambda pairs, *rest: pairs)
    monkeypatch.setattr(scenario, "success_summary", lambda rows, keys: rows.groupBy(*keys).agg(*[F.lit(1.0).alias(n) for n in "n wins_v1 wins_v2 mean_delta_v1 mean_wait mean_wait_wins win_rate_v1 win_rate_v2".split()]))
    monkeypatch.setattr(scenario.C, "SUCCESS_CONFIGS", [("a", 50, 60, 0.95), ("b", 50, 45, 0.95), ("c", 50, 60, 0.85)])
    out = scenario.config_sweep(spark.createDataFrame([("a",)], "od_id string"), None, None, None, 28800)
    assert sorted((r.config, r.eta_minutes, r.density_weight) for r in out.collect()) == [("a", 60, 0.95), ("b", 45, 0.95), ("c", 60, 0.85)]
    assert sorted(asked) == [(50, 45, 0.95), (50, 60, 0.85), (50, 60, 0.95)]
