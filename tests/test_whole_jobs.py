"""Registered queries take all requests, lines and replications."""

import hashlib
from types import SimpleNamespace

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries in their order
from transitloom import constants as C
from transitloom.operators import demand, resample
from transitloom.plans import network_queries, resample_queries, route_queries


def test_route_requests_are_the_whole_request_table(ctx):
    want = {(r.origin, r.destination) for r in ctx.t.catalog.collect()}
    assert want
    assert sorted((r.origin, r.destination) for r in ctx.od.collect()) == sorted(want)


def test_segments_of_crowded_lines_take_the_mean_of_their_line(spark):
    segments = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B"), ("s4", "C")], "segment_id string, corridor_id string")
    loads = spark.createDataFrame([("A", 0.8), ("A", 0.6), ("B", 0.2)], "corridor_id string, load double")
    seen = spark.createDataFrame([("s1", "A", 28000, 29000, 0.9)], "segment_id string, corridor_id string, dep int, next_arr int, segment_load double")
    c = SimpleNamespace(segment_loads=seen, loads=loads, t=SimpleNamespace(segments=segments))
    got = {r.segment_id: r.density for r in network_queries.edge_weights(c).collect()}
    assert got == {"s1": 0.9, "s2": 0.7, "s3": 0.2, "s4": C.DENSITY_FALLBACK}


def test_trips_without_ridership_stay_at_the_fallback(spark):
    trips = spark.createDataFrame([("i1", "A", 28800), ("i2", "B", 28800)], "instance_id string, corridor_id string, departure int")
    riders = spark.createDataFrame([("A", "1998-01-05", 100.0)], "corridor_id string, date string, riders double").selectExpr("corridor_id", "CAST(date AS DATE) AS date", "riders")
    members = spark.createDataFrame([("A",), ("B",)], "corridor_id string")
    c = SimpleNamespace(instances=trips, step=lambda name, build: build(), t=SimpleNamespace(riders=riders, members=members))
    rows = resample_queries.mc_trip_loads(c).collect()
    assert sum(r.instance_id == "i1" for r in rows) == resample_queries.RUNS
    missing = [r for r in rows if r.instance_id == "i2"]
    assert sorted(r.replication for r in missing) == list(range(resample_queries.RUNS))
    assert all(r.draw is None and r.load == C.DENSITY_FALLBACK for r in missing)


def test_replicated_queries_run_all_replications(ctx):
    assert {r.replication for r in resample_queries.mc_trips(ctx).select("replication").distinct().collect()} == set(range(100))
    assert route_queries.REPLICATIONS == 100


def test_a_date_is_drawn_per_replication(spark):
    days = [("A", f"2024-01-{d:02d}", float(d)) for d in range(1, 32)] + [("B", "2024-02-01", 7.0)]
    riders = spark.createDataFrame(days, "corridor_id string, date string, riders double").withColumn("date", F.to_date("date"))
    lines = spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "corridor_id string")
    rows = demand.replicated_ridership(riders, lines, resample.replication_seed("m", F.col("replication")), 50).collect()
    assert len(rows) == 3 * 50
    for r in rows:
        seed = int(hashlib.sha256(f"m|{r.replication}".encode()).hexdigest()[:13], 16)
        if r.corridor_id == "A":
            place = int(hashlib.sha256(f"ridership_sample_30|{seed}|A".encode()).hexdigest()[:16], 16) % 30
            assert (r.used_date.day, r.riders) == (31 - place, 31.0 - place)
        else:
            assert r.riders == (7.0 if r.corridor_id == "B" else None)
    trips = spark.createDataFrame([(f"{k}{i}", k, 28800 + 600 * i) for k in "ABC" for i in range(4)], "instance_id string, corridor_id string, departure int")
    resolved = demand.replicated_ridership(riders, lines, resample.replication_seed("m", F.col("replication")), 50)
    loads = resample.replicated_trip_loads(trips, resolved, "m", 50).groupBy("replication", "corridor_id").agg(F.round(F.sum("passengers"), 6).alias("p"), F.count("*").alias("n"))
    want = {(r.replication, r.corridor_id): r.riders for r in rows}
    for r in loads.collect():
        assert r.n == 4 and r.p == (160.0 if r.corridor_id == "C" else want[r.replication, r.corridor_id])
