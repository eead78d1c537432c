"""Tests of the findings of round 4."""

from pyspark.sql import functions as F

from tests.test_routes import _network
from transitloom.llm import neighbours
from transitloom.operators import demand, network, resample, route_search, routes
from transitloom.plans import load_all
from transitloom.plans.base import RUN_ID, SERVICE_DATE


def test_route_totals_do_not_depend_on_the_order_of_rows(spark):
    """0.1 + 0.2 + 0.3 differs from 0.3 + 0.2 + 0.1 in the last bit; sums go along the route."""
    schema = "od_id string, candidate int, pos int, from_stop string, to_stop string, kind string, corridor_id string, segment_id string, secs int, meters double, density double"
    rows = [("od", 1, i, str(i), str(i + 1), "segmen", "1", f"s{i}", 60, value, value) for i, value in enumerate([0.1, 0.2, 0.3])]
    rows.append(("od", 1, 3, "3", "3", "transit", "2", None, 0, None, None))
    found = [routes.route_totals(spark.createDataFrame(order, schema).coalesce(1)).first() for order in (rows, rows[::-1])]
    assert [(r["meters"], r["density"]) for r in found] == [(0.1 + 0.2 + 0.3, (0.1 + 0.2 + 0.3) / 3)] * 2
    assert found[0] == found[1]


def test_sample_rows_are_filtered_before_they_reach_the_driver(spark):
    """each of 40 tasks held ``keep`` rows for the driver; now all together hold a few times ``keep``."""
    entries = spark.range(20000, numPartitions=40).select(F.col("id").alias("entry"))
    plain = [r["entry"] for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(50).collect()]
    assert [r["entry"] for r in neighbours.lowest_hashes(entries, 20000, 50).collect()] == plain
    assert 50 <= entries.where(F.xxhash64("entry") < neighbours.hash_limit(20000, 50)).count() <= 400
    # A row count far above that of the entries, as with many equal vectors, and fewer entries than wanted.
    assert [r["entry"] for r in neighbours.lowest_hashes(entries, 10**7, 50).collect()] == plain
    assert neighbours.lowest_hashes(entries.limit(20), 20, 50).count() == 20


def test_pairs_between_parts_of_the_network_are_not_searched(spark, monkeypatch):
    """origins and platform pairs without any way to their destination took part in every step."""
    moves = network.route_moves(_network(spark, {"1": [("A", "B", 60), ("B", "A", 60)], "2": [("C", "D", 60)]}))
    asked = []
    plain = route_search.search_origins
    monkeypatch.setattr(route_search, "search_origins", lambda origins, *rest: (asked.extend(r[0] for r in origins.distinct().collect()), plain(origins, *rest))[1])
    pairs = spark.createDataFrame([("x", "A", "B"), ("y", "C", "B"), ("z", "C", "A"), ("q", "Z", "B")], "od_id string, origin string, destination string")
    assert [(r.od_id, r.cost) for r in routes.candidate_routes(pairs, moves, k=1).collect()] == [("x", 60)]
    assert asked == ["A"]


def test_replications_of_an_instance_stay_in_its_row(spark, ctx):
    """every replication was a row before the segments met it, and all loads of a segment were counted and sorted as rows."""
    load_all()
    from transitloom.plans import resample_queries

    packed = resample_queries.mc_packed(ctx)
    assert packed.groupBy("instance_id").count().where("count > 1").count() == 0
    resolved = demand.resolve_ridership(ctx.t.riders, ctx.t.members, SERVICE_DATE, RUN_ID)
    trips = resample.replicated_trip_loads(ctx.instances, resolved, resample_queries.MASTER, resample_queries.RUNS)
    plain = resample.replicated_segment_loads(ctx.hops, trips, ctx.instances, ctx.matched)
    columns = ["replication", "instance_id", "pos", "segment_id", "dep", "next_arr", "draw", "segment_load"]
    rows = [df.select(*columns).toPandas().sort_values(columns[:4], ignore_index=True) for df in (plain, resample.unpacked_segment_loads(packed))]
    assert len(rows[0]) and rows[0].equals(rows[1].astype(rows[0].dtypes.to_dict()))
    stats = [df.toPandas().sort_values("segment_id", ignore_index=True) for df in (resample.series_stats(plain, ["segment_id"], "segment_load"), resample.packed_segment_stats(packed))]
    assert list(stats[0].columns) == list(stats[1].columns)
    for name in ["mean", "std", "p05", "p95", "n", "min", "max"]:
        assert (stats[0][name] - stats[1][name]).abs().max() < 1e-9, name


def test_lines_without_riders_keep_the_fallback_when_packed(spark):
    """Instances of lines without riders have no draws and no sums, but every replication; ``only`` does not change the sums of a line."""
    instances = spark.createDataFrame([("i", "L", "t", 30000), ("j", "L", "t", 31000), ("k", "M", "u", 30000)], "instance_id string, corridor_id string, trip_id string, departure int")
    riders = spark.createDataFrame([("L", 800.0)], "corridor_id string, riders double")
    segments = spark.createDataFrame([(t, [(p, f"{t}{p}", 0, 10) for p in range(3)], 0) for t in "tu"], "trip_id string, segments array<struct<pos:int,segment_id:string,dep:int,next_arr:int>>, first_dep int")
    draws = resample.trip_draws(instances, riders, "1", 4)
    rows = {r["instance_id"]: r for r in resample.packed_segment_loads(segments, instances, riders, draws, "1", 4).collect()}
    assert [(r["replication"], r["base"]) for r in rows["k"]["runs"]] == [(i, 0.5) for i in range(4)]
    one = resample.packed_segment_loads(segments, instances, riders, draws, "1", 4, only=spark.createDataFrame([("i",)], "instance_id string")).collect()
    assert len(one) == 1 and sorted(one[0]["runs"]) == sorted(rows["i"]["runs"])
    assert all(abs(a["base"] + b["base"] - 10.0) < 1e-9 for a, b in zip(sorted(rows["i"]["runs"]), sorted(rows["j"]["runs"])))
