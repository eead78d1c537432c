from pyspark.sql import functions as F

from transitloom.plans.base import QUERIES, Context
from transitloom.operators import lookup, resample, route_search, routes, scenario
from transitloom.plans import demand_queries
from transitloom.session import cut


def test_means_that_differ_by_summation_order_are_equal(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit."""
    values = [(0.1, 0.3), (0.2, 0.2), (0.3, 0.1)]
    rows = spark.createDataFrame([("s", *v) for v in values], "scenario string, baseline double, recommended double").coalesce(1)
    stats = spark.createDataFrame([("s", "1", 0.2, 0.1)], "scenario string, segment string, mean double, std double")
    assert not scenario.final_comparison(rows, stats, ["scenario"]).first()["is_better"]


def test_points_are_rounded_as_scaled_doubles(spark, ctx, monkeypatch):
    """-5.3395625 as an interpolated double lies just below the tie; its millionfold is the tie."""
    lat = -5.3395624999999995
    assert lat * 1e6 == -5339562.5
    placed = spark.createDataFrame([("t", "b", "c", "n", 1, lat, 107.2375)], "time string, instance_id string, corridor_id string, next_stop string, eta_min int, lat double, lng double")
    monkeypatch.setattr(lookup, "positions", lambda *_: placed)
    assert "[107.237500,-5.339563]" in demand_queries.positions_geojson(ctx).first()["feature"]


def test_segment_rows_of_replications_are_neither_windowed_nor_hashed_again(spark):
    """The segments of a trip meet its replications as one array; no window over (replication, trip) is left in the plan."""
    hops = spark.createDataFrame([("i", "L", p, f"s{p}", 0, 10) for p in range(3)], "instance_id string, corridor_id string, pos int, segment_id string, dep int, next_arr int")
    trips = spark.createDataFrame([("i", "L", 30000)], "instance_id string, corridor_id string, departure int")
    riders = spark.createDataFrame([("L", 800.0)], "corridor_id string, riders double")
    loads = resample.replicated_trip_loads(trips, riders, "m", 20)
    segments = resample.replicated_segment_loads(hops, loads)
    assert "Window" not in segments._jdf.queryExecution().executedPlan().toString()
    rows = segments.collect()
    assert len(rows) == 60 and {r.replication for r in rows} == set(range(20))
    for i in range(20):
        own = [r for r in rows if r.replication == i]
        assert sum(r.draw for r in own) == own[0].trip_draws and abs(sum(r.segment_load for r in own) / 3 - own[0].base) < 1e-9


def test_steps_of_many_short_rows_are_read_by_several_tasks(spark):
    """Rows that shrink to a few kilobytes are still spread over files, so that what grows from them is not left to one task."""
    table = cut(spark.range(250_000).select(F.lit("a").alias("name")).coalesce(1))
    assert len(table.inputFiles()) == 3 and table.count() == 250_000


def test_candidates_are_stored_by_their_number_of_transfers(spark):
    """The closed search reads one table per number of transfers, and rides that are shut without a detour leave."""
    rides = [("L1", "a", "b", 10), ("L2", "b", "c", 10), ("L1", "b", "a", 10), ("L2", "c", "b", 10)]
    moves = [(a, b, line, f"{line}:{a}", 0, s, [f"{a}~{b}~segmen~{line}:{a}~{line}"]) for line, a, b, s in rides]
    moves += [("b", b, line, f"{line}:b", 1, 910, [f"b~b~transit~~{line}", f"b~{b}~segmen~{line}:b~{line}"]) for line, b in [("L1", "a"), ("L2", "c")]]
    net = route_search.line_network(spark.createDataFrame(moves, "from_stop string, to_stop string, corridor string, segment_id string, transfers int, cost bigint, edges array<string>"))
    search = route_search.search_origins(spark.createDataFrame([("a",)], "origin string"), net)
    assert [{r.transfers for r in table.collect()} for table in search.candidates] == [{0}, {1}]
    states, labels = route_search.search_closures(search, net, spark.createDataFrame([("a", "s:L2:b"), ("a", "c:L1")], "origin string, closure string"))
    assert {(r.closure, r.stop) for r in states.collect()} == {("s:L2:b", "c"), ("c:L1", "b"), ("c:L1", "c")} and labels.count() == 0


def test_close_candidates_neither_collect_nor_rank_routes(spark, ctx):
    """The scores come from sums per route; they equal those of the ranked routes."""
    steps = ctx.t.route_steps
    plan = routes.route_figures(steps)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    scores = routes.scored_routes(routes.route_figures(steps)).select("od_id", "candidate", F.round("primary_score", 9), F.round("density", 9))
    ranked = ctx.ranked_routes.select("od_id", "candidate", F.round("primary_score", 9), F.round("density", 9))
    assert scores.count() == ranked.count() > 0 and scores.exceptAll(ranked).count() == 0


def test_next_trips_and_segment_loads_do_not_sort_hops(spark):
    """no window spans the stops or hops of instances."""
    c = Context(spark, "/root/testdata/sf0.001")
    for name in ["next_trip_tiered", "segment_loads", "segment_snapshot"]:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(instance_id" not in plan and "avg(raw" not in plan, name
    assert c.hops.columns.count("segment_id") == 1


def test_a_stored_step_is_not_broadcast_for_its_short_names(spark):
    """the size that plans see is near that in memory, not that of repeated names on disk."""
    c = Context(spark, "/root/testdata/sf0.01")
    size = int(str(c.instances._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 100 * c.instances.count()


def test_next_trip_against_a_loop(spark):
    instances = spark.createDataFrame(
        [("i1", "1", "t1", 0), ("i2", "1", "t1", 2000), ("i3", "1", "t2", 100), ("i0", "1", "t1", 2000), ("i9", "1", "t1", 90000)],
        "instance_id string, corridor_id string, trip_id string, shift long",
    )
    template = spark.createDataFrame(
        [("t1", 1, "a", 1000, 1010), ("t1", 2, "b", 1200, 1210), ("t1", 3, "c", 1500, 1510), ("t2", 1, "b", 1000, 1010), ("t2", 2, "c", 1300, 1310)],
        "trip_id string, pos int, stop_id string, arr long, dep long",
    )
    hops = spark.createDataFrame([("t1", "a", "b", 1000, "s1"), ("t1", "b", "c", 1200, "s2"), ("t2", "b", "c", 1000, None)], "trip_id string, from_stop string, to_stop string, arr long, segment_id string")
    asked = [(f"{a}{b}{ready}", "x", "1", a, b, ready) for a, b in [("a", "b"), ("b", "c"), ("b", "z"), ("q", "z"), ("c", "a")] for ready in [0, 1000, 1101, 1201, 3000, 3201, 80000, 99999]]
    requests = spark.createDataFrame(asked, "request_id string, segment_id string, corridor_id string, from_stop string, to_stop string, ready int")
    got = {r[0]: tuple(r[1:]) for r in lookup.next_trip(requests, instances, template, hops).select("request_id", "tier", "at_sec", "instance_id", "matched_segment").collect()}
    runs = [(i, t, shift) for i, _, t, shift in map(tuple, instances.collect())]
    for key, own, _, a, b, ready in asked:
        found = [(1, arr + s, i, seg) for t, x, y, arr, seg in map(tuple, hops.collect()) for i, u, s in runs if (t, x, y) == (u, a, b)]
        found += [(2, arr + s, i, None) for t, _, x, arr, _ in map(tuple, template.collect()) for i, u, s in runs if (t, x) == (u, a)]
        found += [(3, dep + s, i, None) for t, pos, _, _, dep in map(tuple, template.collect()) for i, u, s in runs if t == u and pos == 1]
        best = min((f for f in found if f[1] >= ready), key=lambda f: f[:3], default=(None, None, None, None))
        assert got[key] == (*best[:3], best[3] or own), key


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_sweep_meets_the_truth_once(spark):
    """28 rows an image were shuffled and sorted to meet a count they already carried."""
    from transitloom.operators import telemetry

    boxes = spark.createDataFrame([(1, 0.9, 100.0, 200.0), (1, 0.3, 100.0, 200.0), (9, 0.9, 100.0, 200.0)], "image long, conf double, w double, h double")
    truth = spark.createDataFrame([(1, 1), (2, 0), (3, 4)], "image long, actual long")
    out = telemetry.threshold_sweep(boxes, truth, [0.2, 0.5], [320], 640, 480)
    assert _plan(out).count("Join") == 1
    assert {(r.conf, r.imgsz): (r.images, r.mae, r.exact_rate) for r in out.collect()} == {(0.2, 320): (3, 5 / 3, 100 / 3), (0.5, 320): (3, 4 / 3, 200 / 3)}


def test_legs_come_from_one_array_per_route(spark):
    """two windows and an aggregate per leg each held a sort of the same rows in one task."""
    from transitloom.operators import routes

    kinds = [("segmen", "1"), ("segmen", "1"), ("segmen", "2"), ("transit", "2"), ("segmen", None), ("segmen", "3"), ("transit", "3"), ("transit", "4")]
    rows = [("o", 7, i, f"s{i}", f"s{i + 1}", k, c, 30 * i, float(i), None if i == 1 else i / 8) for i, (k, c) in enumerate(kinds, 1)]
    steps = spark.createDataFrame(rows, "od_id string, candidate long, pos int, from_stop string, to_stop string, kind string, corridor_id string, secs int, meters double, density double")
    out = routes.route_legs(steps)
    assert "Window" not in _plan(out) and _plan(out).count("Aggregate") == 1
    got = [tuple(r[c] for c in ("leg", "kind", "corridor_id", "board_stop", "alight_stop", "density", "secs", "meters", "segments", "rounded_min", "from_corridor")) for r in out.orderBy("leg").collect()]
    assert got == [
        (1, "segmen", "1", "s1", "s3", 2 / 8, 90, 3.0, 2, 1, None), (2, "segmen", "2", "s3", "s4", 3 / 8, 90, 3.0, 1, 2, None), (3, "transit", "2", "s4", "s5", 4 / 8, 120, 4.0, 1, 2, "2"),
        (4, "segmen", None, "s5", "s7", 5.5 / 8, 330, 11.0, 2, 5, None), (5, "transit", "3", "s7", "s8", 7 / 8, 210, 7.0, 1, 4, "2"), (6, "transit", "4", "s8", "s9", 1.0, 240, 8.0, 1, 4, "2"),
    ]


def test_diversity_multiplies_no_rows(spark):
    """two distinct counts in one aggregate tripled every route with its texts."""
    from transitloom.operators import routes, scenario

    paths = {1: [("segmen", "1"), ("segmen", "1")], 2: [("segmen", "1"), ("segmen", "1")], 3: [("segmen", "1")], 4: [("transit", "1")], 5: [("segmen", "2")]}
    rows = [("o", c, i, f"s{i}", f"s{i + 1}", k, line, None, float(c), c / 8) for c, own in paths.items() for i, (k, line) in enumerate(own)]
    steps = spark.createDataFrame(rows, "od_id string, candidate long, pos int, from_stop string, to_stop string, kind string, corridor_id string, segment_id string, meters double, density double")
    out = scenario.diversity(routes.route_shapes(steps), ["od_id"])
    assert "Expand" not in _plan(out) and "Join" not in _plan(out)
    assert [tuple(r) for r in out.select("od_id", "candidates", "corridor_sequences", "signatures", "min_meters", "max_meters", "min_density", "max_density").collect()] == [
        ("o", 5, 3, 4, 2.0, 5.0, 0.0, 5 / 8)
    ]
