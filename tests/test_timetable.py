"""Timetable expansion on small hand-made feeds."""

import random

from pyspark.sql import functions as F

from transitloom.functions.sequences import overlap_ratio
from transitloom.operators import demand, timetable
from transitloom.operators.components import connected_groups


def _feed(spark):
    stops = spark.createDataFrame([(s, s, -6.2, 106.8 + i * 0.01) for i, s in enumerate("ABCDEF")], "stop_id STRING, name STRING, lat DOUBLE, lng DOUBLE")
    trips = spark.createDataFrame([("t1", "1.0", "0"), ("t2", " 1 ", "0"), ("t3", "1", "1")], "trip_id STRING, route_id STRING, direction_id STRING")
    rows = []
    for trip, seq in [("t1", "ABCDE"), ("t2", "ABCD"), ("t3", "EDC")]:
        for i, s in enumerate(seq):
            rows.append((trip, i + 1, s, f"05:{2 * i:02d}:00", f"05:{2 * i:02d}:10"))
    stop_times = spark.createDataFrame(rows, "trip_id STRING, stop_sequence INT, stop_id STRING, arrival_time STRING, departure_time STRING")
    freq = spark.createDataFrame(
        [("t1", "05:00:00", "06:00:00", 600), ("t2", "05:00:00", "06:00:00", 300), ("t3", "05:00:00", "05:30:00", 900), ("t3", "x", "05:30:00", 900), ("nope", "05:00:00", "06:00:00", 60)],
        "trip_id STRING, start_time STRING, end_time STRING, headway_secs INT",
    )
    segments = spark.createDataFrame([("s1", "1", "A", "B"), ("s2", "1", "B", "C"), ("s3", "1", "C", "D"), ("s4", "1", "D", "E")], "segment_id STRING, corridor_id STRING, from_stop STRING, to_stop STRING")
    return stops, trips, stop_times, freq, segments


def _expand(spark):
    stops, trips, stop_times, freq, segments = _feed(spark)
    template = timetable.template_stops(stop_times, stops)
    matched = timetable.match_segments(template, trips, segments)
    patterns = timetable.service_patterns(timetable.valid_frequencies(freq, trips), template, timetable.match_summary(matched))
    ranked = timetable.rank_members(timetable.group_patterns(patterns))
    selected = timetable.selected_patterns(ranked)
    return template, matched, ranked, timetable.trip_instances(selected)


def test_merge_keeps_longest_pattern_with_smallest_headway(spark):
    template, matched, ranked, instances = _expand(spark)
    groups = {r.rep_trip: r for r in timetable.merge_groups(ranked).collect()}
    assert groups["t1"].members == 2 and groups["t1"].service_headway == 300
    assert groups["t1"].reason == "selected because same match ratio but highest stop_count"
    rows = instances.filter("trip_id = 't1'").orderBy("departure").collect()
    assert [r.departure for r in rows] == list(range(18000, 21600, 300))
    assert rows[0].instance_id == "BUS-1-0-001" and rows[-1].instance_id == "BUS-1-0-012"
    # First departure in the template is ten seconds late, so the visits keep that shift.
    visits = timetable.instance_stops(instances, template).filter("instance_id = 'BUS-1-0-001'").orderBy("pos").collect()
    assert visits[0].dep == 18000 and visits[-1].arr == 18000 - 10 + 480


def test_fallback_segments_and_rejects(spark):
    stops, trips, stop_times, freq, segments = _feed(spark)
    template, matched, _, _ = _expand(spark)
    t3 = [r.segment_id for r in matched.filter("trip_id = 't3' AND fallback").collect()]
    assert sorted(t3) == ["s1", "s2", "s3", "s4"]
    verdicts = sorted(r.verdict for r in timetable.check_frequencies(freq, trips).collect())
    assert verdicts == ["invalid_value", "ok", "ok", "ok", "unknown_trip"]


def test_overlap_ratio_matches_dynamic_programming(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(1, 9))], [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]) for _ in range(40)]

    def lcs(a, b):
        table = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                table[i, j] = 0 if not i or not j else table[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(table[i - 1, j], table[i, j - 1])
        return table[len(a), len(b)]

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a ARRAY<STRING>, b ARRAY<STRING>")
    for row in df.withColumn("o", overlap_ratio(F.col("a"), F.col("b"))).collect():
        assert abs(row.o - lcs(row.a, row.b) / min(len(row.a), len(row.b))) < 1e-12


def test_rare_stop_candidates_miss_no_pair(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        start, size = rng.randrange(0, 6), rng.randrange(2, 12)
        rows.append(("1", "0", [f"s{x}" for x in range(start, start + size) if rng.random() > 0.1] or ["s0"], f"p{i:02d}"))
    patterns = spark.createDataFrame(rows, "corridor_id STRING, direction_id STRING, signature ARRAY<STRING>, pattern_id STRING")
    nodes = patterns.groupBy("signature").agg(F.min("pattern_id").alias("n"))
    pairs = nodes.alias("a").join(nodes.alias("b"), F.col("a.n") < F.col("b.n")).filter(overlap_ratio(F.col("a.signature"), F.col("b.signature")) >= 0.8)
    want = {frozenset((r[0], r[1])) for r in pairs.select("a.n", "b.n").collect()}
    got = {frozenset((r.short, r.long)) for r in timetable.overlapping_signatures(patterns).collect()}
    assert got == want and want


def test_connected_groups_on_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n + 1)], "node STRING")
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1)], "a STRING, b STRING")
    labels = {r.node: r.label for r in connected_groups(nodes, links).collect()}
    assert {labels[f"n{i:03d}"] for i in range(n)} == {"n000"} and labels[f"n{n:03d}"] == f"n{n:03d}"


def test_allocation_balances_and_segment_mean_is_kept(ctx):
    loads = ctx.loads.filter("riders IS NOT NULL").groupBy("corridor_id").agg(F.sum("passengers").alias("p"), F.max("riders").alias("r")).collect()
    assert loads
    for row in loads:
        assert abs(row.p - row.r) < 1e-6 * max(1.0, row.r)
    means = ctx.segment_loads.groupBy("instance_id").agg(F.avg("segment_load").alias("m"), F.max("load").alias("l")).collect()
    for row in means:
        assert abs(row.m - row.l) < 1e-9 * max(1.0, row.l)


def test_same_run_same_loads_other_run_other_loads(ctx):
    resolved = demand.resolve_ridership(ctx.t.riders, ctx.t.members, "1998-01-05", "x")
    one = {r.instance_id: r.load for r in demand.trip_loads(ctx.instances, resolved, "x").collect()}
    two = {r.instance_id: r.load for r in demand.trip_loads(ctx.instances.repartition(5), resolved, "x").collect()}
    other = {r.instance_id: r.load for r in demand.trip_loads(ctx.instances, resolved, "y").collect()}
    assert all(abs(one[k] - two[k]) < 1e-12 for k in one) and any(abs(one[k] - other[k]) > 1e-9 for k in one)


def test_thirty_newest_dates(spark):
    rows = [(f"2026-0{1 + i // 20}-{1 + i % 20:02d}", "1", float(i)) for i in range(40)]
    riders = spark.createDataFrame(rows, "date STRING, corridor_id STRING, riders DOUBLE").withColumn("date", F.col("date").cast("date"))
    recent = demand.recent_dates(riders)
    assert recent.count() == 30 and str(recent.agg(F.min("date")).first()[0]) == "2026-01-11"
