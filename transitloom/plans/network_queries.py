"""Queries on stops, segments, shapes and the route network."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom import constants as C
from transitloom.functions.geo import bearing, distance_asin_m, distance_m, flat_bearing
from transitloom.functions.scalar import natural_order, normal_id
from transitloom.operators import demand, network, scenario, shapes
from transitloom.plans.base import STEPS_SQL, bearing_sql, clamp_sql, dist_sql, norm_sql, r, register, sec_sql


@register("scan_project", "SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem}")
def scan_project(c):
    from transitloom.sources.readers import scan

    return scan(c.spark, f"{c.folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@register(
    "shape_lines",
    """
    SELECT corridor_id, shape_id, count(*) AS n_points, string_agg(concat(CAST(seq AS VARCHAR), ':', CAST(CAST(round(lng * 10000) AS BIGINT) AS VARCHAR), ' ', CAST(CAST(round(lat * 10000) AS BIGINT) AS VARCHAR)), ',' ORDER BY seq) AS line
    FROM {shapes} GROUP BY ALL HAVING count(*) >= 2""",
)
def shape_lines(c):
    whole = lambda name: F.round(F.col(name) * 10000).cast("bigint").cast("string")
    rows = c.t.shapes.sortWithinPartitions("corridor_id", "seq")
    packed = F.array_sort(F.collect_list(F.struct("seq", whole("lng").alias("x"), whole("lat").alias("y"))))
    lines = rows.groupBy("corridor_id", "shape_id").agg(F.count(F.lit(1)).alias("n_points"), packed.alias("p")).filter("n_points >= 2")
    return lines.select(
        "corridor_id", "shape_id", "n_points", F.array_join(F.transform("p", lambda p: F.concat(p["seq"].cast("string"), F.lit(":"), p["x"], F.lit(" "), p["y"])), ",").alias("line")
    )


@register(
    "stop_directory",
    """
    WITH d AS (SELECT s.stop_id, s.name, s.lat, s.lng, count(m.corridor_id) AS n_lines, coalesce(string_agg(m.corridor_id, ',' ORDER BY m.cnum), '') AS lines
               FROM {stops} s LEFT JOIN {lines_of_stop} m ON s.stop_id = m.stop_id GROUP BY ALL)
    SELECT stop_id, name, n_lines, lines, upper(substr(trim(name), 1, 1)) AS letter, n_lines >= 2 AS transfer_stop,
           stop_id = min(stop_id) OVER (PARTITION BY lower(trim(name))) AS shown FROM d""",
)
def stop_directory(c):
    from transitloom.operators.directory import stop_directory as build

    return build(c.t.stops, c.t.lines_of_stop)


@register(
    "norm_ids",
    f"""
    SELECT trip_id, {norm_sql('route_id')} AS corridor_id, {norm_sql('route_id')} IN ({', '.join(f"'{x}'" for x in C.DEFAULT_SCOPE)}) AS in_scope,
           CAST(dense_rank() OVER (ORDER BY try_cast({norm_sql('route_id')} AS INT) IS NULL, try_cast({norm_sql('route_id')} AS INT), {norm_sql('route_id')}) AS INT) AS position
    FROM {{feed_trips}}""",
)
def norm_ids(c):
    from pyspark.sql import Window

    rows = c.t.feed_trips.select("trip_id", normal_id(F.col("route_id")).alias("corridor_id"))
    # Only the distinct ids are ordered, not the trips.
    ids = rows.select("corridor_id").distinct()
    placed = ids.withColumn("position", F.row_number().over(Window.orderBy(*natural_order(F.col("corridor_id")))))
    return rows.join(placed, "corridor_id").select("trip_id", "corridor_id", F.col("corridor_id").isin(C.DEFAULT_SCOPE).alias("in_scope"), "position")


PLATFORM_SQL = "regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), ' arah (utara|selatan|barat|timur)$', '')"


@register(
    "stop_aliases",
    f"""
    SELECT stop_id, alias_id, round(m, 4) AS meters, CAST(row_number() OVER (PARTITION BY stop_id ORDER BY m, alias_id <> stop_id, alias_id) AS INT) AS rank FROM (
      SELECT a.stop_id, b.stop_id AS alias_id, {dist_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS m
      FROM {{stops}} a JOIN {{stops}} b ON {PLATFORM_SQL.format('a.name')} = {PLATFORM_SQL.format('b.name')}) p WHERE m <= 200""",
)
def stop_aliases(c):
    return network.stop_aliases(c.t.stops).withColumn("meters", r("meters", 4))


@register(
    "hide_numbered",
    f"""
    SELECT stop_id, name FROM {{hubs}} h WHERE NOT (NOT regexp_matches(name, ' [0-9]+$') AND EXISTS (
      SELECT 1 FROM {{hubs}} o WHERE regexp_matches(o.name, ' [0-9]+$') AND lower(regexp_replace(o.name, ' [0-9]+$', '')) = lower(h.name)
        AND {dist_sql('h.lat', 'h.lng', 'o.lat', 'o.lng')} <= 120))""",
)
def hide_numbered(c):
    return network.hide_generic(c.t.hubs).select("stop_id", "name")


@register(
    "geo_fns",
    f"""
    SELECT h.corridor_id, h.a, h.b, round({dist_sql('x.lat', 'x.lng', 'y.lat', 'y.lng')}, 4) AS meters, round({dist_sql('x.lat', 'x.lng', 'y.lat', 'y.lng')}, 4) AS meters_asin,
           round({bearing_sql('x.lat', 'x.lng', 'y.lat', 'y.lng')}, 5) AS bearing,
           CAST((CAST(floor(atan2((y.lng - x.lng) * cos((x.lat + y.lat) / 2 * (3.141592653589793::DOUBLE / 180)), y.lat - x.lat) * 180 / 3.141592653589793::DOUBLE + 0.5::DOUBLE) AS INT) + 360) % 360 AS INT) AS flat
    FROM {{hops}} h JOIN {{stops}} x ON x.stop_id = h.a JOIN {{stops}} y ON y.stop_id = h.b""",
)
def geo_fns(c):
    at = lambda p: c.t.stops.select(F.col("stop_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    pair = [F.col(n) for n in ["a_lat", "a_lng", "b_lat", "b_lng"]]
    return c.t.hops.filter("b IS NOT NULL").join(at("a"), "a").join(at("b"), "b").select(
        "corridor_id", "a", "b", r(distance_m(*pair), 4).alias("meters"), r(distance_asin_m(*pair), 4).alias("meters_asin"),
        r(bearing(*pair), 5).alias("bearing"), flat_bearing(*pair).alias("flat"),
    )


AUGMENT_SQL = f"""
    WITH hp AS (SELECT t.route_id AS corridor_id, st.trip_id, st.stop_sequence, st.stop_id AS from_stop, lead(st.stop_id) OVER w AS to_stop,
                       {sec_sql('st.departure_time')} AS dep, lead({sec_sql('st.arrival_time')}) OVER w AS arr
                FROM {{stop_times}} st JOIN {{trips}} t ON st.trip_id = t.trip_id WINDOW w AS (PARTITION BY st.trip_id ORDER BY st.stop_sequence)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, from_stop, to_stop ORDER BY trip_id, stop_sequence) AS rn FROM hp WHERE to_stop IS NOT NULL),
    added AS (SELECT f.* FROM firsts f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {{segments}} s WHERE s.corridor_id = f.corridor_id AND s.from_stop = f.from_stop AND s.to_stop = f.to_stop))
    SELECT segment_id, corridor_id, from_stop, to_stop, CAST(secs AS INT) AS secs, 'segments' AS origin FROM {{segments}}
    UNION ALL
    SELECT concat('gtfs:', corridor_id, ':', from_stop, ':', to_stop), corridor_id, from_stop, to_stop,
           CAST(coalesce(CASE WHEN arr > dep THEN greatest(30, arr - dep) END, greatest(30, round_even({dist_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} / 5, 0)), 60) AS INT), 'timetable'
    FROM added f JOIN {{stops}} a ON a.stop_id = f.from_stop JOIN {{stops}} b ON b.stop_id = f.to_stop"""


STEPS_SQL["o_augmented"] = AUGMENT_SQL


@register("augment_segments", AUGMENT_SQL)
def augment_segments(c):
    return c.all_segments


SNAP_SQL = f"""
    SELECT segment_id, {clamp_sql(f"avg({clamp_sql('segment_load')})")} AS density FROM {{o_segloads}} WHERE dep <= 28800 AND 28800 < next_arr GROUP BY segment_id"""


@register(
    "edge_weights",
    f"""
    SELECT s.segment_id, s.corridor_id, round(coalesce(p.density, m.density, 0.5::DOUBLE), 6) AS density FROM {{segments}} s
    LEFT JOIN ({SNAP_SQL}) p ON p.segment_id = s.segment_id
    LEFT JOIN (SELECT corridor_id, {clamp_sql('avg(load)')} AS density FROM {{o_loads}} GROUP BY corridor_id) m ON m.corridor_id = s.corridor_id""",
)
def edge_weights(c):
    snap = demand.segment_snapshot(c.segment_loads, F.lit(28800))
    means = demand.corridor_mean(c.loads, c.loads)
    return network.edge_weights(c.t.segments, snap, means, None).select("segment_id", "corridor_id", r("density").alias("density"))


@register(
    "network_edges",
    f"""
    WITH lines AS (SELECT DISTINCT stop_id, corridor_id FROM {{members}}),
    tr AS (SELECT l.stop_id AS f, l.stop_id AS t, l.corridor_id FROM lines l WHERE (SELECT count(*) FROM lines x WHERE x.stop_id = l.stop_id) >= 2
           UNION ALL SELECT a.stop_id, b.stop_id, l.corridor_id FROM {{stops}} a JOIN {{stops}} b ON a.stop_id <> b.stop_id AND {PLATFORM_SQL.format('a.name')} = {PLATFORM_SQL.format('b.name')}
             JOIN lines l ON l.stop_id = b.stop_id WHERE {dist_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 200)
    SELECT from_stop, to_stop, 'segmen' AS kind, segment_id, corridor_id, secs, round({dist_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 4) AS meters, 0.5::DOUBLE AS density
    FROM {{o_augmented}} JOIN {{stops}} a ON a.stop_id = from_stop JOIN {{stops}} b ON b.stop_id = to_stop
    UNION ALL SELECT f, t, 'transit', NULL, corridor_id, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM tr""",
)
def network_edges(c):
    return c.edges.withColumn("meters", r("meters", 4))


@register(
    "nearest_shape_point",
    f"""
    SELECT shape_id, stop_id, seq, round(m, 4) AS meters FROM (
      SELECT p.shape_id, m.stop_id, p.seq, {dist_sql('s.lat', 's.lng', 'p.lat', 'p.lng')} AS m,
             row_number() OVER (PARTITION BY p.shape_id, m.stop_id ORDER BY round({dist_sql('s.lat', 's.lng', 'p.lat', 'p.lng')}, 6), p.seq) AS rn
      FROM {{members}} m JOIN {{stops}} s ON s.stop_id = m.stop_id JOIN {{shapes}} p ON p.corridor_id = m.corridor_id) q WHERE rn = 1""",
)
def nearest_shape_point(c):
    on_shape = c.t.members.join(c.t.shapes.select("corridor_id", "shape_id").distinct(), "corridor_id").join(c.t.stops, "stop_id").select("shape_id", "stop_id", "lat", "lng")
    return shapes.nearest_points(on_shape, c.t.shapes).select("shape_id", "stop_id", "seq", r("meters", 4).alias("meters"))


@register(
    "shape_slices",
    """
    WITH hp AS (SELECT DISTINCT corridor_id, from_stop, to_stop FROM {segments}),
    ends AS (SELECT corridor_id, from_stop AS stop_id FROM hp UNION SELECT corridor_id, to_stop FROM hp),
    near AS (SELECT corridor_id, shape_id, stop_id, seq, err FROM (
      SELECT e.corridor_id, p.shape_id, e.stop_id, p.seq, round((p.lng - s.lng) * (p.lng - s.lng) + (p.lat - s.lat) * (p.lat - s.lat), 12) AS err,
             row_number() OVER (PARTITION BY e.corridor_id, p.shape_id, e.stop_id ORDER BY round((p.lng - s.lng) * (p.lng - s.lng) + (p.lat - s.lat) * (p.lat - s.lat), 12), p.seq) AS rn
      FROM ends e JOIN {stops} s ON s.stop_id = e.stop_id JOIN {shapes} p ON p.corridor_id = e.corridor_id) z WHERE rn = 1),
    best AS (SELECT * FROM (SELECT h.*, a.shape_id, a.seq AS a_seq, b.seq AS b_seq, row_number() OVER (PARTITION BY h.corridor_id, h.from_stop, h.to_stop ORDER BY round(a.err + b.err, 12), a.shape_id) AS rn
      FROM hp h JOIN near a ON a.corridor_id = h.corridor_id AND a.stop_id = h.from_stop JOIN near b ON b.corridor_id = h.corridor_id AND b.stop_id = h.to_stop AND b.shape_id = a.shape_id
      WHERE a.seq <> b.seq) y WHERE rn = 1)
    SELECT b.corridor_id, b.from_stop, b.to_stop, b.shape_id, CAST(row_number() OVER (PARTITION BY b.corridor_id, b.from_stop, b.to_stop ORDER BY CASE WHEN b.a_seq > b.b_seq THEN -p.seq ELSE p.seq END) - 1 AS INT) AS step,
           round(p.lat, 7) AS lat, round(p.lng, 7) AS lng
    FROM best b JOIN {shapes} p ON p.shape_id = b.shape_id AND p.seq BETWEEN least(b.a_seq, b.b_seq) AND greatest(b.a_seq, b.b_seq)""",
)
def shape_slices(c):
    slices = shapes.hop_slices(c.t.segments, c.t.stops, c.t.shapes)
    return shapes.slice_points(slices, c.t.shapes).withColumn("lat", r("lat", 7)).withColumn("lng", r("lng", 7))


FLAT = "sqrt(((lng2 - lng) * cos(radians(lat))) * ((lng2 - lng) * cos(radians(lat))) + (lat2 - lat) * (lat2 - lat))"


@register(
    "polyline_position",
    f"""
    WITH pc AS (SELECT * FROM (SELECT shape_id, seq, lat, lng, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM {{shapes}} WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) z WHERE lat2 IS NOT NULL),
    ln AS (SELECT *, {dist_sql('lat', 'lng', 'lat2', 'lng2')} AS len, {FLAT} AS flat FROM pc),
    cm AS (SELECT *, sum(len) OVER w - len AS walked, sum(len) OVER (PARTITION BY shape_id) AS total, sum(flat) OVER w - flat AS fwalked, sum(flat) OVER (PARTITION BY shape_id) AS ftotal
           FROM ln WINDOW w AS (PARTITION BY shape_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    hit AS (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY seq) AS rn FROM cm WHERE round(walked + len, 6) >= round(0.37::DOUBLE * total, 6)),
    pre AS (SELECT shape_id, count(*) AS pieces, max(seq) AS last_seq FROM cm WHERE fwalked < 0.37::DOUBLE * ftotal GROUP BY shape_id)
    SELECT h.shape_id, round(h.lat + (h.lat2 - h.lat) * ((0.37::DOUBLE * total - walked) / len), 7) AS lat, round(h.lng + (h.lng2 - h.lng) * ((0.37::DOUBLE * total - walked) / len), 7) AS lng,
           round({bearing_sql('h.lat', 'h.lng', 'h.lat2', 'h.lng2')}, 5) AS bearing, p.pieces,
           (SELECT round(x.lng + (x.lng2 - x.lng) * least(1.0::DOUBLE, (0.37::DOUBLE * x.ftotal - x.fwalked) / x.flat), 7) FROM cm x WHERE x.shape_id = p.shape_id AND x.seq = p.last_seq) AS cut_lng
    FROM hit h JOIN pre p ON p.shape_id = h.shape_id WHERE rn = 1""",
)
def polyline_position(c):
    at = shapes.position_on_line(c.t.shapes, ["shape_id"], "seq", F.lit(0.37))
    prefix = shapes.line_prefix(c.t.shapes, ["shape_id"], "seq", 0.37).groupBy("shape_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.max_by("end_lng", "seq").alias("cut_lng")
    )
    return at.join(prefix, "shape_id").select(
        "shape_id", r("lat", 7).alias("lat"), r("lng", 7).alias("lng"), r("bearing", 5).alias("bearing"), "pieces", r("cut_lng", 7).alias("cut_lng")
    )


@register(
    "fix_motion",
    """
    WITH p AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM {fixes} WINDOW w AS (PARTITION BY bus_id ORDER BY ms, event_id)),
    d AS (SELECT *, sqrt((lng - plng) * (lng - plng) + (lat - plat) * (lat - plat)) > 0.02::DOUBLE AS j,
                 (lng - plng) * cos((lat + plat) / 2 * (3.141592653589793::DOUBLE / 180)) AS dx, lat - plat AS dy FROM p)
    SELECT event_id, bus_id, ms, coalesce(j, false) AS jump,
           CASE WHEN NOT j AND sqrt(dx * dx + dy * dy) >= 0.000001::DOUBLE THEN CAST((CAST(floor(atan2(dx, dy) * 180 / 3.141592653589793::DOUBLE + 0.5::DOUBLE) AS INT) + 360) % 360 AS INT) END AS bearing FROM d""",
)
def fix_motion(c):
    return shapes.fix_motion(c.t.fixes, "bus_id")


@register(
    "od_pairs",
    """
    WITH n AS (SELECT corridor_id, stop_id, seq - 1 AS i, n_stops AS n, greatest(1, n_stops // 16) AS stride FROM {members} WHERE n_stops >= 3),
    s AS (SELECT corridor_id, stop_id, i // stride AS idx FROM n WHERE i % stride = 0),
    p AS (SELECT a.corridor_id, a.stop_id AS origin, b.stop_id AS destination, row_number() OVER (PARTITION BY a.corridor_id ORDER BY a.idx, b.idx) AS rn
          FROM s a JOIN s b ON a.corridor_id = b.corridor_id AND b.idx >= a.idx + 2),
    d AS (SELECT DISTINCT origin, destination FROM p WHERE rn <= 12)
    SELECT origin, destination, h.hour FROM d, (VALUES (8), (17)) h(hour)""",
)
def od_pairs(c):
    return scenario.at_hours(scenario.screening_pairs(c.t.members), [8, 17])


@register(
    "transfer_pairs",
    """
    WITH l AS (SELECT * FROM {lines_of_stop}),
    ex AS (SELECT corridor_id, stop_id, row_number() OVER (PARTITION BY corridor_id ORDER BY stop_id) AS rn FROM l WHERE (SELECT count(*) FROM l x WHERE x.stop_id = l.stop_id) = 1),
    own AS (SELECT corridor_id, string_agg(stop_id, ',' ORDER BY stop_id) AS stops FROM ex WHERE rn <= 3 GROUP BY corridor_id),
    sh AS (SELECT a.corridor_id AS line_a, b.corridor_id AS line_b, a.stop_id, row_number() OVER (PARTITION BY a.corridor_id, b.corridor_id ORDER BY a.stop_id) AS rn FROM l a JOIN l b ON a.stop_id = b.stop_id AND a.cnum < b.cnum)
    SELECT line_a, line_b, count(*) AS connectors, string_agg(CASE WHEN rn <= 3 THEN stop_id END, ',' ORDER BY stop_id) AS via, x.stops AS own_a, y.stops AS own_b
    FROM sh JOIN own x ON x.corridor_id = line_a JOIN own y ON y.corridor_id = line_b GROUP BY ALL""",
)
def transfer_pairs(c):
    return scenario.line_connections(c.t.lines_of_stop)


SCOPE_TEN = [str(n) for n in range(1, 11)]


@register(
    "scope_map",
    f"""
    WITH l AS (SELECT stop_id, string_agg(corridor_id, ',' ORDER BY corridor_id) AS lines, bool_and(corridor_id IN ({', '.join(f"'{x}'" for x in SCOPE_TEN)})) AS ok FROM {{lines_of_stop}} GROUP BY stop_id)
    SELECT coalesce(o.lines, '?') AS o_lines, coalesce(d.lines, '?') AS d_lines, coalesce(o.ok, true) AND coalesce(d.ok, true) AS in_scope, count(*) AS pairs
    FROM {{catalog}} c LEFT JOIN l o ON o.stop_id = c.origin LEFT JOIN l d ON d.stop_id = c.destination GROUP BY ALL""",
)
def scope_map(c):
    return scenario.scope_map(c.t.catalog, c.t.lines_of_stop, SCOPE_TEN).groupBy("o_lines", "d_lines", "in_scope").agg(F.count(F.lit(1)).alias("pairs"))


@register(
    "synthetic_members",
    """
    SELECT DISTINCT t.route_id AS corridor_id, st.stop_id FROM {stop_times} st JOIN {trips} t ON t.trip_id = st.trip_id WHERE NOT EXISTS (SELECT 1 FROM {lines_of_stop} l WHERE l.stop_id = st.stop_id)""",
)
def synthetic_members(c):
    return network.augment_segments(c.t.segments, c.t.lines_of_stop, c.t.stop_times, c.t.trips, c.t.stops)[1]
