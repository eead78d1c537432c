"""Queries on ridership, allocation of riders, crowding and time-point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom import constants as C
from transitloom.functions.scalar import band_name, band_weight, density_class, density_label, density_rank, clamp_load, round_scaled
from transitloom.operators import audit, demand, lookup
from transitloom.plans.base import (
    RUN_ID, SERVICE_DATE, TIMES_SQL, band_sql, bearing_sql, clamp_sql, pick_sql, r, register,
)

CLASS_SQL = "CASE WHEN {0} < 0.5::DOUBLE THEN 'sepi' WHEN {0} < 0.8::DOUBLE THEN 'sedang' WHEN {0} < 1.0::DOUBLE THEN 'padat' ELSE 'sangat_padat' END"


@register(
    "ridership_branches",
    """
    SELECT regexp_extract(label, 'BRT\\s*(\\d+)', 1) AS corridor_id, CAST(max(branches) AS INT) AS branches
    FROM (SELECT concat('BRT ', CAST(1 + c_custkey % 13 AS VARCHAR), ' (x cabang)') AS label, try_cast(CASE WHEN c_nationkey = 7 THEN 'n/a' ELSE CAST(1 + c_nationkey % 4 AS VARCHAR) END AS INT) AS branches,
                 c_mktsegment FROM {customer}) x WHERE c_mktsegment <> 'FURNITURE' AND branches IS NOT NULL GROUP BY 1""",
)
def ridership_branches(c):
    sheet = c.t.customer.select(
        F.when(F.col("c_mktsegment") == "FURNITURE", "Koridor").otherwise(
            F.concat(F.lit("BRT "), (1 + F.col("c_custkey") % 13).cast("string"), F.lit(" (x cabang)"))
        ).alias("label"),
        F.when(F.col("c_nationkey") == 7, "n/a").otherwise((1 + F.col("c_nationkey") % 4).cast("string")).alias("branches"),
    )
    return demand.branch_counts(sheet).groupBy("corridor_id").agg(F.max("branches").alias("branches"))


@register(
    "ridership_rows",
    """
    SELECT concat('RID-', strftime(r.date, '%Y%m%d'), '-', r.corridor_id) AS ridership_id, strftime(r.date, '%Y-%m-%d') AS date, r.corridor_id,
           CASE WHEN isodow(r.date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, r.total, CAST(coalesce(b.branches, 1) AS INT) AS branches,
           round(r.total::DOUBLE / coalesce(b.branches, 1), 6) AS riders
    FROM {ridership} r LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS corridor_id, 1 + s_nationkey % 4 AS branches FROM {supplier} WHERE s_nationkey <> 3) b USING (corridor_id)""",
)
def ridership_rows(c):
    branches = c.t.supplier.filter("s_nationkey <> 3").select(F.col("s_suppkey").cast("string").alias("corridor_id"), (1 + F.col("s_nationkey") % 4).alias("branches"))
    return demand.derive_ridership(c.t.ridership, branches).withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn("riders", r("riders"))


@register(
    "recent_dates",
    f"""
    WITH ranked AS (SELECT corridor_id, date, row_number() OVER (PARTITION BY corridor_id ORDER BY date DESC) AS rn FROM {{riders}}),
    kept AS (SELECT * FROM ranked WHERE rn <= 30),
    n AS (SELECT corridor_id, count(*) AS n, max(date) AS latest FROM kept GROUP BY corridor_id)
    SELECT k.corridor_id, CAST(n.n AS BIGINT) AS recent, strftime(n.latest, '%Y-%m-%d') AS latest, strftime(k.date, '%Y-%m-%d') AS sampled,
           strftime(u.used_date, '%Y-%m-%d') AS used_for_date
    FROM kept k JOIN n ON k.corridor_id = n.corridor_id AND k.rn - 1 = {pick_sql('n.n', "'ridership_sample_30'", f"'{RUN_ID}'", 'k.corridor_id')}
    JOIN {{o_used}} u ON u.corridor_id = k.corridor_id""",
)
def recent_dates(c):
    riders = c.t.riders
    recent = demand.recent_dates(riders).groupBy("corridor_id").agg(F.count(F.lit(1)).alias("recent"), F.max("date").alias("latest"))
    sampled = demand.sampled_dates(riders, F.lit(RUN_ID)).withColumnRenamed("date", "sampled")
    used = demand.resolve_ridership(riders, riders.select("corridor_id"), SERVICE_DATE, RUN_ID)
    text = lambda name: F.date_format(name, "yyyy-MM-dd")
    return recent.join(sampled, "corridor_id").join(used, "corridor_id").select(
        "corridor_id", "recent", text("latest").alias("latest"), text("sampled").alias("sampled"), text("used_date").alias("used_for_date")
    )


@register(
    "daily_mean_load",
    """
    SELECT strftime(r.date, '%Y-%m-%d') AS date, r.corridor_id, coalesce(s.supply, 0) AS supply,
           CASE WHEN s.supply > 0 THEN r.riders / (s.supply * 80) ELSE 0.5::DOUBLE END AS mean_load
    FROM {riders} r LEFT JOIN (SELECT corridor_id, count(*) AS supply FROM {o_instances} GROUP BY corridor_id) s USING (corridor_id)""",
)
def daily_mean_load(c):
    return demand.daily_mean_load(c.t.riders, c.instances).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "corridor_id", "supply", "mean_load"
    )


@register(
    "allocate_riders",
    "SELECT instance_id, corridor_id, strftime(used_date, '%Y-%m-%d') AS used_date, band, round(weight, 6) AS weight, round(passengers, 5) AS passengers, round(load, 6) AS load FROM {o_loads}",
)
def allocate_riders(c):
    return c.loads.select(
        "instance_id", "corridor_id", F.date_format("used_date", "yyyy-MM-dd").alias("used_date"), "band", r("weight").alias("weight"),
        r("passengers", 5).alias("passengers"), r("load").alias("load"),
    )


BANDS_SQL = "(VALUES " + ", ".join(f"('{b[0]}', {b[3]}::DOUBLE)" for b in C.TIME_BANDS) + ") AS bands(band, band_weight)"


@register(
    "band_summary",
    f"""
    SELECT c.corridor_id, bands.band, bands.band_weight, count(l.instance_id) AS trips, round(coalesce(sum(l.weight), 0), 5) AS weights,
           round(coalesce(sum(l.passengers), 0), 4) AS passengers, round(coalesce(avg(l.load), 0), 6) AS avg_load,
           round(coalesce(min(l.load), 0), 6) AS min_load, round(coalesce(max(l.load), 0), 6) AS max_load
    FROM (SELECT DISTINCT corridor_id FROM {{o_loads}}) c CROSS JOIN {BANDS_SQL} LEFT JOIN {{o_loads}} l ON l.corridor_id = c.corridor_id AND l.band = bands.band GROUP BY ALL""",
)
def band_summary(c):
    out = demand.band_summary(c.loads)
    digits = {"weights": 5, "passengers": 4}
    return out.select(
        "corridor_id", "band", "band_weight", "trips",
        *[r(n, digits.get(n, 6)).alias(n) for n in ["weights", "passengers", "avg_load", "min_load", "max_load"]],
    )


@register(
    "segment_loads",
    "SELECT instance_id, pos, segment_id, round(load, 6) AS load, round(segment_load, 6) AS segment_load FROM {o_segloads}",
)
def segment_loads(c):
    return c.segment_loads.select("instance_id", "pos", "segment_id", r("load").alias("load"), r("segment_load").alias("segment_load"))


@register(
    "segment_snapshot",
    f"""
    SELECT segment_id, CAST(28805 - 28805 % 60 AS INT) AS bucket, count(*) AS vehicles, round({clamp_sql(f"avg({clamp_sql('segment_load')})")}, 6) AS density
    FROM {{o_segloads}} WHERE dep <= 28800 AND 28800 < next_arr GROUP BY segment_id""",
)
def segment_snapshot(c):
    asked = F.lit(28805)
    bucket = asked - F.pmod(asked, F.lit(60))
    snap = demand.segment_snapshot(c.segment_loads_at(bucket), bucket)
    return snap.select("segment_id", bucket.cast("int").alias("bucket"), "vehicles", r("density").alias("density"))


@register(
    "corridor_mean",
    f"""
    SELECT m.corridor_id, round(coalesce(l.density, 0.5::DOUBLE), 6) AS density FROM (SELECT DISTINCT corridor_id FROM {{members}}) m
    LEFT JOIN (SELECT corridor_id, {clamp_sql('avg(load)')} AS density FROM {{o_loads}} GROUP BY corridor_id) l USING (corridor_id)""",
)
def corridor_mean(c):
    return demand.corridor_mean(c.loads, c.t.members).withColumn("density", r("density"))


DENSITY_TABLE_SQL = f"""
    SELECT instance_id AS bus_id, corridor_id, CAST((departure // 3600) % 24 AS INT) AS hour, 'weekday' AS day_type, {clamp_sql('load')} AS density FROM {{o_loads}}"""


@register("density_table", f"SELECT bus_id, corridor_id, hour, day_type, round(density, 4) AS density FROM ({DENSITY_TABLE_SQL}) d")
def density_table(c):
    return demand.density_table(c.loads, "weekday").withColumn("density", r("density", 4))


@register("corridor_min", f"SELECT corridor_id, round(min(density), 6) AS density FROM ({DENSITY_TABLE_SQL}) d WHERE hour = 8 GROUP BY corridor_id")
def corridor_min(c):
    return demand.corridor_minimum(demand.density_table(c.loads, "weekday"), 8, "weekday").withColumn("density", r("density"))


@register(
    "borrow_load",
    f"""
    WITH pool AS (SELECT corridor_id, instance_id, load, row_number() OVER (PARTITION BY corridor_id ORDER BY instance_id) - 1 AS slot, count(*) OVER (PARTITION BY corridor_id) AS n
                  FROM {{o_loads}} WHERE band = 'morning_peak'),
    v AS (SELECT DISTINCT bus_id, CAST(1 + event_id % 15 AS VARCHAR) AS corridor_id FROM {{readings}})
    SELECT v.bus_id, v.corridor_id, p.instance_id, round({clamp_sql('p.load')}, 6) AS density
    FROM v JOIN pool p ON v.corridor_id = p.corridor_id AND p.slot = {pick_sql('p.n', 'v.bus_id', 'v.corridor_id', "'morning_peak'")}""",
)
def borrow_load(c):
    vehicles = c.t.readings.select("bus_id", (1 + F.col("event_id") % 15).cast("string").alias("corridor_id"))
    return demand.borrow_loads(vehicles, c.loads, 28800).withColumn("density", r("density"))


@register(
    "density_class",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, x AS load, {clamp_sql('x')} AS shown, {CLASS_SQL.format('x')} AS class,
           CAST(CASE WHEN x < 0.5::DOUBLE THEN 0 WHEN x < 0.8::DOUBLE THEN 1 WHEN x < 1.0::DOUBLE THEN 2 ELSE 3 END AS INT) AS class_rank,
           CASE WHEN x < 0.5::DOUBLE THEN 'Sepi' WHEN x < 0.8::DOUBLE THEN 'Sedang' ELSE 'Padat' END AS label,
           CASE WHEN {clamp_sql('x')} < 0.4::DOUBLE THEN 'Sepi' WHEN {clamp_sql('x')} < 0.7::DOUBLE THEN 'Sedang' ELSE 'Padat' END AS display_label
    FROM (SELECT *, (l_quantity - 2) / 40 AS x FROM {{lineitem}}) q""",
)
def density_class_query(c):
    x = F.col("load")
    return c.t.lineitem.withColumn("load", (F.col("l_quantity") - 2) / 40).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "load", clamp_load(x).alias("shown"), density_class(x).alias("class"),
        density_rank(x).alias("class_rank"), density_label(x).alias("label"), density_label(clamp_load(x), 0.4, 0.7).alias("display_label"),
    )


@register(
    "time_band",
    f"""
    SELECT event_id, CAST(ms // 1000 % 129600 AS BIGINT) AS second, {band_sql('(ms // 1000) % 129600', 0)} AS band, {band_sql('(ms // 1000) % 129600', 3)} AS weight FROM {{readings}}""",
)
def time_band(c):
    second = F.floor(F.col("ms") / 1000) % 129600
    return c.t.readings.select("event_id", second.alias("second"), band_name(second).alias("band"), band_weight(second).alias("weight"))


@register(
    "active_counts",
    f"SELECT time, corridor_id, direction_id, count(*) AS active FROM {{o_instances}} JOIN {TIMES_SQL} ON first_dep <= second AND second < last_arr GROUP BY ALL",
)
def active_counts(c):
    return audit.active_counts(c.instances)


@register(
    "active_segments",
    f"SELECT time, instance_id, pos, segment_id FROM {{o_ihops}} JOIN {TIMES_SQL} ON dep <= second AND second < next_arr",
)
def active_segments(c):
    return lookup.current_hops(c.hops, C.SAMPLE_TIMES).select("time", "instance_id", "pos", "segment_id")


FRACTION = "((second - dep)::DOUBLE / (next_arr - dep))"
POSITIONS_SQL = f"""
    SELECT h.time, h.instance_id, h.corridor_id, h.direction_id, h.lat + (h.to_lat - h.lat) * {FRACTION} AS lat, h.lng + (h.to_lng - h.lng) * {FRACTION} AS lng,
           {bearing_sql('h.lat', 'h.lng', 'h.to_lat', 'h.to_lng')} AS bearing, h.to_name AS next_stop, CAST(round_even((next_arr - second)::DOUBLE / 60, 0) AS INT) AS eta_min,
           {clamp_sql('l.load')} AS load
    FROM (SELECT * FROM {{o_ihops}} JOIN {TIMES_SQL} ON dep <= second AND second < next_arr) h JOIN {{o_loads}} l ON l.instance_id = h.instance_id"""


@register(
    "positions",
    f"""
    SELECT time, instance_id, corridor_id, direction_id, round(lat, 7) AS lat, round(lng, 7) AS lng, round(bearing, 4) AS bearing, next_stop, eta_min, round(load, 3) AS load,
           {CLASS_SQL.format('load')} AS class FROM ({POSITIONS_SQL}) p""",
)
def positions(c):
    return lookup.positions(c.hops, C.SAMPLE_TIMES, c.loads).select(
        "time", "instance_id", "corridor_id", "direction_id", r("lat", 7).alias("lat"), r("lng", 7).alias("lng"), r("bearing", 4).alias("bearing"),
        "next_stop", "eta_min", r("load", 3).alias("load"), density_class(F.col("load")).alias("class"),
    )


@register(
    "positions_visible",
    f"""
    SELECT time, instance_id, corridor_id, direction_id, next_stop, eta_min FROM (
      SELECT *, row_number() OVER (PARTITION BY time, corridor_id, direction_id ORDER BY eta_min, instance_id) AS rn FROM ({POSITIONS_SQL}) p) q WHERE rn <= 3""",
)
def positions_visible(c):
    return lookup.positions(c.hops, C.SAMPLE_TIMES, c.loads, visible=3).select("time", "instance_id", "corridor_id", "direction_id", "next_stop", "eta_min")


@register(
    "positions_geojson",
    f"""
    SELECT time, instance_id, concat('{{{{"type":"Feature","geometry":{{{{"type":"Point","coordinates":[', CAST(CAST(round(lng, 6) AS DECIMAL(10, 6)) AS VARCHAR), ',', CAST(CAST(round(lat, 6) AS DECIMAL(10, 6)) AS VARCHAR),
           ']}}}},"properties":{{{{"bus_id":"', instance_id, '","koridor_id":"', corridor_id, '","next_stop":"', next_stop, '","eta_minutes":', CAST(eta_min AS VARCHAR), '}}}}}}}}') AS feature
    FROM ({POSITIONS_SQL}) p""",
)
def positions_geojson(c):
    from transitloom.sources.sinks import point_feature

    rows = lookup.positions(c.hops, C.SAMPLE_TIMES, c.loads)
    # Degrees with six places (about 0.1 m), as decimals, so that both engines print the same digits.
    degrees = lambda name: round_scaled(F.col(name), 6).cast("decimal(10, 6)")
    properties = {"bus_id": F.col("instance_id"), "koridor_id": F.col("corridor_id"), "next_stop": F.col("next_stop"), "eta_minutes": F.col("eta_min")}
    return rows.select("time", "instance_id", point_feature(degrees("lng"), degrees("lat"), properties).alias("feature"))


@register(
    "next_arrivals",
    f"""
    WITH due AS (SELECT t.time, t.second, v.* FROM {{o_visits}} v JOIN {TIMES_SQL.replace(' AS times(time, second)', ' AS t(time, second)')} ON v.arr >= t.second AND v.arr - t.second <= 3600),
    first_visit AS (SELECT *, row_number() OVER (PARTITION BY time, stop_id, instance_id ORDER BY arr) AS fv FROM due),
    best AS (SELECT *, row_number() OVER (PARTITION BY time, stop_id, corridor_id ORDER BY arr, instance_id) AS b FROM first_visit WHERE fv = 1)
    SELECT x.time, x.stop_id, x.corridor_id, x.instance_id, x.trip_id, x.arr - x.second AS eta_secs, CAST(round_even((x.arr - x.second)::DOUBLE / 60, 0) AS INT) AS eta_min,
           round({clamp_sql('l.load')}, 3) AS load, {CLASS_SQL.format(clamp_sql('l.load'))} AS class, round(l.passengers, 2) AS passengers,
           CAST(row_number() OVER (PARTITION BY x.time, x.stop_id ORDER BY x.arr - x.second, x.corridor_id) AS INT) AS rank
    FROM best x JOIN {{o_loads}} l ON l.instance_id = x.instance_id WHERE x.b = 1""",
)
def next_arrivals(c):
    rows = lookup.next_arrivals(c.visits, c.loads, C.SAMPLE_TIMES)
    return rows.select(
        "time", "stop_id", "corridor_id", "instance_id", "trip_id", "eta_secs", F.bround(F.col("eta_secs") / 60, 0).cast("int").alias("eta_min"),
        r("load", 3).alias("load"), density_class(F.col("load")).alias("class"), r("passengers", 2).alias("passengers"), "rank",
    )


REQUESTS_SQL = """
    SELECT concat(s.segment_id, '@', CAST(25200 + (s.seq * 1777) % 50000 AS VARCHAR)) AS request_id, s.segment_id, s.corridor_id, s.from_stop, s.to_stop,
           25200 + (s.seq * 1777) % 50000 AS ready FROM {segments} s
    UNION ALL
    SELECT concat(h.corridor_id, ':', h.b, '!', h.a), concat('none:', h.corridor_id), h.corridor_id, h.b, 'nowhere', 30000 + h.seq * 2222 FROM {hops} h WHERE h.b IS NOT NULL"""


@register(
    "next_trip_tiered",
    f"""
    WITH req AS ({REQUESTS_SQL}),
    cand AS (
      SELECT r.request_id, 1 AS tier, h.arr AS at_sec, h.instance_id, h.segment_id AS seg FROM req r JOIN {{o_ihops}} h ON h.corridor_id = r.corridor_id AND h.from_stop = r.from_stop AND h.to_stop = r.to_stop AND h.arr >= r.ready
      UNION ALL SELECT r.request_id, 2, v.arr, v.instance_id, NULL FROM req r JOIN {{o_visits}} v ON v.corridor_id = r.corridor_id AND v.stop_id = r.from_stop AND v.arr >= r.ready
      UNION ALL SELECT r.request_id, 3, v.dep, v.instance_id, NULL FROM req r JOIN {{o_visits}} v ON v.corridor_id = r.corridor_id AND v.pos = 1 AND v.dep >= r.ready),
    best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, at_sec, instance_id) AS rn FROM cand)
    SELECT r.request_id, b.tier, b.at_sec, b.instance_id, coalesce(b.seg, r.segment_id) AS matched_segment FROM req r LEFT JOIN best b ON b.request_id = r.request_id AND b.rn = 1""",
)
def next_trip_tiered(c):
    one = c.t.segments.withColumn("ready", 25200 + (F.col("seq") * 1777) % 50000).select(
        F.concat("segment_id", F.lit("@"), F.col("ready").cast("string")).alias("request_id"), "segment_id", "corridor_id", "from_stop", "to_stop", "ready"
    )
    two = c.t.hops.filter("b IS NOT NULL").select(
        F.concat("corridor_id", F.lit(":"), "b", F.lit("!"), "a").alias("request_id"), F.concat(F.lit("none:"), "corridor_id").alias("segment_id"),
        "corridor_id", F.col("b").alias("from_stop"), F.lit("nowhere").alias("to_stop"), (30000 + F.col("seq") * 2222).alias("ready"),
    )
    found = lookup.next_trip(one.unionByName(two), c.instances, c.template, c.trip_hops)
    return found.select("request_id", "tier", "at_sec", "instance_id", "matched_segment")


@register(
    "live_overlay",
    f"""
    WITH ahead AS (SELECT * FROM {{o_instances}} WHERE corridor_id = '1' AND direction_id = '0' AND last_arr > 28800),
    pick AS (SELECT instance_id FROM ahead ORDER BY first_dep > 28800, departure, instance_id LIMIT 1),
    newest AS (SELECT passengers, ms FROM {{readings}} ORDER BY ms DESC, event_id DESC LIMIT 1)
    SELECT l.instance_id, round({clamp_sql('coalesce(n.passengers::DOUBLE / 80, l.load)')}, 6) AS load, round(coalesce(n.passengers::DOUBLE, l.passengers), 4) AS passengers,
           CASE WHEN n.passengers IS NOT NULL THEN 'cv_live' ELSE 'generated' END AS data_source
    FROM {{o_loads}} l LEFT JOIN pick p ON p.instance_id = l.instance_id LEFT JOIN newest n ON p.instance_id IS NOT NULL""",
)
def live_overlay(c):
    return _overlay(c, 60_000)


def _overlay(c, after_ms: int):
    """The clock stands ``after_ms`` past the newest reading."""
    newest = lookup.fresh_reading(c.t.readings, F.max("ms") + after_ms)
    picked = lookup.live_pick(c.instances, "1", "0", 28800)
    return lookup.overlay_live(c.loads, picked, newest).select(
        "instance_id", r(clamp_load(F.col("load"))).alias("load"), r("passengers", 4).alias("passengers"), "data_source"
    )


@register(
    "live_overlay_stale",
    f"SELECT instance_id, round({clamp_sql('load')}, 6) AS load, round(passengers, 4) AS passengers, 'generated' AS data_source FROM {{o_loads}}",
)
def live_overlay_stale(c):
    return _overlay(c, C.LIVE_TTL_SECS * 1000 + 1)
