"""Queries on live feeds, telemetry, detections, duplicates and package checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom import constants as C
from transitloom.operators import demand, live, quality, telemetry
from transitloom.plans.base import STEPS_SQL, band_sql, clamp_sql, dist_sql, pick_sql, r, register
from transitloom.session import step_folder
from transitloom.sources import readers, sinks

# ---- keyed tables, freshness -------------------------------------------------------------------


@register(
    "latest_per_key",
    """
    SELECT bus_id, event_id, ms, passengers, skipped FROM (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY ms DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY bus_id) - 1 AS skipped FROM {readings}) x WHERE rn = 1""",
)
def latest_per_key(c):
    rows = c.t.readings.select("bus_id", "event_id", "ms", "passengers")
    skipped = rows.groupBy("bus_id").agg((F.count(F.lit(1)) - 1).alias("skipped"))
    return sinks.newest_per_key(rows, ["bus_id"], ["ms", "event_id"]).join(skipped, "bus_id")


TTL_MS = 6 * 3600 * 1000


@register(
    "latest_ttl",
    f"""
    WITH b AS (SELECT concat('bus-', CAST(c_custkey AS VARCHAR)) AS bus_id FROM {{customer}}),
    n AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY ms DESC, event_id DESC) AS rn FROM {{readings}}),
    j AS (SELECT b.bus_id, n.ms, n.passengers, (SELECT max(ms) FROM {{readings}}) - n.ms AS age FROM b LEFT JOIN n ON n.bus_id = b.bus_id AND n.rn = 1)
    SELECT bus_id, ms, CASE WHEN ms IS NULL THEN 'unknown' WHEN age > {TTL_MS} THEN 'stale' ELSE 'ok' END AS outcome, CASE WHEN age <= {TTL_MS} THEN passengers END AS shown FROM j""",
)
def latest_ttl(c):
    # The readings arrive as text with varying fraction digits and zone marks, as a database returns them.
    stamp = F.timestamp_millis(F.col("ms"))
    text = F.concat(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.regexp_replace(F.date_format(stamp, "SSS"), "(?<=.)0+$", ""),
        F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+00:00").otherwise(""),
    )
    readings = c.t.readings.select("bus_id", "event_id", "passengers", F.unix_millis(telemetry.tolerant_timestamp(text)).alias("ms"))
    buses = c.t.customer.select(F.concat(F.lit("bus-"), F.col("c_custkey").cast("string")).alias("bus_id"))
    now = readings.agg(F.max("ms").alias("now"))
    # The clock is one number, read once; the driver passes it on as a literal.
    return telemetry.freshness(buses, readings, "bus_id", now.first()["now"], TTL_MS).select("bus_id", "ms", "outcome", "shown")


STALE_MS = 5 * 3600 * 1000
STATUS_SQL = "CASE event_type WHEN 'click' THEN 'tersambung' WHEN 'error' THEN 'ditolak' ELSE 'terputus' END"


@register(
    "relay_status",
    f"""
    WITH rp AS (SELECT bus_id AS relay, event_id, ms, {STATUS_SQL} AS status, ms >= (SELECT max(ms) FROM {{readings}}) - {STALE_MS} AS fresh FROM {{readings}} WHERE event_type <> 'view'),
    g AS (SELECT relay, count(CASE WHEN fresh THEN 1 END) AS f, count(CASE WHEN fresh AND status = 'tersambung' THEN 1 END) AS up, arg_max(status, CASE WHEN fresh THEN ms * 100000 + event_id END) AS last FROM rp GROUP BY relay),
    a AS (SELECT DISTINCT bus_id AS relay FROM {{readings}} UNION SELECT concat('bus-', CAST(c_custkey AS VARCHAR)) FROM {{customer}})
    SELECT a.relay, CASE WHEN g.f IS NULL THEN 'menyambung' WHEN g.f = 0 THEN 'terputus' WHEN g.up > 0 THEN 'tersambung' ELSE g.last END AS state FROM a LEFT JOIN g ON g.relay = a.relay""",
)
def relay_status(c):
    now = c.t.readings.agg(F.max("ms").alias("now")).first()["now"]
    status = F.when(F.col("event_type") == "click", "tersambung").when(F.col("event_type") == "error", "ditolak").otherwise("terputus")
    reports = c.t.readings.filter("event_type <> 'view'").select(F.col("bus_id").alias("relay"), "event_id", "ms", status.alias("status"))
    relays = c.t.readings.select(F.col("bus_id").alias("relay")).union(c.t.customer.select(F.concat(F.lit("bus-"), F.col("c_custkey").cast("string"))))
    return telemetry.relay_status(relays, reports, now, STALE_MS)


# ---- live vehicles -----------------------------------------------------------------------------

SCOPE_SQL = ", ".join(f"'{x}'" for x in C.DEFAULT_SCOPE)
STEPS_SQL["o_parsed"] = f"""
    SELECT event_id, ms, payload->>'$.bus_body_no' AS bus_id, payload->>'$.route_code' AS corridor_id, try_cast(payload->>'$.latitude' AS DOUBLE) AS lat, try_cast(payload->>'$.longitude' AS DOUBLE) AS lng,
           coalesce(try_cast(payload->>'$.bearing' AS INT), 0) AS bearing, CASE WHEN payload->>'$.stops[0].eta' IS NOT NULL THEN payload->>'$.stops[0].name' ELSE payload->>'$.stops[1].name' END AS next_stop,
           coalesce(try_cast(payload->>'$.eta' AS INT), 0) AS eta_min, payload->>'$.trip_id' AS trip_id, payload
    FROM {{vehicle_messages}} WHERE payload->>'$.route_code' IN ({SCOPE_SQL}) AND try_cast(payload->>'$.latitude' AS DOUBLE) IS NOT NULL"""


@register(
    "live_parse",
    "SELECT event_id, bus_id, corridor_id, round(lat, 6) AS lat, round(lng, 6) AS lng, bearing, next_stop, eta_min, trip_id, CAST(CASE WHEN payload->>'$.stops[0].eta' IS NULL THEN 1 ELSE 2 END AS INT) AS n_stops FROM {o_parsed}",
)
def live_parse(c):
    rows = live.parse_messages(c.t.vehicle_messages, F.col("m.route_code").isin(C.DEFAULT_SCOPE))
    return rows.select("event_id", "bus_id", "corridor_id", r("lat").alias("lat"), r("lng").alias("lng"), "bearing", "next_stop", "eta_min", "trip_id", F.size("stops").alias("n_stops"))


@register(
    "live_validate",
    """
    WITH v AS (SELECT event_id, payload->>'$.bus_body_no' AS relay, payload->>'$.route_code' AS rc, try_cast(payload->>'$.latitude' AS DOUBLE) AS lat, try_cast(payload->>'$.longitude' AS DOUBLE) AS lng, try_cast(payload->>'$.bearing' AS INT) AS bearing FROM {vehicle_messages}),
    p AS (SELECT relay, CASE WHEN rc IS NULL THEN 'route_code' WHEN lat IS NULL OR lat NOT BETWEEN -7.0::DOUBLE AND -5.8::DOUBLE THEN 'latitude' WHEN lng NOT BETWEEN 106.2::DOUBLE AND 107.4::DOUBLE THEN 'longitude' WHEN bearing NOT BETWEEN 0 AND 360 THEN 'bearing' END AS problem FROM v)
    SELECT relay, count(CASE WHEN problem IS NULL THEN 1 END) AS accepted, count(problem) AS rejected, count(CASE WHEN problem = 'latitude' THEN 1 END) AS bad_latitude, count(CASE WHEN problem = 'bearing' THEN 1 END) AS bad_bearing FROM p GROUP BY relay""",
)
def live_validate(c):
    rows = live.validate_messages(c.t.vehicle_messages).withColumn("relay", F.get_json_object("payload", "$.bus_body_no"))
    return rows.groupBy("relay").agg(
        F.count_if(F.col("problem").isNull()).alias("accepted"), F.count("problem").alias("rejected"), F.count_if(F.col("problem") == "latitude").alias("bad_latitude"),
        F.count_if(F.col("problem") == "bearing").alias("bad_bearing"),
    )


@register(
    "live_schedule",
    f"""
    WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY ms DESC, event_id DESC) AS rn FROM {{o_parsed}}) x WHERE rn = 1),
    s AS (SELECT bus_id, corridor_id, CASE WHEN payload->>'$.stops[0].eta' IS NULL THEN i - 1 ELSE i END AS pos, json_extract_string(payload, concat('$.stops[', CAST(i AS VARCHAR), '].stop_id')) AS sid, json_extract_string(payload, concat('$.stops[', CAST(i AS VARCHAR), '].parent_stop_id')) AS pid,
                 try_cast(json_extract_string(payload, concat('$.stops[', CAST(i AS VARCHAR), '].eta')) AS INT) AS eta FROM n, (SELECT unnest([0, 1]) AS i) k),
    m AS (SELECT s.*, coalesce(a.stop_id, b.stop_id) AS stop_id FROM s LEFT JOIN {{stops}} a ON a.stop_id = s.sid LEFT JOIN {{stops}} b ON b.stop_id = s.pid WHERE eta IS NOT NULL),
    pool AS (SELECT corridor_id, load, row_number() OVER (PARTITION BY corridor_id ORDER BY instance_id) - 1 AS slot, count(*) OVER (PARTITION BY corridor_id) AS cnt FROM {{o_loads}} WHERE band = 'morning_peak')
    SELECT m.bus_id, m.corridor_id, CAST(m.pos AS INT) AS pos, m.stop_id, 28800 + m.eta * 60 AS arr, round({clamp_sql('p.load')}, 6) AS density
    FROM m JOIN pool p ON p.corridor_id = m.corridor_id AND p.slot = {pick_sql('p.cnt', 'm.bus_id', 'm.corridor_id', "'morning_peak'")} WHERE m.stop_id IS NOT NULL""",
)
def live_schedule(c):
    parsed = live.parse_messages(c.t.vehicle_messages, F.col("m.route_code").isin(C.DEFAULT_SCOPE))
    newest = sinks.newest_per_key(parsed, ["bus_id"], ["ms", "event_id"])
    schedule = live.live_schedule(newest, c.t.stops, 28800)
    density = demand.borrow_loads(newest, c.loads, 28800).select("bus_id", "density")
    return schedule.join(density, "bus_id").select("bus_id", "corridor_id", "pos", "stop_id", "arr", r("density").alias("density"))


STEPS_SQL["o_livestops"] = """
    SELECT event_id, payload->>'$.route_code' AS route, try_cast(payload->>'$.latitude' AS DOUBLE) AS lat, try_cast(payload->>'$.longitude' AS DOUBLE) AS lng,
           json_extract_string(payload, concat('$.stops[', CAST(i AS VARCHAR), '].name')) AS name, json_extract_string(payload, concat('$.stops[', CAST(i AS VARCHAR), '].stop_id')) AS sid,
           json_extract_string(payload, concat('$.stops[', CAST(i AS VARCHAR), '].parent_stop_id')) AS pid FROM {vehicle_messages}, (SELECT unnest([0, 1]) AS i) k"""


@register(
    "stop_match_report",
    f"""
    WITH a AS (SELECT sid AS stop_id, min(struct_pack(e := event_id, n := name, la := lat, ln := lng)) AS i FROM {{o_livestops}} WHERE sid IS NOT NULL GROUP BY sid),
    b AS (SELECT pid AS stop_id, min(struct_pack(e := event_id, n := name, la := lat, ln := lng)) AS i FROM {{o_livestops}} WHERE pid IS NOT NULL GROUP BY pid),
    j AS (SELECT s.*, a.stop_id IS NOT NULL AS ah, b.stop_id IS NOT NULL AS bh, CASE WHEN a.stop_id IS NOT NULL THEN a.i ELSE b.i END AS i FROM {{stops}} s LEFT JOIN a ON a.stop_id = s.stop_id LEFT JOIN b ON b.stop_id = s.stop_id)
    SELECT stop_id, CASE WHEN ah THEN 'stop_id' WHEN bh THEN 'parent_stop_id' ELSE 'tidak_ada' END AS match, round({dist_sql('lat', 'lng', 'i.la', 'i.ln')}, 1) AS meters,
           CASE WHEN ah OR bh THEN coalesce({dist_sql('lat', 'lng', 'i.la', 'i.ln')} > 50, false) END AS far, CASE WHEN ah OR bh THEN lower(name) <> lower(i.n) END AS name_differs FROM j""",
)
def stop_match_report(c):
    by_id, by_parent, _ = live.live_stops(c.t.vehicle_messages)
    return live.match_stops(c.t.stops, by_id, by_parent)


@register(
    "corridor_coverage",
    """
    WITH l AS (SELECT DISTINCT route AS corridor_id, unnest([sid, pid]) AS stop_id FROM {o_livestops}),
    lv AS (SELECT * FROM l WHERE stop_id IS NOT NULL AND corridor_id IN (SELECT corridor_id FROM {members})),
    st AS (SELECT DISTINCT corridor_id, stop_id FROM {members}),
    j AS (SELECT coalesce(st.corridor_id, lv.corridor_id) AS corridor_id, st.stop_id AS s, lv.stop_id AS l FROM st FULL JOIN lv ON st.corridor_id = lv.corridor_id AND st.stop_id = lv.stop_id)
    SELECT corridor_id, count(s) AS static_stops, count(l) AS live_stops, count(CASE WHEN s IS NOT NULL AND l IS NOT NULL THEN 1 END) AS both, count(CASE WHEN l IS NULL THEN 1 END) AS only_static, count(CASE WHEN s IS NULL THEN 1 END) AS only_live,
           count(l) > 0 AS in_live, CASE WHEN count(l) > 0 THEN round(100 * count(CASE WHEN s IS NOT NULL AND l IS NOT NULL THEN 1 END)::DOUBLE / count(s), 1) END AS percent_served FROM j GROUP BY corridor_id""",
)
def corridor_coverage(c):
    return live.corridor_coverage(c.t.members, live.live_stops(c.t.vehicle_messages)[2])


# ---- camera and power messages -------------------------------------------------------------------

STEPS_SQL["o_latency"] = f"""
    WITH p AS (SELECT *, CASE WHEN payload LIKE '{{{{%' THEN payload END AS j FROM {{camera_messages}}),
    d AS (SELECT *, CASE WHEN try_cast(j->>'$.timestamp' AS BIGINT) >= {C.EPOCH_MS_MIN} THEN try_cast(j->>'$.timestamp' AS BIGINT) END AS device_ms, j->>'$.image' AS img FROM p),
    l AS (SELECT *, received_ms - device_ms AS raw, received_ms - device_ms + offset_ms AS cor FROM d)
    SELECT *, CASE WHEN j IS NULL THEN 'invalid_payload' WHEN device_ms IS NULL THEN 'invalid_timestamp' WHEN img <> '/9j/2Q==' THEN 'invalid_image' WHEN retain THEN 'retained'
           WHEN offset_ms IS NULL THEN 'ntp_unavailable' WHEN cor < 0 THEN 'clock_ahead' ELSE 'ok' END AS status FROM l"""


@register("latency_status", "SELECT event_id, device_ms, raw AS latency_raw_ms, cor AS latency_corrected_ms, status, status = 'ok' AS valid FROM {o_latency}")
def latency_status(c):
    return telemetry.latency_rows(c.t.camera_messages).select("event_id", "device_ms", "latency_raw_ms", "latency_corrected_ms", "status", "valid")


@register(
    "latency_stats",
    """
    WITH v AS (SELECT event_type, 'raw' AS measure, raw::DOUBLE AS v FROM {o_latency} WHERE status IN ('ok', 'ntp_unavailable', 'clock_ahead') AND CASE WHEN offset_ms IS NOT NULL THEN cor >= 0 ELSE raw >= 0 END
               UNION ALL SELECT event_type, 'corrected', cor FROM {o_latency} WHERE status = 'ok')
    SELECT event_type, measure, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max FROM v GROUP BY ALL""",
)
def latency_stats(c):
    rows = telemetry.latency_rows(c.t.camera_messages)
    stats = telemetry.measure_stats(rows, ["event_type"], {
        "raw": F.when(F.col("raw_counts"), F.col("latency_raw_ms")), "corrected": F.when(F.col("valid"), F.col("latency_corrected_ms")),
    })
    return stats.select("event_type", "measure", "n", r("mean").alias("mean"), r("median").alias("median"), r("p95").alias("p95"), "max")


@register(
    "payload_check",
    """
    SELECT event_id, bytes, CASE WHEN img IS NULL THEN 'no_image' WHEN img = '%%%' THEN 'not_base64' WHEN img = 'AAAA' THEN 'not_jpeg' ELSE 'ok' END AS verdict FROM (
      SELECT event_id, img, CAST(CASE WHEN img = 'AAAA' THEN 3 WHEN img IS NOT NULL AND img <> '%%%' THEN 4 END AS INT) AS bytes FROM (
        SELECT event_id, CASE WHEN payload LIKE '{{%' THEN payload->>'$.image' END AS img FROM {camera_messages}) y) z""",
)
def payload_check(c):
    image = F.when(F.col("payload").rlike(r"^\{"), F.get_json_object("payload", "$.image"))
    rows = c.t.camera_messages.select("event_id", image.alias("img"), telemetry.decode_image(image).alias("blob"))
    verdict = (
        F.when(F.col("img").isNull(), "no_image").when(F.col("blob").isNull(), "not_base64").when(F.octet_length("blob") > C.MAX_IMAGE_BYTES, "too_large")
        .when(~telemetry.is_jpeg(F.col("blob")), "not_jpeg").otherwise("ok")
    )
    return rows.select("event_id", F.octet_length("blob").alias("bytes"), verdict.alias("verdict"))


STEPS_SQL["o_power"] = """
    SELECT *, coalesce(try_cast(payload->>'$.voltage_v' AS DOUBLE), try_cast(payload->>'$.voltage' AS DOUBLE)) AS voltage_v, coalesce(try_cast(payload->>'$.current_ma' AS DOUBLE), try_cast(payload->>'$.current_a' AS DOUBLE) * 1000) AS current_ma,
           coalesce(try_cast(payload->>'$.power_mw' AS DOUBLE), try_cast(payload->>'$.power_w' AS DOUBLE) * 1000) AS power_mw FROM {power_messages}"""


@register("power_fields", "SELECT event_id, voltage_v, current_ma, power_mw FROM {o_power}")
def power_fields(c):
    return telemetry.power_fields(c.t.power_messages).select("event_id", "voltage_v", "current_ma", "power_mw")


@register(
    "power_stats",
    """
    WITH a AS (SELECT *, received_ms - lag(received_ms) OVER (PARTITION BY event_type ORDER BY received_ms, event_id) AS ia FROM {o_power}),
    v AS (SELECT event_type, unnest(['power', 'current', 'voltage', 'inter_arrival']) AS measure, unnest([CASE WHEN current_ma IS NOT NULL THEN power_mw END, CASE WHEN current_ma IS NOT NULL THEN current_ma END, CASE WHEN current_ma IS NOT NULL THEN voltage_v END, ia::DOUBLE]) AS v FROM a)
    SELECT event_type, measure, count(v) AS n, round(avg(v), 5) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max, any_value(bad.n) AS invalid FROM v
    JOIN (SELECT event_type AS et, count(CASE WHEN current_ma IS NULL THEN 1 END) AS n FROM {o_power} GROUP BY event_type) bad ON bad.et = v.event_type GROUP BY event_type, measure""",
)
def power_stats(c):
    rows = telemetry.inter_arrival(telemetry.power_fields(c.t.power_messages), ["event_type"])
    complete = F.col("voltage_v").isNotNull() & F.col("current_ma").isNotNull() & F.col("power_mw").isNotNull()
    stats = telemetry.measure_stats(rows, ["event_type"], {
        "power": F.when(complete, F.col("power_mw")), "current": F.when(complete, F.col("current_ma")), "voltage": F.when(complete, F.col("voltage_v")), "inter_arrival": F.col("inter_arrival_ms"),
    })
    invalid = rows.groupBy("event_type").agg(F.count_if(~complete).alias("invalid"))
    return stats.join(invalid, "event_type").select("event_type", "measure", "n", r("mean", 5).alias("mean"), r("median").alias("median"), "min", "max", "invalid")


SAMPLES_SQL = "SELECT bus_id, event_id, ms AS t1, ms + 5 + passengers % 13 AS t2, ms + 6 + passengers % 17 AS t3, ms + 12 + passengers % 23 AS t4 FROM {readings}"


@register(
    "clock_offset",
    f"""
    WITH s AS (SELECT *, greatest(0.0::DOUBLE, ((t4 - t1) - (t3 - t2))::DOUBLE) AS rtt, ((t2 - t1) + (t3 - t4))::DOUBLE / 2 AS off FROM ({SAMPLES_SQL}) q WHERE t3 >= t2 AND (t4 - t1) - (t3 - t2) >= -0.001),
    n AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY rtt, event_id) AS rn, count(*) OVER (PARTITION BY bus_id) AS samples FROM s)
    SELECT bus_id, off AS "offset", rtt, samples FROM n WHERE rn = 1""",
)
def clock_offset(c):
    p = F.col("passengers")
    samples = c.t.readings.select("bus_id", "event_id", F.col("ms").alias("t1"), (F.col("ms") + 5 + p % 13).alias("t2"), (F.col("ms") + 6 + p % 17).alias("t3"), (F.col("ms") + 12 + p % 23).alias("t4"))
    return telemetry.clock_offsets(samples, "bus_id", "event_id")


# ---- smoothing -----------------------------------------------------------------------------------


@register(
    "rolling_median",
    """
    SELECT event_id, bus_id, idx, CAST(round_even(med, 0) AS BIGINT) AS median, CASE WHEN idx % 10 = 0 THEN round(mean, 6) END AS moving_mean FROM (
      SELECT event_id, bus_id, row_number() OVER w AS idx, quantile_cont(passengers, 0.5) OVER (PARTITION BY bus_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med,
             avg(passengers) OVER (PARTITION BY bus_id ORDER BY ms, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM {readings} WINDOW w AS (PARTITION BY bus_id ORDER BY ms, event_id)) x""",
)
def rolling_median(c):
    return telemetry.smoothed_counts(c.t.readings.select("event_id", "bus_id", "ms", "passengers"), "bus_id").select("event_id", "bus_id", "idx", "median", r("moving_mean").alias("moving_mean"))


THROTTLE_MS = 9 * 3600 * 1000


@register(
    "throttled_median",
    f"""
    WITH n AS (SELECT event_id, bus_id, ms, passengers, row_number() OVER w AS idx, quantile_cont(passengers, 0.5) OVER (PARTITION BY bus_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med FROM {{readings}} WINDOW w AS (PARTITION BY bus_id ORDER BY ms, event_id)),
    walk AS (SELECT bus_id, idx, ms, ms AS last FROM n WHERE idx = 1
             UNION ALL SELECT n.bus_id, n.idx, n.ms, CASE WHEN n.ms - w.last >= {THROTTLE_MS} THEN n.ms ELSE w.last END FROM walk w JOIN n ON n.bus_id = w.bus_id AND n.idx = w.idx + 1)
    SELECT n.event_id, n.bus_id, n.ms, CAST(round_even(n.med, 0) AS BIGINT) AS passengers FROM walk w JOIN n ON n.bus_id = w.bus_id AND n.idx = w.idx WHERE w.last = w.ms""",
)
def throttled_median(c):
    readings = c.t.readings.select("event_id", "bus_id", "ms", "passengers")
    passed = telemetry.throttled(readings, "bus_id", THROTTLE_MS).select("event_id")
    smooth = telemetry.smoothed_counts(readings, "bus_id")
    return smooth.join(passed, "event_id", "left_semi").select("event_id", "bus_id", "ms", F.col("median").alias("passengers"))


@register(
    "keep_last_n",
    "SELECT event_id, bus_id, row_number() OVER (PARTITION BY bus_id ORDER BY ms DESC, event_id DESC) <= 10 AS kept FROM {readings}",
)
def keep_last_n(c):
    return telemetry.keep_last(c.t.readings, "bus_id", 10).select("event_id", "bus_id", "kept")


# ---- chunks and detections -------------------------------------------------------------------------


@register(
    "chunk_assembly",
    """
    WITH k AS (SELECT *, total_len > 0 AND total_len <= 2097152 AND total_chunks = ceil(total_len / 512) AND chunk_index < total_chunks AND length(body) = least(512, total_len - chunk_index * 512) AS ok FROM {chunks}),
    fh AS (SELECT * FROM (SELECT frame_id, total_chunks AS tc, total_len AS tl, row_number() OVER (PARTITION BY frame_id ORDER BY seen, chunk_index, total_chunks, total_len, body) AS rn FROM k WHERE ok) x WHERE rn = 1),
    g AS (SELECT k.*, fh.tc, fh.tl, k.total_chunks = fh.tc AND k.total_len = fh.tl AS same FROM k JOIN fh ON fh.frame_id = k.frame_id WHERE k.ok),
    fb AS (SELECT frame_id, chunk_index, arg_min(body, struct_pack(s := seen, b := body)) AS body, min(seen) AS first_seen, count(*) AS n FROM g WHERE same GROUP BY ALL),
    br AS (SELECT g.frame_id, min(g.seen) AS at FROM g LEFT JOIN fb ON fb.frame_id = g.frame_id AND fb.chunk_index = g.chunk_index WHERE NOT g.same OR g.body <> fb.body GROUP BY g.frame_id),
    fr AS (SELECT fb.frame_id, count(*) AS present, max(first_seen) AS done_at, sum(n - 1) AS dup, string_agg(body, '' ORDER BY chunk_index) AS whole FROM fb GROUP BY fb.frame_id),
    iv AS (SELECT frame_id, count(*) AS invalid FROM k WHERE NOT ok GROUP BY frame_id),
    st AS (SELECT fr.*, fh.tc, CASE WHEN present = fh.tc AND (br.at IS NULL OR done_at < br.at) THEN 'completed' WHEN br.at IS NOT NULL THEN 'dropped' ELSE 'expired' END AS status FROM fr JOIN fh ON fh.frame_id = fr.frame_id LEFT JOIN br ON br.frame_id = fr.frame_id)
    SELECT coalesce(st.frame_id, iv.frame_id) AS frame_id, coalesce(st.status, 'invalid') AS status, coalesce(present, 0) AS present, CAST(tc AS INT) AS total_chunks, CAST(coalesce(dup, 0) AS BIGINT) AS duplicates, coalesce(invalid, 0) AS invalid,
           CASE WHEN status = 'completed' THEN sha256(whole) END AS digest FROM st FULL JOIN iv ON iv.frame_id = st.frame_id""".replace("AS at FROM g", "AS at_seen FROM g").replace("br.at ", "br.at_seen ").replace("br.at)", "br.at_seen)"),
)
def chunk_assembly(c):
    out = telemetry.assemble_chunks(c.t.chunks)
    return out.select("frame_id", "status", "present", "total_chunks", "duplicates", "invalid", F.sha2("body", 256).alias("digest"))


BOX_SQL = "CASE WHEN w <= 0 OR h <= 0 OR h / w < 0.2::DOUBLE THEN 'aspect' WHEN w * h / 307200 < {0}::DOUBLE THEN 'low_area' WHEN w * h / 307200 > 0.7::DOUBLE THEN 'high_area' ELSE 'ok' END"


@register(
    "box_filter",
    f"""
    SELECT image, count(*) AS raw, count(CASE WHEN v = 'ok' THEN 1 END) AS valid, count(CASE WHEN v = 'aspect' THEN 1 END) AS aspect_rejected, count(CASE WHEN v = 'low_area' THEN 1 END) AS low_area_rejected, count(CASE WHEN v = 'high_area' THEN 1 END) AS high_area_rejected
    FROM (SELECT image, {BOX_SQL.format(C.BOX_MIN_AREA)} AS v FROM {{detections}}) d GROUP BY image""",
)
def box_filter(c):
    return telemetry.box_counts(c.t.detections, 640, 480)


@register(
    "count_metrics",
    f"""
    WITH p AS (SELECT image, count(CASE WHEN {BOX_SQL.format(C.BOX_MIN_AREA)} = 'ok' THEN 1 END) AS predicted FROM {{detections}} GROUP BY image)
    SELECT image, predicted, actual, predicted - actual AS error, abs(predicted - actual) AS abs_error,
           round(CASE WHEN actual = 0 AND predicted = 0 THEN 100 WHEN actual = 0 THEN 0 ELSE (1 - abs(predicted - actual)::DOUBLE / actual) * 100 END, 6) AS accuracy, actual IS NULL AS missing_truth
    FROM (SELECT coalesce(t.image, p.image) AS image, coalesce(p.predicted, 0) AS predicted, t.actual FROM p FULL JOIN {{truth}} t ON t.image = p.image) j""",
)
def count_metrics(c):
    counts = telemetry.box_counts(c.t.detections, 640, 480).select("image", F.col("valid").alias("predicted"))
    return telemetry.count_metrics(counts, c.t.truth).drop("accuracy_bounded").withColumn("accuracy", r("accuracy"))


# Thresholds and input sizes of the whole sweep.
CONFS, SIZES = [0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50], [320, 416, 512, 640]
GRID_SQL = ", ".join(f"({t}::DOUBLE, {s})" for t in CONFS for s in SIZES)


@register(
    "sweep_summary",
    f"""
    WITH n AS (SELECT g.conf, g.imgsz, t.image, t.actual, count(CASE WHEN d.conf >= g.conf AND {BOX_SQL.format(C.BOX_MIN_AREA)} = 'ok' THEN 1 END) AS predicted
               FROM (SELECT * FROM {{truth}} t, (VALUES {GRID_SQL}) v(conf, imgsz)) g JOIN {{truth}} t ON t.image = g.image LEFT JOIN {{detections}} d ON d.image = g.image GROUP BY ALL),
    m AS (SELECT n.*, predicted - actual AS e, CASE WHEN actual = 0 AND predicted = 0 THEN 100 WHEN actual = 0 THEN 0 ELSE (1 - abs(predicted - actual)::DOUBLE / actual) * 100 END AS acc FROM n)
    SELECT conf, imgsz, images, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(ex, 6) AS exact_rate, round(acc, 6) AS mean_accuracy, round(accb, 6) AS mean_accuracy_bounded, row_number() OVER (ORDER BY round(mae, 9), round(ex, 9) DESC, conf, imgsz) AS place
    FROM (SELECT conf, imgsz, count(*) AS images, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(CASE WHEN e = 0 THEN 100 ELSE 0 END) AS ex, avg(acc) AS acc, avg(greatest(0, acc)) AS accb FROM m GROUP BY conf, imgsz) z""",
)
def sweep_summary(c):
    from pyspark.sql import Window

    out = telemetry.threshold_sweep(c.t.detections, c.t.truth, CONFS, SIZES, 640, 480)
    # One row per configuration: the ranking window holds the grid, not the images.
    place = F.row_number().over(Window.orderBy(F.round("mae", 9), F.desc(F.round("exact_rate", 9)), "conf", "imgsz")).cast("bigint")
    names = ["mae", "rmse", "exact_rate", "mean_accuracy", "mean_accuracy_bounded"]
    return out.withColumn("place", place).select("conf", "imgsz", "images", *[r(n).alias(n) for n in names], "place")


@register(
    "quality_flags",
    """
    SELECT doc_id, concat_ws('|', CASE WHEN n_chars % 100 < 30 THEN 'blurry' END, CASE WHEN n_chars % 256 < 25 THEN 'too_dark' END, CASE WHEN n_chars % 256 > 245 THEN 'too_bright' END, CASE WHEN n_chars % 60 < 10 THEN 'low_contrast' END) AS flags FROM {documents}""",
)
def quality_flags(c):
    n = F.col("n_chars")
    return c.t.documents.select("doc_id", telemetry.quality_flags(n % 100, n % 256, n % 60).alias("flags"))


@register(
    "label_audit",
    """
    WITH p AS (SELECT file, len(string_split(trim(line), ' ')) AS n, try_cast(string_split(line, ' ')[1] AS DOUBLE) AS cls, try_cast(string_split(line, ' ')[2] AS DOUBLE) AS x, try_cast(string_split(line, ' ')[3] AS DOUBLE) AS y,
                      try_cast(string_split(line, ' ')[4] AS DOUBLE) AS w, try_cast(string_split(line, ' ')[5] AS DOUBLE) AS h FROM {label_lines}),
    v AS (SELECT *, CASE WHEN n <> 5 THEN 'a' WHEN cls IS NULL OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'b' WHEN cls < 0 OR cls <> floor(cls) THEN 'c' WHEN x NOT BETWEEN 0 AND 1 OR y NOT BETWEEN 0 AND 1 OR w NOT BETWEEN 0 AND 1 OR h NOT BETWEEN 0 AND 1 THEN 'd' WHEN w <= 0 OR h <= 0 THEN 'e' END AS problem FROM p),
    g AS (SELECT v.file, count(CASE WHEN problem IS NULL AND cls = CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 0 ELSE 1 END THEN 1 END) AS objects, count(problem) AS broken FROM v JOIN {orders} ON v.file = concat('img-', CAST(o_orderkey AS VARCHAR)) GROUP BY v.file)
    SELECT concat('img-', CAST(o.o_orderkey AS VARCHAR)) AS file, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'valid' ELSE 'train' END AS split, coalesce(g.objects, 0) AS objects, coalesce(g.broken, 0) AS broken, g.file IS NULL AS missing,
           count(g.file) OVER (PARTITION BY CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'valid' ELSE 'train' END) AS split_labels
    FROM {orders} o LEFT JOIN g ON g.file = concat('img-', CAST(o.o_orderkey AS VARCHAR))""",
)
def label_audit(c):
    # One class list per data set (a region); "people" and "orang" are the only alias hits.
    place = F.floor(F.col("n_nationkey") / 5)
    person = F.when((F.col("n_regionkey") == 2) & (place == 0), " Orang").when((F.col("n_regionkey") != 2) & (place == 1), " People")
    names = c.t.nation.select(F.col("n_regionkey").alias("source"), place.alias("class_id"), F.coalesce(person, F.col("n_name")).alias("class_name"))
    target = readers.resolve_class(names)
    sets = c.t.orders.select(F.concat(F.lit("img-"), F.col("o_orderkey").cast("string")).alias("file"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("source"))
    parsed = readers.parse_labels(c.t.label_lines).join(sets, "file").join(target, "source")
    counts = readers.label_counts(parsed, F.col("class_id"))
    images = c.t.orders.select(F.concat(F.lit("img-"), F.col("o_orderkey").cast("string")).alias("file"), F.when(F.col("o_orderpriority") == "1-URGENT", "valid").otherwise("train").alias("split"))
    missing = readers.without_labels(images, counts).withColumn("missing", F.lit(True))
    joined = images.join(counts, "file", "left").join(missing, "file", "left").fillna({"objects": 0, "broken": 0, "missing": False})
    per_split = joined.groupBy("split").agg(F.count_if(~F.col("missing")).alias("split_labels"))
    return joined.join(per_split, "split").select("file", "split", "objects", "broken", "missing", "split_labels")


# ---- package checks and duplicates -----------------------------------------------------------------


@register(
    "table_delta",
    """
    SELECT id, name, brand FROM {static_rows} s WHERE NOT EXISTS (SELECT 1 FROM {live_rows} l WHERE l.id = s.id AND l.brand = s.brand) AND brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6')""",
)
def table_delta(c):
    only = [f"Brand#{n}" for n in range(1, 7)]
    fresh = quality.new_rows(c.t.static_rows, c.t.live_rows, ["id", "brand"], only, "brand")
    return fresh.select("id", "name", "brand")


@register(
    "id_consistency",
    """
    WITH a AS (SELECT DISTINCT CAST(size AS VARCHAR) AS id, 'package' AS t FROM {static_rows} UNION ALL SELECT DISTINCT CAST(size AS VARCHAR), 'live' FROM {live_rows})
    SELECT id, string_agg(t, ',' ORDER BY t) AS present_in FROM a GROUP BY id HAVING count(*) < 2""",
)
def id_consistency(c):
    return quality.id_differences({"package": c.t.static_rows, "live": c.t.live_rows}, "size")


@register(
    "table_diff",
    """
    SELECT s.id, CASE WHEN s.price <> l.price THEN 'price' ELSE '' END AS differing, abs(s.price - l.price) > 0.000001::DOUBLE AS drifted FROM {static_rows} s JOIN {live_rows} l ON l.id = s.id""",
)
def table_diff(c):
    collisions = quality.key_collisions(c.t.static_rows, c.t.live_rows, ["id"])
    drift = quality.value_drift(c.t.static_rows, c.t.live_rows, ["id"], "price").select("id", F.lit(True).alias("drifted"))
    return collisions.join(drift, "id", "left").fillna({"drifted": False})


@register("schema_diff")
def schema_diff(c):
    changed = c.t.live_rows.drop("size").withColumn("price", F.col("price").cast("string")).withColumn("note", F.lit(""))
    return quality.schema_differences(c.t.static_rows, changed)


@register(
    "exact_dup",
    """
    SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept_id, count(*) OVER (PARTITION BY sha256(text)) AS copies, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'kept' ELSE 'exact_duplicate' END AS status FROM {documents}""",
)
def exact_dup(c):
    return quality.exact_duplicates(c.t.documents, "doc_id", "text").select("doc_id", "digest", "kept_id", "copies", "status")


NEAR_BITS, NEAR_WINDOW = 16, 30


@register(
    "near_dup",
    f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[64]::DOUBLE[] AS e FROM {{embeddings}}),
    m AS (SELECT vec_id, e, list_median(e[2:64]) AS med FROM v),
    b AS (SELECT row_number() OVER (ORDER BY vec_id) AS idx, vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > med THEN '1' ELSE '0' END), '')::BIT AS h FROM m),
    walk AS (SELECT 0::BIGINT AS idx, NULL::BIGINT AS vec_id, NULL::BIGINT AS bits, NULL::BIGINT AS similar_to, []::STRUCT(h BIT, id BIGINT)[] AS recent
      UNION ALL
      SELECT idx, vec_id, n.bits, n.similar_to, CASE WHEN n.bits IS NOT NULL THEN recent ELSE list_append(recent, struct_pack(h := h, id := vec_id))[-{NEAR_WINDOW}:] END FROM (
        SELECT b.idx, b.vec_id, b.h, w.recent, list_min(list_filter(list_transform(w.recent, lambda k, i: struct_pack(bits := bit_count(xor(b.h, k.h))::BIGINT, rank := i, similar_to := k.id)), lambda s: s.bits <= {NEAR_BITS})) AS n FROM walk w JOIN b ON b.idx = w.idx + 1) z)
    SELECT vec_id, CASE WHEN bits IS NULL THEN 'kept' ELSE 'near_duplicate' END AS status, similar_to, CAST(bits AS INT) AS bits FROM walk WHERE idx > 0""",
)
def near_dup(c):
    vector = F.transform("embedding", lambda x: x.cast("double"))
    hashed = c.t.embeddings.select("vec_id", quality.sign_hash(vector).alias("h")).select("vec_id", "h.high", "h.low")
    return quality.near_duplicates(hashed, "vec_id", "high", "low", NEAR_BITS, NEAR_WINDOW)


@register("gtfs_csv_roundtrip")
def gtfs_csv_roundtrip(c):
    import uuid

    base = f"{step_folder(c.spark)}/feed-{uuid.uuid4().hex}"
    sinks.write_csv(c.t.feed_stop_times, f"{base}/stop_times", ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "pickup_type"])
    sinks.write_json(c.t.feed_trips.groupBy("route_id").agg(F.count(F.lit(1)).alias("trips")), f"{base}/summary")
    back = readers.read_feed(c.spark, f"{base}/stop_times", "trip_id STRING, stop_sequence INT, stop_id STRING, arrival_time STRING, departure_time STRING, pickup_type STRING")
    summary = c.spark.read.schema("route_id STRING, trips BIGINT").json(f"{base}/summary")
    return back.join(c.t.feed_trips.select("trip_id", "route_id"), "trip_id").join(summary, "route_id")


@register(
    "media_scan",
    """
    WITH d AS (SELECT coalesce(lang, 'none') AS lang, CASE doc_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' ELSE 'txt' END AS extension, strlen(coalesce(text, '')) AS n FROM {documents})
    SELECT m.lang, extension, bytes, labels FROM (SELECT lang, extension, CAST(sum(2 * n + 2) AS BIGINT) AS bytes FROM d WHERE extension <> 'txt' GROUP BY ALL) m
    JOIN (SELECT lang, count(*) AS labels FROM d WHERE extension = 'txt' GROUP BY lang) l ON l.lang = m.lang
    UNION ALL
    SELECT lang, extension, CAST(sum(2 * n + 2) AS BIGINT), 0 FROM d WHERE extension <> 'txt' AND lang NOT IN (SELECT lang FROM d WHERE extension = 'txt') GROUP BY ALL""",
)
def media_scan(c):
    """Bytes of the media files per folder and extension, and the lines of the label files beside them.

    The folders are written from ``documents``: per language the texts of a third each as ``jpg``, ``PNG`` and label lines (``txt``).
    """
    import uuid

    base = f"{step_folder(c.spark)}/media-{uuid.uuid4().hex}"
    line = F.concat(F.lit("x"), F.hex(F.coalesce("text", F.lit(""))))
    for part, extension in enumerate(("jpg", "PNG", "txt")):
        rows = c.t.documents.filter(F.col("doc_id") % 3 == part).select(F.coalesce("lang", F.lit("none")).alias("lang"), line.alias("line"))
        rows.write.partitionBy("lang").option("extension", extension).mode("append").csv(base)
    folder, extension = F.regexp_extract("path", r"lang=([^/]+)/", 1), F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    sizes = readers.media_files(c.spark, base).groupBy(folder.alias("lang"), extension.alias("extension")).agg(F.sum("length").alias("bytes"))
    lines = c.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").schema("line STRING").text(base).select(F.col("_metadata.file_path").alias("path"))
    labels = lines.groupBy(folder.alias("lang")).agg(F.count(F.lit(1)).alias("labels"))
    return sizes.join(labels, "lang", "left").select("lang", "extension", "bytes", F.coalesce("labels", F.lit(0)).alias("labels"))


@register("latest_file")
def latest_file(c):
    import uuid

    base = f"{step_folder(c.spark)}/results-{uuid.uuid4().hex}"
    for attempt in ("first", "second"):
        rows = c.t.orders.select(F.col("o_orderpriority").alias("period"), F.col("o_orderstatus").alias("kind"), "o_orderkey", "o_totalprice")
        rows.repartition("period", "kind").write.partitionBy("period", "kind").mode("append").json(f"{base}/{attempt}")
    found = readers.newest_file(c.spark, base, F.regexp_extract("path", r"period=([^/]+)", 1), F.regexp_extract("path", r"kind=([^/]+)", 1))
    return found.select("period", "kind", F.regexp_extract("path", r"/(first|second)/", 1).alias("attempt"))
