"""Queries on timetable preparation and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom import constants as C
from transitloom.functions.scalar import normal_id, service_seconds, service_text
from transitloom.operators import audit, timetable
from transitloom.plans.base import TIMES_SQL, norm_sql, r, register, sec_sql


@register(
    "service_time",
    f"""
    SELECT trip_id, stop_sequence, arr, dep,
           CASE WHEN dep IS NULL THEN NULL ELSE concat(lpad(CAST((dep % 86400) // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST((dep % 3600) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(dep % 60 AS VARCHAR), 2, '0')) END AS dep_text
    FROM (SELECT trip_id, stop_sequence, {sec_sql('arrival_time')} AS arr, {sec_sql('departure_time')} + 72000 AS dep FROM {{feed_stop_times}}) x""",
)
def service_time(c):
    dep = service_seconds(F.col("departure_time")) + 72000
    return c.t.feed_stop_times.select(
        "trip_id", "stop_sequence", service_seconds(F.col("arrival_time")).alias("arr"), dep.alias("dep"),
        F.when(dep.isNotNull(), service_text(dep)).alias("dep_text"),
    )


@register(
    "freq_clean",
    """
    SELECT trip_id, start_sec, end_sec, headway,
           CASE WHEN corridor_id = '' THEN 'unknown_trip' WHEN start_sec IS NULL OR end_sec IS NULL OR headway IS NULL THEN 'invalid_value'
                WHEN headway <= 0 OR end_sec <= start_sec THEN 'invalid_range' ELSE 'ok' END AS verdict
    FROM {o_freq}""",
)
def freq_clean(c):
    return timetable.check_frequencies(c.t.frequencies, c.t.trips).select("trip_id", "start_sec", "end_sec", "headway", "verdict")


FEED_TEMPLATE = f"""
    SELECT st.trip_id, st.stop_sequence AS seq, st.stop_id, {sec_sql('st.arrival_time')} AS arr, {sec_sql('st.departure_time')} AS dep
    FROM {{feed_stop_times}} st JOIN {{stops}} s ON st.stop_id = s.stop_id"""


@register(
    "template_stops",
    f"""
    SELECT trip_id, seq, stop_id, arr, dep FROM ({FEED_TEMPLATE}) x WHERE trip_id IN (
      SELECT trip_id FROM ({FEED_TEMPLATE}) y GROUP BY trip_id HAVING count(*) >= 2 AND count(*) = count(arr + dep))""",
)
def template_stops(c):
    return timetable.template_stops(c.t.feed_stop_times, c.t.stops).select("trip_id", "seq", "stop_id", "arr", "dep")


@register(
    "hop_times",
    f"""
    WITH hops AS (
      SELECT {norm_sql('t.route_id')} AS corridor_id, h.from_stop, h.to_stop, h.secs, t.o_orderkey, h.seq FROM (
        SELECT trip_id, stop_sequence AS seq, stop_id AS from_stop, lead(stop_id) OVER w AS to_stop,
               lead({sec_sql('arrival_time')}) OVER w - {sec_sql('departure_time')} AS secs
        FROM {{feed_stop_times}} WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) h
      JOIN {{feed_trips}} t ON t.trip_id = h.trip_id WHERE to_stop IS NOT NULL AND secs > 0)
    SELECT p.corridor_id, p.from_stop, p.to_stop, p.first_secs, m.mean_secs, p.trips FROM (
      SELECT corridor_id, from_stop, to_stop, arg_min(secs, o_orderkey * 1000 + seq) AS first_secs, count(*) AS trips FROM hops GROUP BY ALL) p
    JOIN (SELECT corridor_id, CAST(round_even(avg(secs), 0) AS INT) AS mean_secs FROM hops GROUP BY corridor_id) m ON p.corridor_id = m.corridor_id""",
)
def hop_times(c):
    return timetable.hop_times(c.t.feed_stop_times, c.t.feed_trips, "o_orderkey")


@register(
    "segment_match",
    """
    SELECT trip_id, corridor_id, CAST(matched AS BIGINT) AS matched, CAST(pairs AS BIGINT) AS pairs, CAST(pairs - matched AS BIGINT) AS missing,
           matched = 0 AS used_fallback, round(match_ratio, 6) AS match_ratio FROM {o_summary}""",
)
def segment_match(c):
    return timetable.match_summary(c.matched).select(
        "trip_id", "corridor_id", "matched", "pairs", "missing", "used_fallback", r("match_ratio").alias("match_ratio")
    )


@register(
    "service_patterns",
    """
    SELECT corridor_id, direction_id, trip_id, start_sec, end_sec, headway, CAST(raw_rows AS BIGINT) AS raw_rows, CAST(stop_count AS INT) AS stop_count,
           duration, round(match_ratio, 6) AS match_ratio, array_to_string(signature, '>') AS stops FROM {o_patterns}""",
)
def service_patterns(c):
    return c.patterns.select(
        "corridor_id", "direction_id", "trip_id", "start_sec", "end_sec", "headway", "raw_rows", "stop_count", "duration",
        r("match_ratio").alias("match_ratio"), F.array_join("signature", ">").alias("stops"),
    )


@register(
    "pattern_overlap",
    """
    SELECT short, long, round(overlap, 6) AS overlap,
           CASE WHEN len(sa)::DOUBLE / len(sb) < 0.8 THEN 'kept_separate_as_possible_subroute'
                WHEN sa[1] = sb[1] AND sa[len(sa)] = sb[len(sb)] THEN 'duplicate_mergeable' ELSE 'kept_separate_different_endpoints' END AS decision
    FROM {o_overlap}""",
)
def pattern_overlap(c):
    pairs = timetable.overlapping_signatures(c.patterns)
    return pairs.select(
        "short", "long", r("overlap").alias("overlap"),
        timetable.relate(F.col("sig_short"), F.col("sig_long"), F.col("overlap")).alias("decision"),
    )


@register(
    "merge_patterns",
    """
    SELECT b.group_id, b.corridor_id, b.direction_id, b.trip_id AS rep_trip, b.headway AS rep_headway, b.service_headway, CAST(b.members AS BIGINT) AS members,
           (SELECT string_agg(h, ',' ORDER BY CAST(h AS INT)) FROM (SELECT DISTINCT CAST(headway AS VARCHAR) AS h FROM {o_ranked} m WHERE m.group_id = b.group_id) hh) AS headways,
           CASE WHEN b.members = 1 THEN 'only pattern in overlap group'
                WHEN b.match_ratio > (SELECT min(match_ratio) FROM {o_ranked} m WHERE m.group_id = b.group_id) THEN 'selected because highest segment_match_ratio'
                WHEN b.stop_count > (SELECT min(stop_count) FROM {o_ranked} m WHERE m.group_id = b.group_id AND m.match_ratio = b.match_ratio) THEN 'selected because same match ratio but highest stop_count'
                WHEN b.headway < (SELECT max(headway) FROM {o_ranked} m WHERE m.group_id = b.group_id AND m.match_ratio = b.match_ratio AND m.stop_count = b.stop_count) THEN 'selected because same match ratio/stop_count but lower headway_secs'
                WHEN b.duration > (SELECT min(duration) FROM {o_ranked} m WHERE m.group_id = b.group_id AND m.match_ratio = b.match_ratio AND m.stop_count = b.stop_count AND m.headway = b.headway) THEN 'selected because same match/headway but longest trip_duration_seconds'
                ELSE 'selected by deterministic trip_id tie-break' END AS reason
    FROM {o_ranked} b WHERE b.preference = 1""",
)
def merge_patterns(c):
    return timetable.merge_groups(c.ranked).select(
        "group_id", "corridor_id", "direction_id", "rep_trip", "rep_headway", "service_headway", "members",
        F.array_join(F.transform("member_headways", lambda h: h.cast("string")), ",").alias("headways"), "reason",
    )


@register(
    "trip_instances",
    "SELECT instance_id, corridor_id, direction_id, trip_id, departure, first_dep, last_arr FROM {o_instances}",
)
def trip_instances(c):
    return c.instances.select("instance_id", "corridor_id", "direction_id", "trip_id", "departure", "first_dep", "last_arr")


@register(
    "generation_audit",
    f"""
    WITH active AS (
      SELECT corridor_id, direction_id, time, count(*) AS n FROM {{o_instances}} JOIN {TIMES_SQL} ON first_dep <= second AND second < last_arr GROUP BY ALL),
    pre AS (SELECT corridor_id, direction_id, sum(raw_rows) AS raw_rows, count(*) AS patterns,
                   sum(CAST(ceil((end_sec - start_sec) / headway) AS BIGINT)) AS departures_before FROM {{o_patterns}} GROUP BY ALL),
    gen AS (SELECT corridor_id, direction_id, count(*) AS instances FROM {{o_instances}} GROUP BY ALL),
    sel AS (SELECT corridor_id, direction_id, count(*) AS selected, max(duration::DOUBLE / service_headway) AS top_active FROM {{o_selected}} GROUP BY ALL)
    SELECT p.corridor_id, p.direction_id, CAST(p.raw_rows AS BIGINT) AS raw_rows, p.patterns, s.selected, coalesce(g.instances, 0) AS instances,
           CAST(p.departures_before AS BIGINT) AS departures_before, round(s.top_active, 6) AS top_active,
           {', '.join(f"coalesce((SELECT n FROM active a WHERE a.corridor_id = p.corridor_id AND a.direction_id = p.direction_id AND a.time = '{t}'), 0) AS active_{t}" for t, _ in C.SAMPLE_TIMES)}
    FROM pre p LEFT JOIN sel s ON s.corridor_id = p.corridor_id AND s.direction_id = p.direction_id
    LEFT JOIN gen g ON g.corridor_id = p.corridor_id AND g.direction_id = p.direction_id""",
)
def generation_audit(c):
    return audit.generation_audit(c.patterns, c.selected, c.instances)


@register(
    "merge_warnings",
    f"""
    WITH b AS (SELECT * FROM {{o_ranked}} WHERE preference = 1),
    est AS (SELECT corridor_id, direction_id, sum(duration::DOUBLE / headway) AS before_est FROM {{o_patterns}} GROUP BY ALL),
    aft AS (SELECT corridor_id, direction_id, sum(duration::DOUBLE / service_headway) AS after_est, count(*) AS n FROM b GROUP BY ALL),
    grp AS (SELECT b.group_id, b.corridor_id, b.direction_id, b.trip_id, b.match_ratio, b.stop_count,
                   max(CASE WHEN m.pattern_id <> b.pattern_id THEN m.stop_count END) AS max_disc,
                   count(CASE WHEN m.pattern_id <> b.pattern_id AND m.match_ratio > b.match_ratio + 0.05::DOUBLE THEN 1 END) AS better
            FROM b JOIN {{o_ranked}} m ON m.group_id = b.group_id GROUP BY ALL),
    act AS (SELECT time, count(instance_id) AS n FROM {TIMES_SQL} LEFT JOIN {{o_instances}} ON first_dep <= second AND second < last_arr GROUP BY time)
    SELECT 'zero_selected_representative_patterns' AS rule, concat(e.corridor_id, '/', e.direction_id) AS subject, 0.0::DOUBLE AS value
      FROM est e LEFT JOIN aft a USING (corridor_id, direction_id) WHERE a.n IS NULL
    UNION ALL SELECT 'active_trip_instances_drop_gt_80pct_estimated', concat(e.corridor_id, '/', e.direction_id), round(coalesce(after_est, 0) / before_est, 6)
      FROM est e LEFT JOIN aft a USING (corridor_id, direction_id) WHERE before_est > 0 AND coalesce(after_est, 0) / before_est < 0.2::DOUBLE
    UNION ALL SELECT 'selected_representative_low_segment_match_ratio', trip_id, round(match_ratio, 6) FROM grp WHERE match_ratio < 0.8::DOUBLE
    UNION ALL SELECT 'selected_representative_shorter_than_discarded', trip_id, stop_count::DOUBLE FROM grp WHERE stop_count < max_disc * 0.75::DOUBLE
    UNION ALL SELECT 'discarded_pattern_has_better_segment_match_ratio', trip_id, better::DOUBLE FROM grp WHERE better > 0
    UNION ALL SELECT 'total_active_trip_instances_outside_sanity_range', time, n::DOUBLE FROM act WHERE n < 40 OR n > 180""",
)
def merge_warnings(c):
    return audit.merge_warnings(c.patterns, c.ranked, c.instances).withColumn("value", r("value"))


@register(
    "mainline_trips",
    f"""
    WITH cand AS (
      SELECT {norm_sql('route_id')} AS corridor_id, direction_id, trip_id, lower(trim(short_name)) AS short, o_orderkey,
             CASE WHEN short_name NOT LIKE '% via %' THEN 0 ELSE 1 END AS tier FROM {{feed_trips}}),
    best AS (SELECT *, min(tier) OVER (PARTITION BY corridor_id) AS best_tier FROM cand)
    SELECT corridor_id, direction_id, trip_id, short FROM (
      SELECT *, row_number() OVER (PARTITION BY corridor_id, direction_id
               ORDER BY CASE WHEN short = concat('line ', corridor_id) THEN 0 ELSE 1 END, length(short), o_orderkey) AS rn
      FROM best WHERE tier = best_tier) z WHERE rn = 1""",
)
def mainline_trips(c):
    trips = c.t.feed_trips.withColumn("corridor_id", normal_id(F.col("route_id")))
    return timetable.mainline_trips(
        trips, long_name=F.concat(F.lit("line "), F.col("corridor_id")), plain=[~F.col("short_name").contains(" via ")], order="o_orderkey"
    ).select("corridor_id", "direction_id", "trip_id", F.lower(F.trim("short_name")).alias("short"))


@register(
    "corridor_stops",
    f"""
    SELECT corridor_id, stop_id, CAST(row_number() OVER (PARTITION BY corridor_id ORDER BY first_seen) AS BIGINT) AS seq FROM (
      SELECT {norm_sql('t.route_id')} AS corridor_id, s.stop_id, min(t.o_orderkey * 1000 + s.stop_sequence) AS first_seen
      FROM {{feed_trips}} t JOIN {{feed_stop_times}} s ON t.trip_id = s.trip_id GROUP BY ALL) f""",
)
def corridor_stops(c):
    return timetable.corridor_stop_order(
        c.t.feed_trips.withColumn("corridor_id", normal_id(F.col("route_id"))), c.t.feed_stop_times, "o_orderkey"
    )


STATES_SQL = f"""
    SELECT time, corridor_id, direction_id, instance_id, departure, (pos - 1 + (second - dep)::DOUBLE / (next_arr - dep)) / pairs * 100 AS progress,
           lat + (to_lat - lat) * ((second - dep)::DOUBLE / (next_arr - dep)) AS lat, lng + (to_lng - lng) * ((second - dep)::DOUBLE / (next_arr - dep)) AS lng
    FROM {{o_ihops}} JOIN {TIMES_SQL} ON dep <= second AND second < next_arr
    UNION ALL
    SELECT time, corridor_id, direction_id, instance_id, departure, (pos - 1)::DOUBLE / pairs * 100, lat, lng
    FROM {{o_ihops}} JOIN {TIMES_SQL} ON arr <= second AND second < dep WHERE pos > 1"""


@register(
    "spacing_audit",
    f"""
    WITH st AS ({STATES_SQL}),
    gaps AS (
      SELECT *, progress - lag(progress) OVER w AS pg, abs(departure - lag(departure) OVER w) AS dg, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng
      FROM st WINDOW w AS (PARTITION BY time, corridor_id, direction_id ORDER BY progress, departure, instance_id)),
    g AS (SELECT *, 2 * 6371000 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2))) AS mg FROM gaps)
    SELECT time, corridor_id, direction_id, count(*) AS active, round(min(pg), 5) AS min_progress_gap, round(median(pg), 5) AS median_progress_gap,
           min(dg) AS min_departure_gap, median(dg)::DOUBLE AS median_departure_gap, round(min(mg), 3) AS min_distance_gap, round(median(mg), 3) AS median_distance_gap,
           count(CASE WHEN pg < 1.0::DOUBLE THEN 1 END) AS close_progress, count(CASE WHEN dg < 120 THEN 1 END) AS close_departure
    FROM g GROUP BY ALL""",
)
def spacing_audit(c):
    from transitloom.operators.lookup import vehicle_states

    summary = audit.spacing_summary(audit.spacing_gaps(vehicle_states(c.visits, c.hops, C.SAMPLE_TIMES)))
    for name, digits in [("min_progress_gap", 5), ("median_progress_gap", 5), ("min_distance_gap", 3), ("median_distance_gap", 3)]:
        summary = summary.withColumn(name, r(name, digits))
    return summary


@register(
    "top_contributors",
    """
    SELECT corridor_id, direction_id, trip_id, service_headway, duration, round(duration::DOUBLE / service_headway, 6) AS estimated_active, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY corridor_id, direction_id ORDER BY duration::DOUBLE / service_headway DESC, service_headway, trip_id) AS rank FROM {o_selected}) x WHERE rank <= 10""",
)
def top_contributors(c):
    return audit.top_contributors(c.selected).select(
        "corridor_id", "direction_id", "trip_id", "service_headway", "duration", r("estimated_active").alias("estimated_active"), "rank"
    )


@register(
    "closest_pairs",
    f"""
    WITH st AS ({STATES_SQL}),
    g AS (SELECT time, corridor_id, direction_id, instance_id, lag(instance_id) OVER w AS behind, progress - lag(progress) OVER w AS pg, abs(departure - lag(departure) OVER w) AS dg
          FROM st WINDOW w AS (PARTITION BY time, corridor_id, direction_id ORDER BY progress, departure, instance_id))
    SELECT time, corridor_id, direction_id, behind, instance_id, round(pg, 5) AS progress_gap, dg AS departure_gap FROM (
      SELECT *, row_number() OVER (PARTITION BY time, corridor_id, direction_id ORDER BY round(pg, 9), dg, instance_id) AS rn FROM g WHERE behind IS NOT NULL) z WHERE rn <= 5""",
)
def closest_pairs(c):
    from transitloom.operators.lookup import vehicle_states

    gaps = audit.spacing_gaps(vehicle_states(c.visits, c.hops, C.SAMPLE_TIMES))
    return audit.closest_pairs(gaps).select("time", "corridor_id", "direction_id", "behind", "instance_id", r("progress_gap", 5).alias("progress_gap"), "departure_gap")
