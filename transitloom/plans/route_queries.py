"""Queries on routes: stored routes (every order is a route) and searches on the bound network."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from transitloom import constants as C
from transitloom.functions.scalar import clock_text, density_class, kilometres, minutes, rupiah
from transitloom.operators import choice, demand, network, resample, routes, scenario
from transitloom.plans.base import RUN_ID, SERVICE_DATE, STEPS_SQL, dist_sql, r, register

EDGE_SQL = "concat_ws('~', from_stop, to_stop, kind, coalesce(segment_id, ''), corridor_id)"

STEPS_SQL["o_totals"] = f"""
    SELECT od_id, candidate, CAST(sum(secs) AS BIGINT) AS secs, sum(meters) AS meters, count(CASE WHEN kind = 'transit' THEN 1 END) AS transfers,
           count(CASE WHEN kind = 'segmen' THEN 1 END) AS rides, coalesce(avg(CASE WHEN kind = 'segmen' THEN density END), 0) AS density,
           list(corridor_id ORDER BY pos) FILTER (kind = 'segmen') AS corridors,
           concat(arg_min(from_stop, pos), ' -> ', string_agg(to_stop, ' -> ' ORDER BY pos)) AS route_text,
           string_agg({EDGE_SQL}, '|' ORDER BY pos) AS signature
    FROM {{route_steps}} GROUP BY od_id, candidate"""
STEPS_SQL["o_runs"] = """
    SELECT od_id, candidate, list(corridor_id ORDER BY pos) AS runs FROM (
      SELECT *, lag(corridor_id) OVER (PARTITION BY od_id, candidate ORDER BY pos) AS before FROM {route_steps} WHERE kind = 'segmen') z
    WHERE before IS NULL OR before <> corridor_id GROUP BY od_id, candidate"""
STEPS_SQL["o_scored"] = """
    SELECT t.*, 0.3::DOUBLE * tn + 0.2::DOUBLE * dn + 0.3::DOUBLE * least(transfers / 12, 1.0::DOUBLE) + 0.2::DOUBLE * least(greatest(density, 0.0::DOUBLE), 1.0::DOUBLE) AS primary_score
    FROM (SELECT *, CASE WHEN max(secs) OVER w - min(secs) OVER w <= 0 THEN 0.0::DOUBLE ELSE (secs - min(secs) OVER w)::DOUBLE / (max(secs) OVER w - min(secs) OVER w) END AS tn,
                 CASE WHEN max(meters) OVER w - min(meters) OVER w <= 1e-9::DOUBLE THEN 0.0::DOUBLE ELSE (meters - min(meters) OVER w) / (max(meters) OVER w - min(meters) OVER w) END AS dn
          FROM {o_totals} WINDOW w AS (PARTITION BY od_id)) t"""


def stored_totals(c):
    steps, totals = c.t.route_steps, c.route_totals
    edge = F.concat_ws("~", "from_stop", "to_stop", "kind", F.coalesce("segment_id", F.lit("")), "corridor_id")
    signatures = steps.groupBy("od_id", "candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", edge.alias("e")))), lambda x: x["e"]).alias("path"))
    return totals.join(signatures, ["od_id", "candidate"]).withColumn("signature", F.array_join("path", "|"))


@register(
    "route_signature",
    """
    SELECT t.od_id, t.candidate, t.signature, t.route_text, coalesce(array_to_string(r.runs, '>'), '') AS corridor_runs,
           len(coalesce(r.runs, [])) <> len(list_distinct(coalesce(r.runs, []))) AS revisits,
           coalesce((SELECT string_agg(s.segment_id, ',' ORDER BY s.pos) FROM {route_steps} s WHERE s.candidate = t.candidate AND s.kind = 'segmen'), '') AS segments
    FROM {o_totals} t LEFT JOIN {o_runs} r ON r.candidate = t.candidate""",
)
def route_signature(c):
    from transitloom.functions.sequences import revisits

    t = stored_totals(c)
    segments = F.transform(routes.ridden(F.col("path")), lambda e: F.get(F.split(e, "~"), F.lit(3)))
    return t.select(
        "od_id", "candidate", "signature", "route_text", F.array_join("runs", ">").alias("corridor_runs"), revisits(F.col("corridors")).alias("revisits"),
        F.array_join(segments, ",").alias("segments"),
    )


@register(
    "path_valid",
    """
    WITH p AS (SELECT *, lag(to_stop) OVER w AS pt, lag(kind) OVER w AS pk, lag(corridor_id) OVER w AS pc, row_number() OVER w AS n, count(*) OVER (PARTITION BY candidate) AS total
               FROM {route_steps} WINDOW w AS (PARTITION BY candidate ORDER BY pos)),
    f AS (SELECT od_id, candidate, max(CASE WHEN n > 1 AND pt <> from_stop THEN 1 ELSE 0 END) AS broken, max(CASE WHEN n = 1 AND kind = 'transit' THEN 1 ELSE 0 END) AS st,
                 max(CASE WHEN pk = 'transit' AND kind = 'transit' THEN 1 ELSE 0 END) AS dbl, max(CASE WHEN n > 1 AND kind = 'transit' AND pc = corridor_id THEN 1 ELSE 0 END) AS idle,
                 max(CASE WHEN n > 1 AND kind = 'segmen' AND pc <> corridor_id THEN 1 ELSE 0 END) AS jump, max(CASE WHEN n = total AND kind = 'transit' THEN 1 ELSE 0 END) AS fin FROM p GROUP BY ALL)
    SELECT od_id, candidate, CASE WHEN broken = 1 THEN 'not_continuous' WHEN st = 1 THEN 'starts_with_transfer' WHEN dbl = 1 THEN 'double_transfer' WHEN idle = 1 THEN 'transfer_to_same_corridor'
           WHEN jump = 1 THEN 'corridor_change_without_transfer' WHEN fin = 1 THEN 'ends_with_transfer' ELSE 'ok' END AS verdict FROM f""",
)
def path_valid(c):
    return stored_totals(c).select("od_id", "candidate", routes.path_verdict(F.col("path")).alias("verdict"))


@register(
    "route_metrics",
    f"""
    SELECT s.od_id, s.candidate, round(sum(s.secs) / 60, 3) AS minutes, round(sum(CASE WHEN s.kind = 'segmen' THEN {dist_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} ELSE 0 END), 2) AS meters,
           count(CASE WHEN s.kind = 'transit' THEN 1 END) AS transfers
    FROM {{route_steps}} s JOIN {{stops}} a ON a.stop_id = s.from_stop JOIN {{stops}} b ON b.stop_id = s.to_stop GROUP BY ALL""",
)
def route_metrics(c):
    from transitloom.functions.geo import distance_m

    at = lambda p: c.t.stops.select(F.col("stop_id").alias(f"{p}_stop"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    meters = distance_m(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"), F.col("to_lng"))
    steps = c.t.route_steps.join(at("from"), "from_stop").join(at("to"), "to_stop")
    return steps.groupBy("od_id", "candidate").agg(
        r(F.sum("secs") / 60, 3).alias("minutes"), r(F.sum(F.when(F.col("kind") == "segmen", meters).otherwise(0.0)), 2).alias("meters"),
        F.count_if(F.col("kind") == "transit").alias("transfers"),
    )


@register(
    "route_legs",
    """
    WITH f AS (SELECT *, CASE WHEN kind = 'transit' OR coalesce(lag(kind) OVER w, 'transit') = 'transit' OR lag(corridor_id) OVER w <> corridor_id THEN 1 ELSE 0 END AS fresh
               FROM {route_steps} WINDOW w AS (PARTITION BY candidate ORDER BY pos)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY candidate ORDER BY pos) AS leg FROM f),
    l AS (SELECT od_id, candidate, CAST(leg AS BIGINT) AS leg, any_value(kind) AS kind, any_value(corridor_id) AS corridor_id, arg_min(from_stop, pos) AS board_stop, arg_max(to_stop, pos) AS alight_stop,
                 round(avg(density), 6) AS density, CAST(sum(secs) AS BIGINT) AS secs, round(sum(meters), 4) AS meters, count(*) AS segments FROM g GROUP BY od_id, candidate, leg)
    SELECT *, CASE WHEN kind = 'transit' THEN last_value(CASE WHEN kind = 'segmen' THEN corridor_id END IGNORE NULLS) OVER (PARTITION BY candidate ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS from_corridor FROM l""",
)
def route_legs(c):
    legs = routes.route_legs(c.t.route_steps).drop("rounded_min")
    return legs.withColumn("density", r("density")).withColumn("meters", r("meters", 4))


@register(
    "primary_rank",
    """
    SELECT od_id, candidate, round(tn, 6) AS time_norm, round(dn, 6) AS distance_norm, round(primary_score, 6) AS primary_score,
           row_number() OVER (PARTITION BY od_id ORDER BY round(primary_score, 9), candidate) AS primary_rank FROM {o_scored}""",
)
def primary_rank(c):
    return c.ranked_routes.select("od_id", "candidate", r("time_norm").alias("time_norm"), r("distance_norm").alias("distance_norm"), r("primary_score").alias("primary_score"), "primary_rank")


@register(
    "rerank",
    """
    WITH m AS (SELECT *, secs::DOUBLE / 60 AS minutes, min(secs::DOUBLE / 60) OVER w + 15 AS tcap, min(meters) OVER w + 3000 AS dcap FROM {o_scored} WINDOW w AS (PARTITION BY od_id)),
    k AS (SELECT *, minutes <= tcap AND meters <= dcap AS within_cap, CASE WHEN density < 0.5::DOUBLE THEN 0 WHEN density < 0.8::DOUBLE THEN 1 WHEN density < 1.0::DOUBLE THEN 2 ELSE 3 END AS class_rank FROM m)
    SELECT od_id, candidate, within_cap, CAST(class_rank AS INT) AS class_rank,
           row_number() OVER (PARTITION BY od_id ORDER BY NOT within_cap, class_rank, round(density, 12), round(primary_score, 12), candidate) AS final_rank FROM k""",
)
def rerank(c):
    scored = c.ranked_routes.withColumn("minutes", F.col("secs") / 60)
    return choice.rerank(scored, ["od_id"]).select("od_id", "candidate", "within_cap", "class_rank", "final_rank")


@register(
    "diversity",
    """
    SELECT t.od_id, count(*) AS candidates, count(DISTINCT coalesce(r.runs, [])) AS corridor_sequences, count(DISTINCT t.signature) AS signatures,
           round(min(meters), 4) AS min_meters, round(max(meters), 4) AS max_meters, round(min(density), 6) AS min_density, round(max(density), 6) AS max_density
    FROM {o_totals} t LEFT JOIN {o_runs} r ON r.candidate = t.candidate GROUP BY t.od_id""",
)
def diversity(c):
    out = scenario.diversity(routes.route_shapes(c.t.route_steps), ["od_id"])
    for name, digits in [("min_meters", 4), ("max_meters", 4), ("min_density", 6), ("max_density", 6)]:
        out = out.withColumn(name, r(name, digits))
    return out


STEPS_SQL["o_typed"] = """
    WITH rk AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY round(primary_score, 9), candidate) AS rank FROM {o_scored}),
    b AS (SELECT od_id, corridors AS seq, density AS bd, secs AS bs, route_text AS bt FROM rk WHERE rank = 1),
    a AS (SELECT rk.od_id, min(struct_pack(d := rk.density, k := rk.rank, s := rk.secs, t := rk.route_text)) FILTER (rk.rank > 1 AND coalesce(rk.corridors, []) <> coalesce(b.seq, [])) AS alt, count(*) AS candidates,
                 count(DISTINCT rk.corridors) FILTER (len(rk.corridors) > 0) AS sequences FROM rk JOIN b ON b.od_id = rk.od_id GROUP BY rk.od_id)
    SELECT a.od_id, a.candidates, a.sequences, b.bd, b.bs, b.bt, a.alt, a.candidates >= 2 AND a.sequences >= 2 AND a.alt IS NOT NULL AS shown,
           CASE WHEN a.candidates < 2 THEN 'D' WHEN a.sequences < 2 OR a.alt IS NULL THEN 'A' WHEN b.bd - a.alt.d > 0.3::DOUBLE THEN 'C' WHEN b.bd - a.alt.d >= 0.1::DOUBLE THEN 'B' ELSE 'A' END AS scenario_type
    FROM a JOIN b ON a.od_id = b.od_id"""


@register(
    "classify_routes",
    """
    SELECT t.od_id, t.scenario_type, t.candidates, t.sequences, CASE WHEN shown THEN round(bd - alt.d, 6) END AS delta, CASE WHEN shown THEN round((alt.s - bs)::DOUBLE / 60, 3) END AS time_penalty,
           CASE WHEN shown THEN bt END AS best_route, CASE WHEN shown THEN alt.t END AS alt_route, (SELECT count(*) FROM {o_typed} x WHERE x.scenario_type = t.scenario_type) AS same_type
    FROM {o_typed} t""",
)
def classify_routes(c):
    typed = c.typed_routes
    counted = scenario.type_counts(typed).withColumnRenamed("n", "same_type")
    return typed.join(counted, "scenario_type").select(
        "od_id", "scenario_type", "candidates", "sequences", r("delta").alias("delta"), r("time_penalty", 3).alias("time_penalty"), "best_route", "alt_route", "same_type"
    )


@register(
    "close_candidates",
    """
    WITH b AS (SELECT od_id, min(primary_score) AS best, count(*) AS n, max(density) - min(density) AS density_gap, arg_min(candidate, struct_pack(p := primary_score, c := candidate)) AS first FROM {o_scored} GROUP BY od_id HAVING count(*) >= 2),
    g AS (SELECT s.od_id, b.n, b.density_gap, min(abs(s.primary_score - b.best) / greatest(abs(b.best), 1e-9::DOUBLE)) AS score_gap FROM {o_scored} s JOIN b ON b.od_id = s.od_id WHERE s.candidate <> b.first GROUP BY ALL)
    SELECT od_id, n, round(density_gap, 6) AS density_gap, round(score_gap, 6) AS score_gap FROM g ORDER BY score_gap <= 0.15::DOUBLE DESC, round(density_gap, 9) DESC, round(score_gap, 9), od_id LIMIT 20""",
)
def close_candidates(c):
    # Scores alone: neither paths nor ranks are wanted here.
    scored = c.step("route_scores", lambda: routes.scored_routes(routes.route_figures(c.t.route_steps)).select("od_id", "candidate", "primary_score", "density"))
    found = scenario.closest_candidates(scored, ["od_id"])
    return found.select("od_id", "n", r("density_gap").alias("density_gap"), r("score_gap").alias("score_gap"))


@register(
    "plan_labels",
    """
    SELECT od_id, candidate, concat_ws(',', CASE WHEN n >= 2 AND f = 1 THEN 'Tercepat' END, CASE WHEN n >= 2 AND e = 1 THEN 'Paling lega' END) AS labels FROM (
      SELECT od_id, candidate, count(*) OVER (PARTITION BY od_id) AS n, row_number() OVER (PARTITION BY od_id ORDER BY round_even(secs::DOUBLE / 60, 0), candidate) AS f,
             row_number() OVER (PARTITION BY od_id ORDER BY round(density, 9), candidate) AS e FROM {o_totals}) z""",
)
def plan_labels(c):
    totals = c.route_totals.withColumn("minutes", minutes(F.col("secs"))).withColumn("density", F.round("density", 9))
    return scenario.plan_labels(totals, ["od_id"])


@register(
    "display_fields",
    """
    SELECT od_id, candidate, CAST(round_even(secs::DOUBLE / 60, 0) AS INT) AS minutes, concat(printf('%.1f', floor(round(meters, 2) / 100 + 0.5::DOUBLE) / 10), ' km') AS km,
           concat('Rp', replace(format('{{:,}}', CAST(3500 * rides AS BIGINT)), ',', '.')) AS fare,
           concat(lpad(CAST((18000 + secs) // 3600 % 24 AS VARCHAR), 2, '0'), '.', lpad(CAST((18000 + secs) // 60 % 60 AS VARCHAR), 2, '0')) AS clock FROM {o_totals}""",
)
def display_fields(c):
    return c.route_totals.select(
        "od_id", "candidate", minutes(F.col("secs")).alias("minutes"), kilometres(F.round("meters", 2)).alias("km"), rupiah(F.col("rides") * 3500).alias("fare"),
        clock_text(F.lit(18000) + F.col("secs")).alias("clock"),
    )


STEPS_SQL["o_rideclock"] = """
    SELECT s.*, CASE WHEN s.kind = 'segmen' AND s.density < 0.9::DOUBLE THEN 21600 + s.pos * 600 + (s.candidate % 7) * 60 END AS board,
           CASE WHEN s.kind = 'segmen' AND s.density < 0.9::DOUBLE THEN 21600 + s.pos * 600 + (s.candidate % 7) * 60 + CAST(round_even(s.secs::DOUBLE / 60, 0) AS INT) * 60 END AS alight FROM {route_steps} s"""


@register(
    "itinerary_times",
    """
    WITH k AS (SELECT * FROM {o_rideclock} WHERE kind = 'segmen'),
    e AS (SELECT candidate, arg_min(coalesce(board, -1), pos) AS b, arg_max(coalesce(alight, -1), pos) AS a, count(*) AS rides FROM k GROUP BY candidate)
    SELECT candidate, CASE WHEN b < 0 THEN '—' ELSE concat(lpad(CAST(b // 3600 % 24 AS VARCHAR), 2, '0'), '.', lpad(CAST(b // 60 % 60 AS VARCHAR), 2, '0')) END AS departs,
           CASE WHEN a < 0 THEN '—' ELSE concat(lpad(CAST(a // 3600 % 24 AS VARCHAR), 2, '0'), '.', lpad(CAST(a // 60 % 60 AS VARCHAR), 2, '0')) END AS arrives, greatest(rides - 1, 0) AS transfers FROM e""",
)
def itinerary_times(c):
    steps = c.t.route_steps.filter("kind = 'segmen'")
    legs = steps.select(
        "candidate", "pos", F.when(F.col("density") < 0.9, F.lit(21600) + F.col("pos") * 600).alias("clock"), ((F.col("candidate") % 7)).alias("eta_min"),
        minutes(F.col("secs")).alias("ride_min"),
    )
    return choice.itinerary(legs, ["candidate"])


@register(
    "final_comparison",
    """
    WITH seg AS (SELECT scenario, l_partkey % 7 AS segment, avg(recommended) AS mean, stddev_samp(recommended) AS std FROM (SELECT * FROM {mc_rows}) m GROUP BY ALL),
    hv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(std, 9) DESC, segment) AS rn FROM seg) z WHERE rn = 1)
    SELECT m.scenario, round(avg(m.baseline), 10) AS baseline_density, round(avg(m.recommended), 10) AS recommended_density, round(avg(m.baseline) - avg(m.recommended), 10) AS delta_density,
           avg(m.recommended) < avg(m.baseline) AS is_better, any_value(CAST(hv.segment AS VARCHAR)) AS top_segment, round(any_value(hv.mean), 10) AS segment_mean, round(any_value(hv.std), 6) AS segment_std
    FROM {mc_rows} m JOIN hv ON hv.scenario = m.scenario GROUP BY m.scenario""",
)
def final_comparison(c):
    rows = c.t.mc_rows
    stats = resample.series_stats(rows.withColumn("segment", (F.col("l_partkey") % 7).cast("string")), ["scenario", "segment"], "recommended")
    out = scenario.final_comparison(rows, stats, ["scenario"])
    for name in ["baseline_density", "recommended_density", "delta_density", "segment_mean"]:
        out = out.withColumn(name, r(name, 10))
    return out.withColumn("segment_std", r("segment_std"))


@register(
    "k_routes",
)
def k_routes(c):
    return c.routes.select("od_id", "candidate", "cost", "transfers", F.array_join("path", "|").alias("path"))


@register("alias_od")
def alias_od(c):
    return routes.with_aliases(c.od, network.stop_aliases(c.t.stops), network.route_moves(c.edges), c.edges).select(
        "od_id", "origin", "destination", "used_origin", "used_destination", "cost", "transfers", r("primary_score").alias("primary_score")
    )


@register("reachability")
def reachability(c):
    return routes.reachability(c.od, c.routes, c.t.members)


def _snapshot_edges(c):
    seg = demand.segment_snapshot(c.segment_loads, F.lit(28800))
    means = demand.corridor_mean(c.loads, c.t.members)
    weighted = network.edge_weights(c.all_segments, seg, means, None)
    return c.step("weighted_edges", lambda: network.network_edges(weighted, c.t.members, c.t.stops))


def _recommended(c):
    def build():
        steps = routes.route_edges(c.routes, _snapshot_edges(c))
        return choice.recommend(steps, c.visits, c.loads, 28800)

    return c.step("recommended", build)


@register("recommend")
def recommend(c):
    out = _recommended(c)
    return out.select(
        "od_id", "candidate", "final_rank", "secs", r("meters", 2).alias("meters"), "transfers", r("primary_score").alias("primary_score"),
        r("route_density").alias("route_density"), density_class(F.col("route_density")).alias("density_class"), "density_source", r("mean_extra_wait").alias("mean_extra_wait"), "route_text",
    )


@register("scenario_success")
def scenario_success(c):
    steps = routes.route_edges(c.routes, _snapshot_edges(c))
    rows = c.step("success", lambda: scenario.success_rows(c.od, steps, _recommended(c), c.visits, c.loads, 28800))
    return rows.select(
        "od_id", "d_base_v1", "d_base_v2", "d_rec", "delta_v1", "delta_v2", "extra_wait", "route_changed", "reason"
    )


@register("config_sweep")
def config_sweep(c):
    steps = routes.route_edges(c.routes, _snapshot_edges(c))
    return scenario.config_sweep(c.od, steps, c.visits, c.loads, 28800)


REPLICATIONS = 100


@register("sensitivity")
def sensitivity(c):
    resolved = demand.resolve_ridership(c.t.riders, c.t.members, SERVICE_DATE, RUN_ID)
    loads = c.step("mc_loads_small", lambda: resample.replicated_trip_loads(c.instances, resolved, "12345", REPLICATIONS))
    steps = routes.route_edges(c.routes, c.edges)
    return scenario.routing_sensitivity(steps, c.visits, loads, 28800)
