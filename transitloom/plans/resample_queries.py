"""Queries on replicated resampling, paired evaluation, vehicle choice and scenario typing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from transitloom import constants as C
from transitloom.functions.draws import clamped_normal, poisson, stable_hash, uniform
from transitloom.functions.scalar import anchored_clock
from transitloom.operators import choice, demand, lookup, resample, scenario
from transitloom.plans.base import (
    RUN_ID, SERVICE_DATE, STEPS_SQL, band_sql, cdf_sql, clamp_sql, hash_sql, normal_sql, pick_sql, poisson_sql, r, register, uniform_sql,
)
from transitloom.session import cut

MASTER = "12345"
RUNS = 100

STEPS_SQL["o_mcdraw"] = f"""
    SELECT instance_id, corridor_id, departure, riders, CAST(round(riders * 100) AS HUGEINT) AS total, replication, seed, bw, CASE WHEN riders IS NOT NULL THEN len(list_filter(CASE bw
           {' '.join(f"WHEN {w}::DOUBLE THEN {cdf_sql(w * C.POISSON_SCALE)}" for w in sorted({x[3] for x in C.TIME_BANDS}))} END, lambda p: p < u)) END AS draw
    FROM (SELECT i.instance_id, i.corridor_id, i.departure, u.riders, rep.replication, {hash_sql(f"'{MASTER}'", 'rep.replication')} AS seed, {band_sql('i.departure', 3)} AS bw,
                 {uniform_sql(hash_sql(f"'{MASTER}'", 'rep.replication'), 'i.corridor_id', 'i.instance_id', "'trip'")} AS u
          FROM {{o_instances}} i LEFT JOIN {{o_used}} u ON u.corridor_id = i.corridor_id, (SELECT unnest(range(0, {RUNS})) AS replication) rep) z"""
STEPS_SQL["o_mctrips"] = """
    SELECT *, load * 80 AS passengers FROM (
      SELECT *, CASE WHEN riders IS NULL THEN 0.5::DOUBLE WHEN sw > 0 THEN riders * (draw::DOUBLE / sw) / 80 ELSE riders * (bw / sbw) / 80 END AS load,
             CASE WHEN riders IS NULL THEN 1 WHEN sw > 0 THEN total * draw END AS num, CASE WHEN riders IS NULL THEN 2 WHEN sw > 0 THEN 8000 * sw END AS den
      FROM (SELECT *, CAST(sum(draw) OVER (PARTITION BY replication, corridor_id) AS HUGEINT) AS sw, sum(bw) OVER (PARTITION BY replication, corridor_id) AS sbw FROM {o_mcdraw}) d) e"""
STEPS_SQL["o_mcseg"] = f"""
    SELECT *, CASE WHEN sd > 0 THEN base * draw / (sd / n) ELSE base END AS segment_load, CASE WHEN sd > 0 THEN num * draw * n ELSE num END AS snum, CASE WHEN sd > 0 THEN den * sd ELSE den END AS sden FROM (
      SELECT *, CAST(sum(draw) OVER w AS HUGEINT) AS sd, count(*) OVER w AS n FROM (
        SELECT t.replication, t.seed, h.instance_id, h.corridor_id, h.pos, h.segment_id, h.dep, h.next_arr, t.load AS base, t.num, t.den,
               {poisson_sql(25.0, 't.seed', 'h.corridor_id', 'h.instance_id', 'h.segment_id', "'segment'")} AS draw
        FROM {{o_ridden}} h JOIN {{o_mctrips}} t ON t.instance_id = h.instance_id) a WINDOW w AS (PARTITION BY replication, instance_id)) b"""


def exact_sql(num: str, den: str, digits: int, otherwise: str) -> str:
    """A quotient of whole numbers, rounded half up without passing through a double; ``otherwise`` where there is none."""
    unit = 10**digits
    return f"CASE WHEN {den} > 0 THEN CAST((2 * {unit}::HUGEINT * {num} + {den}) // (2 * {den}) AS DOUBLE) / {unit} ELSE round({otherwise}, {digits}) END"


def exact(num: Column, den: Column, digits: int, otherwise: Column) -> Column:
    """``otherwise`` is the same quotient as a double. Only where it lies near a tie, or is large, do whole numbers decide how it is rounded."""
    unit = 10**digits
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    whole = F.call_function("div", wide(F.lit(2 * unit), 8) * wide(num, 27) + wide(den, 27), wide(F.lit(2), 1) * wide(den, 27))
    scaled = otherwise * unit
    clear = (scaled < 1e10) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    near = F.when(den > 0, whole.cast("double") / unit).otherwise(F.round(otherwise, digits))
    return F.when(clear, F.floor(scaled + 0.5).cast("double") / unit).otherwise(near)


def trip_fraction(riders: Column, draw: Column, draw_sum: Column) -> tuple[Column, Column]:
    """The load of a trip as whole numbers (rides are hundredths, seats 80); null where the draws of the line are all zero."""
    total = F.round(riders * 100).cast("decimal(18,0)")
    num = F.when(riders.isNull(), F.lit(1).cast("decimal(27,0)")).when(draw_sum > 0, (total * draw.cast("decimal(6,0)")).cast("decimal(27,0)"))
    den = F.when(riders.isNull(), F.lit(2).cast("decimal(27,0)")).when(draw_sum > 0, (F.lit(8000).cast("decimal(4,0)") * draw_sum.cast("decimal(18,0)")).cast("decimal(27,0)"))
    return num, den


def mc_trips(c):
    """Rows per replication, made from the stored draws whenever they are read."""
    resolved = demand.resolve_ridership(c.t.riders, c.t.members, SERVICE_DATE, RUN_ID)
    draws = c.step("mc_draws", lambda: resample.trip_draws(c.instances, resolved.filter("riders IS NOT NULL"), MASTER, RUNS))
    return resample.replicated_trip_loads(c.instances, resolved, MASTER, RUNS, draws=draws)


def mc_packed(c, only=None):
    """Rows of instances with all their replications and segments."""
    resolved = demand.resolve_ridership(c.t.riders, c.t.members, SERVICE_DATE, RUN_ID)
    draws = c.step("mc_draws", lambda: resample.trip_draws(c.instances, resolved.filter("riders IS NOT NULL"), MASTER, RUNS))
    return resample.packed_segment_loads(demand.trip_segments(c.trip_hops, c.matched), c.instances, resolved, draws, MASTER, RUNS, only=only)


@register(
    "stable_hash",
    f"SELECT o_orderkey, {hash_sql('o_orderkey', 'o_orderstatus', 'o_orderpriority')} AS h, round({uniform_sql('o_orderkey', 'o_orderstatus')}, 12) AS u FROM {{orders}}",
)
def stable_hash_query(c):
    key = [F.col("o_orderkey"), F.col("o_orderstatus")]
    return c.t.orders.select("o_orderkey", stable_hash(*key, F.col("o_orderpriority")).alias("h"), r(uniform(*key), 12).alias("u"))


@register(
    "seeded_draws",
    f"""
    SELECT o_orderkey, round({normal_sql(0.15, 0.6, 1.4, 'o_orderkey', "'x'")}, 6) AS noise, {poisson_sql(25.0, 'o_orderkey', "'seg'")} AS draw FROM {{orders}}""",
)
def seeded_draws(c):
    k = F.col("o_orderkey")
    return c.t.orders.select("o_orderkey", r(clamped_normal(1.0, 0.15, 0.6, 1.4, k, F.lit("x"))).alias("noise"), poisson(25.0, k, F.lit("seg")).alias("draw"))


@register(
    "mc_trip_loads",
    f"SELECT replication, instance_id, CAST(draw AS INT) AS draw, {exact_sql('80 * num', 'den', 4, 'passengers')} AS passengers, {exact_sql('num', 'den', 6, 'load')} AS load FROM {{o_mctrips}}",
)
def mc_trip_loads(c):
    rows = mc_trips(c)
    num, den = trip_fraction(F.col("riders"), F.col("draw"), F.col("draw_sum"))
    return rows.select(
        "replication", "instance_id", "draw", exact(F.lit(80).cast("decimal(2,0)") * num, den, 4, F.col("passengers")).alias("passengers"), exact(num, den, 6, F.col("load")).alias("load")
    )


def replication_dates(c):
    return demand.replicated_ridership(c.t.riders, c.t.members, resample.replication_seed(MASTER, F.col("replication")), RUNS)


STEPS_SQL["o_mcdates"] = f"""
    WITH ranked AS (SELECT corridor_id, date, riders, row_number() OVER (PARTITION BY corridor_id ORDER BY date DESC) - 1 AS rk FROM {{riders}}),
    n AS (SELECT corridor_id, least(30, count(*)) AS n FROM ranked GROUP BY corridor_id),
    picked AS (SELECT rep.replication, n.corridor_id, {pick_sql('n.n', "'ridership_sample_30'", hash_sql(f"'{MASTER}'", 'rep.replication'), 'n.corridor_id')} AS rk
               FROM n, (SELECT unnest(range(0, {RUNS})) AS replication) rep)
    SELECT m.replication, m.corridor_id, k.date AS used_date, k.riders
    FROM (SELECT DISTINCT corridor_id, replication FROM {{members}}, (SELECT unnest(range(0, {RUNS})) AS replication) rep) m
    LEFT JOIN picked p ON p.corridor_id = m.corridor_id AND p.replication = m.replication LEFT JOIN ranked k ON k.corridor_id = p.corridor_id AND k.rk = p.rk"""


@register("mc_ridership_dates", "SELECT replication, corridor_id, strftime(used_date, '%Y-%m-%d') AS used_date, round(riders, 6) AS riders FROM {o_mcdates}")
def mc_ridership_dates(c):
    return replication_dates(c).select("replication", "corridor_id", F.date_format("used_date", "yyyy-MM-dd").alias("used_date"), r("riders").alias("riders"))


@register(
    "mc_trip_loads_sampled",
    f"""
    SELECT replication, instance_id, CAST(draw AS INT) AS draw, {exact_sql('80 * num', 'den', 4, 'passengers')} AS passengers, {exact_sql('num', 'den', 6, 'load')} AS load FROM (
      SELECT *, load * 80 AS passengers FROM (
        SELECT t.replication, t.instance_id, t.draw, CASE WHEN d.riders IS NULL THEN 0.5::DOUBLE WHEN sw > 0 THEN d.riders * (draw::DOUBLE / sw) / 80 ELSE d.riders * (bw / sbw) / 80 END AS load,
               CASE WHEN d.riders IS NULL THEN 1 WHEN sw > 0 THEN CAST(round(d.riders * 100) AS HUGEINT) * draw END AS num, CASE WHEN d.riders IS NULL THEN 2 WHEN sw > 0 THEN 8000 * sw END AS den
        FROM {{o_mctrips}} t LEFT JOIN {{o_mcdates}} d ON d.corridor_id = t.corridor_id AND d.replication = t.replication) x) y""",
)
def mc_trip_loads_sampled(c):
    """As ``mc_trip_loads`` where no date is given: every replication draws its own date."""
    rows = resample.replicated_trip_loads(c.instances, replication_dates(c), MASTER, RUNS)
    num, den = trip_fraction(F.col("riders"), F.col("draw"), F.col("draw_sum"))
    return rows.select(
        "replication", "instance_id", "draw", exact(F.lit(80).cast("decimal(2,0)") * num, den, 4, F.col("passengers")).alias("passengers"), exact(num, den, 6, F.col("load")).alias("load")
    )


@register(
    "mc_segment_loads",
    f"SELECT replication, instance_id, pos, segment_id, draw, {exact_sql('snum', 'sden', 6, 'segment_load')} AS segment_load, dep <= 28800 AND 28800 < next_arr AS active FROM {{o_mcseg}}",
)
def mc_segment_loads(c):
    rows = resample.unpacked_segment_loads(mc_packed(c))
    active = (F.col("dep") <= 28800) & (F.lit(28800) < F.col("next_arr"))
    num, den = trip_fraction(F.col("trip.riders"), F.col("trip.draw"), F.col("trip.draw_sum"))
    drawn = F.col("trip_draws") > 0
    whole = lambda c: c.cast("decimal(6,0)")
    load = exact(
        F.when(drawn, num * whole(F.col("draw")) * whole(F.col("trip_hops"))).otherwise(num), F.when(drawn, den * whole(F.col("trip_draws"))).otherwise(den), 6, F.col("segment_load")
    )
    return rows.select("replication", "instance_id", "pos", "segment_id", "draw", load.alias("segment_load"), active.alias("active"))


@register(
    "replication_stats",
    """
    WITH s AS (SELECT segment_id, avg(segment_load) AS mean, coalesce(stddev_samp(segment_load), 0) AS std, quantile_cont(segment_load, 0.05) AS p05, quantile_cont(segment_load, 0.95) AS p95, count(*) AS n,
                      min(segment_load) AS min, max(segment_load) AS max FROM {o_mcseg} GROUP BY segment_id)
    SELECT segment_id, round(mean, 6) AS mean, round(std, 6) AS std, round(p05, 6) AS p05, round(p95, 6) AS p95, n, round(min, 6) AS min, round(max, 6) AS max,
           row_number() OVER (ORDER BY round(std, 9) DESC, segment_id) <= 10 AS in_top FROM s""",
)
def replication_stats(c):
    stats = cut(resample.packed_segment_stats(mc_packed(c)))
    top = resample.variance_report(stats, "segment_id").filter("kind = 'top_std'").select(F.col("subject").alias("segment_id"), F.lit(True).alias("in_top"))
    return stats.join(top, "segment_id", "left").select(
        "segment_id", *[r(x).alias(x) for x in ["mean", "std", "p05", "p95"]], "n", r("min").alias("min"), r("max").alias("max"), F.coalesce("in_top", F.lit(False)).alias("in_top")
    )


@register(
    "paired_comparison",
    """
    SELECT scenario, round(avg(CASE WHEN baseline - recommended > 0 THEN 1 ELSE 0 END), 6) AS improvement_rate, round(avg(CASE WHEN changed THEN 1 ELSE 0 END), 6) AS change_rate,
           round(avg(CASE WHEN abs(baseline - recommended) <= 0 THEN 1 ELSE 0 END), 6) AS tie_rate, round(avg(baseline - recommended), 6) AS mean_delta, round(median(baseline - recommended), 6) AS median_delta,
           round(quantile_cont(baseline - recommended, 0.05), 6) AS p05_delta, round(quantile_cont(baseline - recommended, 0.95), 6) AS p95_delta, round(avg(extra_secs), 6) AS mean_extra_secs, count(*) AS n
    FROM {mc_rows} GROUP BY scenario""",
)
def paired_comparison(c):
    out = resample.paired_comparison(c.t.mc_rows, ["scenario"]).drop("baseline_mean", "recommended_mean")
    return out.select("scenario", *[r(x).alias(x) for x in out.columns if x not in ("scenario", "n")], "n")


@register(
    "route_stability",
    """
    WITH k AS (SELECT scenario, signature, count(*) AS c, min(replication) AS f FROM {mc_rows} GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY c DESC, f) AS rn, count(*) OVER (PARTITION BY scenario) AS distinct_tops FROM k WHERE signature IS NOT NULL)
    SELECT m.scenario, m.signature AS mode_signature, m.c AS mode_count, m.distinct_tops, round(m.c::DOUBLE / (SELECT sum(c) FROM k WHERE k.scenario = m.scenario), 6) AS stability FROM m WHERE rn = 1""",
)
def route_stability(c):
    return resample.route_stability(c.t.mc_rows, ["scenario"]).withColumn("stability", r("stability"))


@register(
    "rank_corr",
    """
    WITH items AS (SELECT o.o_orderpriority AS scenario, l.l_orderkey AS replication, CAST(l.l_partkey % 5 AS VARCHAR) AS item, max(l.l_extendedprice) AS price FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey GROUP BY ALL),
    rk AS (SELECT scenario, replication, string_agg(item, '' ORDER BY price DESC, item) AS ranking FROM items GROUP BY ALL),
    k AS (SELECT scenario, ranking, count(*) AS c FROM rk GROUP BY ALL),
    p AS (SELECT a.scenario, a.ranking AS a, b.ranking AS b, CASE WHEN a.ranking = b.ranking THEN a.c * (a.c - 1) / 2 ELSE a.c * b.c END AS w FROM k a JOIN k b ON a.scenario = b.scenario AND a.ranking <= b.ranking),
    x AS (SELECT scenario, a, b, w, list_filter(string_split(a, ''), lambda i: contains(b, i)) AS common FROM p WHERE w > 0),
    y AS (SELECT *, len(common) AS n, list_sum(list_transform(common, lambda i: (instr(a, i) - instr(b, i)) * (instr(a, i) - instr(b, i)))) AS sq,
                 list_sum(list_transform(range(1, len(common) + 1), lambda i: len(list_filter(range(i + 1, len(common) + 1), lambda j: instr(b, common[j]) > instr(b, common[i]))))) AS con FROM x)
    SELECT scenario, round(sum((1 - 6 * sq::DOUBLE / (n * (n * n - 1))) * w) / sum(w), 6) AS spearman, round(sum((2 * con - n * (n - 1) / 2)::DOUBLE / (n * (n - 1) / 2) * w) / sum(w), 6) AS kendall
    FROM y WHERE n >= 2 GROUP BY scenario""",
)
def rank_corr(c):
    items = c.t.lineitem.join(c.t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_orderpriority").alias("scenario"), F.col("l_orderkey").alias("replication"), (F.col("l_partkey") % 5).cast("string").alias("item")
    ).agg(F.max("l_extendedprice").alias("price"))
    rankings = items.groupBy("scenario", "replication").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "item"))), lambda x: x["item"]).alias("ranking")
    )
    out = resample.rank_correlation(rankings, ["scenario"])
    return out.select("scenario", r("spearman").alias("spearman"), r("kendall").alias("kendall"))


LEGS_SQL = "SELECT concat(m.corridor_id, '@', m.stop_id) AS leg, m.corridor_id, m.stop_id AS board_stop, 27000 + m.seq * 300 AS clock FROM {members} m"
STEPS_SQL["o_cands"] = f"""
    SELECT l.leg, l.clock, v.instance_id, min(v.arr - l.clock) AS eta_secs, CAST(round_even(min(v.arr - l.clock)::DOUBLE / 60, 0) AS INT) AS eta_min
    FROM ({LEGS_SQL}) l JOIN {{o_visits}} v ON v.corridor_id = l.corridor_id AND v.stop_id = l.board_stop AND v.arr >= l.clock AND v.arr - l.clock <= 3600 GROUP BY ALL"""
SCORE_SQL = """
    SELECT *, eta_min - earliest_eta AS extra_wait, eta_min - earliest_eta <= 50 AS eligible,
           0.95::DOUBLE * density + (1 - 0.95::DOUBLE) * least((eta_min - earliest_eta) / 50::DOUBLE, 1.0::DOUBLE) AS score FROM (
      SELECT *, min(eta_min) OVER w AS earliest_eta, count(*) OVER w AS candidate_count, rank() OVER ({part} ORDER BY eta_min) AS arrival_order FROM ({src}) s WINDOW w AS ({part})) q"""


def _scored_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}"
    inner = SCORE_SQL.replace("{part}", part).replace("{src}", source)
    # Density 0 is the only value at or below the safe threshold; those legs take the first vehicle.
    return f"""
        SELECT *, row_number() OVER ({part} ORDER BY NOT (first_density <= 0 AND instance_id = first_id), NOT eligible, round(score, 12), eta_min, round(density, 2), instance_id) AS choice FROM (
          SELECT *, first_value(instance_id) OVER f AS first_id, first_value(density) OVER f AS first_density FROM ({inner}) i WINDOW f AS ({part} ORDER BY eta_min, round(density, 2), instance_id)) j"""


STEPS_SQL["o_scoredlegs"] = _scored_sql(
    f"SELECT c.*, {clamp_sql('l.load')} AS density FROM {{o_cands}} c JOIN {{o_loads}} l ON l.instance_id = c.instance_id", "leg"
)
STEPS_SQL["o_scoredmc"] = _scored_sql(
    f"SELECT c.*, l.replication, {clamp_sql('l.load')} AS density FROM {{o_cands}} c JOIN {{o_mctrips}} l ON l.instance_id = c.instance_id", "leg, replication"
)


def stop_legs(c):
    return c.t.members.select(
        F.concat("corridor_id", F.lit("@"), "stop_id").alias("leg"), "corridor_id", F.col("stop_id").alias("board_stop"), (F.lit(27000) + F.col("seq") * 300).cast("bigint").alias("clock")
    )


def scored_legs(c):
    return choice.score_candidates(choice.boarding_candidates(stop_legs(c), c.visits, c.loads, ["leg"]), ["leg"])


@register(
    "bus_choice",
    """
    SELECT s.leg, s.instance_id, s.eta_min, round(s.density, 6) AS density, round(s.score, 6) AS score, s.extra_wait, s.arrival_order, s.candidate_count,
           CASE WHEN first_density <= 0 THEN 'next_bus_safe_density' ELSE 'bus_score' END AS reason,
           (SELECT string_agg(concat(d.instance_id, ':', CAST(d.eta_min AS VARCHAR)), ',' ORDER BY d.n) FROM (
              SELECT *, row_number() OVER (PARTITION BY leg ORDER BY eta_min, round(density, 2), instance_id) AS n FROM {o_scoredlegs} WHERE eligible) d WHERE d.leg = s.leg AND d.n <= 5) AS debug
    FROM {o_scoredlegs} s WHERE choice = 1""",
)
def bus_choice(c):
    scored = scored_legs(c)
    debug = choice.debug_candidates(scored, ["leg"]).groupBy("leg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("debug_rank", "instance_id", "eta_min"))), lambda x: F.concat(x["instance_id"], F.lit(":"), x["eta_min"].cast("string"))), ",").alias("debug")
    )
    return choice.chosen_vehicles(scored).join(debug, "leg").select(
        "leg", "instance_id", "eta_min", r("density").alias("density"), r("score").alias("score"), "extra_wait", "arrival_order", "candidate_count", "reason", "debug"
    )


@register(
    "classify_buses",
    """
    WITH e AS (SELECT leg, min(struct_pack(eta := eta_min, id := instance_id, d := density)) AS e, count(*) AS n, round(max(density) - min(density), 3) AS spread FROM {o_scoredlegs} GROUP BY leg),
    a AS (SELECT s.leg, min(struct_pack(d := s.density, eta := s.eta_min)) AS alt FROM {o_scoredlegs} s JOIN e ON e.leg = s.leg WHERE s.instance_id <> e.e.id AND s.density <= 0.35::DOUBLE AND s.density < e.e.d GROUP BY s.leg),
    j AS (SELECT e.*, a.alt, e.n >= 2 AND e.e.d >= 0.8::DOUBLE AND a.alt IS NOT NULL AS conflict FROM e LEFT JOIN a ON a.leg = e.leg)
    SELECT leg, CASE WHEN conflict AND round(e.d - alt.d, 3) >= 0.5::DOUBLE THEN 'C''' WHEN conflict THEN 'B''' ELSE 'D''' END AS scenario_type,
           CASE WHEN n < 2 THEN 'fewer_than_two' WHEN conflict THEN 'crowded_first_empty_later' WHEN spread < 0.15::DOUBLE THEN 'all_similar' ELSE 'no_conflict' END AS why,
           round(e.d, 6) AS first_density, CASE WHEN conflict THEN round(alt.d, 6) END AS later_density, CASE WHEN conflict THEN alt.eta - e.eta END AS wait_min, spread FROM j""",
)
def classify_buses(c):
    typed = scenario.classify_vehicles(scored_legs(c), ["leg"])
    return typed.select("leg", "scenario_type", "why", r("first_density").alias("first_density"), r("later_density").alias("later_density"), "wait_min", "spread")


@register(
    "bus_choice_mc",
    """
    WITH p AS (SELECT leg, replication, arg_min(struct_pack(i := instance_id, d := density, e := eta_min), struct_pack(e := eta_min, i := instance_id)) AS b,
                      arg_min(struct_pack(i := instance_id, d := density, e := eta_min), choice) AS c FROM {o_scoredmc} WHERE candidate_count >= 2 GROUP BY ALL)
    SELECT leg, count(*) AS eligible, round(avg(CASE WHEN b.i <> c.i THEN 1 ELSE 0 END), 6) AS change_rate, round(avg(round(b.d - c.d, 3)), 5) AS mean_delta, round(median(round(b.d - c.d, 3)), 5) AS median_delta,
           round(coalesce(avg(CASE WHEN b.i <> c.i THEN c.e - b.e END), 0), 6) AS mean_wait FROM p GROUP BY leg""",
)
def bus_choice_mc(c):
    legs = stop_legs(c)
    first = choice.boarding_candidates(legs, c.visits, mc_trips(c).filter("replication = 0"), ["leg"]).drop("density")
    runs = first.join(mc_trips(c).select("replication", "instance_id", F.greatest(F.lit(0.0), F.least("load", F.lit(1.0))).alias("density")), "instance_id")
    scored = choice.score_candidates(runs, ["leg", "replication"])
    out = resample.bus_choice_summary(scored, ["leg"])
    return out.select("leg", "eligible", r("change_rate").alias("change_rate"), r("mean_delta", 5).alias("mean_delta"), r("median_delta", 5).alias("median_delta"), r("mean_wait").alias("mean_wait"))


@register(
    "success_summary",
    """
    SELECT scenario, count(*) AS n, count(CASE WHEN d1 > 0 THEN 1 END) AS wins_v1, count(CASE WHEN d2 > 0 THEN 1 END) AS wins_v2, round(coalesce(avg(d1), 0), 6) AS mean_delta_v1,
           round(coalesce(avg(w), 0), 6) AS mean_wait, round(coalesce(avg(CASE WHEN d1 > 0 THEN w END), 0), 6) AS mean_wait_wins,
           round(count(CASE WHEN d1 > 0 THEN 1 END)::DOUBLE / count(*), 6) AS win_rate_v1
    FROM (SELECT scenario, round(baseline - recommended, 4) AS d1, round(baseline - recommended - 0.3::DOUBLE, 4) AS d2, CASE WHEN signature IS NOT NULL THEN extra_secs / 10 END AS w FROM {mc_rows}) x GROUP BY scenario""",
)
def success_summary(c):
    rows = c.t.mc_rows.select(
        "scenario", F.round(F.col("baseline") - F.col("recommended"), 4).alias("delta_v1"), F.round(F.col("baseline") - F.col("recommended") - 0.3, 4).alias("delta_v2"),
        F.when(F.col("signature").isNotNull(), F.col("extra_secs") / 10).alias("extra_wait"),
    )
    out = scenario.success_summary(rows, ["scenario"])
    return out.select("scenario", "n", "wins_v1", "wins_v2", r("mean_delta_v1").alias("mean_delta_v1"), r("mean_wait").alias("mean_wait"), r("mean_wait_wins").alias("mean_wait_wins"), r("win_rate_v1").alias("win_rate_v1"))


SETS_SQL = "(VALUES " + ", ".join(f"('{s[0]}', {s[1]}::DOUBLE, {s[4]}::DOUBLE)" for s in C.WEIGHT_SETS) + ") AS w(weight_label, w_time, w_density)"


@register(
    "sensitivity_plan",
    f"""
    WITH cat AS (SELECT *, row_number() OVER (PARTITION BY scenario_type ORDER BY coalesce(CASE WHEN shown THEN round(bd - alt.d, 9) END, 0) DESC, od_id) AS rank FROM {{o_typed}})
    SELECT scenario_type, od_id AS origin, CAST(rank AS INT) AS rank, weight_label, w_time, w_density, concat_ws('_', scenario_type, od_id, weight_label) AS label FROM cat, {SETS_SQL} WHERE rank <= 2""",
)
def sensitivity_plan(c):
    typed = c.typed_routes.withColumn("delta", F.round("delta", 9))
    catalog = typed.select("scenario_type", F.col("od_id").alias("origin"), F.lit(None).cast("string").alias("destination"), "delta", F.col("od_id").alias("seen"))
    return scenario.sensitivity_plan(catalog).select("scenario_type", "origin", "rank", "weight_label", "w_time", "w_density", "label")


WAITS = [20, 30, 40, 60]
RATIO = C.WAIT_WEIGHT / C.DENSITY_WEIGHT


@register(
    "wait_lever",
    f"""
    WITH e AS (SELECT leg, min(struct_pack(eta := eta_min, id := instance_id, d := density)) AS e FROM {{o_scoredlegs}} GROUP BY leg),
    b AS (SELECT s.leg, e.e, max(struct_pack(a := e.e.d - s.density, w := -s.eta_min, d := s.density, id := s.instance_id)) AS b FROM {{o_scoredlegs}} s JOIN e ON e.leg = s.leg WHERE e.e.d > 0.35::DOUBLE GROUP BY s.leg, e.e)
    SELECT leg, round(e.d, 3) AS base_density, round(b.d, 3) AS best_density, -b.w - e.eta AS wait_min, round(b.a, 4) AS advantage,
           {', '.join(f"(b.a - {RATIO!r}::DOUBLE * ((-b.w - e.eta) / {w}::DOUBLE) > 0 AND b.a > 0.01::DOUBLE) AS flips_wait{w}" for w in WAITS)} FROM b""",
)
def wait_lever(c):
    out = scenario.wait_margins(scored_legs(c), WAITS, RATIO).filter("base_density > 0.35D")
    return out.withColumn("base_density", r("base_density", 3)).withColumn("best_density", r("best_density", 3)).withColumn("advantage", r("advantage", 4))


@register(
    "sim_clock",
    """
    SELECT event_id, CASE WHEN passengers % 5 = 0 THEN ms // 1000 % 86400 ELSE 18000 + ((least(greatest(ms // 1000 % 86400, 18000), 82800) - 18000 + CAST(floor(value * (1 + passengers % 60)) AS BIGINT)) % 64800) END AS second FROM {readings}""",
)
def sim_clock(c):
    anchor = F.floor(F.col("ms") / 1000) % 86400
    return c.t.readings.select("event_id", anchored_clock(anchor, F.col("value"), 1 + F.col("passengers") % 60, F.col("passengers") % 5 != 0).alias("second"))


@register(
    "boarding_weights",
    f"""
    WITH st AS (SELECT segment_id, corridor_id, from_stop, to_stop, 25200 + (seq * 1777) % 50000 AS ready, concat(segment_id, '@', CAST(25200 + (seq * 1777) % 50000 AS VARCHAR)) AS request_id FROM {{segments}}),
    c AS (SELECT s.request_id, 1 AS tier, h.arr AS t, h.instance_id, h.segment_id AS seg FROM st s JOIN {{o_ihops}} h ON h.corridor_id = s.corridor_id AND h.from_stop = s.from_stop AND h.to_stop = s.to_stop AND h.arr >= s.ready
          UNION ALL SELECT s.request_id, 2, v.arr, v.instance_id, NULL FROM st s JOIN {{o_visits}} v ON v.corridor_id = s.corridor_id AND v.stop_id = s.from_stop AND v.arr >= s.ready
          UNION ALL SELECT s.request_id, 3, v.dep, v.instance_id, NULL FROM st s JOIN {{o_visits}} v ON v.corridor_id = s.corridor_id AND v.pos = 1 AND v.dep >= s.ready),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, t, instance_id) AS rn FROM c) z WHERE rn = 1),
    m AS (SELECT corridor_id, {clamp_sql('avg(load)')} AS density FROM {{o_loads}} GROUP BY corridor_id),
    j AS (SELECT st.request_id, st.corridor_id, st.segment_id, b.instance_id, t.replication, coalesce(g.segment_load, t.load * {poisson_sql(25.0, 't.seed', 'st.corridor_id', 'b.instance_id', 'st.segment_id', "'segment'")} / 25) AS v
          FROM st LEFT JOIN b ON b.request_id = st.request_id LEFT JOIN {{o_mctrips}} t ON t.instance_id = b.instance_id
          LEFT JOIN {{o_mcseg}} g ON g.replication = t.replication AND g.instance_id = b.instance_id AND g.segment_id = coalesce(b.seg, st.segment_id))
    SELECT j.request_id, coalesce(j.replication, -1) AS replication, j.instance_id, round(CASE WHEN v IS NOT NULL THEN {clamp_sql('v')} ELSE coalesce(m.density, 0.5::DOUBLE) END, 6) AS value,
           CASE WHEN v IS NOT NULL THEN 'boarding_trip_segment' ELSE 'corridor_daily_mean' END AS source FROM j LEFT JOIN m ON m.corridor_id = j.corridor_id""",
)
def boarding_weights(c):
    ready = 25200 + (F.col("seq") * 1777) % 50000
    steps = c.t.segments.withColumn("ready", ready).select(
        F.concat("segment_id", F.lit("@"), F.col("ready").cast("string")).alias("request_id"), "segment_id", "corridor_id", "from_stop", "to_stop", "ready"
    )
    trips = lookup.next_trip(steps, c.instances, c.template, c.trip_hops)
    means = demand.corridor_mean(c.loads, c.t.members)
    # Only trips that are boarded meet the replications.
    boarded = c.step("boarded", lambda: trips.select("instance_id").distinct())
    out = resample.packed_boarding_weights(steps, trips, mc_packed(c, boarded), means)
    return out.select("request_id", F.coalesce("replication", F.lit(-1)).alias("replication"), "instance_id", r("value").alias("value"), "source")
