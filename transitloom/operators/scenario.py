"""Scenario selection and typing, success evaluation, sensitivity plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.functions.scalar import clamp_load


def screening_pairs(members: DataFrame, stops_per_line: int = 16, pairs_per_line: int = 12) -> DataFrame:
    """Origin-destination pairs of a line: every n-th stop, at least two apart, the first twelve.

    The right-hand stops are generated as positions up to the wanted number and then looked up, so
    the pairs of a line are never all built.
    """
    w = Window.partitionBy("corridor_id").orderBy("seq")
    counts = members.groupBy("corridor_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / stops_per_line))
    numbered = members.select("corridor_id", "stop_id", (F.row_number().over(w) - 1).alias("i")).join(counts, "corridor_id")
    sampled = numbered.filter(F.col("i") % stride == 0).select(
        "corridor_id", "stop_id", (F.col("i") / stride).cast("int").alias("left"), (F.floor((F.col("n") - 1) / stride) + 1).alias("m")
    )
    before = F.col("left") * (F.col("m") - 2) - F.floor(F.col("left") * (F.col("left") - 1) / 2)
    room = F.least(F.col("m") - 2 - F.col("left"), F.lit(pairs_per_line) - before)
    lefts = sampled.withColumn("_room", room).filter("_room > 0").select(
        "corridor_id", F.col("stop_id").alias("origin"), "left", F.explode(F.sequence(F.col("left") + 2, F.col("left") + 1 + F.col("_room"))).alias("right")
    )
    rights = sampled.select("corridor_id", F.col("left").cast("bigint").alias("right"), F.col("stop_id").alias("destination"))
    return lefts.withColumn("right", F.col("right").cast("bigint")).join(rights, ["corridor_id", "right"]).select("corridor_id", "origin", "destination")


def at_hours(pairs: DataFrame, hours: list[int]) -> DataFrame:
    """Each distinct pair once per hour."""
    return pairs.select("origin", "destination").distinct().withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours])))


def _first_stops(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("stop_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("stop_id")), ",").alias("stops")
    )


def line_connections(lines: DataFrame, examples: int = 3) -> DataFrame:
    """Pairs of lines that share a stop: number of connectors and example stops.

    Only pairs where both lines have a stop of their own are kept; the self-join runs on the stop,
    whose number of lines is small.
    """
    per_stop = lines.groupBy("stop_id").agg(F.count(F.lit(1)).alias("n"))
    exclusive = lines.join(per_stop.filter("n = 1"), "stop_id").select("corridor_id", "stop_id")
    own = _first_stops(exclusive, ["corridor_id"], examples)
    a = lines.select("stop_id", F.col("corridor_id").alias("line_a"), F.col("cnum").alias("na"))
    b = lines.select("stop_id", F.col("corridor_id").alias("line_b"), F.col("cnum").alias("nb"))
    shared = a.join(b, "stop_id").filter("na < nb")
    counts = shared.groupBy("line_a", "line_b").agg(F.count(F.lit(1)).alias("connectors"))
    via = _first_stops(shared, ["line_a", "line_b"], examples)
    side = lambda p: own.select(F.col("corridor_id").alias(f"line_{p}"), F.col("stops").alias(f"own_{p}"))
    return counts.join(via.withColumnRenamed("stops", "via"), ["line_a", "line_b"]).join(side("a"), "line_a").join(side("b"), "line_b")


def scope_map(catalog: DataFrame, lines: DataFrame, scope: list[str]) -> DataFrame:
    """Line lists of both ends of every catalog pair and whether all of them are in scope."""
    lists = lines.groupBy("stop_id").agg(F.array_sort(F.collect_set("corridor_id")).alias("lines"))
    side = lambda p, key: lists.select(F.col("stop_id").alias(key), F.col("lines").alias(f"{p}_lines"))
    joined = catalog.select("origin", "destination").distinct().join(side("o", "origin"), "origin", "left").join(side("d", "destination"), "destination", "left")
    known = F.concat(F.coalesce("o_lines", F.array()), F.coalesce("d_lines", F.array()))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("?"))
    return joined.select(
        "origin", "destination", text("o_lines").alias("o_lines"), text("d_lines").alias("d_lines"),
        F.forall(known, lambda x: x.isin(scope)).alias("in_scope"),
    )


def classify_routes(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Conflict type per pair: D no alternative, A congruent, B mild, C severe.

    ``routes`` has keys, rank (1 = best), corridors (array per ride edge), density, secs, route_text.
    """
    best = routes.filter("rank = 1").select(
        *keys, F.col("corridors").alias("_seq"), F.col("density").alias("best_density"), F.col("secs").alias("_secs"), F.col("route_text").alias("best_route")
    )
    joined = routes.join(best, keys)
    other = F.when((F.col("rank") > 1) & (F.col("corridors") != F.col("_seq")), F.struct("density", "rank", "secs", "route_text"))
    out = joined.groupBy(*keys, "best_density", "_secs", "best_route").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct(F.when(F.size("corridors") > 0, F.col("corridors"))).alias("sequences"), F.min(other).alias("alt")
    )
    delta = F.col("best_density") - F.col("alt.density")
    kind = (
        F.when(F.col("candidates") < 2, "D").when(F.col("sequences") < 2, "A").when(F.col("alt").isNull(), "A")
        .when(delta > C.DELTA_SEVERE, "C").when(delta >= C.DELTA_MILD, "B").otherwise("A")
    )
    typed = out.withColumn("scenario_type", kind)
    shown = (F.col("candidates") >= 2) & (F.col("sequences") >= 2) & F.col("alt").isNotNull()
    pick = lambda c: F.when(shown, c)
    return typed.select(
        *keys, "scenario_type", "candidates", "sequences", pick(F.col("best_density")).alias("best_density"), pick(F.col("alt.density")).alias("alt_density"),
        pick(delta).alias("delta"), pick((F.col("alt.secs") - F.col("_secs")) / 60).alias("time_penalty"), pick(F.col("best_route")).alias("best_route"),
        pick(F.col("alt.route_text")).alias("alt_route"),
    )


def type_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("scenario_type").agg(F.count(F.lit(1)).alias("n"))


def classify_vehicles(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Vehicle-level conflict per leg: C' severe, B' conflict, D' none.

    ``candidates`` has keys, instance_id, eta_min, density.
    """
    first = candidates.groupBy(*keys).agg(F.min(F.struct("eta_min", "instance_id", "density")).alias("e"), F.count(F.lit(1)).alias("n"))
    joined = candidates.join(first, keys)
    emptier = F.when(
        (F.col("instance_id") != F.col("e.instance_id")) & (F.col("density") <= C.BUS_EMPTY) & (F.col("density") < F.col("e.density")),
        F.struct("density", "eta_min"),
    )
    out = joined.groupBy(*keys, "e", "n").agg(F.min(emptier).alias("alt"), F.round(F.max("density") - F.min("density"), 3).alias("spread"))
    crowded = F.col("e.density") >= C.BUS_CROWDED
    conflict = (F.col("n") >= 2) & crowded & F.col("alt").isNotNull()
    delta = F.round(F.col("e.density") - F.col("alt.density"), 3)
    kind = F.when(conflict & (delta >= 0.50), "C'").when(conflict, "B'").otherwise("D'")
    why = (
        F.when(F.col("n") < 2, "fewer_than_two").when(conflict, "crowded_first_empty_later").when(F.col("spread") < C.BUS_SIMILAR, "all_similar").otherwise("no_conflict")
    )
    return out.select(
        *keys, kind.alias("scenario_type"), why.alias("why"), F.col("e.density").alias("first_density"), F.when(conflict, F.col("alt.density")).alias("later_density"),
        F.when(conflict, delta).alias("delta"), F.when(conflict, F.col("alt.eta_min") - F.col("e.eta_min")).alias("wait_min"), "spread",
    )


def diversity(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate count, distinct corridor sequences and paths, and the ranges of length and density.

    ``runs`` follows from ``signature`` (equal paths have equal corridors), so equal paths are put together first, then equal
    sequences: rows are never multiplied to count two things.
    """
    ranges = [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in ("meters", "density") for f in (F.min, F.max)]
    paths = routes.groupBy(*keys, "signature").agg(
        F.first("runs").alias("runs"), F.count(F.lit(1)).alias("candidates"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("meters", "density") for f in (F.min, F.max)]
    )
    sequences = paths.groupBy(*keys, "runs").agg(F.sum("candidates").alias("candidates"), F.count("signature").alias("signatures"), *ranges)
    return sequences.groupBy(*keys).agg(F.sum("candidates").alias("candidates"), F.count("runs").alias("corridor_sequences"), F.sum("signatures").alias("signatures"), *ranges)


def success_summary(rows: DataFrame, keys: list[str], tolerance: float = C.TOLERANCE) -> DataFrame:
    """Win counts and rates against both baselines, mean gain and mean extra waits."""
    win1, win2 = F.col("delta_v1") > tolerance, F.col("delta_v2") > tolerance
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(win1).alias("wins_v1"), F.count_if(win2).alias("wins_v2"), none(F.avg("delta_v1")).alias("mean_delta_v1"),
        none(F.avg("extra_wait")).alias("mean_wait"), none(F.avg(F.when(win1, F.col("extra_wait")))).alias("mean_wait_wins"),
    ).withColumn("win_rate_v1", F.col("wins_v1") / F.col("n")).withColumn("win_rate_v2", F.col("wins_v2") / F.col("n"))


def largest_deltas(catalog: DataFrame, keep: int = 2, order: str = "seen") -> DataFrame:
    """The scenarios with the largest density delta per type; equal deltas keep the one seen first."""
    w = Window.partitionBy("scenario_type").orderBy(F.desc(F.coalesce(F.col("delta"), F.lit(0.0))), order)
    return catalog.filter(F.col("scenario_type").isin("A", "B", "C", "D")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def sensitivity_plan(catalog: DataFrame, replications: int = 500) -> DataFrame:
    """Two scenarios per type times the weight sets, one row per run to make."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ["label", "time", "distance", "transfer", "density"])]) for row in C.WEIGHT_SETS])
    chosen = largest_deltas(catalog)
    return chosen.withColumn("w", F.explode(sets)).select(
        "scenario_type", "origin", "destination", "rank", F.col("w.label").alias("weight_label"), F.col("w.time").alias("w_time"),
        F.col("w.distance").alias("w_distance"), F.col("w.transfer").alias("w_transfer"), F.col("w.density").alias("w_density"), F.lit(replications).alias("replications"),
        F.concat_ws("_", "scenario_type", "origin", "destination", "w.label").alias("label"),
    )


def closest_candidates(scored: DataFrame, keys: list[str], keep: int = 20) -> DataFrame:
    """Pairs whose second-best score is close to the best one and whose densities differ most."""
    best = scored.groupBy(*keys).agg(
        F.min("primary_score").alias("b"), F.count(F.lit(1)).alias("n"), (F.max("density") - F.min("density")).alias("density_gap"),
        F.min(F.struct("primary_score", "candidate")).alias("first"),
    ).filter("n >= 2")
    floor = F.greatest(F.abs(F.col("b")), F.lit(1e-9))
    gap = scored.join(best, keys).filter(F.col("candidate") != F.col("first.candidate")).groupBy(*keys, "density_gap", "n").agg(
        F.min(F.abs(F.col("primary_score") - F.col("b")) / floor).alias("score_gap")
    )
    return gap.orderBy(F.desc(F.col("score_gap") <= 0.15), F.desc(F.round("density_gap", 9)), F.round("score_gap", 9), *keys).limit(keep)


def wait_margins(rows: DataFrame, windows: list[int], ratio: float) -> DataFrame:
    """For every wait window whether the density advantage outweighs the wait."""
    first = rows.groupBy("leg").agg(F.min(F.struct("eta_min", "instance_id", "density")).alias("e"))
    advantage = F.col("e.density") - F.col("density")
    best = rows.join(first, "leg").groupBy("leg", "e").agg(
        F.max(F.struct(advantage.alias("advantage"), (-F.col("eta_min")).alias("_neg"), "density", "instance_id")).alias("b")
    )
    wait = -F.col("b._neg") - F.col("e.eta_min")
    out = best.select("leg", F.col("e.density").alias("base_density"), F.col("b.density").alias("best_density"), wait.alias("wait_min"), F.col("b.advantage").alias("advantage"))
    for w in windows:
        out = out.withColumn(f"flips_wait{w}", (F.col("advantage") - ratio * (F.col("wait_min") / w) > 0) & (F.col("advantage") > 0.01))
    return out


def plan_labels(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Marks the fastest and the emptiest plan where there is more than one; ties go to the first."""
    best = routes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("minutes", "candidate")).alias("fast"), F.min(F.struct("density", "candidate")).alias("empty")
    )
    labelled = lambda field, text: F.when((F.col("n") >= 2) & (F.col("candidate") == F.col(f"{field}.candidate")), text)
    return routes.join(best, keys).select(
        *keys, "candidate", F.array_join(F.array_compact(F.array(labelled("fast", "Tercepat"), labelled("empty", "Paling lega"))), ",").alias("labels")
    )


def final_comparison(rows: DataFrame, segment_stats: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline against recommended density per scenario, with the segment of highest deviation.

    Means that differ only by the order in which they were summed count as equal.
    """
    top = segment_stats.groupBy(*keys).agg(
        F.min_by(F.struct("segment", "mean", "std"), F.struct(-F.round("std", 9), F.col("segment"))).alias("s")
    )
    base = rows.groupBy(*keys).agg(F.avg("baseline").alias("b"), F.avg("recommended").alias("r"))
    return base.join(top, keys).select(
        *keys, F.col("b").alias("baseline_density"), F.col("r").alias("recommended_density"), (F.col("b") - F.col("r")).alias("delta_density"),
        (F.round(F.col("b") - F.col("r"), 12) > 0).alias("is_better"), F.col("s.segment").alias("top_segment"), F.col("s.mean").alias("segment_mean"), F.col("s.std").alias("segment_std"),
    )


def success_rows(pairs: DataFrame, steps: DataFrame, recommended: DataFrame, visits: DataFrame, loads: DataFrame, second: int, eta_minutes: int = C.MAX_ETA_MINUTES,
                 settings: list[tuple[int, int, float]] | None = None) -> DataFrame:
    """Success of the recommendation per pair (and setting) against two baselines on the shortest route.

    V1 boards the earliest vehicle of every leg at the start time; V2 chooses vehicles by density. Legs of different pairs that
    board at the same stop of a line are one boarding. Pairs without a route keep nulls and a reason.
    """
    from transitloom.operators import choice, routes as R

    base = steps.filter("candidate = 1")
    legs = R.route_legs(base).filter("kind = 'segmen'").withColumnRenamed("density", "edge_density").withColumn("clock", F.lit(second).cast("bigint"))
    keys = ["od_id"]
    place = ["corridor_id", "board_stop", "clock"]
    reach, longest = eta_minutes, None
    if settings is not None:
        legs, pairs = choice.with_settings(legs, settings), choice.with_settings(pairs, settings)
        keys, place = [*keys, *choice.SETTING], [*place, "eta_minutes"]
        reach, longest = F.col("eta_minutes"), max(e for _, e, _ in settings)
    options = choice.boarding_candidates(legs.select(*place).distinct(), visits, loads, place, reach, longest=longest)
    first = options.groupBy(*place).agg(F.min_by("density", F.struct("eta_min", "instance_id")).alias("density"))
    v1 = legs.join(first, place, "left").groupBy(*keys).agg(F.avg(F.coalesce("density", "edge_density")).alias("v1"))
    v2 = recommended.filter("candidate = 1").select(*keys, F.col("route_density").alias("v2"), F.col("route_text").alias("base_text"))
    top = recommended.filter("final_rank = 1").select(*keys, F.col("route_density").alias("rec"), F.col("mean_extra_wait").alias("extra_wait"), "route_text")
    joined = pairs.join(v1, keys, "left").join(v2, keys, "left").join(top, keys, "left")
    delta = lambda a: F.round(F.col(a) - F.col("rec"), 4)
    return joined.select(
        *keys, F.round("v1", 4).alias("d_base_v1"), F.round("v2", 4).alias("d_base_v2"), F.round("rec", 4).alias("d_rec"), delta("v1").alias("delta_v1"),
        delta("v2").alias("delta_v2"), F.round("extra_wait", 3).alias("extra_wait"), (F.col("base_text") != F.col("route_text")).alias("route_changed"),
        F.when(F.col("rec").isNull(), "no_route").alias("reason"),
    )


def config_sweep(pairs: DataFrame, steps: DataFrame, visits: DataFrame, loads: DataFrame, second: int) -> DataFrame:
    """Win rates of the success configurations: one plan with the setting as a key; equal settings are evaluated once."""
    from transitloom.operators import choice

    settings = sorted({tuple(row[1:]) for row in C.SUCCESS_CONFIGS})
    chosen = choice.recommend(steps, visits, loads, second, settings=settings)
    per_setting = success_summary(success_rows(pairs, steps, chosen, visits, loads, second, settings=settings), choice.SETTING)
    names = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(w).alias("w"), F.lit(e).alias("e"), F.lit(d).alias("d")) for n, w, e, d in C.SUCCESS_CONFIGS])
    same = lambda x: (x["w"] == F.col("extra_minutes")) & (x["e"] == F.col("eta_minutes")) & (x["d"] == F.col("density_weight"))
    out = per_setting.withColumn("c", F.explode(F.filter(names, same)))
    shown = ["mean_delta_v1", "mean_wait", "mean_wait_wins", "win_rate_v1", "win_rate_v2"]
    return out.select(
        F.col("c.config").alias("config"), "extra_minutes", "eta_minutes", "density_weight", "n", "wins_v1", "wins_v2", *[F.round(s, 4).alias(s) for s in shown], (F.col("win_rate_v1") >= 0.5).alias("passes_half")
    )


def routing_sensitivity(steps: DataFrame, visits: DataFrame, loads: DataFrame, second: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Per pair over the replications: paired comparison, route stability and rank correlation.

    Candidate routes do not depend on density, so they are searched once. Each replication scores them
    with its own mean density per line, then chooses vehicles by their loads and ranks again.
    """
    from transitloom.operators import choice, resample
    from transitloom.session import cut

    means = loads.groupBy("replication", "corridor_id").agg(clamp_load(F.avg("load")).alias("density"))
    ranked = cut(choice.recommend(steps, visits, loads, second, load_keys=["replication"], weights=weights, line_means=means))
    keys = ["od_id"]
    base = ranked.filter("candidate = 1").select(*keys, "replication", F.col("route_density").alias("baseline"), F.col("route_text").alias("base_text"), F.col("secs").alias("base_secs"))
    top = ranked.filter("final_rank = 1").select(*keys, "replication", F.col("route_density").alias("recommended"), F.col("route_text").alias("signature"), "secs")
    paired = base.join(top, [*keys, "replication"]).withColumn("changed", F.col("base_text") != F.col("signature")).withColumn("extra_secs", F.col("secs") - F.col("base_secs"))
    orders = ranked.groupBy(*keys, "replication").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "route_text"))), lambda x: x["route_text"]).alias("ranking")
    )
    compared = resample.paired_comparison(paired, keys)
    stable = resample.route_stability(top, keys)
    corr = resample.rank_correlation(orders, keys)
    # Worse by more than rounding; how often the shortest route is among the candidates at all.
    worse = paired.groupBy(*keys).agg(F.count_if(F.col("baseline") - F.col("recommended") < -0.01).alias("worse"), F.count(F.lit(1)).alias("with_baseline"))
    joined = compared.join(stable, keys, "left").join(corr, keys, "left").join(worse, keys, "left")
    doubles = [n for n, t in joined.dtypes if t == "double"]
    return joined.select([F.round(n, 6).alias(n) if n in doubles else F.col(n) for n in joined.columns])
