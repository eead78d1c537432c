"""Timetable expansion: frequencies x trips x stop times to trip instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.functions.scalar import normal_id, service_seconds
from transitloom.functions.sequences import overlap_ratio
from transitloom.operators.components import connected_groups
from transitloom.operators.ordered import number_rows
from transitloom.session import cut

PATTERN_KEY = ["corridor_id", "direction_id", "signature", "start_sec", "end_sec", "headway"]


def check_frequencies(frequencies: DataFrame, trips: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every frequency row with parsed times and a ``verdict`` (``ok`` or the reason for rejection)."""
    owners = trips.select(
        "trip_id",
        normal_id(F.col("route_id")).alias("corridor_id"),
        F.coalesce(F.col("direction_id").cast("string"), F.lit("0")).alias("direction_id"),
    )
    rows = frequencies.join(owners, "trip_id", "left").select(
        "trip_id",
        "corridor_id",
        "direction_id",
        service_seconds(F.col("start_time")).alias("start_sec"),
        service_seconds(F.col("end_time")).alias("end_sec"),
        F.col("headway_secs").try_cast("int").alias("headway"),
    )
    in_scope = F.col("corridor_id").isin(scope) if scope else F.lit(True)
    verdict = (
        F.when(F.col("corridor_id").isNull(), "unknown_trip")
        .when(~in_scope, "out_of_scope")
        .when(F.col("start_sec").isNull() | F.col("end_sec").isNull() | F.col("headway").isNull(), "invalid_value")
        .when((F.col("headway") <= 0) | (F.col("end_sec") <= F.col("start_sec")), "invalid_range")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict)


def valid_frequencies(frequencies: DataFrame, trips: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return check_frequencies(frequencies, trips, scope).filter("verdict = 'ok'").drop("verdict")


def template_stops(stop_times: DataFrame, stops: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Stop rows of usable trips. One bad row or fewer than two stops rejects the whole trip."""
    rows = stop_times.join(allowed.select("stop_id").distinct(), "stop_id", "left_semi") if allowed else stop_times
    rows = rows.join(stops.select("stop_id", "name", "lat", "lng"), "stop_id", "left").select(
        "trip_id",
        F.col("stop_sequence").cast("int").alias("seq"),
        "stop_id",
        "name",
        "lat",
        "lng",
        service_seconds(F.col("arrival_time")).alias("arr"),
        service_seconds(F.col("departure_time")).alias("dep"),
    )
    trip = Window.partitionBy("trip_id")
    good = F.col("lat").isNotNull() & F.col("arr").isNotNull() & F.col("dep").isNotNull()
    ordered = Window.partitionBy("trip_id").orderBy("seq")
    return (
        rows.withColumn("_good", F.min(good).over(trip))
        .withColumn("_n", F.count(F.lit(1)).over(trip))
        .filter(F.col("_good") & (F.col("_n") >= 2))
        .withColumn("pos", F.row_number().over(ordered))
        .drop("_good", "_n")
    )


def hop_pairs(template: DataFrame) -> DataFrame:
    """Consecutive stop pairs of every trip (``pos`` is the position of the first stop)."""
    w = Window.partitionBy("trip_id").orderBy("pos")
    return (
        template.select(
            "trip_id", "pos", F.col("stop_id").alias("from_stop"), "dep", F.lead("stop_id").over(w).alias("to_stop"),
            F.lead("arr").over(w).alias("next_arr"),
        )
        .filter(F.col("to_stop").isNotNull())
    )


def match_segments(template: DataFrame, trips: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment of every hop; a trip without any match gets all segments of its corridor, flagged.

    Matched and missing hops keep their pair position, so a missing hop never shifts the others.
    """
    owners = trips.select("trip_id", normal_id(F.col("route_id")).alias("corridor_id"))
    known = segments.select("corridor_id", "from_stop", "to_stop", "segment_id")
    hops = hop_pairs(template).join(owners, "trip_id").join(known, ["corridor_id", "from_stop", "to_stop"], "left")
    per_trip = hops.groupBy("trip_id", "corridor_id").agg(
        F.count("segment_id").alias("matched"), F.count(F.lit(1)).alias("pairs")
    )
    hops = hops.join(per_trip, ["trip_id", "corridor_id"]).withColumn("fallback", F.lit(False))
    unmatched = per_trip.filter("matched = 0").join(known, "corridor_id").withColumn("pos", F.lit(None).cast("int"))
    columns = ["trip_id", "corridor_id", "pos", "from_stop", "to_stop", "segment_id", "matched", "pairs", "fallback"]
    return hops.select(columns).unionByName(unmatched.withColumn("fallback", F.lit(True)).select(columns))


def match_summary(matched: DataFrame) -> DataFrame:
    return matched.groupBy("trip_id", "corridor_id").agg(
        F.max("matched").alias("matched"),
        F.max("pairs").alias("pairs"),
        (F.max("pairs") - F.max("matched")).alias("missing"),
        (F.max("matched") == 0).alias("used_fallback"),
        (F.max("matched") / F.max("pairs")).alias("match_ratio"),
    )


def service_patterns(frequencies: DataFrame, template: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per distinct (corridor, direction, stop sequence, window, headway); duplicates counted.

    The trip with the smallest id stands for the duplicates.
    """
    shapes = template.groupBy("trip_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias("signature"),
        F.min_by("dep", "pos").alias("first_dep"),
        F.max_by("arr", "pos").alias("last_arr"),
    )
    rows = frequencies.join(shapes, "trip_id").join(summary.select("trip_id", "match_ratio"), "trip_id")
    picked = rows.groupBy(*PATTERN_KEY).agg(
        F.min(F.struct("trip_id", "first_dep", "last_arr", "match_ratio")).alias("kept"),
        F.count(F.lit(1)).alias("raw_rows"),
    )
    return picked.select(
        *PATTERN_KEY,
        "kept.trip_id",
        (F.col("kept.last_arr") - F.col("kept.first_dep")).alias("duration"),
        F.col("kept.first_dep").alias("first_dep"),
        "kept.match_ratio",
        F.size("signature").alias("stop_count"),
        "raw_rows",
        F.concat_ws("|", "kept.trip_id", "start_sec", "end_sec", "headway").alias("pattern_id"),
    )


def _needed(length: Column, threshold: float) -> Column:
    return F.ceil(length * threshold - 1e-9)


def overlapping_signatures(patterns: DataFrame, threshold: float = C.OVERLAP_THRESHOLD) -> DataFrame:
    """Pairs of distinct stop sequences of a corridor-direction whose ordered overlap reaches the threshold.

    Two sequences can only qualify when one of the rarest ``n - ceil(threshold * n) + 1`` stops of the
    shorter one occurs in the other, so candidates come from an equi-join on those rare stops; the
    longest-common-subsequence check runs on the candidates only.
    """
    group = ["corridor_id", "direction_id"]
    nodes = patterns.groupBy(*group, "signature").agg(F.min("pattern_id").alias("node"))
    tokens = nodes.select(*group, "node", F.size("signature").alias("n"), F.explode(F.array_distinct("signature")).alias("stop"))
    rarity = tokens.groupBy(*group, "stop").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy(*group, "node").orderBy("uses", "stop")
    prefix = (
        tokens.join(rarity, [*group, "stop"])
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= F.col("n") - _needed(F.col("n"), threshold) + 1)
        .select(*group, "stop", F.col("node").alias("short"), F.col("n").alias("n_short"))
    )
    longer = tokens.select(*group, "stop", F.col("node").alias("long"), F.col("n").alias("n_long"))
    candidates = (
        prefix.join(longer, [*group, "stop"])
        .filter((F.col("n_short") < F.col("n_long")) | ((F.col("n_short") == F.col("n_long")) & (F.col("short") < F.col("long"))))
        .select("short", "long")
        .distinct()
    )
    body = nodes.select("node", "signature")
    return (
        candidates.join(body.select(F.col("node").alias("short"), F.col("signature").alias("sig_short")), "short")
        .join(body.select(F.col("node").alias("long"), F.col("signature").alias("sig_long")), "long")
        .withColumn("overlap", overlap_ratio(F.col("sig_short"), F.col("sig_long")))
        .filter(F.col("overlap") >= threshold)
    )


def relate(sig_a: Column, sig_b: Column, overlap: Column, threshold: float = C.OVERLAP_THRESHOLD) -> Column:
    """Merge decision for a pair of stop sequences."""
    ratio = F.least(F.size(sig_a), F.size(sig_b)) / F.greatest(F.size(sig_a), F.size(sig_b))
    same_ends = (F.get(sig_a, F.lit(0)) == F.get(sig_b, F.lit(0))) & (F.element_at(sig_a, -1) == F.element_at(sig_b, -1))
    return (
        F.when(overlap < threshold, "kept_separate_low_overlap")
        .when(ratio < 0.80, "kept_separate_as_possible_subroute")
        .when(same_ends, "duplicate_mergeable")
        .otherwise("kept_separate_different_endpoints")
    )


def group_patterns(patterns: DataFrame, threshold: float = C.OVERLAP_THRESHOLD) -> DataFrame:
    """Adds ``group_id``: patterns of a corridor-direction linked, directly or not, by overlap."""
    links = overlapping_signatures(patterns, threshold).select(F.col("short").alias("a"), F.col("long").alias("b"))
    nodes = patterns.groupBy("corridor_id", "direction_id", "signature").agg(F.min("pattern_id").alias("node"))
    groups = connected_groups(nodes.select("node"), links)
    return patterns.join(nodes, ["corridor_id", "direction_id", "signature"]).join(groups, "node").withColumnRenamed(
        "label", "group_id"
    ).drop("node")


def rank_members(grouped: DataFrame) -> DataFrame:
    """Marks the representative of each overlap group (``preference`` 1) and adds the group's headway.

    The best member is a map-side combinable minimum, so a very large group is never sorted.
    """
    order = F.struct(
        -F.col("match_ratio"), -F.col("stop_count"), "headway", -F.col("duration"), "trip_id", "start_sec", "end_sec", "pattern_id"
    )
    best = grouped.groupBy("group_id").agg(
        F.min_by("pattern_id", order).alias("_best"),
        F.min("headway").alias("service_headway"),
        F.count(F.lit(1)).alias("members"),
    )
    return grouped.join(best, "group_id").withColumn(
        "preference", F.when(F.col("pattern_id") == F.col("_best"), 1).otherwise(2)
    ).drop("_best")


def merge_groups(ranked: DataFrame) -> DataFrame:
    """One row per overlap group: representative, members, discarded trips, overlaps and the reason."""
    best = ranked.filter("preference = 1").select(
        "group_id", "corridor_id", "direction_id", F.col("trip_id").alias("rep_trip"), F.col("pattern_id").alias("rep_pattern"),
        F.col("signature").alias("rep_signature"), F.col("headway").alias("rep_headway"), "service_headway", "members",
        F.col("match_ratio").alias("rep_ratio"), F.col("stop_count").alias("rep_stops"), F.col("duration").alias("rep_duration"),
    )
    joined = ranked.drop("corridor_id", "direction_id", "service_headway", "members").join(best, "group_id")
    tie_ratio = F.col("match_ratio") == F.col("rep_ratio")
    tie_stops = tie_ratio & (F.col("stop_count") == F.col("rep_stops"))
    tie_headway = tie_stops & (F.col("headway") == F.col("rep_headway"))
    per_group = joined.groupBy(
        "group_id", "corridor_id", "direction_id", "rep_trip", "rep_pattern", "rep_headway", "service_headway", "members",
        "rep_ratio", "rep_stops", "rep_duration",
    ).agg(
        F.min("match_ratio").alias("_low_ratio"),
        F.min(F.when(tie_ratio, F.col("stop_count"))).alias("_low_stops"),
        F.max(F.when(tie_stops, F.col("headway"))).alias("_high_headway"),
        F.min(F.when(tie_headway, F.col("duration"))).alias("_low_duration"),
        F.max(F.when(F.col("preference") > 1, F.col("stop_count"))).alias("discarded_max_stops"),
        F.count_if((F.col("preference") > 1) & (F.col("match_ratio") > F.col("rep_ratio") + 0.05)).alias("better_discarded"),
        F.min(F.when(F.col("preference") > 1, overlap_ratio(F.col("rep_signature"), F.col("signature")))).alias("lowest_overlap"),
        F.array_sort(F.collect_set("headway")).alias("member_headways"),
    )
    reason = (
        F.when(F.col("members") == 1, "only pattern in overlap group")
        .when(F.col("rep_ratio") > F.col("_low_ratio"), "selected because highest segment_match_ratio")
        .when(F.col("rep_stops") > F.col("_low_stops"), "selected because same match ratio but highest stop_count")
        .when(F.col("rep_headway") < F.col("_high_headway"), "selected because same match ratio/stop_count but lower headway_secs")
        .when(F.col("rep_duration") > F.col("_low_duration"), "selected because same match/headway but longest trip_duration_seconds")
        .otherwise("selected by deterministic trip_id tie-break")
    )
    return per_group.withColumn("reason", reason).drop("_low_ratio", "_low_stops", "_high_headway", "_low_duration")


def selected_patterns(ranked: DataFrame) -> DataFrame:
    """Representatives with their index in the corridor-direction and the departure offset."""
    order = Window.partitionBy("corridor_id", "direction_id").orderBy("start_sec", "end_sec", "service_headway", "trip_id", "pattern_id")
    whole = Window.partitionBy("corridor_id", "direction_id")
    chosen = (
        ranked.filter("preference = 1")
        .withColumn("pattern_index", F.row_number().over(order) - 1)
        .withColumn("group_count", F.count(F.lit(1)).over(whole))
    )
    offset = F.when(
        F.col("group_count") > 1,
        F.bround(F.col("pattern_index") * F.col("service_headway") / F.col("group_count"), 0).cast("int"),
    ).otherwise(0)
    chosen = chosen.withColumn("offset", offset)
    span = F.col("end_sec") - F.col("start_sec") - F.col("offset")
    chosen = chosen.withColumn("departures", F.greatest(F.lit(0), F.ceil(span / F.col("service_headway"))).cast("bigint"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return chosen.withColumn("first_number", F.coalesce(F.sum("departures").over(before), F.lit(0)) + 1)


def trip_instances(selected: DataFrame) -> DataFrame:
    """One row per departure. Numbers come from per-pattern counts, so no window spans the instances."""
    rows = selected.filter("departures > 0 AND duration > 0").select(
        "corridor_id", "direction_id", "trip_id", "pattern_id", "first_dep", "duration", "service_headway", "start_sec", "offset",
        "first_number", F.explode(F.sequence(F.lit(0), F.col("departures") - 1)).alias("i"),
    )
    departure = (F.col("start_sec") + F.col("offset") + F.col("i") * F.col("service_headway")).cast("bigint")
    number = (F.col("first_number") + F.col("i")).cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return rows.select(
        F.concat_ws("-", F.lit("BUS"), "corridor_id", "direction_id", padded).alias("instance_id"),
        "corridor_id", "direction_id", "trip_id", "pattern_id",
        departure.alias("departure"),
        (departure - F.col("first_dep")).alias("shift"),
        departure.alias("first_dep"),
        (departure + F.col("duration")).alias("last_arr"),
    )


def instance_stops(instances: DataFrame, template: DataFrame) -> DataFrame:
    """Shifted stop times of every instance (join on the trip, which bounds the fan-out)."""
    return instances.select("instance_id", "corridor_id", "direction_id", "trip_id", "departure", "shift").join(
        template.select("trip_id", "pos", "stop_id", "name", "lat", "lng", F.col("arr").alias("_a"), F.col("dep").alias("_d")), "trip_id"
    ).select(
        "instance_id", "corridor_id", "direction_id", "trip_id", "departure", "pos", "stop_id", "name", "lat", "lng",
        (F.col("_a") + F.col("shift")).alias("arr"), (F.col("_d") + F.col("shift")).alias("dep"),
    )


def template_hops(template: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Hops of every trip with departure, next arrival and (when ``matched`` is given) the segment; times of the template."""
    w = Window.partitionBy("trip_id").orderBy("pos")
    hops = template.select(
        "trip_id", "pos", F.col("stop_id").alias("from_stop"), "name", "lat", "lng", "arr", "dep",
        *[F.lead(c).over(w).alias(n) for c, n in [("stop_id", "to_stop"), ("name", "to_name"), ("lat", "to_lat"), ("lng", "to_lng"), ("arr", "next_arr")]],
        (F.count(F.lit(1)).over(Window.partitionBy("trip_id")) - 1).alias("pairs"),
    ).filter(F.col("to_stop").isNotNull())
    if matched is None:
        return hops
    keyed = matched.filter("NOT fallback").select("trip_id", "pos", "segment_id")
    return hops.join(keyed, ["trip_id", "pos"], "left")


def instance_hops(instances: DataFrame, hops: DataFrame) -> DataFrame:
    """The hops of ``template_hops`` shifted to every instance, so no window spans the instances' stops."""
    shifted = {c: F.col(c) + F.col("shift") for c in ["arr", "dep", "next_arr"]}
    rows = instances.select("instance_id", "corridor_id", "direction_id", "trip_id", "departure", "shift").join(hops, "trip_id")
    return rows.withColumns(shifted).drop("shift")


def hop_times(stop_times: DataFrame, trips: DataFrame, order: str) -> DataFrame:
    """Positive hop times: the first trip's value per pair, and the rounded corridor mean."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    hops = stop_times.select(
        "trip_id", F.col("stop_sequence").alias("seq"), F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"),
        (F.lead(service_seconds(F.col("arrival_time"))).over(w) - service_seconds(F.col("departure_time"))).alias("secs"),
    ).filter("to_stop IS NOT NULL AND secs > 0")
    owned = hops.join(trips.select("trip_id", normal_id(F.col("route_id")).alias("corridor_id"), F.col(order).alias("_o")), "trip_id")
    pairs = owned.groupBy("corridor_id", "from_stop", "to_stop").agg(
        F.min_by("secs", F.struct("_o", "seq")).alias("first_secs"), F.count(F.lit(1)).alias("trips"), F.sum("secs").alias("_s")
    )
    # The corridor mean comes from the pair totals; they are written once, so the hops are read and
    # shuffled a single time.
    pairs = cut(pairs)
    means = pairs.groupBy("corridor_id").agg(F.bround(F.sum("_s") / F.sum("trips"), 0).cast("int").alias("mean_secs"))
    return pairs.drop("_s").join(means, "corridor_id")


def mainline_trips(trips: DataFrame, long_name: Column, plain: list[Column], order: str) -> DataFrame:
    """One trip per corridor and direction: best tier of the corridor, exact name, then shortest name.

    ``plain`` lists the conditions of the tiers in order of preference; trips that meet none form the
    last tier, used only where a corridor has nothing better.
    """
    tier = F.lit(len(plain))
    for i, condition in reversed(list(enumerate(plain))):
        tier = F.when(condition, i).otherwise(tier)
    name = F.lower(F.trim("short_name"))
    scored = trips.withColumn("_tier", tier).withColumn(
        "_score", F.struct(F.when(name == long_name, 0).otherwise(1).alias("exact"), F.length(name).alias("n"), F.col(order).alias("o"))
    )
    best_tier = scored.groupBy("corridor_id").agg(F.min("_tier").alias("_tier"))
    row = F.struct(*[F.col(c) for c in trips.columns if c not in ("corridor_id", "direction_id")])
    return (
        scored.join(best_tier, ["corridor_id", "_tier"])
        .groupBy("corridor_id", "direction_id").agg(F.min_by(row, "_score").alias("_t"))
        .select("corridor_id", "direction_id", "_t.*")
    )


def corridor_stop_order(trips: DataFrame, stop_times: DataFrame, order: str) -> DataFrame:
    """Distinct stops per corridor in order of first appearance; ``order`` is a numeric trip order."""
    seen = stop_times.join(trips.select("trip_id", "corridor_id", F.col(order).alias("_o")), "trip_id").groupBy("corridor_id", "stop_id").agg(
        F.min(F.struct("_o", "stop_sequence")).alias("_first")
    )
    # Numbered inside ranges of the trip order, so a corridor with very many stops is not sorted at once.
    ranged = seen.withColumn("_b", F.floor(F.col("_first._o") / 4096))
    return number_rows(ranged, ["corridor_id"], ["_first"], "_b", "seq").select("corridor_id", "stop_id", "seq")
