"""Audit reports on timetable generation: counts, warnings, vehicle spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.functions.geo import distance_m
from transitloom.operators.lookup import active_at
from transitloom.operators.ordered import exact_quantiles, previous_row
from transitloom.session import cut

LINE = ["corridor_id", "direction_id"]


def generation_audit(patterns: DataFrame, selected: DataFrame, instances: DataFrame, times=C.SAMPLE_TIMES) -> DataFrame:
    """Per corridor-direction: raw rows, patterns, departures before merging, instances, active counts."""
    before = F.ceil((F.col("end_sec") - F.col("start_sec")) / F.col("headway"))
    pre = patterns.groupBy(*LINE).agg(
        F.sum("raw_rows").alias("raw_rows"), F.count(F.lit(1)).alias("patterns"), F.sum(before).alias("departures_before")
    )
    chosen = selected.groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("selected"), F.round(F.max(F.col("duration") / F.col("service_headway")), 6).alias("top_active")
    )
    counts = instances.groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("instances"),
        *[F.count_if((F.col("first_dep") <= s) & (s < F.col("last_arr"))).alias(f"active_{label}") for label, s in times],
    )
    joined = pre.join(chosen, LINE, "left").join(counts, LINE, "left")
    return joined.fillna(0, ["instances", *[f"active_{label}" for label, _ in times]])


def top_contributors(selected: DataFrame, keep: int = 10) -> DataFrame:
    """Patterns that put most vehicles on the road, per corridor-direction."""
    load = F.col("duration") / F.col("service_headway")
    w = Window.partitionBy(*LINE).orderBy(F.desc("estimated_active"), "service_headway", "trip_id")
    return selected.withColumn("estimated_active", load).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def merge_warnings(patterns: DataFrame, ranked: DataFrame, instances: DataFrame, low: int = 40, high: int = 180) -> DataFrame:
    """Rule rows (rule, subject, value) for suspicious merge results."""
    from transitloom.operators.timetable import merge_groups

    line = F.concat_ws("/", *LINE)
    before = patterns.groupBy(*LINE).agg(F.sum(F.col("duration") / F.col("headway")).alias("before"))
    after = ranked.filter("preference = 1").groupBy(*LINE).agg(
        F.sum(F.col("duration") / F.col("service_headway")).alias("after"), F.count(F.lit(1)).alias("n")
    )
    both = before.join(after, LINE, "left")
    share = F.coalesce("after", F.lit(0.0)) / F.col("before")
    groups = merge_groups(ranked)

    def rule(rows: DataFrame, name: str, subject, value) -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), subject.alias("subject"), value.cast("double").alias("value"))

    trip = F.col("rep_trip")
    parts = [
        rule(both.filter("n IS NULL"), "zero_selected_representative_patterns", line, F.lit(0.0)),
        rule(both.filter((F.col("before") > 0) & (share < 0.20)), "active_trip_instances_drop_gt_80pct_estimated", line, share),
        rule(groups.filter("rep_ratio < 0.8D"), "selected_representative_low_segment_match_ratio", trip, F.col("rep_ratio")),
        rule(groups.filter("rep_stops < discarded_max_stops * 0.75D"), "selected_representative_shorter_than_discarded", trip, F.col("rep_stops")),
        rule(groups.filter("better_discarded > 0"), "discarded_pattern_has_better_segment_match_ratio", trip, F.col("better_discarded")),
    ]
    totals = instances.agg(*[F.count_if((F.col("first_dep") <= s) & (s < F.col("last_arr"))).alias(label) for label, s in C.SAMPLE_TIMES])
    per_time = totals.select(F.explode(F.array(*[F.struct(F.lit(label).alias("time"), F.col(label).alias("n")) for label, _ in C.SAMPLE_TIMES])).alias("t")).select("t.*")
    parts.append(rule(per_time.filter((F.col("n") < low) | (F.col("n") > high)), "total_active_trip_instances_outside_sanity_range", F.col("time"), F.col("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spacing_gaps(states: DataFrame) -> DataFrame:
    """Gap of every active vehicle to the one behind it, per time and corridor-direction.

    Vehicles are ordered inside progress cells of one percent; only the last vehicle of each cell is
    carried to the next cell.
    """
    keys = ["time", *LINE]
    cells = cut(states.withColumn("_cell", F.floor("progress")))
    linked = previous_row(cells, keys, ["progress", "departure", "instance_id"], "_cell", ["progress", "departure", "lat", "lng", "instance_id"])
    return linked.select(
        *keys, "instance_id", F.col("prev.instance_id").alias("behind"),
        (F.col("progress") - F.col("prev.progress")).alias("progress_gap"),
        F.abs(F.col("departure") - F.col("prev.departure")).alias("departure_gap"),
        distance_m(F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng")).alias("distance_gap"),
    )


def spacing_summary(gaps: DataFrame) -> DataFrame:
    keys = ["time", *LINE]
    base = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("active"), F.min("progress_gap").alias("min_progress_gap"), F.min("departure_gap").alias("min_departure_gap"),
        F.min("distance_gap").alias("min_distance_gap"), F.count_if(F.col("progress_gap") < 1.0).alias("close_progress"),
        F.count_if(F.col("departure_gap") < 120).alias("close_departure"),
    )
    fields = ["progress_gap", "departure_gap", "distance_gap"]
    # The three measures are stacked, so one pass finds all medians.
    stacked = gaps.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(f).alias("measure"), F.col(f).cast("double").alias("v")) for f in fields])).alias("m")
    ).select(*keys, "m.*")
    medians = exact_quantiles(stacked, [*keys, "measure"], "v", {"median": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == f, F.col("median"))).alias(f"median_{f}") for f in fields]
    )
    return base.join(medians, keys, "left")


def closest_pairs(gaps: DataFrame, keep: int = 5) -> DataFrame:
    w = Window.partitionBy("time", *LINE).orderBy(F.round("progress_gap", 9), "departure_gap", "instance_id")
    return gaps.filter("behind IS NOT NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def active_counts(instances: DataFrame, times=C.SAMPLE_TIMES) -> DataFrame:
    return active_at(instances, times).groupBy("time", *LINE).agg(F.count(F.lit(1)).alias("active"))
