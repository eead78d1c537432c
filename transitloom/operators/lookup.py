"""Time-point lookups on trip instances: active, current segment, position, next arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.functions.geo import bearing
from transitloom.functions.scalar import clamp_load, minutes


def at_times(df: DataFrame, times: list[tuple[str, int]], start: Column, end: Column) -> DataFrame:
    """One row per (row, time) with ``start <= time < end``.

    The times are a literal array filtered per row, so no join and no nested loop is planned.
    """
    points = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(s).cast("bigint").alias("second")) for label, s in times])
    hits = F.filter(points, lambda p: (start <= p["second"]) & (p["second"] < end))
    return df.withColumn("_t", F.explode(hits)).select("*", F.col("_t.label").alias("time"), F.col("_t.second").alias("second")).drop("_t")


def active_at(instances: DataFrame, times: list[tuple[str, int]]) -> DataFrame:
    return at_times(instances, times, F.col("first_dep"), F.col("last_arr"))


def current_hops(hops: DataFrame, times: list[tuple[str, int]]) -> DataFrame:
    return at_times(hops, times, F.col("dep"), F.col("next_arr"))


def vehicle_states(visits: DataFrame, hops: DataFrame, times: list[tuple[str, int]]) -> DataFrame:
    """Position and progress of every active vehicle; while dwelling it stays at the latest reached stop."""
    moving = current_hops(hops, times)
    part = F.when(F.col("next_arr") == F.col("dep"), 0.0).otherwise((F.col("second") - F.col("dep")) / (F.col("next_arr") - F.col("dep")))
    moving = moving.select(
        "time", "second", "instance_id", "corridor_id", "direction_id", "trip_id", "departure", "from_stop", "to_stop",
        ((F.col("pos") - 1 + part) / F.col("pairs") * 100).alias("progress"),
        (F.col("lat") + (F.col("to_lat") - F.col("lat")) * part).alias("lat"),
        (F.col("lng") + (F.col("to_lng") - F.col("lng")) * part).alias("lng"),
    )
    # A dwell is the half-open span between arrival and departure at a stop that is neither first nor last.
    dwell = at_times(hops.filter("pos > 1"), times, F.col("arr"), F.col("dep")).select(
        "time", "second", "instance_id", "corridor_id", "direction_id", "trip_id", "departure", "from_stop", "to_stop",
        ((F.col("pos") - 1) / F.col("pairs") * 100).alias("progress"), "lat", "lng",
    )
    return moving.unionByName(dwell)


def positions(hops: DataFrame, times: list[tuple[str, int]], loads: DataFrame, visible: int | None = None) -> DataFrame:
    """Interpolated vehicle positions with bearing, next stop, ETA and load."""
    moving = current_hops(hops, times)
    part = F.when(F.col("next_arr") == F.col("dep"), 0.0).otherwise((F.col("second") - F.col("dep")) / (F.col("next_arr") - F.col("dep")))
    placed = moving.select(
        "time", "instance_id", "corridor_id", "direction_id", "trip_id",
        (F.col("lat") + (F.col("to_lat") - F.col("lat")) * part).alias("lat"),
        (F.col("lng") + (F.col("to_lng") - F.col("lng")) * part).alias("lng"),
        bearing(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")).alias("bearing"),
        F.col("to_name").alias("next_stop"),
        minutes(F.col("next_arr") - F.col("second")).alias("eta_min"),
    )
    out = placed.join(loads.select("instance_id", "load"), "instance_id", "left").withColumn("load", clamp_load(F.col("load")))
    if visible:
        w = Window.partitionBy("time", "corridor_id", "direction_id").orderBy("eta_min", "instance_id")
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= visible).drop("_r")
    return out


def next_arrivals(visits: DataFrame, loads: DataFrame, times: list[tuple[str, int]], window_secs: int = C.MAX_ETA_MINUTES * 60, limit: int = 500) -> DataFrame:
    """For every stop: the next vehicle of each corridor within the window, nearest corridors first.

    The first qualifying visit per vehicle and the first vehicle per corridor are one map-side
    combinable minimum: the earliest arrival of a corridor is the first visit of its vehicle.
    """
    due = at_times(visits, times, F.col("arr") - window_secs, F.col("arr") + 1)
    joined = due.join(loads.select("instance_id", "load", "passengers"), "instance_id", "left")
    first = joined.groupBy("time", "second", "stop_id", "corridor_id").agg(
        F.min(F.struct("arr", "instance_id", "trip_id", "load", "passengers")).alias("best")
    )
    w = Window.partitionBy("time", "stop_id").orderBy("eta_secs", "corridor_id")
    out = first.select(
        "time", "stop_id", "corridor_id", F.col("best.instance_id").alias("instance_id"), F.col("best.trip_id").alias("trip_id"),
        (F.col("best.arr") - F.col("second")).alias("eta_secs"), clamp_load(F.col("best.load")).alias("load"),
        F.coalesce(F.col("best.passengers"), F.lit(C.DENSITY_FALLBACK * C.BUS_CAPACITY)).alias("passengers"),
    )
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def live_pick(instances: DataFrame, corridor: str, direction: str, second: int) -> DataFrame:
    """The instance that stands for the camera vehicle: active first, then the earliest departure."""
    ahead = instances.filter((F.col("corridor_id") == corridor) & (F.col("direction_id") == direction) & (F.col("last_arr") > second))
    return ahead.agg(
        F.min(F.struct((F.col("first_dep") > second).alias("later"), "departure", "instance_id")).alias("best")
    ).select(F.col("best.instance_id").alias("instance_id"))


def fresh_reading(readings: DataFrame, now_ms: Column, ttl_ms: int = C.LIVE_TTL_SECS * 1000) -> DataFrame:
    """The newest head count, or no row when it is older than ``ttl_ms`` at ``now_ms`` (an aggregate over the readings)."""
    newest = readings.agg(F.max(F.struct("ms", "event_id", "passengers")).alias("n"), now_ms.alias("now"))
    return newest.filter(F.col("now") - F.col("n.ms") <= ttl_ms).select("n.passengers")


def overlay_live(loads: DataFrame, picked: DataFrame, reading: DataFrame) -> DataFrame:
    """Replaces the modelled load of the picked instance by the live head count, when there is a fresh one."""
    # Both inputs are single rows; stacking them avoids a join without a key.
    one = picked.select("instance_id", F.lit(None).cast("double").alias("live")).unionByName(
        reading.select(F.lit(None).cast("string").alias("instance_id"), F.col("passengers").cast("double").alias("live"))
    )
    live = one.agg(F.max("instance_id").alias("instance_id"), F.max("live").alias("live")).filter("instance_id IS NOT NULL AND live IS NOT NULL")
    joined = loads.join(live, "instance_id", "left")
    return joined.select(
        "instance_id", "corridor_id",
        F.coalesce(F.col("live") / C.BUS_CAPACITY, "load").alias("load"),
        F.coalesce("live", "passengers").alias("passengers"),
        F.when(F.col("live").isNotNull(), "cv_live").otherwise("generated").alias("data_source"),
    )


SLOT_SECS = 1800


def next_trip(requests: DataFrame, instances: DataFrame, template: DataFrame, hops: DataFrame) -> DataFrame:
    """Next boardable trip per request (stop, next stop, corridor, ready second), three tiers.

    Tier 1 needs the exact hop, tier 2 the stop on the corridor, tier 3 any later departure of the corridor. ``template`` and
    ``hops`` hold the stops and hops of trips, not of instances: a request meets the few trips of its corridor that serve it, and
    each of them is a forward as-of search over the instances of that trip. These are kept per (trip, time slot) as a sorted
    array with the first instance of all later slots, so a request looks into one row per trip and tier.
    """
    trip = ["corridor_id", "trip_id"]
    slot = F.floor(F.col("shift") / SLOT_SECS)
    cells = instances.groupBy(*trip, slot.alias("slot")).agg(F.array_sort(F.collect_list(F.struct("shift", "instance_id"))).alias("own"))
    lines = cells.groupBy(*trip).agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    # Every slot between the first and the last of a trip is a row.
    frame = lines.select(*trip, F.explode(F.sequence("low", "high")).alias("slot")).join(cells, [*trip, "slot"], "left")
    after = Window.partitionBy(*trip).orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    frame = frame.withColumn("later", F.min(F.get("own", F.lit(0))).over(after))

    none = F.lit(None).cast("string").alias("trip_segment")
    served = lines.select(*trip, "low")
    exact = hops.select("trip_id", "from_stop", "to_stop", F.col("arr").alias("offset"), F.col("segment_id").alias("trip_segment")).join(served, "trip_id")
    at_stop = template.select("trip_id", F.col("stop_id").alias("from_stop"), F.col("arr").alias("offset"), none).join(served, "trip_id")
    starts = template.filter("pos = 1").select("trip_id", F.col("dep").alias("offset"), none).join(served, "trip_id")

    def asked(keys: list[str], places: DataFrame, tier: int) -> DataFrame:
        met = requests.join(places, keys).withColumn("need", F.col("ready") - F.col("offset"))
        return met.select("request_id", F.lit(tier).alias("tier"), *trip, "need", "offset", "trip_segment", F.greatest("low", F.floor(F.col("need") / SLOT_SECS)).alias("slot"))

    wanted = (
        asked(["corridor_id", "from_stop", "to_stop"], exact, 1)
        .unionByName(asked(["corridor_id", "from_stop"], at_stop, 2))
        .unionByName(asked(["corridor_id"], starts, 3))
    )
    hit = F.coalesce(F.get(F.filter("own", lambda i: i["shift"] >= F.col("need")), F.lit(0)), F.col("later"))
    hits = wanted.join(frame, [*trip, "slot"]).withColumn("hit", hit).filter("hit IS NOT NULL")
    found = hits.groupBy("request_id").agg(
        F.min(F.struct("tier", (F.col("offset") + F.col("hit.shift")).alias("at"), F.col("hit.instance_id").alias("instance_id"), "trip_segment")).alias("b")
    )
    return requests.join(found, "request_id", "left").select(
        *requests.columns, F.col("b.tier").alias("tier"), F.col("b.at").alias("at_sec"), F.col("b.instance_id").alias("instance_id"),
        F.coalesce(F.col("b.trip_segment"), F.col("segment_id")).alias("matched_segment"),
    )
