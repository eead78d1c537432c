"""Live vehicle messages: parsing, validation, schedules, comparison with the static network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transitloom.functions.geo import distance_m
from transitloom.functions.scalar import squeeze

MESSAGE = (
    "route_code STRING, bus_body_no STRING, trip_id STRING, latitude STRING, longitude STRING, bearing STRING, eta STRING, "
    "stops ARRAY<STRUCT<name: STRING, stop_id: STRING, parent_stop_id: STRING, eta: INT>>"
)


def decoded(messages: DataFrame) -> DataFrame:
    return messages.withColumn("m", F.from_json("payload", MESSAGE))


def parse_messages(messages: DataFrame, routes: Column | None = None) -> DataFrame:
    """Usable vehicle records: known route, numeric coordinates, the first stop with an ETA is next."""
    rows = decoded(messages)
    lat, lng = F.col("m.latitude").try_cast("double"), F.col("m.longitude").try_cast("double")
    known = routes if routes is not None else F.lit(True)
    ahead = F.filter("m.stops", lambda s: s["eta"].isNotNull())
    kept = rows.withColumn("lat", lat).withColumn("lng", lng).filter(
        F.col("m.route_code").isNotNull() & known & F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("m.bus_body_no").isNotNull()
    )
    return kept.withColumn("ahead", ahead).select(
        "event_id", "ms", F.trim("m.bus_body_no").alias("bus_id"), F.trim("m.route_code").alias("corridor_id"), "lat", "lng",
        F.coalesce(F.col("m.bearing").try_cast("int"), F.lit(0)).alias("bearing"), F.coalesce(F.get("ahead", F.lit(0))["name"], F.lit("")).alias("next_stop"),
        F.coalesce(F.col("m.eta").try_cast("int"), F.lit(0)).alias("eta_min"), F.coalesce("m.trip_id", F.lit("")).alias("trip_id"), F.col("ahead").alias("stops"),
    )


def validate_messages(messages: DataFrame) -> DataFrame:
    """Range check per message; a bad message never rejects its batch. ``problem`` is null for good ones."""
    rows = decoded(messages)
    lat, lng = F.col("m.latitude").try_cast("double"), F.col("m.longitude").try_cast("double")
    number = lambda f: F.col(f"m.{f}").try_cast("int")
    outside = lambda c, low, high: c.isNotNull() & ~c.between(low, high)
    problem = (
        F.when(F.coalesce("m.route_code", F.lit("")) == "", "route_code").when(F.coalesce("m.bus_body_no", F.lit("")) == "", "bus_body_no")
        .when(lat.isNull() | ~lat.between(-7.0, -5.8), "latitude").when(lng.isNull() | ~lng.between(106.2, 107.4), "longitude")
        .when(outside(number("bearing"), 0, 360), "bearing").when(outside(number("eta"), 0, 1440), "eta")
        .when(F.exists("m.stops", lambda s: s["eta"].isNotNull() & ~s["eta"].between(0, 1440)), "stop_eta")
    )
    return rows.withColumn("problem", problem).drop("m")


def live_schedule(vehicles: DataFrame, stops: DataFrame, now_secs: int) -> DataFrame:
    """Remaining stops of live vehicles on static stops: stop id first, then parent id; unknown stops drop out."""
    rows = vehicles.select("bus_id", "corridor_id", F.posexplode("stops").alias("pos", "s")).select(
        "bus_id", "corridor_id", "pos", "s.stop_id", "s.parent_stop_id", F.col("s.eta").alias("eta")
    )
    known = stops.select("stop_id")
    direct = rows.join(known.select(F.col("stop_id").alias("_own")), F.col("stop_id") == F.col("_own"), "left")
    both = direct.join(known.select(F.col("stop_id").alias("_parent")), F.col("parent_stop_id") == F.col("_parent"), "left")
    return both.withColumn("halte_id", F.coalesce("_own", "_parent")).filter("halte_id IS NOT NULL").select(
        "bus_id", "corridor_id", "pos", F.col("halte_id").alias("stop_id"), (F.lit(now_secs) + F.col("eta") * 60).alias("arr")
    )


def live_stops(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stops by id, stops by parent id, stop ids per route) seen in messages; the first sighting describes a stop."""
    rows = decoded(messages).select("event_id", F.col("m.route_code").alias("route"), F.explode("m.stops").alias("s"), F.col("m.latitude").try_cast("double").alias("lat"), F.col("m.longitude").try_cast("double").alias("lng"))
    rows = rows.select("event_id", "route", "s.stop_id", "s.parent_stop_id", "s.name", "lat", "lng")
    info = F.struct("event_id", "name", "lat", "lng")
    by_id = rows.filter("stop_id IS NOT NULL").groupBy("stop_id").agg(F.min(info).alias("i")).select("stop_id", "i.name", "i.lat", "i.lng")
    by_parent = rows.filter("parent_stop_id IS NOT NULL").groupBy(F.col("parent_stop_id").alias("stop_id")).agg(F.min(info).alias("i")).select("stop_id", "i.name", "i.lat", "i.lng")
    both = rows.select(F.coalesce("route", F.lit("")).alias("route"), F.explode(F.array_compact(F.array("stop_id", "parent_stop_id"))).alias("stop_id")).distinct()
    return by_id, by_parent, both


def match_stops(static: DataFrame, by_id: DataFrame, by_parent: DataFrame, far_m: float = 50.0) -> DataFrame:
    """How each static stop is found in the live data, how far apart they are and whether the names differ."""
    side = lambda df, p: df.select("stop_id", *[F.col(c).alias(f"{p}_{c}") for c in ["name", "lat", "lng"]], F.lit(True).alias(f"{p}_hit"))
    joined = static.join(side(by_id, "a"), "stop_id", "left").join(side(by_parent, "b"), "stop_id", "left")
    pick = lambda c: F.when(F.col("a_hit"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    match = F.when(F.col("a_hit"), "stop_id").when(F.col("b_hit"), "parent_stop_id").otherwise("tidak_ada")
    meters = distance_m(F.col("lat"), F.col("lng"), pick("lat"), pick("lng"))
    found = F.col("a_hit") | F.col("b_hit")
    return joined.select(
        "stop_id", match.alias("match"), F.round(meters, 1).alias("meters"), F.when(found, F.coalesce(meters > far_m, F.lit(False))).alias("far"),
        F.when(found, squeeze(F.col("name")) != squeeze(pick("name"))).alias("name_differs"),
    )


def corridor_coverage(members: DataFrame, live: DataFrame) -> DataFrame:
    """Static against live stops per corridor: both, only static, only live, share of static stops served."""
    a = members.select("corridor_id", "stop_id").distinct().withColumn("s", F.lit(1))
    b = live.select(F.col("route").alias("corridor_id"), "stop_id").distinct().withColumn("l", F.lit(1))
    lines = members.select("corridor_id").distinct()
    rows = a.join(b.join(lines, "corridor_id", "left_semi"), ["corridor_id", "stop_id"], "full")
    out = rows.groupBy("corridor_id").agg(
        F.count("s").alias("static_stops"), F.count("l").alias("live_stops"), F.count_if(F.col("s").isNotNull() & F.col("l").isNotNull()).alias("both"),
        F.count_if(F.col("l").isNull()).alias("only_static"), F.count_if(F.col("s").isNull()).alias("only_live"),
    )
    share = F.when(F.col("static_stops") > 0, F.round(100 * F.col("both") / F.col("static_stops"), 1))
    return out.withColumn("in_live", F.col("live_stops") > 0).withColumn("percent_served", F.when(F.col("in_live"), share))
