"""Network construction: missing segments, stop aliases, edge weights, edges, route moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.functions.geo import distance_m
from transitloom.functions.scalar import base_name, is_numbered, normal_id, platform_name, service_seconds


def augment_segments(segments: DataFrame, members: DataFrame, stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments plus timetable pairs that were missing, memberships for stops that had none).

    A pair is added only when both stops exist and each stop is either without any corridor or
    already on this one. Travel time is timetable, else distance at 5 m/s, never below 30 s, else 60 s.
    """
    owned = stop_times.join(trips.select("trip_id", normal_id(F.col("route_id")).alias("corridor_id")), "trip_id")
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    hops = owned.select(
        "corridor_id", "trip_id", "stop_sequence", F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"),
        service_seconds(F.col("departure_time")).alias("dep"), F.lead(service_seconds(F.col("arrival_time"))).over(w).alias("arr"),
    ).filter("to_stop IS NOT NULL")
    first = hops.groupBy("corridor_id", "from_stop", "to_stop").agg(F.min(F.struct("trip_id", "stop_sequence", "dep", "arr")).alias("h"))
    missing = first.join(segments.select("corridor_id", "from_stop", "to_stop"), ["corridor_id", "from_stop", "to_stop"], "left_anti")
    lines = members.groupBy("stop_id").agg(F.collect_set("corridor_id").alias("lines"))
    place = stops.join(lines, "stop_id", "left").select("stop_id", "lat", "lng", "lines")
    side = lambda p: place.select(*[F.col(n).alias(f"{p}_{n}") for n in place.columns])
    joined = missing.join(side("a"), F.col("from_stop") == F.col("a_stop_id")).join(side("b"), F.col("to_stop") == F.col("b_stop_id"))
    allowed = lambda p: F.col(f"{p}_lines").isNull() | F.array_contains(F.col(f"{p}_lines"), F.col("corridor_id"))
    meters = distance_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    timetable = F.when(F.col("h.arr") > F.col("h.dep"), F.greatest(F.lit(30), F.col("h.arr") - F.col("h.dep")))
    by_distance = F.greatest(F.lit(30), F.bround(meters / 5.0, 0).cast("int"))
    added = joined.filter(allowed("a") & allowed("b")).select(
        F.concat_ws(":", F.lit("gtfs"), "corridor_id", "from_stop", "to_stop").alias("segment_id"), "corridor_id", "from_stop", "to_stop",
        F.coalesce(timetable, by_distance, F.lit(60)).cast("int").alias("secs"), F.lit("timetable").alias("origin"),
    )
    known = segments.select("segment_id", "corridor_id", "from_stop", "to_stop", "secs", F.lit("segments").alias("origin"))
    orphans = (
        owned.select("corridor_id", "stop_id").distinct()
        .join(members.select("stop_id").distinct(), "stop_id", "left_anti")
        .join(stops.select("stop_id"), "stop_id", "left_semi")
    )
    return known.unionByName(added), orphans.select("corridor_id", "stop_id")


def stop_aliases(stops: DataFrame, radius_m: float = C.STOP_ALIAS_RADIUS_M) -> DataFrame:
    """Platforms with the same name within the radius, the stop itself included, ranked by distance.

    The join key is the name and the coarse grid cell; the second side is copied to the neighbour
    cells, so a name shared by very many stops is still split by place.
    """
    cell = radius_m / 100000.0  # degrees; never smaller than the radius below 60 degrees latitude
    lng_cell = cell * 2
    named = stops.select("stop_id", "name", "lat", "lng", platform_name(F.col("name")).alias("key")).filter("key <> ''")
    gx, gy = F.floor(F.col("lng") / lng_cell), F.floor(F.col("lat") / cell)
    left = named.select("stop_id", "lat", "lng", "key", gx.alias("gx"), gy.alias("gy"))
    around = F.array(*[F.struct((gx + dx).alias("gx"), (gy + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    right = named.select(
        F.col("stop_id").alias("alias_id"), F.col("lat").alias("alat"), F.col("lng").alias("alng"), "key", F.explode(around).alias("g")
    ).select("alias_id", "alat", "alng", "key", "g.gx", "g.gy")
    pairs = left.join(right, ["key", "gx", "gy"]).withColumn(
        "meters", distance_m(F.col("lat"), F.col("lng"), F.col("alat"), F.col("alng"))
    ).filter(F.col("meters") <= radius_m)
    w = Window.partitionBy("stop_id").orderBy("meters", F.col("alias_id") != F.col("stop_id"), "alias_id")
    return pairs.select("stop_id", "alias_id", "meters", F.row_number().over(w).alias("rank"))


def hide_generic(stops: DataFrame, radius_m: float = C.NUMBERED_DUPLICATE_RADIUS_M) -> DataFrame:
    """Drops a stop with a plain name when a numbered stop of that name lies within the radius.

    Stops meet on name and grid cell, so a name that very many stops share is split by place.
    """
    cell = radius_m / 100000.0
    gx, gy = F.floor(F.col("lng") / (cell * 2)), F.floor(F.col("lat") / cell)
    around = F.array(*[F.struct((gx + dx).alias("gx"), (gy + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    plain = (~is_numbered(F.col("name"))) & (base_name(F.col("name")) == F.trim("name"))
    keyed = stops.withColumn("_key", F.lower(base_name(F.col("name")))).withColumn("_plain", plain)
    numbered = keyed.filter(is_numbered(F.col("name"))).select(F.col("_key").alias("_nkey"), F.col("lat").alias("_nlat"), F.col("lng").alias("_nlng"), F.explode(around).alias("_g")
    )
    keyed = keyed.withColumn("_gx", gx).withColumn("_gy", gy)
    near = (
        F.col("_plain") & (F.col("_key") == F.col("_nkey")) & (F.col("_gx") == F.col("_g.gx")) & (F.col("_gy") == F.col("_g.gy"))
        & (distance_m(F.col("lat"), F.col("lng"), F.col("_nlat"), F.col("_nlng")) <= radius_m)
    )
    return keyed.join(numbered, near, "left_anti").drop("_key", "_plain", "_gx", "_gy")


def edge_weights(segments: DataFrame, snapshot: DataFrame | None, corridor_means: DataFrame | None, corridor_mins: DataFrame | None) -> DataFrame:
    """Density per segment: its own value, else the corridor mean, else the corridor minimum, else the fallback."""
    out = segments
    tiers: list[Column] = []
    for i, (table, key) in enumerate([(snapshot, "segment_id"), (corridor_means, "corridor_id"), (corridor_mins, "corridor_id")]):
        if table is not None:
            out = out.join(table.select(key, F.col("density").alias(f"_d{i}")), key, "left")
            tiers.append(F.col(f"_d{i}"))
    return out.withColumn("density", F.coalesce(*tiers, F.lit(C.DENSITY_FALLBACK))).drop("_d0", "_d1", "_d2")


def network_edges(weighted: DataFrame, members: DataFrame, stops: DataFrame) -> DataFrame:
    """Segment edges, same-stop transfer edges and platform transfer edges."""
    at = lambda p: stops.select(F.col("stop_id").alias(f"{p}_id"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    rides = weighted.join(at("a"), F.col("from_stop") == F.col("a_id")).join(at("b"), F.col("to_stop") == F.col("b_id")).select(
        "from_stop", "to_stop", F.lit("segmen").alias("kind"), "segment_id", "corridor_id", F.col("secs").cast("int").alias("secs"),
        distance_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")).alias("meters"), "density",
    )
    lines = members.select("stop_id", "corridor_id").distinct()
    several = lines.groupBy("stop_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("stop_id")
    same = lines.join(several, "stop_id").select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), "corridor_id")
    platforms = stop_aliases(stops).filter("stop_id <> alias_id").join(
        lines.select(F.col("stop_id").alias("alias_id"), "corridor_id"), "alias_id"
    ).select(F.col("stop_id").alias("from_stop"), F.col("alias_id").alias("to_stop"), "corridor_id")
    transfers = same.unionByName(platforms).select(
        "from_stop", "to_stop", F.lit("transit").alias("kind"), F.lit(None).cast("string").alias("segment_id"), "corridor_id",
        F.lit(0).alias("secs"), F.lit(0.0).alias("meters"), F.lit(0.0).alias("density"),
    )
    return rides.unionByName(transfers)


def route_moves(edges: DataFrame) -> DataFrame:
    """Search steps: a ride, or a transfer together with the ride that must follow it.

    A transfer can neither follow another transfer nor end a route, so joining it to its ride keeps
    every legal route and leaves only states that were reached by riding.
    """
    edge = F.concat_ws("~", "from_stop", "to_stop", "kind", F.coalesce("segment_id", F.lit("")), "corridor_id").alias("edge_id")
    rides = edges.filter("kind = 'segmen'").select("from_stop", "to_stop", "segment_id", "corridor_id", "secs", edge)
    direct = rides.select(
        "from_stop", "to_stop", F.col("corridor_id").alias("corridor"), "segment_id", F.lit(0).alias("transfers"),
        F.col("secs").cast("bigint").alias("cost"), F.array("edge_id").alias("edges"),
    )
    change = edges.filter("kind = 'transit'").select(
        F.col("from_stop").alias("start"), F.col("to_stop").alias("from_stop"), "corridor_id", edge.alias("transfer_id")
    )
    composed = change.join(rides, ["from_stop", "corridor_id"]).select(
        F.col("start").alias("from_stop"), "to_stop", F.col("corridor_id").alias("corridor"), "segment_id", F.lit(1).alias("transfers"),
        (F.col("secs") + C.TRANSFER_PENALTY_SECS).cast("bigint").alias("cost"), F.array("transfer_id", "edge_id").alias("edges"),
    )
    return direct.unionByName(composed)
