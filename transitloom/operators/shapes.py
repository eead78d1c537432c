"""Polyline operators: nearest point, slices per hop, position at a fraction, line prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom.functions.geo import bearing, distance_m, flat_bearing
from transitloom.operators.ordered import previous_row


def nearest_points(stops_on_shape: DataFrame, shapes: DataFrame) -> DataFrame:
    """Nearest shape point of every (shape, stop) row; the first one among equals."""
    joined = stops_on_shape.join(shapes.select("shape_id", "seq", F.col("lat").alias("plat"), F.col("lng").alias("plng")), "shape_id")
    meters = distance_m(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))
    near = joined.groupBy("shape_id", "stop_id").agg(F.min(F.struct(F.round(meters, 6).alias("meters"), "seq", "plat", "plng")).alias("b"))
    return near.select("shape_id", "stop_id", "b.seq", "b.meters", "b.plat", "b.plng")


def hop_slices(hops: DataFrame, stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """For every hop (corridor_id, from_stop, to_stop) the best shape of the corridor and the seq range.

    Score = squared coordinate error at both ends; a shape on which both stops fall on the same point
    does not count. ``reversed`` tells that the slice runs against the shape.
    """
    ends = hops.select("corridor_id", F.col("from_stop").alias("stop_id")).union(hops.select("corridor_id", "to_stop")).distinct()
    lines = shapes.select("corridor_id", "shape_id").distinct()
    wanted = ends.join(lines, "corridor_id").join(stops.select("stop_id", "lat", "lng"), "stop_id")
    joined = wanted.join(shapes.select("shape_id", "seq", F.col("lat").alias("plat"), F.col("lng").alias("plng")), "shape_id")
    dx, dy = F.col("plng") - F.col("lng"), F.col("plat") - F.col("lat")
    near = joined.groupBy("corridor_id", "shape_id", "stop_id").agg(F.min(F.struct(F.round(dx * dx + dy * dy, 12).alias("err"), "seq")).alias("b"))
    side = lambda p, key: near.select("corridor_id", "shape_id", F.col("stop_id").alias(key), F.col("b.seq").alias(f"{p}_seq"), F.col("b.err").alias(f"{p}_err"))
    pairs = hops.select("corridor_id", "from_stop", "to_stop").distinct().join(side("a", "from_stop"), ["corridor_id", "from_stop"]).join(
        side("b", "to_stop"), ["corridor_id", "shape_id", "to_stop"]
    ).filter("a_seq <> b_seq")
    score = F.round(F.col("a_err") + F.col("b_err"), 12)
    best = pairs.groupBy("corridor_id", "from_stop", "to_stop").agg(F.min(F.struct(score.alias("score"), "shape_id", "a_seq", "b_seq")).alias("s"))
    return best.select(
        "corridor_id", "from_stop", "to_stop", "s.shape_id", "s.a_seq", "s.b_seq", (F.col("s.a_seq") > F.col("s.b_seq")).alias("reversed")
    )


def slice_points(slices: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points of every slice in travel order (``step`` 0, 1, ...). One slice is one hop."""
    low, high = F.least("a_seq", "b_seq"), F.greatest("a_seq", "b_seq")
    joined = slices.join(shapes.select("shape_id", "seq", "lat", "lng"), "shape_id").filter((F.col("seq") >= low) & (F.col("seq") <= high))
    w = Window.partitionBy("corridor_id", "from_stop", "to_stop").orderBy(F.when(F.col("reversed"), -F.col("seq")).otherwise(F.col("seq")))
    return joined.withColumn("step", F.row_number().over(w) - 1).select("corridor_id", "from_stop", "to_stop", "shape_id", "step", "lat", "lng")


def _pieces(points: DataFrame, keys: list[str], order: str, length) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    pieces = points.select(
        *keys, F.col(order), "lat", "lng", F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2")
    ).filter("lat2 IS NOT NULL")
    pieces = pieces.withColumn("len", length(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("len").over(Window.partitionBy(*keys))
    return pieces.withColumn("walked", F.sum("len").over(run) - F.col("len")).withColumn("total", total)


def position_on_line(points: DataFrame, keys: list[str], order: str, fraction: Column) -> DataFrame:
    """Point and bearing at a fraction of every polyline; polylines without length give no row."""
    pieces = _pieces(points, keys, order, distance_m).filter("total > 0")
    target = F.greatest(F.lit(0.0), F.least(fraction, F.lit(1.0))) * F.col("total")
    hit = pieces.withColumn("target", target).groupBy(*keys).agg(
        F.min(F.when(F.round(F.col("walked") + F.col("len"), 6) >= F.round("target", 6), F.struct(order, "lat", "lng", "lat2", "lng2", "walked", "len", "target"))).alias("p"),
        F.max(F.struct(order, "lat", "lng", "lat2", "lng2")).alias("last"),
    )
    share = F.when(F.col("p.len") == 0, 0.0).otherwise((F.col("p.target") - F.col("p.walked")) / F.col("p.len"))
    at = lambda a, b: F.when(F.col("p").isNull(), F.col(f"last.{b}")).otherwise(F.col(f"p.{a}") + (F.col(f"p.{b}") - F.col(f"p.{a}")) * share)
    piece = F.coalesce(F.struct("p.lat", "p.lng", "p.lat2", "p.lng2"), F.struct("last.lat", "last.lng", "last.lat2", "last.lng2"))
    return hit.withColumn("_q", F.when(F.col("p").isNull(), F.struct("last.lat", "last.lng", "last.lat2", "last.lng2")).otherwise(piece)).select(
        *keys, at("lat", "lat2").alias("lat"), at("lng", "lng2").alias("lng"),
        bearing(F.col("_q.lat"), F.col("_q.lng"), F.col("_q.lat2"), F.col("_q.lng2")).alias("bearing"),
    )


def flat_length(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Length in degrees with longitudes shortened by the cosine of the first latitude."""
    dx, dy = (lng2 - lng1) * F.cos(F.radians(lat1)), lat2 - lat1
    return F.sqrt(dx * dx + dy * dy)


def line_prefix(points: DataFrame, keys: list[str], order: str, fraction: float) -> DataFrame:
    """First part of every line: whole pieces before the cut, and the piece that is cut at its exact point."""
    pieces = _pieces(points, keys, order, flat_length)
    target = F.lit(min(max(fraction, 0.0), 1.0)) * F.col("total")
    kept = pieces.withColumn("target", target).filter(F.col("walked") < F.col("target"))
    share = F.least(F.lit(1.0), (F.col("target") - F.col("walked")) / F.col("len"))
    return kept.select(
        *keys, order, "lat", "lng", (F.col("lat") + (F.col("lat2") - F.col("lat")) * share).alias("end_lat"),
        (F.col("lng") + (F.col("lng2") - F.col("lng")) * share).alias("end_lng"), (share < 1).alias("cut"),
    )


def fix_motion(fixes: DataFrame, key: str, jump_degrees: float = 0.02) -> DataFrame:
    """Movement between consecutive fixes: jump flag and motion bearing (none on jumps or standstill)."""
    hourly = fixes.withColumn("_hour", F.floor(F.col("ms") / 3600000))
    linked = previous_row(hourly, [key], ["ms", "event_id"], "_hour", ["lat", "lng"])
    dx, dy = F.col("lng") - F.col("prev.lng"), F.col("lat") - F.col("prev.lat")
    jump = F.sqrt(dx * dx + dy * dy) > jump_degrees
    return linked.select(
        "event_id", key, "ms", F.coalesce(jump, F.lit(False)).alias("jump"),
        F.when(~jump, flat_bearing(F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng"))).alias("bearing"),
    )
