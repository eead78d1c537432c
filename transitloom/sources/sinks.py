"""Outputs: CSV with a fixed column list, JSON documents, GeoJSON features, keyed upsert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly ``fields`` in order; columns the input lacks come out as nulls."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    with_columns(df, fields).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def point_feature(lng: Column, lat: Column, properties: dict[str, Column]) -> Column:
    """GeoJSON text of one point."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    named = F.struct(*[value.alias(name) for name, value in properties.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), named.alias("properties")))


def line_features(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """GeoJSON text of one line per key; a line needs two points. The group is one polyline."""
    lines = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "lng", "lat"))).alias("_p")).filter(F.size("_p") >= 2)
    coordinates = F.transform("_p", lambda p: F.array(p["lng"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    properties = F.struct(*[F.col(k) for k in keys])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return lines.select(*keys, F.size("_p").alias("n_points"), feature.alias("feature"))


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Batch form of a keyed upsert: the newest row of every key (map-side combinable)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def merge_upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State of a keyed table after applying ``changes``; the newest row per key wins."""
    return newest_per_key(current.unionByName(changes), keys, order)
