"""Geodesy as Column arithmetic (degrees in, metres or degrees out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371000


def _haversine_term(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = _haversine_term(lat1, lng1, lat2, lng2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def distance_asin_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(_haversine_term(lat1, lng1, lat2, lng2)))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial great-circle bearing, 0..360 from north."""
    dl = F.radians(lng2 - lng1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def flat_bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Flat-earth motion bearing in whole degrees; null when the fixes practically coincide."""
    dx = (lng2 - lng1) * F.cos((lat1 + lat2) / 2 * (math.pi / 180.0))
    dy = lat2 - lat1
    degrees = F.floor(F.atan2(dx, dy) * 180.0 / math.pi + 0.5).cast("int")
    return F.when(F.sqrt(dx * dx + dy * dy) >= 1e-6, F.pmod(degrees + 360, F.lit(360)))
