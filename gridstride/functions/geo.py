"""Map projection, distances and small numeric helpers, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in metres, equator metres per pixel of a 256-pixel world.
EARTH_RADIUS_M, EQUATOR_M_PER_PX = 6371008.8, 156543.03392804097


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def world_x(lng: Column, z: Column, tile_px: float) -> Column:
    return (col(lng) + 180) / 360 * F.pow(F.lit(2.0), col(z)) * tile_px


def world_y(lat: Column, z: Column, tile_px: float) -> Column:
    s = F.sin(F.radians(col(lat)))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * F.pow(F.lit(2.0), col(z)) * tile_px


def lng_of(x: Column, z: Column, tile_px: float) -> Column:
    return col(x) / (F.pow(F.lit(2.0), col(z)) * tile_px) * 360 - 180


def lat_of(y: Column, z: Column, tile_px: float) -> Column:
    n = math.pi - 2 * math.pi * col(y) / (F.pow(F.lit(2.0), col(z)) * tile_px)
    return F.degrees(F.atan((F.exp(n) - F.exp(-n)) / 2))


def metres_per_pixel(lat: Column, z: Column, tile_px: float) -> Column:
    return EQUATOR_M_PER_PX * F.cos(F.radians(col(lat))) / F.pow(F.lit(2.0), col(z)) * (256 / tile_px)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(col(lat2) - col(lat1)) / 2), 2)
    b = F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(F.sin(F.radians(col(lng2) - col(lng1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a + b)))


def wrap_angle(a: Column) -> Column:
    """An angle in (-pi, pi]."""
    o = col(a) - 2 * math.pi * F.floor((col(a) + math.pi) / (2 * math.pi))
    return F.when(o <= -math.pi, o + 2 * math.pi).otherwise(o)


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(col(x) + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))
