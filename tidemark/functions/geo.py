"""Positions as column expressions, and the measures between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude.
DEGREE = 111319.49079327358
COMPASS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def in_bounds(lat: Column, lng: Column) -> Column:
    """Inside 45..52, -130..-120, without the edge."""
    return (lat > 45) & (lat < 52) & (lng > -130) & (lng < -120)


def placeable(confidence: Column, lat: Column, lng: Column) -> Column:
    """An answer that gives a position: present, not "none", finite, in bounds."""
    return F.coalesce((confidence != "none") & ~F.isnan(lat) & ~F.isnan(lng) & in_bounds(lat, lng), F.lit(False))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Compass point from the first position to the second."""
    east = (lng2 - lng1) * F.cos(F.radians(lat1))
    degrees = F.degrees(F.atan2(east, lat2 - lat1))
    eighth = F.floor(F.pmod(degrees + 360, F.lit(360.0)) / 45 + 0.5) % 8
    return F.element_at(F.array(*map(F.lit, COMPASS)), eighth.cast("int") + 1)


def km_between(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular, by the first position's latitude."""
    x = F.radians(lng2 - lng1) * F.cos(F.radians(lat1))
    y = F.radians(lat2 - lat1)
    return F.lit(6371.0) * F.sqrt(x * x + y * y)
