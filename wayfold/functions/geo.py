"""Distances on the sphere, and made-up places of stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; a fixed value of the reference.
EARTH_RADIUS = 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def made_up_place(k: Column) -> tuple[Column, Column]:
    """(lat, lon) of number k, spread over ten kilometres."""
    return F.lit(18.9) + ((7 * k * k + 37 * k) % 1009) / 1009.0 * 0.1, F.lit(72.8) + ((11 * k * k + 53 * k) % 997) / 997.0 * 0.1


def cell(lat: Column, lon: Column, metres: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are at least so wide up to 60 degrees of latitude."""
    step = metres / 111_000.0
    return F.floor(lat / step).cast("long"), F.floor(lon / (2 * step)).cast("long")


#: Shared by SQL statements: the same distance.
SQL_MACRO = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return SQL_MACRO.format(a=a)
