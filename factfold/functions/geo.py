"""Positions and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def within_radius(df: DataFrame, lat: float | None, lon: float | None, radius_m: float | None,
                  lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows with a position inside the circle, with ``distance_m``; inactive unless all three are given.

    A latitude band goes first: it is a plain range predicate, so it reaches the scan.
    """
    if lat is None or lon is None or not radius_m:
        return df
    band = math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001
    distance = haversine_m(F.lit(float(lat)), F.lit(float(lon)), F.col(lat_col), F.col(lon_col))
    near = df.filter(F.col(lat_col).between(lat - band, lat + band))
    return (near.withColumn("_d", distance).filter(F.col("_d") <= radius_m)
            .withColumn("distance_m", F.round("_d", 1)).drop("_d"))


def resolve_location(df: DataFrame, zone_coords: DataFrame) -> DataFrame:
    """Explicit position, else the zone's, else null. ``zone_coords``: zone, zone_lat, zone_lon."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    known = F.col("zone_lat").isNotNull() & F.col("zone_lon").isNotNull()
    located = (F.when(both, F.struct(F.col("lat"), F.col("lon")))
               .when(known, F.struct(F.col("zone_lat").alias("lat"), F.col("zone_lon").alias("lon"))))
    return df.join(zone_coords, "zone", "left").withColumn("location", located).drop("zone_lat", "zone_lon")
