"""Great-circle distance as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0


def _central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two points in radians; null if any coordinate is null."""
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / F.lit(2.0)
    half_dlon = (F.radians(lon2) - F.radians(lon1)) / F.lit(2.0)
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlon) * F.sin(half_dlon)
    # rounding may push the chord of antipodes just above one
    chord = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2.0) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(EARTH_RADIUS_KM) * _central_angle(lat1, lon1, lat2, lon2)


def arc_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.degrees(_central_angle(lat1, lon1, lat2, lon2))
