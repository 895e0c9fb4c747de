"""Great-circle distance and coordinate checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null where any input is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def valid_coordinates(lat: Column, lon: Column, zero_is_valid: bool = False) -> Column:
    """Both present and within range; (0, 0) is no place unless ``zero_is_valid``. Never null."""
    ok = lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
    if not zero_is_valid:
        ok = ok & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))
