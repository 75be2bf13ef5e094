"""Distances, drive-time estimates and simple polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import CIRCUITY, EARTH_RADIUS_KM, URBAN_KMH


def _hav(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    return s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance, arcsine form (used by the drive-time matrix)."""
    return F.lit(EARTH_RADIUS_KM * 2) * F.asin(F.sqrt(_hav(lon1, lat1, lon2, lat2)))


def great_circle_km_atan2(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance, two-argument arctangent form (used by the what-if)."""
    a = _hav(lon1, lat1, lon2, lat2)
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def drive_seconds(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Estimated urban drive time in whole seconds: circuity over mean speed."""
    km = great_circle_km(lon1, lat1, lon2, lat2)
    return (km * CIRCUITY / URBAN_KMH * 3600).cast("int")


def planar_d2(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Squared planar distance in degrees, for argmin only."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def circle_ring(lon: Column, lat: Column, radius_m: Column, steps: int = 64) -> Column:
    """Closed ring of ``steps`` + 1 points at ``radius_m`` metres around a point."""
    km = radius_m / 1000.0
    two_pi = 2 * F.pi()

    def vertex(i: Column) -> Column:
        angle = i / F.lit(float(steps)) * two_pi
        d_lat = km / 111.32 * F.cos(angle)
        d_lon = km / (F.lit(111.32) * F.cos(lat * F.pi() / 180)) * F.sin(angle)
        return _point(lon + d_lon, lat + d_lat)

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), vertex)


def degree_buffer_ring(lon: Column, lat: Column, radius_deg: Column, per_quarter: int = 32) -> Column:
    """Closed ring at a planar radius in degrees, clockwise from due east."""
    n = 4 * per_quarter

    def vertex(i: Column) -> Column:
        angle = -(i / F.lit(float(n))) * 2 * F.pi()
        return _point(lon + radius_deg * F.cos(angle), lat + radius_deg * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), vertex)


def ring_wkt(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("MULTIPOLYGON((("), F.array_join(points, ", "), F.lit(")))"))
