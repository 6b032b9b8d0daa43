"""Geodesic and planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius (km), metres in a foot, nautical miles in a kilometre.
EARTH_KM = 6371.0
FOOT_M = 0.3048
NM_PER_KM = 0.539957


def distance_km(lat1: Column, lon1: Column, alt1: Column, lat2: Column, lon2: Column, alt2: Column) -> Column:
    """Slant range: haversine ground distance and the difference of altitudes (m)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    ground = 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    return F.sqrt(F.pow(ground, 2) + F.pow((alt2 - alt1) / 1000, 2))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    x, y = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return (F.degrees(F.atan2(x, y)) + 360) % 360


# distance_km and bearing_deg in steps, for pairs of places whose sines and cosines are known: a step that is a column of its
# own is computed once, and the code generated for a pair stays small enough to be compiled


def half_sine(a: Column, b: Column) -> Column:
    """Sine of half the angle between two latitudes or longitudes."""
    return F.sin((F.radians(b) - F.radians(a)) / 2)


def ground_km(half_lat: Column, half_lon: Column, cos1: Column, cos2: Column) -> Column:
    """Haversine ground distance. Squares are products, which no library rounds otherwise."""
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(half_lat * half_lat + cos1 * cos2 * (half_lon * half_lon))))


def slant_km(ground: Column, up: Column) -> Column:
    """Slant range of a ground distance and a difference of altitudes, both in kilometres."""
    return F.sqrt(ground * ground + up * up)


def turned_deg(sin1: Column, cos1: Column, lon1: Column, sin2: Column, cos2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 180 to 540."""
    d = F.radians(lon2) - F.radians(lon1)
    return F.degrees(F.atan2(F.sin(d) * cos2, cos1 * sin2 - sin1 * cos2 * F.cos(d))) + 360


def once_round(b: Column) -> Column:
    """0 to 360 of 0 to 720: the difference is exact, so it is the remainder."""
    return F.when(b >= 360, b - 360).otherwise(b)


def rounded(c: Column, digits: int) -> Column:
    """Rounded to a whole number of units of the last digit, halves away from zero, as SQL over doubles does: without the
    decimal text that ``round`` goes through. Numbers of 1e9 or more, and what is no number, stay as they are."""
    unit = F.lit(10.0**digits)
    return F.when(~(F.abs(c) < 1e9), c).when(c < 0, -F.floor(0.5 - c * unit) / unit).otherwise(F.floor(c * unit + 0.5) / unit)


def planar_bearing_deg(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clockwise from north (+y), 0 to 360."""
    b = F.degrees(F.atan2(x2 - x1, y2 - y1))
    return F.when(b < 0, b + 360).otherwise(b)


def turn_command(current: Column, target: Column) -> Column:
    """Signed turn (right positive): none within 5 degrees, 30 up to 45 degrees, else 60."""
    d = target - current
    d = F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    size = F.when(F.abs(d) > 45, 60).otherwise(30)
    return F.when(F.abs(d) < 5, F.lit("")).otherwise(F.concat(F.lit("turn "), F.when(d > 0, size).otherwise(-size).cast("string")))


def altitude_command(z: Column, climb: Column) -> Column:
    """Climb if asked to or below 1000, descend above 8000."""
    return F.when(climb | (z < 1000), "up 100").when(z > 8000, "up -100").otherwise("")
