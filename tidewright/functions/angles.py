"""Angles, great circles and the flat metric, as Column expressions. Angles are degrees, distances nautical miles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_NM, EARTH_M = 3440.065, 6_371_000.0


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm360(a: Column) -> Column:
    """Into [0, 360)."""
    return (a % 360 + 360) % 360


def norm180(a: Column) -> Column:
    """Into (-180, 180]."""
    n = norm360(a)
    return F.when(n > 180, n - 360).otherwise(n)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs((a - b + 540) % 360 - 180)


def angle_apart(a: Column, b: Column) -> Column:
    """The same for directions in [0, 360)."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def _central(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """The great circle's angle in radians."""
    half_lat, half_lon = F.radians(lat2 - lat) / 2, F.radians(lon2 - lon) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distance_nm(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_NM * _central(lat, lon, lat2, lon2)


def distance_m(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_M * _central(lat, lon, lat2, lon2)


def bearing(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """The course at the first point, in [0, 360)."""
    turn, p, q = F.radians(lon2 - lon), F.radians(lat), F.radians(lat2)
    east, north = F.sin(turn) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(turn)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def step_lat(lat: Column, course: Column, nm: Column) -> Column:
    return lat + nm * F.cos(F.radians(course)) / 60


def step_lon(lat: Column, lon: Column, course: Column, nm: Column) -> Column:
    return lon + nm * F.sin(F.radians(course)) / (60 * F.cos(F.radians(lat)))


def flat_course(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """The course that a step takes from one point to the other."""
    return norm360(F.degrees(F.atan2((lon2 - lon) * F.cos(F.radians(lat)), lat2 - lat)))


def flat_distance(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot((lat2 - lat) * 60, (lon2 - lon) * 60 * F.cos(F.radians(lat)))


def cross_track(lat_a, lon_a, lat_b, lon_b, lat_p, lon_p) -> Column:
    """Signed distance of p from the great circle a b; starboard is positive."""
    arc = _central(lat_a, lon_a, lat_p, lon_p)
    off = F.radians(bearing(lat_a, lon_a, lat_p, lon_p) - bearing(lat_a, lon_a, lat_b, lon_b))
    return F.when(arc == 0, F.lit(0.0)).otherwise(F.asin(clamp(F.sin(arc) * F.sin(off), -1.0, 1.0)) * EARTH_NM)


def along_track(lat_a, lon_a, lat_b, lon_b, lat_p, lon_p) -> Column:
    """Signed distance along a b to the foot of p."""
    arc = _central(lat_a, lon_a, lat_p, lon_p)
    off = F.radians(bearing(lat_a, lon_a, lat_p, lon_p) - bearing(lat_a, lon_a, lat_b, lon_b))
    side = F.asin(clamp(F.sin(arc) * F.sin(off), -1.0, 1.0))
    along = F.acos(clamp(F.cos(arc) / F.cos(side), -1.0, 1.0)) * EARTH_NM
    return F.when(arc == 0, F.lit(0.0)).otherwise(F.when(F.cos(off) < 0, -along).otherwise(along))


def point_segment_nm(lat_p, lon_p, lat_a, lon_a, lat_b, lon_b, lat0) -> Column:
    """Distance of p from the segment a b in the flat projection about lat0."""
    shrink = F.cos(F.radians(lat0))
    ax, ay = (lon_a - lon_p) * 60 * shrink, (lat_a - lat_p) * 60
    dx, dy = (lon_b - lon_a) * 60 * shrink, (lat_b - lat_a) * 60
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(clamp(F.try_divide(-(ax * dx + ay * dy), square), 0.0, 1.0))
    off_x, off_y = ax + t * dx, ay + t * dy
    return F.sqrt(off_x * off_x + off_y * off_y)  # not hypot, whose last digit is another


def lerp_direction(a: Column, b: Column, share: Column) -> Column:
    """Between two directions the shorter way."""
    return norm360(a + norm180(b - a) * share)
