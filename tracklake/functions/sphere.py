"""Geometry on the sphere as column expressions: degrees in, meters and radians out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean equatorial radius, sidereal day, rotation rate.
EARTH_RADIUS_METERS = 6_378_100.0
EARTH_DAY_SECONDS = 86_164.091
EARTH_ROTATION_RATE = 2 * math.pi / EARTH_DAY_SECONDS

Value = Column | str | float


def col(x: Value) -> Column:
    """A column, the column of that name, or a number."""
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(float(x))


def _square(x: Column) -> Column:
    return x * x


def haversine(lon1: Value, lat1: Value, lon2: Value, lat2: Value) -> Column:
    """Haversine of the angle between two points: grows with their distance, and is cheaper."""
    lon1, lat1, lon2, lat2 = (F.radians(col(x)) for x in (lon1, lat1, lon2, lat2))
    return F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))


def arc_length(h: Value) -> Column:
    """Meters of a haversine; rounding above half a circle is cut off."""
    return 2 * EARTH_RADIUS_METERS * F.asin(F.sqrt(F.when(col(h) > 1, 1.0).otherwise(col(h))))


def distance(lon1: Value, lat1: Value, lon2: Value, lat2: Value) -> Column:
    """Great-circle distance in meters (haversine); rounding above half a circle is cut off."""
    lon1, lat1, lon2, lat2 = (F.radians(col(x)) for x in (lon1, lat1, lon2, lat2))
    h = _square(F.sin((lat2 - lat1) / 2)) + F.cos(lat1) * F.cos(lat2) * _square(F.sin((lon2 - lon1) / 2))
    return 2 * EARTH_RADIUS_METERS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing(lon1: Value, lat1: Value, lon2: Value, lat2: Value) -> Column:
    """Initial bearing in radians, counter-clockwise from east."""
    lon1, lat1, lon2, lat2 = (F.radians(col(x)) for x in (lon1, lat1, lon2, lat2))
    turn = lon2 - lon1
    return F.atan2(F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(turn), F.sin(turn) * F.cos(lat2))


def step(lon: Value, lat: Value, length: Value, angle: Value) -> Column:
    """Struct (lon, lat) after a great-circle step of ``length`` meters at bearing ``angle``; the longitude isn't recast."""
    lon, lat, arc, angle = F.radians(col(lon)), F.radians(col(lat)), col(length) / EARTH_RADIUS_METERS, col(angle)
    to_lat = F.asin(F.sin(lat) * F.cos(arc) + F.cos(lat) * F.sin(arc) * F.sin(angle))
    to_lon = lon + F.atan2(F.cos(angle) * F.sin(arc) * F.cos(lat), F.cos(arc) - F.sin(lat) * F.sin(to_lat))
    return F.struct(F.degrees(to_lon).alias("lon"), F.degrees(to_lat).alias("lat"))


def recast_lon(lon: Value, lon0: float = -180.0) -> Column:
    """Longitude in [lon0, lon0 + 360)."""
    return F.pmod(col(lon) - lon0, F.lit(360.0)) + lon0


def recast_lon360(lon: Value) -> Column:
    return recast_lon(lon, 0.0)


def recast_lon180(lon: Value) -> Column:
    return recast_lon(lon, -180.0)


def to_cartesian(lon: Value, lat: Value, radius: float = EARTH_RADIUS_METERS) -> Column:
    """Struct (x, y, z) of a point on a sphere."""
    lon, lat = F.radians(col(lon)), F.radians(col(lat))
    return F.struct((radius * F.cos(lat) * F.cos(lon)).alias("x"), (radius * F.cos(lat) * F.sin(lon)).alias("y"), (radius * F.sin(lat)).alias("z"))


def to_spherical(x: Value, y: Value, z: Value) -> Column:
    """Struct (lon, lat) of a point in space: lon in [-180, 180), 0 at the poles; null at the origin."""
    x, y, z = col(x), col(y), col(z)
    length = F.sqrt(x * x + y * y + z * z)
    lon = F.when((x == 0) & (y == 0), 0.0).otherwise(recast_lon180(F.degrees(F.atan2(y, x))))
    return F.struct(lon.alias("lon"), F.degrees(F.asin(F.try_divide(z, length))).alias("lat"))


def to_tangent(u: Value, v: Value, w: Value, lon: Value, lat: Value) -> Column:
    """Struct (up, vp): a vector in space projected on the plane that touches the sphere at (lon, lat)."""
    u, v, w, lon, lat = col(u), col(v), col(w), F.radians(col(lon)), F.radians(col(lat))
    inward = u * F.cos(lon) + v * F.sin(lon)
    return F.struct((v * F.cos(lon) - u * F.sin(lon)).alias("up"), (w * F.cos(lat) - inward * F.sin(lat)).alias("vp"))


def from_tangent(up: Value, vp: Value, lon: Value, lat: Value) -> Column:
    """Struct (u, v, w): a vector of the tangent plane at (lon, lat) in space."""
    up, vp, lon, lat = col(up), col(vp), F.radians(col(lon)), F.radians(col(lat))
    return F.struct((-up * F.sin(lon) - vp * F.sin(lat) * F.cos(lon)).alias("u"), (up * F.cos(lon) - vp * F.sin(lat) * F.sin(lon)).alias("v"), (vp * F.cos(lat)).alias("w"))


def coriolis(lat: Value) -> Column:
    """Coriolis frequency in radians per second."""
    return 2 * EARTH_ROTATION_RATE * F.sin(F.radians(col(lat)))


def kinetic_energy(u: Value, v: Value | None = None) -> Column:
    u = col(u)
    return u * u / 2 if v is None else (u * u + col(v) * col(v)) / 2


def residual_position(lon: Value, lat: Value, x: Value, y: Value) -> Column:
    """Struct (lon, lat) of a position less a local displacement in meters; lon in [0, 360)."""
    lon, lat, x, y = (col(v) for v in (lon, lat, x, y))
    east = F.degrees(x / (EARTH_RADIUS_METERS * F.cos(F.radians(lat))))
    return F.struct(recast_lon360(lon - east).alias("lon"), (lat - F.degrees(y / EARTH_RADIUS_METERS)).alias("lat"))
