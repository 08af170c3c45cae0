"""Velocity, position, spin and distance along rows: window expressions, and walks for recurrences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import sphere
from ..model import OBS, ROW, along

SCHEMES = ("forward", "backward", "centered")


def _so_far():
    return along().rowsBetween(Window.unboundedPreceding, 0)


def _seconds(df: DataFrame, time: str) -> Column:
    kind = df.schema[time].dataType.typeName()
    return F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(time).cast("double")


def _check(scheme: str, coordinates: str) -> None:
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    if coordinates not in ("spherical", "cartesian"):
        raise ValueError("coordinates must be spherical or cartesian")


def _difference(value: Column, scheme: str) -> Column:
    """Step of a column by a scheme; the end that has no neighbour repeats the one beside it."""
    w = along()
    ahead, back = F.lead(value).over(w) - value, value - F.lag(value).over(w)
    if scheme == "forward":
        return F.coalesce(ahead, back)
    if scheme == "backward":
        return F.coalesce(back, ahead)
    return F.coalesce((F.lead(value).over(w) - F.lag(value).over(w)) / 2, ahead, back)


def unwrap(df: DataFrame, column: str, period: float = 360.0, out: str | None = None) -> DataFrame:
    """Remove jumps of more than half a period along rows.

    The correction of a step depends on the raw step alone, so a running sum does it; an upward
    step of exactly half a period stays upward.
    """
    half = period / 2
    jump = F.col(column) - F.lag(column).over(along())
    short = F.pmod(jump + half, F.lit(period)) - half
    short = F.when((short == -half) & (jump > 0), half).otherwise(short)
    fix = F.when(F.abs(jump) < half, 0.0).otherwise(short - jump)
    return df.withColumn("__fix", F.coalesce(fix, F.lit(0.0))).withColumn(out or column, F.col(column) + F.sum("__fix").over(_so_far())).drop("__fix")


def velocity(df: DataFrame, x: str = "lon", y: str = "lat", time: str = "time", coordinates: str = "spherical", scheme: str = "forward", out: tuple[str, str] = ("u", "v")) -> DataFrame:
    """Add velocity components from positions, per second of ``time``.

    On the sphere the step is a great-circle leg split by its bearing; centered legs join the
    midpoints on either side, on unwrapped longitudes. Rows of one observation have null.
    """
    _check(scheme, coordinates)
    t = _seconds(df, time)
    dt = _difference(t, scheme)
    if coordinates == "cartesian":
        cols = {out[0]: F.try_divide(_difference(F.col(x), scheme), dt), out[1]: F.try_divide(_difference(F.col(y), scheme), dt)}
        return df.withColumns(cols)
    w = along()
    here = (F.col(x), F.col(y))
    if scheme == "centered":
        df = unwrap(df, x, 360.0, "__x")
        here = (F.col("__x"), F.col(y))
    before, after = tuple(F.lag(c).over(w) for c in here), tuple(F.lead(c).over(w) for c in here)

    def leg(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        d, th = sphere.distance(*a, *b), sphere.bearing(*a, *b)
        return F.when(d.isNotNull(), F.struct((d * F.cos(th)).alias("x"), (d * F.sin(th)).alias("y")))

    ahead, back = leg(here, after), leg(before, here)
    if scheme == "forward":
        step = F.coalesce(ahead, back)
    elif scheme == "backward":
        step = F.coalesce(back, ahead)
    else:
        middle = lambda p, q: tuple((a + b) / 2 for a, b in zip(p, q, strict=True))
        step = F.coalesce(leg(middle(before, here), middle(here, after)), ahead, back)
    out_df = df.withColumn("__step", step).withColumn("__dt", dt)
    return out_df.withColumns({out[0]: F.try_divide(F.col("__step.x"), F.col("__dt")), out[1]: F.try_divide(F.col("__step.y"), F.col("__dt"))}).drop("__step", "__dt", "__x")


def spin(df: DataFrame, u: str = "u", v: str = "v", time: str = "time", scheme: str = "forward", out: str = "spin") -> DataFrame:
    """Add the spin (u dv - v du) / (2 dt KE); null where the speed or time step is 0."""
    _check(scheme, "cartesian")
    du, dv, dt = _difference(F.col(u), scheme), _difference(F.col(v), scheme), _difference(_seconds(df, time), scheme)
    return df.withColumn(out, F.try_divide(F.col(u) * dv - F.col(v) * du, 2 * dt * sphere.kinetic_energy(u, v)))


def cumulative_distance(df: DataFrame, lon: str = "lon", lat: str = "lat", out: str = "distance", swapped: bool = False) -> DataFrame:
    """Add meters travelled along the row, from 0. ``swapped`` takes latitude for longitude and back, for old results."""
    a, b = (lat, lon) if swapped else (lon, lat)
    leg = sphere.distance(F.lag(a).over(along()), F.lag(b).over(along()), a, b)
    return df.withColumn("__leg", F.coalesce(leg, F.lit(0.0))).withColumn(out, F.sum("__leg").over(_so_far())).drop("__leg")


def _displacements(df: DataFrame, u: str, v: str, time: str, scheme: str) -> DataFrame:
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    w = along()
    t = _seconds(df, time)
    dt = t - F.lag(t).over(w)

    def moved(c: str) -> Column:
        last = F.lag(c).over(w)
        mean = {"forward": last, "backward": F.col(c), "centered": (last + F.col(c)) / 2}[scheme]
        return F.coalesce(mean * dt, F.lit(0.0))

    return df.withColumns({"__dx": moved(u), "__dy": moved(v)})


def position(df: DataFrame, u: str = "u", v: str = "v", time: str = "time", x0: float = 0.0, y0: float = 0.0, coordinates: str = "spherical", scheme: str = "forward", out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Add positions integrated from velocities, from (x0, y0) on.

    In the plane that is a running sum. On the sphere each great-circle step starts where the one
    before ended, so a row's steps are walked in order, each row in one task.
    """
    _check(scheme, coordinates)
    moved = _displacements(df, u, v, time, scheme)
    if coordinates == "cartesian":
        return moved.withColumns({out[0]: F.lit(x0) + F.sum("__dx").over(_so_far()), out[1]: F.lit(y0) + F.sum("__dy").over(_so_far())}).drop("__dx", "__dy")
    return _folded(moved, "__dx", "__dy", x0, y0, out).drop("__dx", "__dy")


def plane_to_sphere(df: DataFrame, x: str = "x", y: str = "y", lon0: float = 0.0, lat0: float = 0.0, out: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Add longitude and latitude of plane positions in meters: great-circle steps from the origin, walked along the row."""
    w = along()
    moved = df.withColumns({"__dx": F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0)), "__dy": F.col(y) - F.coalesce(F.lag(y).over(w), F.lit(0.0))})
    return _folded(moved, "__dx", "__dy", lon0, lat0, out).drop("__dx", "__dy")


LANES = 16  # rows from which a step of all of them at once is quicker than one after another


def _side_by_side(rows, e, n, s, c, origin: tuple[float, float], first: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes in radians along runs of equal ``rows``: each from the origin, the first run from ``first``.

    A step goes by the cosine and sine of its direction (e, n) and of its arc (c, s).
    """
    starts = np.append(0, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(rows)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    lon, lat = np.full(len(starts), origin[0]), np.full(len(starts), origin[1])
    lon[order == 0], lat[order == 0] = first
    lons, lats = np.empty(len(rows)), np.empty(len(rows))
    k, going = 0, len(starts)
    with np.errstate(invalid="ignore"):
        while going >= LANES:
            at, up = starts[:going] + k, np.sin(lat[:going])
            b = np.cos(lat[:going])
            a, up = up, up * c[at] + b * s[at] * n[at]
            lon[:going] += np.arctan2(e[at] * s[at] * b, c[at] - a * up)
            lat[:going] = np.arcsin(np.clip(up, -1, 1))
            lons[at], lats[at] = lon[:going], lat[:going]
            k += 1
            going = int(np.searchsorted(-sizes, -k))  # runs longer than k stand first
    for j in range(going):
        here, there = lon[j], lat[j]
        span = slice(starts[j] + k, starts[j] + sizes[j])
        for i, ei, ni, si, ci in zip(range(span.start, span.stop), e[span].tolist(), n[span].tolist(), s[span].tolist(), c[span].tolist(), strict=True):
            a, b = math.sin(there), math.cos(there)
            up = a * ci + b * si * ni
            here += math.atan2(ei * si * b, ci - a * up)
            there = math.asin(max(-1.0, min(1.0, up))) if up == up else math.nan
            lons[i], lats[i] = here, there
    return lons, lats


def _folded(df: DataFrame, dx: str, dy: str, lon0: float, lat0: float, out: tuple[str, str]) -> DataFrame:
    """Great-circle steps one after another.

    Only a row's steps go to its task, as numbers in order; they pass through it in batches, in
    time proportional to them, so a row of any length fits. Rows of a batch are walked side by
    side, a step of all of them at once, as long as many of them go on. The positions come back to the
    observations by a join, so no other column is gathered.
    """
    schema = T.StructType([T.StructField(ROW, T.LongType()), T.StructField(OBS, T.LongType()), T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.DoubleType())])
    radius, origin = sphere.EARTH_RADIUS_METERS, (math.radians(lon0), math.radians(lat0))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stand = None, origin  # the row that the batch before ended in, and where
        for pdf in frames:
            if not len(pdf):
                continue
            rows = pdf[ROW].to_numpy()
            x, y = pdf[dx].to_numpy(float), pdf[dy].to_numpy(float)
            turn, arc = np.arctan2(y, x), np.hypot(x, y) / radius
            lons, lats = _side_by_side(rows, np.cos(turn), np.sin(turn), np.sin(arc), np.cos(arc), origin, stand if rows[0] == last else origin)
            last, stand = rows[-1], (lons[-1], lats[-1])
            yield pd.DataFrame({ROW: rows, OBS: pdf[OBS].to_numpy(), out[0]: np.degrees(lons), out[1]: np.degrees(lats)})

    steps = df.select(F.col(ROW).cast("long").alias(ROW), F.col(OBS).cast("long").alias(OBS), dx, dy)
    walked = steps.repartition(ROW).sortWithinPartitions(ROW, OBS).mapInPandas(walk, schema)
    return df.drop(*out).join(walked, [ROW, OBS])


def sphere_to_plane(df: DataFrame, lon: str = "lon", lat: str = "lat", lon0: float = 0.0, lat0: float = 0.0, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Add plane positions in meters: running sums of great-circle legs, the first from the origin."""
    w = along()
    a, b = F.coalesce(F.lag(lon).over(w), F.lit(float(lon0))), F.coalesce(F.lag(lat).over(w), F.lit(float(lat0)))
    d, th = sphere.distance(a, b, lon, lat), sphere.bearing(a, b, lon, lat)
    moved = df.withColumn("__d", d).withColumn("__th", th)
    sums = {out[0]: F.sum(F.col("__d") * F.cos("__th")).over(_so_far()), out[1]: F.sum(F.col("__d") * F.sin("__th")).over(_so_far())}
    return moved.withColumns(sums).drop("__d", "__th")


def moving(df: DataFrame, column: str, function: Callable[[Column], Column], before: int, after: int, out: str) -> DataFrame:
    """Add an aggregate over the neighbours of an observation in its row."""
    return df.withColumn(out, function(F.col(column)).over(along().rowsBetween(-before, after)))
