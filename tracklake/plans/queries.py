"""A query for each operator; each takes (spark, sf_dir). Floats are rounded where engines may differ in the last bit."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning, complexes, sphere
from ..model import OBS, ROW, RaggedFrame, along
from ..operators import apply, binning, intervals, kinematics, lines, pairs, ragged, signals
from ..scratch import fresh_path
from ..sources import files, providers
from .tables import DRIFTS, MOORINGS, ORDERS, TRACKS, bearing, distance, drifts, moorings, orders, shapes, table, tracks, wavelet_shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r(c: Column | str, digits: int) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def positive(c: Column | str, digits: int) -> Column:
    """Rounded as SQL does it, by a product; for numbers from 0 that are many, as ``round`` makes a decimal of each."""
    y = (F.col(c) if isinstance(c, str) else c) * float(10**digits)
    whole = F.floor(y)
    return (whole + F.when(y - whole >= 0.5, 1).otherwise(0)) / float(10**digits)


# ---- flagship: a subset, velocities, a reduction ----


@query(
    f"""WITH {TRACKS}, s AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY obs_idx) AS n, count(*) OVER (PARTITION BY row_idx) AS c FROM obs WHERE lat BETWEEN -60 AND 60 AND row_idx % 5 <> 0),
 legs AS (SELECT *, lead(t) OVER w - t AS dt, {distance("lon", "lat", "lead(lon) OVER w", "lead(lat) OVER w")} AS d FROM s WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx)),
 filled AS (SELECT row_idx, CASE WHEN dt IS NULL THEN lag(d) OVER w / nullif(lag(dt) OVER w, 0) ELSE d / nullif(dt, 0) END AS speed FROM legs WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx))
 SELECT row_idx, count(*) AS rowsize, round(avg(speed), 4) AS mean_speed, round(max(speed), 4) AS max_speed FROM filled GROUP BY row_idx"""
)
def subset_velocity_reduce(spark, sf):
    """Rows by a test of the id, observations by latitude, forward velocity, mean and top speed of each row."""
    f = ragged.subset(tracks(spark, sf), {"lat": (-60, 60), ROW: lambda c: c % 5 != 0})
    v = kinematics.velocity(f.obs, time="t").withColumn("speed", F.hypot("u", "v"))
    return v.groupBy(ROW).agg(F.count(F.lit(1)).alias("rowsize"), r(F.avg("speed"), 4).alias("mean_speed"), r(F.max("speed"), 4).alias("max_speed"))


# ---- index and filters ----


@query(f"WITH {TRACKS}, n AS (SELECT row_idx, count(*) AS rowsize FROM obs GROUP BY 1) SELECT row_idx, rowsize, CAST(coalesce(sum(rowsize) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(rowsize) OVER (ORDER BY row_idx) AS BIGINT) AS stop FROM n")
def ragged_index(spark, sf):
    return ragged.offsets(tracks(spark, sf).rows)


@query(f"WITH {TRACKS} SELECT idx AS \"index\", row_idx FROM (SELECT row_number() OVER (ORDER BY row_idx, obs_idx) - 1 AS idx, row_idx FROM obs)")
def obs_to_row(spark, sf):
    f = tracks(spark, sf)
    n = f.obs.count()
    return ragged.checked(ragged.rows_of(spark.range(n).select(F.col("id").alias("index")), f.rows))


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx, event_id FROM obs WHERE value BETWEEN 10 AND 20")
def subset_range(spark, sf):
    return ragged.subset(tracks(spark, sf), {"value": (10, 20)}).obs.select(ROW, OBS, "event_id")


@query(f"WITH {TRACKS} SELECT row_idx, count(*) AS rowsize FROM obs WHERE row_idx IN (1, 3, 5, 7) AND event_type IN ('click', 'view') GROUP BY 1")
def subset_isin(spark, sf):
    return ragged.subset(tracks(spark, sf), {ROW: [1, 3, 5, 7], "event_type": ["click", "view"]}).rows.select(ROW, F.col("rowsize"))


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx FROM obs WHERE row_idx IN (SELECT row_idx FROM obs WHERE lat > 84)")
def subset_full_rows(spark, sf):
    return ragged.subset(tracks(spark, sf), {"lat": lambda c: c > 84}, full_rows=True).obs.select(ROW, OBS)


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx FROM obs WHERE lon * lon + lat * lat < 2500 AND event_type = 'click'")
def subset_many_columns(spark, sf):
    f = ragged.subset(tracks(spark, sf), {("lon", "lat"): lambda x, y: x * x + y * y < 2500, "event_type": "click"})
    return f.obs.select(ROW, OBS)


@query(f"WITH {ORDERS}, n AS (SELECT row_idx, count(*) AS c FROM obs GROUP BY 1) SELECT o.row_idx, o.obs_idx, o.l_quantity FROM obs o JOIN n USING (row_idx) WHERE c >= 5")
def prune(spark, sf):
    return ragged.prune(orders(spark, sf), 5).obs.select(ROW, OBS, "l_quantity")


@query(f"WITH {ORDERS} SELECT row_idx, array_to_string(list(CAST(l_quantity AS BIGINT) ORDER BY obs_idx), ',') AS quantities FROM obs WHERE row_idx IN (1, 2, 3, 7) GROUP BY 1")
def unpack_rows(spark, sf):
    u = ragged.unpack(orders(spark, sf), "l_quantity", [7, 1, 3, 2])
    return u.select(ROW, F.array_join(F.transform("l_quantity", lambda x: x.cast("long").cast("string")), ",").alias("quantities"))


@query(f"WITH {TRACKS} SELECT row_idx, count(*) AS n FROM obs GROUP BY 1")
def count_per_id(spark, sf):
    return tracks(spark, sf).obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).orderBy(ROW)


@query(f"WITH {ORDERS}, k AS (SELECT * FROM obs WHERE l_returnflag = 'R') SELECT r.row_idx, coalesce(n, 0) AS rowsize FROM (SELECT DISTINCT row_idx FROM obs) r LEFT JOIN (SELECT row_idx, count(*) AS n FROM k GROUP BY 1) USING (row_idx)")
def rowsize_recount(spark, sf):
    f = orders(spark, sf)
    return RaggedFrame(f.rows, f.obs.filter("l_returnflag = 'R'")).recounted().rows.select(ROW, "rowsize")


# ---- segments and windows ----


@query(f"WITH {TRACKS}, g AS (SELECT row_idx, obs_idx, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx)), s AS (SELECT row_idx, CAST(sum(new) OVER (PARTITION BY row_idx ORDER BY obs_idx) AS BIGINT) AS segment FROM g) SELECT row_idx, segment, count(*) AS rowsize FROM s GROUP BY 1, 2")
def segment_time(spark, sf):
    return ragged.segment_sizes(tracks(spark, sf).obs, "t", 86400)


@query(f"WITH {ORDERS}, g AS (SELECT row_idx, obs_idx, CASE WHEN l_quantity - lag(l_quantity) OVER w < -10 THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx)), s AS (SELECT row_idx, CAST(sum(new) OVER (PARTITION BY row_idx ORDER BY obs_idx) AS BIGINT) AS segment FROM g) SELECT row_idx, segment, count(*) AS rowsize FROM s GROUP BY 1, 2")
def segment_signed(spark, sf):
    return ragged.segment_sizes(orders(spark, sf).obs, "l_quantity", -10)


@query(f"WITH {TRACKS}, g AS (SELECT row_idx, obs_idx, CASE WHEN abs(lon - lag(lon) OVER w) > 180 THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx)), s AS (SELECT row_idx, obs_idx, CAST(sum(new) OVER (PARTITION BY row_idx ORDER BY obs_idx) AS BIGINT) AS segment FROM g) SELECT row_idx, obs_idx, segment FROM s")
def segment_nested(spark, sf):
    return ragged.segment_both(tracks(spark, sf).obs, "lon", 180).select(ROW, OBS, "segment")


def _chunk_sql(length: int, overlap: int, align: str) -> str:
    stride = length - overlap
    skip = {"start": "0", "middle": f"(n - ((c - 1) * {stride} + {length})) // 2", "end": f"n - ((c - 1) * {stride} + {length})"}[align]
    return f"""WITH {TRACKS}, n AS (SELECT row_idx, count(*) AS n, greatest((count(*) - {length}) // {stride} + 1, 0) AS c FROM obs GROUP BY 1 HAVING count(*) >= {length}),
 k AS (SELECT row_idx, i AS chunk, {skip} + i * {stride} AS first FROM n, range(0, 100000) x(i) WHERE i < c)
 SELECT row_idx, chunk, obs_idx - first AS place, event_id FROM k JOIN obs USING (row_idx) WHERE obs_idx >= first AND obs_idx < first + {length}"""


def _chunk(name: str, length: int, overlap: int, align: str) -> None:
    def run(spark, sf):
        return ragged.chunk(tracks(spark, sf), length, overlap, align).select(ROW, "chunk", "place", "event_id")

    run.__name__ = name
    query(_chunk_sql(length, overlap, align))(run)


for _name, _args in {"chunk_start": (10, 0, "start"), "chunk_middle": (7, 0, "middle"), "chunk_end": (8, 0, "end"), "chunk_overlap": (6, 4, "start"), "chunk_gap": (5, -3, "end")}.items():
    _chunk(_name, *_args)


@query(f"WITH {ORDERS}, m AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM obs GROUP BY row_idx)) SELECT row_idx, array_to_string(list(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ORDER BY obs_idx), ',') || repeat(',-1', any_value(m) - count(*)) AS padded FROM obs, m GROUP BY 1")
def pad_regular(spark, sf):
    p = ragged.to_regular(orders(spark, sf), "l_quantity", -1)
    return p.select(ROW, F.array_join(F.transform("l_quantity", lambda x: x.cast("long").cast("string")), ",").alias("padded"))


@query("WITH e AS (SELECT vec_id AS row_idx, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT row_idx, row_number() OVER (PARTITION BY row_idx ORDER BY i) - 1 AS obs_idx, round(x::DOUBLE, 5) AS x FROM e WHERE x > 0")
def regular_to_ragged(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias(ROW), F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")).otherwise(-1.0)).alias("x"))
    return ragged.to_ragged(e, "x", -1.0).obs.select(ROW, OBS, r("x", 5).alias("x"))


@query(f"WITH {ORDERS} SELECT row_idx, obs_idx, l_quantity, l_shipdate FROM obs")
def nested_roundtrip(spark, sf):
    """Flat to one record a row and back."""
    f = RaggedFrame.from_nested(orders(spark, sf).to_nested())
    return f.obs.select(ROW, OBS, "l_quantity", "l_shipdate")


@query("WITH e AS (SELECT vec_id, list_transform(range(0, len(embedding) // 8), lambda i: round(list_sum(list_slice(embedding, (i * 8 + 1)::BIGINT, (i * 8 + 8)::BIGINT))::DOUBLE, 3)) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)) SELECT vec_id, i AS chunk, s[i + 1] + 0.0 AS total FROM e, range(0, 1000) x(i) WHERE i < len(s)")
def chunk_arrays(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    c = e.select("vec_id", F.posexplode(ragged.chunk_arrays("embedding", 8)).alias("chunk", "part"))
    return c.select("vec_id", F.col("chunk").cast("long").alias("chunk"), r(F.aggregate("part", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(f"WITH {TRACKS}, u AS (SELECT DISTINCT row_idx FROM obs) SELECT row_idx FROM (SELECT row_idx, ((row_idx + 42) * 48271 % 2147483647) * 48271 % 2147483647 AS k FROM u) ORDER BY k, row_idx LIMIT 5")
def sample_rows(spark, sf):
    """Five rows chosen by a seeded hash."""
    return ragged.sample_rows(tracks(spark, sf).rows, 5, seed=42).select(ROW)


# ---- kinematics ----

_W = "WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx)"


def _velocity_sql(scheme: str) -> str:
    d_next, b_next = distance("lon", "lat", "lead(lon) OVER w", "lead(lat) OVER w"), bearing("lon", "lat", "lead(lon) OVER w", "lead(lat) OVER w")
    base = f"WITH {DRIFTS}, leg AS (SELECT *, {d_next} AS d, {b_next} AS b, lead(t) OVER w - t AS dt FROM drift {_W})"
    prev = "lag(d * {f}(b)) OVER w / nullif(lag(dt) OVER w, 0)"
    own = "d * {f}(b) / nullif(dt, 0)"
    test = "dt IS NULL" if scheme == "forward" else "lag(dt) OVER w IS NOT NULL"
    part = lambda f: f"CASE WHEN {test} THEN {prev.format(f=f)} ELSE {own.format(f=f)} END"
    return f"{base} SELECT row_idx, obs_idx, round({part('cos')}, 5) + 0.0 AS u, round({part('sin')}, 5) + 0.0 AS v FROM leg {_W}"


@query(_velocity_sql("forward"))
def velocity_forward(spark, sf):
    v = kinematics.velocity(drifts(spark, sf).obs, time="t")
    return v.select(ROW, OBS, r("u", 5).alias("u"), r("v", 5).alias("v"))


@query(_velocity_sql("backward"))
def velocity_backward(spark, sf):
    v = kinematics.velocity(drifts(spark, sf).obs, time="t", scheme="backward")
    return v.select(ROW, OBS, r("u", 5).alias("u"), r("v", 5).alias("v"))


_CD = distance("x1", "y1", "x2", "y2")
_CB = bearing("x1", "y1", "x2", "y2")


@query(
    f"""WITH {DRIFTS}, n AS (SELECT *, lag(lon) OVER w AS lo, lag(lat) OVER w AS la, lead(lon) OVER w AS ln, lead(lat) OVER w AS lt, lag(t) OVER w AS tp, lead(t) OVER w AS tn FROM drift {_W}),
 m AS (SELECT row_idx, obs_idx, CASE WHEN lo IS NULL THEN lon WHEN ln IS NULL THEN lo ELSE (lo + lon) / 2 END AS x1, CASE WHEN lo IS NULL THEN lat WHEN ln IS NULL THEN la ELSE (la + lat) / 2 END AS y1,
  CASE WHEN ln IS NULL THEN lon WHEN lo IS NULL THEN ln ELSE (ln + lon) / 2 END AS x2, CASE WHEN ln IS NULL THEN lat WHEN lo IS NULL THEN lt ELSE (lt + lat) / 2 END AS y2,
  CASE WHEN tp IS NULL THEN tn - t WHEN tn IS NULL THEN t - tp ELSE (tn - tp) / 2 END AS dt FROM n)
 SELECT row_idx, obs_idx, round({_CD} * cos({_CB}) / nullif(dt, 0), 5) + 0.0 AS u, round({_CD} * sin({_CB}) / nullif(dt, 0), 5) + 0.0 AS v FROM m"""
)
def velocity_centered(spark, sf):
    v = kinematics.velocity(drifts(spark, sf).obs, time="t", scheme="centered")
    return v.select(ROW, OBS, r("u", 5).alias("u"), r("v", 5).alias("v"))


@query(f"WITH {DRIFTS}, s AS (SELECT *, coalesce(lead(u) OVER w - u, u - lag(u) OVER w) AS du, coalesce(lead(v) OVER w - v, v - lag(v) OVER w) AS dv, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS dt FROM drift {_W}) SELECT row_idx, obs_idx, round((u * dv - v * du) / nullif(2 * dt * ((u * u + v * v) / 2), 0) * 1e6, 3) + 0.0 AS spin FROM s")
def spin(spark, sf):
    s = kinematics.spin(drifts(spark, sf).obs, time="t")
    return s.select(ROW, OBS, r(F.col("spin") * 1e6, 3).alias("spin"))


@query(f"WITH {DRIFTS}, l AS (SELECT row_idx, obs_idx, coalesce({distance('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0) AS d FROM drift {_W}) SELECT row_idx, obs_idx, round(sum(d) OVER w, 1) AS distance FROM l {_W}")
def cum_distance(spark, sf):
    return kinematics.cumulative_distance(drifts(spark, sf).obs).select(ROW, OBS, r("distance", 1).alias("distance"))


@query(f"WITH {TRACKS}, n AS (SELECT *, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM obs {_W}) SELECT row_idx, obs_idx, round({distance('lon', 'lat', 'x2', 'y2')}, 1) AS distance, round({bearing('lon', 'lat', 'x2', 'y2')}, 7) AS bearing FROM n WHERE x2 IS NOT NULL")
def bearing_legs(spark, sf):
    w = along()
    o = tracks(spark, sf).obs.withColumns({"x2": F.lead("lon").over(w), "y2": F.lead("lat").over(w)}).filter("x2 IS NOT NULL")
    return o.select(ROW, OBS, r(sphere.distance("lon", "lat", "x2", "y2"), 1).alias("distance"), r(sphere.bearing("lon", "lat", "x2", "y2"), 7).alias("bearing"))


@query(
    f"""WITH {TRACKS}, s AS (SELECT event_id, radians(lon) AS lo, radians(lat) AS la, value * 1000 / 6378100.0::DOUBLE AS a, value::DOUBLE AS b FROM obs),
 t AS (SELECT *, asin(sin(la) * cos(a) + cos(la) * sin(a) * sin(b)) AS l2 FROM s)
 SELECT event_id, round(degrees(lo + atan2(cos(b) * sin(a) * cos(la), cos(a) - sin(la) * sin(l2))), 7) AS lon, round(degrees(l2), 7) AS lat FROM t"""
)
def step_position(spark, sf):
    o = tracks(spark, sf).obs.withColumn("p", sphere.step("lon", "lat", F.col("value") * 1000, "value"))
    return o.select("event_id", r("p.lon", 7).alias("lon"), r("p.lat", 7).alias("lat"))


@query(f"WITH {TRACKS} SELECT event_id, round(fmod(fmod(value * 7, 360) + 360, 360), 7) AS lon360, round(fmod(fmod(value * 7 + 180, 360) + 360, 360) - 180, 7) AS lon180, round(fmod(fmod(value * 7 - 220, 360) + 360, 360) + 220, 7) AS lon220 FROM obs")
def recast(spark, sf):
    x = F.col("value") * 7
    return tracks(spark, sf).obs.select("event_id", r(sphere.recast_lon360(x), 7).alias("lon360"), r(sphere.recast_lon180(x), 7).alias("lon180"), r(sphere.recast_lon(x, 220.0), 7).alias("lon220"))


@query(f"WITH {TRACKS} SELECT event_id, round(6378100.0::DOUBLE * cos(radians(lat)) * cos(radians(lon)), 3) + 0.0 AS x, round(6378100.0::DOUBLE * cos(radians(lat)) * sin(radians(lon)), 3) + 0.0 AS y, round(6378100.0::DOUBLE * sin(radians(lat)), 3) + 0.0 AS z, round(lon, 7) + 0.0 AS lon, round(lat, 7) + 0.0 AS lat FROM obs")
def to_cartesian(spark, sf):
    """Positions in space and back on the sphere."""
    o = tracks(spark, sf).obs.withColumn("p", sphere.to_cartesian("lon", "lat"))
    o = o.withColumn("q", sphere.to_spherical("p.x", "p.y", "p.z"))
    return o.select("event_id", r("p.x", 3).alias("x"), r("p.y", 3).alias("y"), r("p.z", 3).alias("z"), r("q.lon", 7).alias("lon"), r("q.lat", 7).alias("lat"))


@query(f"WITH {DRIFTS}, o AS (SELECT *, radians(lon) AS a, radians(lat) AS b FROM drift) SELECT event_id, round(v * cos(a) - u * sin(a), 8) + 0.0 AS up, round(value * cos(b) - (u * cos(a) + v * sin(a)) * sin(b), 6) + 0.0 AS vp, round(-u * sin(a) - v * sin(b) * cos(a), 8) + 0.0 AS x, round(u * cos(a) - v * sin(b) * sin(a), 8) + 0.0 AS y, round(v * cos(b), 8) + 0.0 AS z FROM o")
def tangent_plane(spark, sf):
    o = drifts(spark, sf).obs.withColumn("p", sphere.to_tangent("u", "v", "value", "lon", "lat")).withColumn("q", sphere.from_tangent("u", "v", "lon", "lat"))
    return o.select("event_id", r("p.up", 8).alias("up"), r("p.vp", 6).alias("vp"), r("q.u", 8).alias("x"), r("q.v", 8).alias("y"), r("q.w", 8).alias("z"))


@query(f"WITH {DRIFTS} SELECT event_id, round(2 * 2 * pi() / 86164.091::DOUBLE * sin(radians(lat)) * 1e9, 3) + 0.0 AS f_nano, round((u * u + v * v) / 2, 9) AS ke FROM drift")
def coriolis(spark, sf):
    return drifts(spark, sf).obs.select("event_id", r(sphere.coriolis("lat") * 1e9, 3).alias("f_nano"), r(sphere.kinetic_energy("u", "v"), 9).alias("ke"))


@query(f"WITH {DRIFTS} SELECT event_id, round(fmod(fmod(lon - degrees(u * 1000 / (6378100.0::DOUBLE * cos(radians(lat)))), 360) + 360, 360), 7) AS lon, round(lat - degrees(v * 1000 / 6378100.0::DOUBLE), 7) + 0.0 AS lat FROM drift")
def residual_position(spark, sf):
    o = drifts(spark, sf).obs.withColumn("p", sphere.residual_position("lon", "lat", F.col("u") * 1000, F.col("v") * 1000))
    return o.select("event_id", r("p.lon", 7).alias("lon"), r("p.lat", 7).alias("lat"))


@query(f"WITH {TRACKS}, j AS (SELECT row_idx, obs_idx, lon, lon - lag(lon) OVER w AS d FROM obs {_W}), f AS (SELECT *, CASE WHEN abs(d) < 180 OR d IS NULL THEN 0 WHEN d > 0 AND fmod(fmod(d + 180, 360) + 360, 360) = 0 THEN 180 - d ELSE fmod(fmod(d + 180, 360) + 360, 360) - 180 - d END AS fix FROM j) SELECT row_idx, obs_idx, round(lon + sum(fix) OVER w, 6) + 0.0 AS lon FROM f {_W}")
def unwrap_lon(spark, sf):
    """Longitudes along rows without jumps; an upward step of exactly half a circle stays upward."""
    return kinematics.unwrap(tracks(spark, sf).obs, "lon").select(ROW, OBS, r("lon", 6).alias("lon"))


def _position_sql(mean: str) -> str:
    return f"WITH {DRIFTS}, s AS (SELECT row_idx, obs_idx, coalesce({mean.format(c='u')} * (t - lag(t) OVER w), 0) AS dx, coalesce({mean.format(c='v')} * (t - lag(t) OVER w), 0) AS dy FROM drift {_W}) SELECT row_idx, obs_idx, round(100 + sum(dx) OVER w, 3) + 0.0 AS x, round(-50 + sum(dy) OVER w, 3) + 0.0 AS y FROM s {_W}"


def _position(name: str, scheme: str, mean: str) -> None:
    def run(spark, sf):
        p = kinematics.position(drifts(spark, sf).obs.drop("lon", "lat"), time="t", x0=100.0, y0=-50.0, coordinates="cartesian", scheme=scheme)
        return p.select(ROW, OBS, r("x", 3).alias("x"), r("y", 3).alias("y"))

    run.__name__ = name
    query(_position_sql(mean))(run)


_position("position_forward", "forward", "lag({c}) OVER w")
_position("position_backward", "backward", "{c}")
_position("position_centered", "centered", "(lag({c}) OVER w + {c}) / 2")


def _fold_sql(steps: str) -> str:
    """Great-circle steps one after another by a recursive query; ``steps`` has (row_idx, obs_idx, dx, dy)."""
    return f"""WITH RECURSIVE {DRIFTS}, steps AS ({steps}),
 p AS (SELECT row_idx, obs_idx, degrees(0 + atan2(cos(b) * sin(a), cos(a))) AS lon, degrees(asin(sin(a) * sin(b))) AS lat FROM (SELECT row_idx, obs_idx, sqrt(dx * dx + dy * dy) / 6378100.0::DOUBLE AS a, atan2(dy, dx) AS b FROM steps WHERE obs_idx = 0)
 UNION ALL SELECT row_idx, obs_idx, degrees(radians(lon) + atan2(cos(b) * sin(a) * cos(radians(lat)), cos(a) - sin(radians(lat)) * sin(l2))), degrees(l2) FROM
  (SELECT s.row_idx, s.obs_idx, p.lon, p.lat, sqrt(dx * dx + dy * dy) / 6378100.0::DOUBLE AS a, atan2(dy, dx) AS b,
   asin(sin(radians(p.lat)) * cos(sqrt(dx * dx + dy * dy) / 6378100.0::DOUBLE) + cos(radians(p.lat)) * sin(sqrt(dx * dx + dy * dy) / 6378100.0::DOUBLE) * sin(atan2(dy, dx))) AS l2
   FROM p JOIN steps s ON s.row_idx = p.row_idx AND s.obs_idx = p.obs_idx + 1))
 SELECT row_idx, obs_idx, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM p"""


@query(_fold_sql(f"SELECT row_idx, obs_idx, coalesce(lag(u) OVER w * (t - lag(t) OVER w), 0) AS dx, coalesce(lag(v) OVER w * (t - lag(t) OVER w), 0) AS dy FROM drift {_W}"))
def position_spherical(spark, sf):
    p = kinematics.position(drifts(spark, sf).obs.drop("lon", "lat"), time="t", out=("lon", "lat"))
    return p.select(ROW, OBS, r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


@query(_fold_sql(f"SELECT row_idx, obs_idx, u * 50000 - coalesce(lag(u) OVER w * 50000, 0) AS dx, v * 50000 - coalesce(lag(v) OVER w * 50000, 0) AS dy FROM drift {_W}"))
def plane_to_sphere(spark, sf):
    o = drifts(spark, sf).obs.select(ROW, OBS, (F.col("u") * 50000).alias("x"), (F.col("v") * 50000).alias("y"))
    return kinematics.plane_to_sphere(o).select(ROW, OBS, r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


@query(f"WITH {DRIFTS}, l AS (SELECT row_idx, obs_idx, coalesce(lag(lon) OVER w, 0) AS x0, coalesce(lag(lat) OVER w, 0) AS y0, lon, lat FROM drift {_W}), s AS (SELECT row_idx, obs_idx, {distance('x0', 'y0', 'lon', 'lat')} AS d, {bearing('x0', 'y0', 'lon', 'lat')} AS b FROM l) SELECT row_idx, obs_idx, round(sum(d * cos(b)) OVER w, 1) + 0.0 AS x, round(sum(d * sin(b)) OVER w, 1) + 0.0 AS y FROM s {_W}")
def sphere_to_plane(spark, sf):
    return kinematics.sphere_to_plane(drifts(spark, sf).obs).select(ROW, OBS, r("x", 1).alias("x"), r("y", 1).alias("y"))


@query(f"WITH {TRACKS}, s AS (SELECT row_idx, obs_idx, value, sum(CASE WHEN abs(d) > 180 THEN 1 ELSE 0 END) OVER w AS piece FROM (SELECT *, lon - lag(lon) OVER w AS d FROM obs {_W}) {_W}) SELECT row_idx, CAST(piece AS BIGINT) AS piece, obs_idx, round(color, 6) AS color FROM (SELECT row_idx, piece, obs_idx, avg(value) OVER (PARTITION BY row_idx, piece ORDER BY obs_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS color, lead(obs_idx) OVER (PARTITION BY row_idx, piece ORDER BY obs_idx) AS nx FROM s) WHERE nx IS NOT NULL")
def line_colors(spark, sf):
    return lines.line_colors(tracks(spark, sf).obs, "value").select(ROW, "piece", OBS, r("color", 6).alias("color"))


@query(f"WITH {TRACKS}, s AS (SELECT row_idx, obs_idx, value, lon, lat, sum(CASE WHEN abs(d) > 180 THEN 1 ELSE 0 END) OVER w AS piece FROM (SELECT *, lon - lag(lon) OVER w AS d FROM obs {_W}) {_W}) SELECT row_idx, CAST(piece AS BIGINT) AS piece, unnest(range(0, count(*))) AS place, round(unnest(list(lon ORDER BY obs_idx)), 6) + 0.0 AS lon, round(unnest(list(lat ORDER BY obs_idx)), 6) + 0.0 AS lat, unnest(list(value ORDER BY obs_idx)) AS color FROM s GROUP BY 1, 2")
def line_pieces(spark, sf):
    """Each piece's points in order, with their colors."""
    p = lines.pieces(tracks(spark, sf).obs, color="value").select(ROW, "piece", F.posexplode("points").alias("place", "p"))
    return p.select(ROW, "piece", F.col("place").cast("long").alias("place"), r("p.lon", 6).alias("lon"), r("p.lat", 6).alias("lat"), "p.color")


# ---- binned statistics ----

_EDGES = "SELECT i AS bin_0, lo + i * (hi - lo) / {n} AS a, CASE WHEN i = {n} - 1 THEN hi ELSE lo + (i + 1) * (hi - lo) / {n} END AS b, i = {n} - 1 AS last FROM range(0, {n}) x(i), (SELECT {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi)"


def _bin1d(lo: str, hi: str, n: int) -> str:
    return _EDGES.format(n=n, lo=lo, hi=hi)


@query(
    f"""WITH {TRACKS}, e AS ({_bin1d("-90", "90", 12)}), j AS (SELECT e.bin_0, o.value FROM e LEFT JOIN obs o ON o.lat >= e.a AND (o.lat < e.b OR (e.last AND o.lat = e.b)))
 SELECT bin_0, count(value) AS value_count, coalesce(round(sum(value), 4), 0) AS value_sum, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, round(stddev_pop(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max FROM j GROUP BY 1"""
)
def bin1d_all_stats(spark, sf):
    b = binning.binned_statistics(tracks(spark, sf).obs, "lat", "value", bins=12, ranges=(-90, 90), statistics=list(binning.NAMES))
    return b.select("bin_0", F.col("value_count"), r("value_sum", 4).alias("value_sum"), *(r(f"value_{s}", 6).alias(f"value_{s}") for s in ("mean", "median", "std")), "value_min", "value_max")


@query(
    f"""WITH {TRACKS}, x AS ({_bin1d("-180", "180", 6)}), y AS (SELECT bin_0 AS bin_1, a, b, last FROM ({_bin1d("-90", "90", 4)}))
 SELECT x.bin_0, y.bin_1, (x.a + x.b) / 2 AS center_0, (y.a + y.b) / 2 AS center_1, count(o.event_id) AS count FROM x CROSS JOIN y LEFT JOIN obs o ON o.lon >= x.a AND (o.lon < x.b OR (x.last AND o.lon = x.b)) AND o.lat >= y.a AND (o.lat < y.b OR (y.last AND o.lat = y.b)) GROUP BY ALL"""
)
def bin2d_count(spark, sf):
    return binning.binned_statistics(tracks(spark, sf).obs, ["lon", "lat"], bins=[6, 4], ranges=[(-180, 180), (-90, 90)])


@query(
    f"""WITH {TRACKS}, m AS (SELECT min(t) AS lo, max(t) AS hi FROM obs), e AS (SELECT i AS bin_0, lo + i * (hi - lo) / 5 AS a, lo + (i + 1) * (hi - lo) / 5 AS b, i = 4 AS last, hi FROM range(0, 5) r(i), m)
 SELECT e.bin_0, count(o.value) AS value_count, round(avg(o.value), 6) AS value_mean FROM e LEFT JOIN obs o ON o.t >= e.a AND (CASE WHEN e.last THEN o.t <= e.hi ELSE o.t < e.b END) GROUP BY 1"""
)
def bin_datetime(spark, sf):
    o = tracks(spark, sf).obs.withColumn("ts", F.timestamp_micros("us"))
    return binning.binned_statistics(o, "ts", "value", bins=5, statistics=["mean", "count"]).select("bin_0", "value_count", r("value_mean", 6).alias("value_mean"))


@query(f"WITH {TRACKS}, e AS (SELECT * FROM (VALUES (0, -90, -45), (1, -45, 0), (2, 0, 10), (3, 10, 85)) v(bin_0, a, b)) SELECT CAST(e.bin_0 AS BIGINT) AS bin_0, round(max(value) - min(value), 6) AS value_spread FROM e LEFT JOIN obs o ON o.lat >= e.a AND (o.lat < e.b OR (e.bin_0 = 3 AND o.lat = e.b)) GROUP BY 1")
def bin_udaf(spark, sf):
    def spread(x):
        return x.max() - x.min()

    b = binning.binned_statistics(tracks(spark, sf).obs, "lat", "value", bins=[-90, -45, 0, 10, 85], statistics=spread)
    return b.select("bin_0", r("value_spread", 6).alias("value_spread"))


@query(f"WITH {DRIFTS}, e AS ({_bin1d('0', '100', 8)}) SELECT e.bin_0, round(avg(u * v), 6) + 0.0 AS flux FROM e LEFT JOIN drift o ON o.value >= e.a AND (o.value < e.b OR (e.last AND o.value = e.b)) GROUP BY 1")
def bin_multivar(spark, sf):
    def flux(uv):
        return float(np.mean(uv[0] * uv[1]))

    b = binning.binned_statistics(drifts(spark, sf).obs, "value", ["u", "v"], bins=8, ranges=(0, 100), statistics=[("u,v", flux)])
    return b.select("bin_0", r("flux", 6).alias("flux"))


@query(f"WITH {DRIFTS}, e AS ({_bin1d('0', '100', 4)}) SELECT e.bin_0, round(sum(u), 5) + 0.0 AS sum_re, round(sum(v), 5) + 0.0 AS sum_im, round(sqrt(greatest(avg(u * u + v * v) - avg(u) * avg(u) - avg(v) * avg(v), 0)), 6) AS std FROM e LEFT JOIN drift o ON o.value >= e.a AND (o.value < e.b OR (e.last AND o.value = e.b)) GROUP BY 1")
def bin_complex(spark, sf):
    o = drifts(spark, sf).obs.select("value", complexes.of("u", "v").alias("w"))
    b = binning.binned_statistics(o, "value", "w", bins=4, ranges=(0, 100), statistics=["sum", "std"])
    return b.select("bin_0", r("w_sum.re", 5).alias("sum_re"), r("w_sum.im", 5).alias("sum_im"), r("w_std", 6).alias("std"))


# ---- pairs, overlaps, lookups ----

_PAIR = "SELECT a.row_idx AS row_1, b.row_idx AS row_2, a.obs_idx AS obs_1, b.obs_idx AS obs_2"


@query(f"WITH {TRACKS} {_PAIR}, round({distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 1) AS space, round(abs(a.t - b.t), 6) AS gap FROM obs a JOIN obs b ON a.row_idx < b.row_idx AND abs(a.t - b.t) <= 3600 AND {distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1500000")
def pairs_space_time(spark, sf):
    p = pairs.chance_pairs(tracks(spark, sf).obs, 1_500_000.0, 3600.0, when="t")
    return p.select("row_1", "row_2", "obs_1", "obs_2", positive("space", 1).alias("space"), positive("gap", 6).alias("gap"))


@query(f"WITH {TRACKS} {_PAIR}, round({distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 1) AS space FROM obs a JOIN obs b ON a.row_idx < b.row_idx AND abs(a.lat - b.lat) < 0.2 AND {distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 20000")
def pairs_space_only(spark, sf):
    p = pairs.chance_pairs(tracks(spark, sf).obs, 20_000.0)
    return p.select("row_1", "row_2", "obs_1", "obs_2", positive("space", 1).alias("space"))


@query(f"WITH {TRACKS} SELECT a.row_idx AS row_1, b.row_idx AS row_2, string_agg(a.obs_idx || '-' || b.obs_idx, ',' ORDER BY a.obs_idx, b.obs_idx) AS pairs FROM obs a JOIN obs b ON a.row_idx < b.row_idx AND a.us // 60000000 = b.us // 60000000 AND abs(a.lat - b.lat) < 45.1 AND {distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 5000000 GROUP BY 1, 2")
def pairs_same_time(spark, sf):
    """No tolerance in time (to the minute): an equality key. Grouped by row pair."""
    o = tracks(spark, sf).obs.withColumn("minute", F.floor(F.col("us") / 60_000_000))
    g = pairs.grouped(pairs.chance_pairs(o, 5_000_000.0, 0.0, when="minute"), "obs_1", "obs_2")
    return g.select("row_1", "row_2", F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["obs_1"], p["obs_2"])), ",").alias("pairs"))


@query(f"WITH {TRACKS}, b AS (SELECT row_idx, min(t) AS lo, max(t) AS hi FROM obs GROUP BY 1) SELECT a.row_idx AS row_1, c.row_idx AS row_2 FROM b a JOIN b c ON a.row_idx < c.row_idx AND a.lo <= c.hi + 60 AND c.lo <= a.hi + 60")
def time_overlap_rows(spark, sf):
    return pairs.overlap_pairs(tracks(spark, sf).obs, "t", 60.0)


@query(f"WITH {TRACKS}, b AS (SELECT row_idx, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM obs GROUP BY 1) SELECT a.row_idx AS row_1, c.row_idx AS row_2 FROM b a JOIN b c ON a.row_idx < c.row_idx AND a.w <= c.e + 1 AND c.w <= a.e + 1 AND a.s <= c.n + 1 AND c.s <= a.n + 1")
def box_overlap_rows(spark, sf):
    """Rows whose boxes of longitude and latitude overlap within a degree."""
    return pairs.overlap_pairs(tracks(spark, sf).obs, ["lon", "lat"], 1.0)


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, min(l_shipdate) AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
 SELECT x.k AS order_1, y.k AS order_2 FROM o x JOIN o y ON x.c = y.c AND x.k < y.k AND x.a <= y.b AND y.a <= x.b"""
)
def interval_join(spark, sf):
    """Orders of one customer whose times on the way overlap: an interval join with a condition."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01")).cast("double")
    span = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.min(day("l_shipdate")).alias("a"), F.max(day("l_shipdate")).alias("b"))
    # customers stand far apart on one axis, so that only their own orders can meet
    far = F.col("o_custkey").cast("double") * 1_000_000
    x, y = (span.select(F.col("o_orderkey").alias(f"order_{k}"), (far + F.col("a")).alias(f"low_{k}"), (far + F.col("b")).alias(f"high_{k}")) for k in (1, 2))
    return intervals.overlap_join(x, y, ("low_1", "high_1"), ("low_2", "high_2"), F.col("order_1") < F.col("order_2")).select("order_1", "order_2")


@query(f"WITH {TRACKS}, a AS (SELECT * FROM obs WHERE row_idx = 1), b AS (SELECT * FROM obs WHERE row_idx = 2) SELECT a.row_idx, a.obs_idx FROM a, (SELECT greatest((SELECT min(t) FROM a), (SELECT min(t) FROM b)) - 10 AS lo, least((SELECT max(t) FROM a), (SELECT max(t) FROM b)) + 10 AS hi) WHERE t BETWEEN lo AND hi")
def time_overlap(spark, sf):
    o = tracks(spark, sf).obs
    return pairs.time_overlap(o.filter(F.col(ROW) == 1), o.filter(F.col(ROW) == 2), 10.0, "t")[0].select(ROW, OBS)


@query(f"WITH {TRACKS}, a AS (SELECT * FROM obs WHERE row_idx = 1), b AS (SELECT * FROM obs WHERE row_idx = 2 AND lat > 0) SELECT a.row_idx, a.obs_idx FROM a WHERE lon BETWEEN greatest((SELECT min(lon) FROM a), (SELECT min(lon) FROM b)) - 1 AND least((SELECT max(lon) FROM a), (SELECT max(lon) FROM b)) + 1 AND lat BETWEEN greatest((SELECT min(lat) FROM a), (SELECT min(lat) FROM b)) - 1 AND least((SELECT max(lat) FROM a), (SELECT max(lat) FROM b)) + 1")
def bbox_overlap(spark, sf):
    o = tracks(spark, sf).obs
    return pairs.box_overlap(o.filter(F.col(ROW) == 1), o.filter((F.col(ROW) == 2) & (F.col("lat") > 0)), 1.0)[0].select(ROW, OBS)


@query(f"WITH {TRACKS} SELECT a.obs_idx AS obs_1, b.obs_idx AS obs_2, round({distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 1) AS space, round(abs(a.t - b.t), 6) AS gap FROM obs a, obs b WHERE a.row_idx = 1 AND b.row_idx = 2")
def distance_matrices(spark, sf):
    o = tracks(spark, sf).obs
    a, b = o.filter(F.col(ROW) == 1), o.filter(F.col(ROW) == 2)
    return pairs.distance_matrix(a, b, time="t").select("obs_1", "obs_2", r("space", 1).alias("space"), r("gap", 6).alias("gap"))


@query(f"WITH {TRACKS} SELECT row_idx, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, min(t) AS t_min, max(t) AS t_max FROM obs GROUP BY 1")
def row_bounds(spark, sf):
    b = pairs.bounds(tracks(spark, sf).obs, "lon", "lat", "t")
    return b.select(ROW, *(r(c, 6).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")), "t_min", "t_max")


@query(f"WITH {TRACKS}, g AS (SELECT * FROM (VALUES (0, -60.0), (1, -20.0), (2, 5.0), (3, 33.3), (4, 80.0)) v(i, p)) SELECT event_id, CAST(arg_min(i, abs(lat - p::DOUBLE)) AS BIGINT) AS nearest FROM obs, g GROUP BY 1")
def nearest_lookup(spark, sf):
    return tracks(spark, sf).obs.select("event_id", pairs.nearest(F.col("lat"), [-60.0, -20.0, 5.0, 33.3, 80.0]).alias("nearest"))


@query("SELECT s_suppkey, n_name, r_name, CASE WHEN n_nationkey < 10 THEN r_name ELSE 'N/A' END AS filled FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_left(spark, sf):
    """Two left joins of lookups, and a third with a fill value where the lookup has nothing."""
    s, n, g = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(g, n["n_regionkey"] == g["r_regionkey"], "left")
    few = n.filter("n_nationkey < 10").join(g, n["n_regionkey"] == g["r_regionkey"]).select(F.col("n_nationkey").alias("k"), F.col("r_name").alias("known"))
    return out.join(few, out["s_nationkey"] == few["k"], "left").select("s_suppkey", "n_name", "r_name", F.coalesce("known", F.lit("N/A")).alias("filled"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def ids_semi(spark, sf):
    lines_ = table(spark, sf, "lineitem").filter("l_quantity > 49")
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(lines_, o["o_orderkey"] == lines_["l_orderkey"], "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def ids_anti(spark, sf):
    lines_ = table(spark, sf, "lineitem").filter("l_quantity > 10")
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(lines_, o["o_orderkey"] == lines_["l_orderkey"], "left_anti")


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE value > 90) UNION ALL SELECT 'left' AS side, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE value > 90) UNION ALL SELECT 'all', count(*) FROM events")
def id_sets(spark, sf):
    e = table(spark, sf, "events")
    a, b = e.filter("event_type = 'click'").select("user_id"), e.filter("value > 90").select("user_id")
    n = lambda d, s: d.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n"))
    halves = e.filter("value > 90").unionByName(e.filter("NOT value > 90 OR value IS NULL"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "left")).unionByName(n(halves, "all"))


@query(f"WITH {TRACKS} SELECT o.row_idx, o.obs_idx, n.c AS rowsize FROM obs o JOIN (SELECT row_idx, count(*) AS c FROM obs GROUP BY 1) n USING (row_idx)")
def row_values_to_obs(spark, sf):
    return tracks(spark, sf).joined(["rowsize"]).select(ROW, OBS, "rowsize")


@query(f"WITH {TRACKS} SELECT x.row_idx AS row_1, y.row_idx AS row_2 FROM (SELECT DISTINCT row_idx FROM obs) x JOIN (SELECT DISTINCT row_idx FROM obs) y ON x.row_idx < y.row_idx")
def row_combinations(spark, sf):
    """All pairs of rows are the result here, as the square of the rows by definition."""
    return pairs.combinations(tracks(spark, sf).rows)


# ---- functions of rows ----


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx, round(value - avg(value) OVER (PARTITION BY row_idx), 9) + 0.0 AS anomaly FROM obs")
def apply_map(spark, sf):
    out = apply.map_rows(tracks(spark, sf), lambda x: x - x.mean(), ["value"], "anomaly")
    return out.select(ROW, OBS, r("anomaly", 9).alias("anomaly"))


@query(f"WITH {TRACKS} SELECT row_idx, round(avg(value), 6) AS mean FROM obs WHERE row_idx IN (2, 4, 6) GROUP BY 1")
def apply_reduce(spark, sf):
    out = apply.reduce_rows(tracks(spark, sf), np.mean, ["value"], "mean", rows=[2, 4, 6])
    return out.select(ROW, r("mean", 6).alias("mean"))


@query(f"WITH {TRACKS} SELECT row_idx, min(value) AS low, max(value) AS high, round(sum(value * lat), 4) + 0.0 AS moment FROM obs GROUP BY 1")
def apply_multi(spark, sf):
    out = apply.reduce_rows(tracks(spark, sf), lambda x, y: (x.min(), x.max(), (x * y).sum()), ["value", "lat"], ["low", "high", "moment"])
    return out.select(ROW, "low", "high", r("moment", 4).alias("moment"))


# ---- signals, wavelets, transfer functions ----

_DFT = """e AS (SELECT vec_id AS row_idx, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE len(embedding) = 64)"""


def _vectors(spark, sf) -> RaggedFrame:
    return _components(table(spark, sf, "embeddings").select(F.col("vec_id").alias(ROW), "embedding"))


def _components(e: DataFrame) -> RaggedFrame:
    e = e.select(ROW, F.posexplode("embedding").alias(OBS, "x"))
    obs = e.select(ROW, F.col(OBS).cast("long").alias(OBS), F.col("x").cast("double").alias("x"))
    return RaggedFrame(obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("rowsize")), obs)


@query(
    f"""WITH {_DFT}, m AS (SELECT row_idx, avg(x) AS m FROM e GROUP BY 1), c AS (SELECT e.row_idx, j, x - m AS x, m FROM e JOIN m USING (row_idx)), k AS (SELECT i AS k, CASE WHEN i = 0 THEN 1 WHEN i < 32 THEN 1 WHEN i = 32 THEN 0.5 END::DOUBLE AS g FROM range(0, 33) r(i)),
 f AS (SELECT row_idx, k, g, any_value(m) AS m, sum(x * cos(-2 * pi() * j * k / 64)) AS re, sum(x * sin(-2 * pi() * j * k / 64)) AS im FROM c, k GROUP BY ALL)
 SELECT row_idx, t AS obs_idx, round(any_value(m) + 2 * sum(g * (re * cos(2 * pi() * t * k / 64) - im * sin(2 * pi() * t * k / 64))) / 64, 6) + 0.0 AS x_re, round(2 * sum(g * (re * sin(2 * pi() * t * k / 64) + im * cos(2 * pi() * t * k / 64))) / 64, 6) + 0.0 AS x_im FROM f, range(0, 64) r(t) GROUP BY 1, 2"""
)
def analytic_signal(spark, sf):
    return apply.analytic(_vectors(spark, sf), "x").select(ROW, OBS, r("x_re", 6).alias("x_re"), r("x_im", 6).alias("x_im"))


@query(f"WITH {DRIFTS} SELECT event_id, round((u - lat / 100) / 2, 8) + 0.0 AS p_re, round((value / 100 + v) / 2, 8) + 0.0 AS p_im, round((u + lat / 100) / 2, 8) + 0.0 AS n_re, round((value / 100 - v) / 2, 8) + 0.0 AS n_im, round(u, 8) + 0.0 AS u, round(v, 8) + 0.0 AS v FROM drift")
def rotary(spark, sf):
    """Complex components (u + i value, v + i lat) as rotary halves and back."""
    a, b = complexes.of("u", F.col("value") / 100), complexes.of("v", F.col("lat") / 100)
    o = drifts(spark, sf).obs.withColumn("w", complexes.to_rotary(a, b)).withColumn("z", complexes.from_rotary(F.col("w.p"), F.col("w.n")))
    return o.select("event_id", r("w.p.re", 8).alias("p_re"), r("w.p.im", 8).alias("p_im"), r("w.n.re", 8).alias("n_re"), r("w.n.im", 8).alias("n_im"), r("z.u.re", 8).alias("u"), r("z.v.re", 8).alias("v"))


@query(
    f"""WITH {DRIFTS}, s AS (SELECT event_id, u AS xr, value / 50 AS xi, v + 0.0537::DOUBLE AS yr, lat / 70 AS yi FROM drift), h AS (SELECT *, sqrt(pow(xr - yi, 2) + pow(xi + yr, 2)) / 2 AS p, sqrt(pow(xr + yi, 2) + pow(xi - yr, 2)) / 2 AS n FROM s)
 SELECT event_id, round(sqrt(p * p + n * n), 7) AS kappa, round(2 * p * n * CASE WHEN p < n THEN -1 ELSE 1 END / (p * p + n * n), 7) + 0.0 AS lambda, round(xr, 7) + 0.0 AS x_re, round(yi, 7) + 0.0 AS y_im FROM h"""
)
def ellipse(spark, sf):
    """Ellipse parameters of complex components, and the components back from them."""
    x, y = complexes.of("u", F.col("value") / 50), complexes.of(F.col("v") + 0.0537, F.col("lat") / 70)
    o = drifts(spark, sf).obs.withColumn("e", complexes.ellipse(x, y))
    o = o.withColumn("s", complexes.from_ellipse("e.kappa", "e.lambda", "e.theta", "e.phi"))
    return o.select("event_id", r("e.kappa", 7).alias("kappa"), r("e.lambda", 7).alias("lambda"), r("s.x.re", 7).alias("x_re"), r("s.y.im", 7).alias("y_im"))


@query(
    f"""WITH {_DFT}, k AS (SELECT i AS k, CASE WHEN i <= 3 OR i >= 61 THEN 1 ELSE 0 END AS g FROM range(0, 64) r(i)), f AS (SELECT row_idx, k, g, sum(x * cos(-2 * pi() * j * k / 64)) AS re, sum(x * sin(-2 * pi() * j * k / 64)) AS im FROM e, k GROUP BY ALL)
 SELECT row_idx, t AS obs_idx, round(sum(g * (re * cos(2 * pi() * t * k / 64) - im * sin(2 * pi() * t * k / 64))) / 64, 6) + 0.0 AS x FROM f, range(0, 64) r(t) GROUP BY 1, 2"""
)
def transfer_fft(spark, sf):
    """A low-pass filter over all of a row."""
    low = lambda omega: (np.abs(omega) <= 2 * math.pi * 3.5 / 64).astype(float)
    return apply.filtered(_vectors(spark, sf), "x", low, 1.0).select(ROW, OBS, r("x_re", 6).alias("x"))


# windows of six over the mirrored signal: a filter by the response's own inverse transform, then the kernel's weighted mean
_RESPONSE = (1.0, 0.75, 0.25, 0.0, 0.25, 0.75)


@query(
    f"""WITH {_DFT}, w AS (SELECT i AS j, CASE WHEN i < 3 THEN 3 - i ELSE i - 3 END AS k FROM range(0, 70) r(i)), p AS (SELECT row_idx, w.j AS p, x FROM w JOIN e ON e.j = least(w.k, 126 - w.k)),
 h AS (SELECT n, sum(g * cos(2 * pi() * n * k / 6)) / 6 AS h FROM range(0, 6) a(n), (VALUES {", ".join(f"({k}, {g})" for k, g in enumerate(_RESPONSE))}) b(k, g) GROUP BY 1),
 f AS (SELECT row_idx, s, o, sum(x * h) AS y FROM p, range(0, 65) a(s), range(0, 6) b(o), h WHERE p >= s AND p < s + 6 AND n = ((o - (p - s)) % 6 + 6) % 6 GROUP BY 1, 2, 3)
 SELECT row_idx, s + o - 3 AS obs_idx, round(sum(y * wt) / sum(wt), 6) + 0.0 AS x FROM (SELECT *, 0.75::DOUBLE * (1 - pow((o + 1) * 2 / 7.0::DOUBLE - 1, 2)) AS wt FROM f) WHERE s + o BETWEEN 3 AND 66 GROUP BY 1, 2"""
)
def transfer_sliding(spark, sf):
    """Sliding windows of six over the mirrored signal, filtered and averaged by an Epanechnikov kernel."""
    out = apply.filtered_sliding(_vectors(spark, sf), "x", np.array(_RESPONSE), 6, 1, kernel="epanechnikov")
    return out.select(ROW, OBS, r("x_re", 6).alias("x"))


@query(f"WITH {DRIFTS}, g AS (SELECT event_id, 1e-5::DOUBLE AS a, (u * 10 + lat / 10) / 86164.091::DOUBLE AS b, (1025.0::DOUBLE * (value + 1)) AS m FROM drift) SELECT event_id, round(a / (a * a + b * b) / m, 6) + 0.0 AS re, round(-b / (a * a + b * b) / m, 6) + 0.0 AS im FROM g")
def slab(spark, sf):
    g = complexes.slab_response(F.col("u") * 10, F.col("lat") / 10, 1e-5, F.col("value") + 1)
    return drifts(spark, sf).obs.withColumn("g", g).select("event_id", r("g.re", 6).alias("re"), r("g.im", 6).alias("im"))


@query(
    f"""WITH {MOORINGS}, c AS (SELECT *, 6.0::DOUBLE / 86164.091::DOUBLE AS f, (omega + 6) / 86164.091::DOUBLE AS turn FROM moorings),
 s AS (SELECT *, sqrt(abs(turn) / (200 * f) / 2) AS m, sign(turn) AS sg FROM c)
 SELECT key, round(exp(-m * z) * (cos(m * z) - sin(sg * m * z)) / (1025 * 200 * f * 2 * m), 8) + 0.0 AS re, round(-sg * exp(-m * z) * (cos(m * z) + sg * sin(sg * m * z)) / (1025 * 200 * f * 2 * m), 8) + 0.0 AS im FROM s"""
)
def wind_ekman(spark, sf):
    """Response of an infinite layer of constant viscosity, at each mooring."""
    w = apply.wind_response(moorings(spark, sf), "omega", "z", f=6.0, delta=20.0, mu=0.0, depth=math.inf)
    return w.select("key", r("re", 8).alias("re"), r("im", 8).alias("im"))


@query(
    f"WITH {wavelet_shapes('customer', 'c_custkey', 'c_acctbal')} SELECT key, round(pow(beta / gamma, 1 / gamma), 9) AS modal, round(exp(lgamma((beta + 2) / gamma) - lgamma((beta + 1) / gamma)), 8) AS instantaneous, round(sqrt(gamma * beta), 9) AS width, round((gamma - 3) / sqrt(gamma * beta), 9) + 0.0 AS skew, round(3 - pow((gamma - 3) / sqrt(gamma * beta), 2) - 2 / (gamma * beta), 9) AS kurt FROM p"
)
def morse_freqs(spark, sf):
    """Frequencies and properties of a Morse wavelet for each customer."""
    each = lambda k, g, b: [(k, round(signals.morse_freq(g, b)[0], 9), round(signals.morse_freq(g, b)[2], 8), *(round(x, 9) + 0.0 for x in signals.morse_properties(g, b)))]
    return shaped(shapes(spark, sf, "customer", "c_custkey", "c_acctbal"), each, "key long, modal double, instantaneous double, width double, skew double, kurt double")


def shaped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Records of a function of (key, gamma, beta), row by row."""

    def run(frames):
        for pdf in frames:
            rows = [x for k, g, b in pdf[["key", "gamma", "beta"]].itertuples(index=False) for x in function(k, g, b)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(run, schema)


def _morse(n: str, freqs: list[float], order: int, gamma: float = 3.0, beta: float = 4.0) -> str:
    """Tables ``psi`` (order, freq_idx, frequency, n, k, psi): Morse wavelets of length n in frequency, for each n of ``lengths``."""
    modal, rr = (beta / gamma) ** (1 / gamma), (2 * beta + 1) / gamma
    weight = [math.exp((math.lgamma(rr) + math.lgamma(k + 1) - math.lgamma(k + rr)) / 2) for k in range(order)]
    rows = ", ".join(f"({o}, {i}, {w!r}::DOUBLE, {weight[o]!r}::DOUBLE)" for o in range(order) for i, w in enumerate(freqs))
    return f"""psi AS (SELECT "order", freq_idx, frequency, n, k, CASE WHEN k = 0 THEN 0 ELSE wt * 2 * exp({modal**gamma!r}::DOUBLE - {beta * math.log(modal)!r}::DOUBLE + {beta!r}::DOUBLE * ln(om) - pow(om, {gamma!r}::DOUBLE)) * CASE WHEN "order" = 0 THEN 1 ELSE {rr!r}::DOUBLE - 2 * pow(om, {gamma!r}::DOUBLE) END END AS psi
  FROM (SELECT *, 2 * pi() * greatest(k, 1) / n * {modal!r}::DOUBLE / frequency AS om FROM {n} lengths(n), (VALUES {rows}) w("order", freq_idx, frequency, wt), range(0, 5000) r(k) WHERE k < (n + 1) // 2 AND (n % 4 <> 1 OR k < n // 2)))"""


@query(
    f"""WITH {_DFT}, {_morse("(VALUES (64))", [0.5, 1.0, 2.0], 2)}, x AS (SELECT row_idx, k, sum(x * cos(-2 * pi() * j * k / 64)) AS re, sum(x * sin(-2 * pi() * j * k / 64)) AS im FROM e, range(0, 32) r(k) GROUP BY 1, 2)
 SELECT row_idx, "order"::BIGINT AS "order", freq_idx::BIGINT AS freq_idx, frequency, t AS obs_idx, round(sum(psi * (re * cos(2 * pi() * t * x.k / 64) - im * sin(2 * pi() * t * x.k / 64))) / 64, 8) + 0.0 AS re, round(sum(psi * (re * sin(2 * pi() * t * x.k / 64) + im * cos(2 * pi() * t * x.k / 64))) / 64, 8) + 0.0 AS im
 FROM x JOIN psi ON x.k = psi.k, range(0, 64) r(t) GROUP BY ALL"""
)
def morse_transform(spark, sf):
    w = apply.wavelets(_vectors(spark, sf), "x", 3.0, 4.0, [0.5, 1.0, 2.0], order=2)
    return w.select(ROW, "order", "freq_idx", "frequency", OBS, r("re", 8).alias("re"), r("im", 8).alias("im"))


@query()
def inertial(spark, sf):
    return apply.inertial(drifts(spark, sf), relative_bandwidth=0.5)


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS middle FROM lineitem GROUP BY 1, 2")
def median_by_key(spark, sf):
    """Exact medians of groups of any size, by a sort by range."""
    return binning.medians(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "middle")


# ---- sources: tables as a provider's text, read by its parser ----


def _lines(df: DataFrame, *columns: Column, sep: str = " ") -> DataFrame:
    return df.select(*(c for c in ("row_idx", "at") if c in df.columns), F.concat_ws(sep, *columns).alias("value"))


def _text(df: DataFrame, label: str) -> str:
    """Write lines as text files in the scratch folder; with row_idx and at, a row's lines stay together and in order."""
    path = fresh_path(df.sparkSession, label)
    if "at" in df.columns:
        # by a value that no input is dealt by: a union of two tables dealt by row passes for one, but its parts stay apart
        df = df.repartition(F.xxhash64(ROW)).sortWithinPartitions(ROW, "at")
    df.select("value").write.text(path)
    return path


def _fixed(c: Column | str, digits: int = 4) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(20,{digits})").cast("string")


@query(f"WITH {TRACKS} SELECT 'D' || row_idx AS id, obs_idx, us, round(CAST(lat AS DECIMAL(20,4))::FLOAT::DOUBLE, 3) + 0.0 AS latitude, round(CAST(value AS DECIMAL(20,4))::FLOAT::DOUBLE, 3) AS u FROM obs")
def glad_text(spark, sf):
    """Columns parted by white space: id, date, time, positions, velocities."""
    o = tracks(spark, sf).obs
    t = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    path = _text(_lines(o.drop("at"), F.concat(F.lit("D"), ROW), t, _fixed("lat"), _fixed("lon"), F.lit("5.0"), _fixed("value"), F.lit("0.5"), F.lit("0.01")), "glad")
    f = providers.glad(spark, path, header=0)
    return f.joined(["id"]).select("id", OBS, F.unix_micros("time").alias("us"), r(F.col("latitude").cast("double"), 3).alias("latitude"), r(F.col("u").cast("double"), 3).alias("u"))


@query(f"WITH {TRACKS} SELECT 'Q' || row_idx AS drifter_id, obs_idx, CASE WHEN event_id % 50 = 0 THEN -1 ELSE us // 1000000 * 1000000 END AS us, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS battery_state FROM (SELECT * EXCLUDE obs_idx, row_number() OVER (PARTITION BY row_idx ORDER BY CASE WHEN event_id % 50 = 0 THEN NULL ELSE us // 1000000 END NULLS FIRST, event_id) - 1 AS obs_idx FROM obs)")
def quicche_text(spark, sf):
    """Ten columns, the last two of which may be absent; bad times are null and sort first."""
    o = tracks(spark, sf).obs.withColumn("at", F.col("event_id"))
    t = F.when(F.col("event_id") % 50 == 0, "unknown").otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    state = F.when(F.col("event_id") % 3 != 0, F.concat_ws(" ", "event_type", F.lit("F")))
    path = _text(_lines(o, F.lit("1"), F.lit("2"), F.concat(F.lit("Q"), ROW), t, F.lit("0"), _fixed("lat"), _fixed("lon"), F.lit("X"), state), "quicche")
    f = providers.quicche(spark, path, "qc1")
    return f.joined(["drifter_id"]).select("drifter_id", OBS, F.coalesce(F.unix_micros("time"), F.lit(-1)).alias("us"), "battery_state")


@query(f"WITH {TRACKS} SELECT 'AL' || lpad(row_idx::VARCHAR, 6, '0') AS id, obs_idx, round(CAST(lat AS DECIMAL(20,2))::DOUBLE, 2) + 0.0 AS lat, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(floor(value) * 1825 / 3600, 6) END AS wind_speed, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 100.0 * (900 + event_id % 100) END AS pressure FROM obs")
def hurdat2_text(spark, sf):
    """A header line before each storm's data lines; -999 and negative winds are missing."""
    f = tracks(spark, sf)
    storm = F.concat(F.lit("AL"), F.lpad(F.col(ROW).cast("string"), 6, "0"))
    head = f.rows.withColumn("at", F.lit(-1).cast("long")).select(ROW, "at", F.concat_ws(", ", storm, F.lit("UNNAMED"), F.col("rowsize").cast("string"), F.lit("")).alias("value"))
    t = F.timestamp_micros("us")
    lat = F.col("lat").cast("decimal(20,2)")
    north = F.concat(F.abs(lat).cast("string"), F.when(lat < 0, "S").otherwise("N"))
    east = F.concat(F.abs(F.col("lon").cast("decimal(20,1)")).cast("string"), F.when(F.col("lon") < 0, "W").otherwise("E"))
    wind = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "-99").otherwise("-999")).otherwise(F.floor("value").cast("string"))
    pressure = F.when(F.col("event_id") % 5 == 0, "-999").otherwise((900 + F.col("event_id") % 100).cast("string"))
    data = f.obs.select(ROW, F.col(OBS).alias("at"), F.concat_ws(", ", F.date_format(t, "yyyyMMdd"), F.date_format(t, "HHmm"), F.lit(" "), F.lit("HU"), north, east, wind, pressure, *[F.lit("-999")] * 13).alias("value"))
    path = _text(head.unionByName(data), "hurdat2")
    return providers.hurdat2(spark, path).joined(["id"]).select("id", OBS, r("lat", 2).alias("lat"), r("wind_speed", 6).alias("wind_speed"), "pressure")


@query(f"WITH {TRACKS} SELECT row_idx AS id, obs_idx, CASE WHEN event_id % 6 = 0 THEN NULL ELSE round(CAST(lon AS DECIMAL(20,4))::DOUBLE, 4) + 0.0 END AS lon_d, round(CAST(lat AS DECIMAL(20,4))::DOUBLE, 4) + 0.0 AS lat_d, 900 + row_idx AS wmo_id, CASE WHEN row_idx % 3 = 0 THEN 'METOCEAN' WHEN row_idx % 3 = 1 THEN 'APEX' END AS float_type FROM obs")
def yomaha_text(spark, sf):
    """28 columns with a mark of missing values for each, and two lookups by left join."""
    f = tracks(spark, sf)
    o = f.obs.withColumn("at", F.col(OBS))
    lon = F.when(F.col("event_id") % 6 == 0, "-999.9999").otherwise(_fixed("lon"))
    path = _text(_lines(o, lon, _fixed("lat"), *[F.lit("1.5")] * 23, F.col(ROW).cast("string"), F.lit("7"), F.lit("0")), "yomaha")
    ids = _text(_lines(f.rows, F.col(ROW).cast("string"), (F.col(ROW) + 900).cast("string"), F.lit("1"), (F.col(ROW) % 3).cast("string")), "wmo")
    kinds = _text(spark.createDataFrame([("0 : X",), ("1 : APEX ",)], "value string"), "types")
    y = providers.yomaha(spark, path, ids, types=kinds)
    return y.joined(["id", "wmo_id", "float_type"]).select("id", OBS, r("lon_d", 4).alias("lon_d"), r("lat_d", 4).alias("lat_d"), "wmo_id", "float_type")


@query(f"WITH {TRACKS} SELECT row_idx AS id, count(*) AS rowsize, CASE WHEN row_idx % 4 = 0 THEN -999 ELSE row_idx + 5000 END AS wmo_number, min(epoch_us(date_trunc('day', make_timestamp(us)))) AS first_day FROM obs WHERE event_id % 9 <> 0 GROUP BY 1")
def gdp_text(spark, sf):
    """Raw fixes with fractional days, anomalous lines to leave out, and metadata that some drifters lack."""
    f = tracks(spark, sf)
    t = F.timestamp_micros("us")
    day = F.concat(F.dayofmonth(t).cast("string"), F.lit(".25"))
    year = F.when(F.col("event_id") % 9 == 0, "9999").otherwise(F.year(t).cast("string"))
    month = F.month(t).cast("string")
    raw = _text(_lines(f.obs.withColumn("at", F.col(OBS)), F.col(ROW).cast("string"), month, day, year, _fixed("lat"), _fixed("lon"), month, day, F.year(t).cast("string"), *[F.lit("1.0")] * 7), "gdp")
    meta = _lines(f.rows.filter(F.col(ROW) % 4 != 0), F.col(ROW).cast("string"), (F.col(ROW) + 5000).cast("string"), F.lit("1 SVP 2024/01/01 00:00 1.0 2.0 2024/02/01 00:00 3.0 4.0 0000/00/00 00:00 1"))
    g = providers.gdp_source(spark, raw, providers.directory(spark, _text(meta, "dirfl")))
    days = g.obs.groupBy(ROW).agg(F.min(F.unix_micros(F.date_trunc("day", "position_datetime"))).alias("first_day"))
    return g.rows.join(days, ROW).select("id", "rowsize", "wmo_number", "first_day")


# ---- cleaning ----


@query("SELECT doc_id, substr(source, 1, 4) AS source, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS DOUBLE), -1) AS number, CASE WHEN n_chars < 100 THEN NULL ELSE n_chars::DOUBLE END AS n_chars, regexp_replace(lang, 'n$', '') AS lang, trim(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii FROM documents")
def cleaning_strings(spark, sf):
    d = table(spark, sf, "documents")
    n = F.when(F.col("n_chars") < 100, F.lit(cleaning.FILL)).otherwise(F.col("n_chars").cast("double"))
    return d.select("doc_id", cleaning.cut(F.col("source"), 4).alias("source"), cleaning.to_float(F.regexp_extract("source", "([0-9]+)$", 1), -1.0).alias("number"), cleaning.unfill(n).alias("n_chars"), cleaning.drop_suffix(F.col("lang"), "n").alias("lang"), cleaning.ascii_only(F.col("text")).alias("ascii"))


@query("SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate::TIMESTAMP) + CAST(round(l_quantity::DOUBLE / 100 * 86400000000) AS BIGINT) AS us FROM lineitem")
def cleaning_dates(spark, sf):
    """A date whose day has a fraction, by year, month and day, and by MATLAB's day number."""
    li = table(spark, sf, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    part = F.col("l_quantity").cast("double") / 100
    t = cleaning.fraction_date(F.year("d"), F.month("d"), F.dayofmonth("d") + part)
    m = cleaning.matlab_time(F.unix_date("d") + cleaning.EPOCH_DAY + part)
    same = F.abs(F.unix_micros(t) - F.unix_micros(m)) <= 50
    exact = F.unix_micros(F.col("d").cast("timestamp")) + F.round(part * 86_400_000_000).cast("long")
    return li.select("l_orderkey", "l_linenumber", F.when(same & (F.abs(F.unix_micros(t) - exact) <= 50), exact).alias("us"))


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx, CASE WHEN row_idx % 3 = 0 THEN true WHEN max(t) OVER (PARTITION BY row_idx) <= lost THEN true ELSE t < lost END AS drogue_on FROM (SELECT *, 1704000000.0::DOUBLE + row_idx * 20000 AS lost FROM obs)")
def drogue_presence(spark, sf):
    o = tracks(spark, sf).obs.withColumn("lost", F.when(F.col(ROW) % 3 != 0, 1704000000.0 + F.col(ROW) * 20000))
    return o.select(ROW, OBS, cleaning.drogue_on(F.col("lost"), F.col("t")).alias("drogue_on"))


@query(f"WITH {ORDERS} SELECT row_idx, obs_idx, l_quantity FROM obs")
def padded_to_ragged(spark, sf):
    """Arrays padded to one length, cut to their counts."""
    lists = ragged.to_regular(orders(spark, sf), "l_quantity", -1).join(orders(spark, sf).rows, ROW)
    f = providers.padded(lists.withColumnRenamed("rowsize", "numobs"))
    return f.obs.select(ROW, OBS, "l_quantity")


@query("SELECT user_id AS id, count(*) AS rowsize, min(event_id) AS first_event FROM events GROUP BY 1")
def ranked_rows(spark, sf):
    """Rows numbered by the rank of their id."""
    f = files.number_rows(table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts", "event_id"), "id", ["ts", "event_id"])
    return f.rows.join(f.obs.groupBy(ROW).agg(F.min("event_id").alias("first_event")), ROW).select("id", "rowsize", "first_event")


@query(f"WITH {TRACKS} SELECT min(t) AS start, max(t) AS stop, count(DISTINCT row_idx) AS n_rows FROM obs")
def time_coverage(spark, sf):
    return tracks(spark, sf).obs.agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.countDistinct(ROW).alias("n_rows"))


@query(f"WITH {TRACKS}, x AS (SELECT row_idx, obs_idx, value, row_number() OVER (PARTITION BY row_idx ORDER BY value DESC, obs_idx) AS k FROM obs) SELECT row_idx, obs_idx, value FROM x WHERE k <= 2")
def top_two(spark, sf):
    """The two largest values of each row."""
    w = Window.partitionBy(ROW).orderBy(F.desc("value"), OBS)
    return tracks(spark, sf).obs.withColumn("k", F.row_number().over(w)).filter("k <= 2").select(ROW, OBS, "value")
