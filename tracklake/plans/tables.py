"""The standard tables as ragged data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere
from ..model import RaggedFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> RaggedFrame:
    """Events as trajectories: a row a user, positions derived from an event's properties and value.

    Longitudes jump over the whole globe, date line included; ``t`` is seconds.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    e = table(spark, sf_dir, "events")
    lon = sphere.recast_lon180(F.col("value") * 7 + F.col("event_id") * 0.37)
    obs = e.select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), lon.alias("lon"), ((k - 49.5) * 1.7).alias("lat")).withColumn("t", F.col("us") / 1e6)
    return RaggedFrame.from_long(obs, "user_id", ["us", "event_id"])


def drifts(spark: SparkSession, sf_dir: str) -> RaggedFrame:
    """Events as short steps in the plane and a smooth position in degrees: ``u``, ``v``, ``lon``, ``lat``."""
    f = tracks(spark, sf_dir)
    u, v = F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0 - 0.5, F.pmod(F.col("event_id") * 53, F.lit(97)) / 100.0 - 0.48
    slow = {"u": u, "v": v, "lon": F.col("obs_idx") * 0.01 + F.pmod("row_idx", F.lit(300)) - 150.0, "lat": F.pmod("row_idx", F.lit(120)) - 60.0 + F.pmod(F.col("event_id"), F.lit(7)) * 0.01}
    return f.with_obs(**slow)


#: Line numbers repeat within an order, so the other columns decide.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def orders(spark: SparkSession, sf_dir: str) -> RaggedFrame:
    """Lines as observations: a row an order."""
    return RaggedFrame.from_long(table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, "l_returnflag"), "l_orderkey", list(LINE))


# ---- the same in SQL ----

TRACKS = """obs AS (SELECT user_id AS row_idx, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS obs_idx, event_id, event_type, value,
  epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, fmod(fmod(value * 7 + event_id * CAST(0.37 AS DOUBLE) + 180, 360) + 360, 360) - 180 AS lon,
  (CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) - 49.5) * CAST(1.7 AS DOUBLE) AS lat, user_id FROM events)"""
DRIFTS = f"""{TRACKS}, drift AS (SELECT row_idx, obs_idx, event_id, t, value, (event_id * 37 % 101) / CAST(100.0 AS DOUBLE) - 0.5 AS u, (event_id * 53 % 97) / CAST(100.0 AS DOUBLE) - CAST(0.48 AS DOUBLE) AS v,
  obs_idx * CAST(0.01 AS DOUBLE) + row_idx % 300 - CAST(150.0 AS DOUBLE) AS lon, row_idx % 120 - CAST(60.0 AS DOUBLE) + event_id % 7 * CAST(0.01 AS DOUBLE) AS lat FROM obs)"""
ORDERS = "obs AS (SELECT l_orderkey AS row_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS obs_idx, l_quantity, l_extendedprice, l_shipdate, l_returnflag FROM lineitem)"


def distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {sphere.EARTH_RADIUS_METERS:.1f}::DOUBLE * asin(sqrt(CASE WHEN {h} > 1 THEN 1 ELSE {h} END)))"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a, b, d = f"radians({lat1})", f"radians({lat2})", f"radians({lon2} - {lon1})"
    return f"atan2(cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d}), sin({d}) * cos({b}))"


#: Moorings, one a supplier: a frequency in radians a day and a depth in meters.
MOORINGS = "moorings AS (SELECT s_suppkey AS key, s_acctbal / 500 - 4 AS omega, (s_suppkey * 7 % 39)::DOUBLE + 0.25::DOUBLE AS z FROM supplier)"


def moorings(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 500 - 4).alias("omega"), ((F.col("s_suppkey") * 7 % 39).cast("double") + 0.25).alias("z"))


def wavelet_shapes(name: str, key: str, balance: str) -> str:
    """SQL of a table p (key, gamma, beta): a wavelet's shape for each row of a table of accounts."""
    return f"p AS (SELECT {key} AS key, (2 + {key} % 3)::DOUBLE AS gamma, 1 + abs({balance}) / 700 AS beta FROM {name})"


def shapes(spark: SparkSession, sf: str, name: str, key: str, balance: str) -> DataFrame:
    t = table(spark, sf, name)
    return t.select(F.col(key).alias("key"), (2 + F.col(key) % 3).cast("double").alias("gamma"), (1 + F.abs(balance) / 700).alias("beta"))
