"""Line pieces for maps: rows split where their longitude jumps, with a color for each point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import OBS, ROW
from .ragged import segment_both


def pieces(obs: DataFrame, lon: str = "lon", lat: str = "lat", tolerance: float = 180.0, color: str | None = None) -> DataFrame:
    """(row_idx, piece, points): each unbroken piece of a row as an ordered array of (lon, lat, color).

    ``color`` is a column; without one the row's index is the color.
    """
    shade = F.col(color).cast("double") if color else F.col(ROW).cast("double")
    cut = segment_both(obs, lon, tolerance, "piece").withColumn("__color", shade)
    point: Column = F.struct(OBS, F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col("__color").alias("color"))
    return cut.groupBy(ROW, "piece").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["color"].alias("color"))).alias("points"))


def line_colors(obs: DataFrame, color: str, lon: str = "lon", tolerance: float = 180.0) -> DataFrame:
    """(row_idx, piece, obs_idx, color): a color for each line between two points of a piece, the mean of its ends."""
    cut = segment_both(obs, lon, tolerance, "piece")
    w = Window.partitionBy(ROW, "piece").orderBy(OBS)
    mean = F.avg(F.col(color).cast("double")).over(w.rowsBetween(0, 1))
    return cut.withColumn("__mean", mean).withColumn("__next", F.lead(OBS).over(w)).filter("__next IS NOT NULL").select(ROW, "piece", OBS, F.col("__mean").alias("color"))
