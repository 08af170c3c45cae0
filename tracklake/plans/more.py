"""More queries: streams, files of providers, stored forms, pairs of tables, wavelet shapes, wind layers. The same rules as in ``queries``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning
from ..model import OBS, ROW, RaggedFrame
from ..operators import apply, kinematics, pairs, ragged, signals, special, transfer
from ..scratch import fresh_path, materialize
from ..sources import files, grids, growing, matlab, providers
from ..streaming import streams
from .queries import _W, _fixed, _lines, _morse, _text, positive, query, r, shaped
from .tables import DRIFTS, MOORINGS, ORDERS, TRACKS, bearing, distance, drifts, moorings, orders, shapes, table, tracks, wavelet_shapes

# ---- streams: the table as files that a stream reads to their end ----


def _stream(df: DataFrame, label: str, *dealt: str) -> DataFrame:
    """A stream over ``df`` written as files by its time, or dealt out by other columns; ``time`` is its timestamp."""
    path = fresh_path(df.sparkSession, label)
    n = max(4, df.sparkSession.sparkContext.defaultParallelism)
    (df.repartition(n, *dealt) if dealt else df.repartitionByRange(n, "time")).write.parquet(path)
    return streams.observations(df.sparkSession, path, df.schema, per_trigger=1000)


def _ended(stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives by the time its files are read, as a table."""
    path = fresh_path(stream.sparkSession, label)
    with streams.timers(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _timed(spark, sf, *columns) -> DataFrame:
    return tracks(spark, sf).obs.select(ROW, OBS, F.timestamp_micros("us").alias("time"), *columns)


@query(f"WITH {TRACKS} SELECT row_idx, count(*) AS n, min(us) AS first, max(us) AS last FROM obs GROUP BY 1")
def stream_ingest(spark, sf):
    """Observations read chunk by chunk into a table."""
    o = _ended(_stream(_timed(spark, sf, "value"), "stream"), "ingested")
    return o.groupBy(ROW).agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("time")).alias("first"), F.max(F.unix_micros("time")).alias("last"))


@query(f"WITH {TRACKS}, g AS (SELECT row_idx, us, CASE WHEN us - lag(us) OVER w >= 21600000000 THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY row_idx ORDER BY us)), s AS (SELECT row_idx, us, sum(new) OVER (PARTITION BY row_idx ORDER BY us) AS k FROM g) SELECT row_idx, min(us) AS start, max(us) AS stop, count(*) AS rowsize FROM s GROUP BY row_idx, k HAVING max(us) + 21600000000 <= (SELECT max(us) // 1000 * 1000 FROM obs)")
def stream_sessions(spark, sf):
    """Runs of a row that the watermark has closed."""
    s = _ended(streams.sessions(_stream(_timed(spark, sf), "stream"), ROW, "6 hours", late="0 seconds"), "sessions")
    return s.select(ROW, F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "rowsize")


@query(f"WITH {TRACKS} SELECT us // 3600000000 * 3600000000 AS start, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM obs GROUP BY 1 HAVING us // 3600000000 * 3600000000 + 3600000000 <= (SELECT max(us) // 1000 * 1000 FROM obs)")
def stream_bins(spark, sf):
    """Statistics of the hours that the watermark has closed."""
    b = _ended(streams.binned(_stream(_timed(spark, sf, "value"), "stream"), "value", "1 hour", late="0 seconds"), "bins")
    return b.select(F.unix_micros("start").alias("start"), "count", r("sum", 4).alias("sum"), r("mean", 6).alias("mean"), r("std", 6).alias("std"), "min", "max")


@query(
    f"WITH {DRIFTS}, n AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y, t - lag(t) OVER w AS dt FROM drift {_W}), l AS (SELECT row_idx, CAST(round(t * 1e6) AS BIGINT) AS us, {distance('x', 'y', 'lon', 'lat')} AS d, {bearing('x', 'y', 'lon', 'lat')} AS b, dt FROM n)"
    " SELECT row_idx, us, round(d * cos(b) / dt, 5) + 0.0 AS u, round(d * sin(b) / dt, 5) + 0.0 AS v FROM l"
)
def stream_velocities(spark, sf):
    """Velocities from each fix and the one before it, which is the state."""
    o = drifts(spark, sf).obs.select(ROW, "lon", "lat", F.timestamp_micros("us").alias("time"))
    v = _ended(streams.velocities(_stream(o, "stream", "lat"), ROW, late="0 seconds"), "velocities")
    return v.select(ROW, F.unix_micros("time").alias("us"), r("u", 5).alias("u"), r("v", 5).alias("v"))


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx // 5 AS chunk, round(avg(value), 9) AS mean FROM obs GROUP BY 1, 2 HAVING count(*) = 5")
def stream_chunks(spark, sf):
    """Means of every five observations of a row."""
    c = _ended(streams.count_windows(_stream(_timed(spark, sf, "value"), "stream", "value"), ROW, "value", 5, late="0 seconds"), "chunks")
    return c.select(ROW, "chunk", r("mean", 9).alias("mean"))


@query(f"WITH {TRACKS} SELECT a.row_idx AS row_1, b.row_idx AS row_2, a.us AS us_1, b.us AS us_2 FROM obs a JOIN obs b ON a.row_idx < b.row_idx AND abs(a.us - b.us) <= 3600000000 AND {distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1500000")
def stream_pairs(spark, sf):
    """Pairs of two streams that are close in space and time."""
    s = _stream(_timed(spark, sf, "lon", "lat"), "stream")
    p = _ended(streams.crowded_pairs(s, s, 1_500_000.0, 3600, ordered=True), "pairs")
    return p.filter("row_1 < row_2").select("row_1", "row_2", F.unix_micros("time_1").alias("us_1"), F.unix_micros("time_2").alias("us_2"))


# ---- files of providers ----


@query(f"WITH {TRACKS} SELECT 'L' || row_idx AS id, row_number() OVER (PARTITION BY row_idx ORDER BY us // 86400000000, obs_idx) - 1 AS obs_idx, us // 86400000000 * 86400000000 AS us, round(CAST(lat AS DECIMAL(20,4))::FLOAT::DOUBLE, 3) + 0.0 AS latitude, event_id FROM obs")
def laser_text(spark, sf):
    """The same columns with comments; equal times (whole days) keep the file's order. The last column has the event."""
    o = tracks(spark, sf).obs.withColumn("at", F.col(OBS))
    t = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd' 00:00:00.0'")
    lines = _lines(o, F.concat(F.lit("L"), ROW), t, _fixed("lat"), _fixed("lon"), F.lit("5.0"), F.floor(F.col("event_id") / 1000).cast("string"), (F.col("event_id") % 1000).cast("string"), F.lit("0.01 % a comment"))
    f = providers.laser(spark, _text(lines.unionByName(lines.limit(1).withColumn("value", F.lit("% only a comment"))), "laser"))
    event = (F.col("u").cast("double") * 1000 + F.col("v").cast("double")).cast("long")
    return f.joined(["id"]).select("id", OBS, F.unix_micros("time").alias("us"), r(F.col("latitude").cast("double"), 3).alias("latitude"), event.alias("event_id"))


@query(f"WITH {TRACKS} SELECT row_idx AS id, obs_idx, CASE WHEN event_id % 6 = 0 THEN NULL ELSE round(CAST(lon AS DECIMAL(20,4))::DOUBLE, 4) + 0.0 END AS lon_d, round(CAST(lat AS DECIMAL(20,4))::DOUBLE, 4) + 0.0 AS lat_d, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 4.5 END AS temp_d, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END AS profile_id FROM obs")
def andro_text(spark, sf):
    """37 columns, each with its own mark of missing values."""
    o = tracks(spark, sf).obs.withColumn("at", F.col(OBS))
    lon = F.when(F.col("event_id") % 6 == 0, "-999.9999").otherwise(_fixed("lon"))
    temp = F.when(F.col("event_id") % 7 == 0, "-99.999").otherwise("4.5")
    profile = F.when(F.col("event_id") % 5 == 0, "-99").otherwise(F.col("event_id").cast("string"))
    f = providers.andro(spark, _text(_lines(o, lon, _fixed("lat"), F.lit("900.0"), temp, *[F.lit("1.5")] * 29, F.lit("3"), F.col(ROW).cast("string"), F.lit("7"), profile), "andro"))
    return f.joined(["id"]).select("id", OBS, r("lon_d", 4).alias("lon_d"), r("lat_d", 4).alias("lat_d"), r(F.col("temp_d").cast("double"), 4).alias("temp_d"), F.coalesce("profile_id", F.lit(-1)).alias("profile_id"))


def _files(df: DataFrame, label: str, name: str, ending: str = ".csv") -> str:
    """A folder with a text file for each value of ``name``: its header and the lines of ``value`` in order of ``at``. A task writes many."""
    folder = fresh_path(df.sparkSession, label)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = grids.store(folder)
        system.create_dir(path, recursive=True)
        for pdf in frames:
            for of, text in zip(pdf[name], pdf["text"], strict=True):
                with system.open_output_stream(f"{path}/x_{of}{ending}") as out:
                    out.write(text.encode())
            yield pdf[[name]]

    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    df.groupBy(name).agg(F.array_join(ordered["value"], "\n").alias("text")).mapInPandas(write, T.StructType([T.StructField(name, df.schema[name].dataType)])).count()
    return folder


def _sensors(spark, sf) -> tuple[str, str]:
    """A list of sensors (nations, last first) and a file of fixes (suppliers) for each."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    listed = n.select(F.lit("list").alias("of"), (-F.col("n_nationkey")).alias("at"), F.concat_ws(",", F.concat(F.lit("S"), "n_nationkey"), "n_regionkey", F.lit("2019-10-01")).alias("value"))
    head = spark.createDataFrame([("list", -1000, "Sensor ID,leg,Deployment Date")], "of string, at long, value string")
    fixes = s.select(F.concat(F.lit("S"), "s_nationkey").alias("of"), F.col("s_suppkey").cast("long").alias("at"), F.concat_ws(",", F.lit("2019-10-05 00:00:00"), F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")).alias("value"))
    top = n.select(F.concat(F.lit("S"), "n_nationkey").alias("of"), F.lit(-1).cast("long").alias("at"), F.lit("datetime,latitude,longitude").alias("value"))
    return _files(head.unionByName(listed.withColumn("at", F.col("at").cast("long"))), "sensors", "of"), _files(fixes.unionByName(top), "buoys", "of")


@query("SELECT 24 - n_nationkey AS row_idx, 'S' || n_nationkey AS id, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS obs_idx, s_suppkey::DOUBLE AS latitude, s_acctbal::DOUBLE AS longitude FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def mosaic_text(spark, sf):
    """Buoys in the order of a sensor list, each in a file that its name tells."""
    f = providers.mosaic(spark, *_sensors(spark, sf))
    return f.joined(["id"]).select(ROW, "id", OBS, "latitude", "longitude")


@query("SELECT 'f' || n_nationkey || '.csv' AS name, 'http://x/' || n_name AS url FROM nation")
def xml_urls(spark, sf):
    """File names and addresses of a repository's XML record, one record a nation."""
    one = F.format_string("<eml><dataset><dataTable><physical><objectName>f%d.csv</objectName><distribution><online><url>http://x/%s</url></online></distribution></physical></dataTable></dataset></eml>", F.col("n_nationkey"), F.col("n_name"))
    return providers.file_urls(table(spark, sf, "nation").select(one.alias("value"))).filter("name IS NOT NULL")


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx, us, round(lat::FLOAT::DOUBLE, 3) + 0.0 AS pres, round(value::FLOAT::DOUBLE, 3) AS temp FROM (SELECT *, CAST(round(us / 1000) AS BIGINT) * 1000 AS ms FROM obs)")
def subsurface_arrays(spark, sf):
    """Records of arrays with MATLAB days."""
    day = F.col("us") / 86_400_000_000 + cleaning.EPOCH_DAY
    o = tracks(spark, sf).obs.select(ROW, OBS, F.struct(OBS, day.alias("dtnum"), "lon", F.col("lat").alias("p"), F.col("value").alias("t"), "us").alias("x"))
    nested = o.groupBy(F.col(ROW)).agg(F.array_sort(F.collect_list("x")).alias("x")).select(ROW, *(F.col(f"x.{c}").alias(c) for c in ("dtnum", "lon", "p", "t", "us")))
    f = providers.subsurface(nested)
    near = F.abs(F.unix_micros("time") - F.col("us")) <= 20  # a day number has about that resolution
    return f.obs.select(ROW, OBS, F.when(near, F.col("us")).alias("us"), r(F.col("pres").cast("double"), 3).alias("pres"), r(F.col("temp").cast("double"), 3).alias("temp"))


MAT_OBS = 1 << 18  # observations of a MATLAB file, about: more floats go to more files


@query(f"WITH {TRACKS} SELECT row_idx, obs_idx, us, round(lat::FLOAT::DOUBLE, 3) + 0.0 AS pres, round(value::FLOAT::DOUBLE, 3) AS temp, 'experiment ' || row_idx % 4 AS experiment FROM obs")
def subsurface_file(spark, sf):
    """Floats of four experiments from MATLAB files of bounded size, plain and compressed in turn."""
    folder = fresh_path(spark, "mat")
    day = F.col("us") / 86_400_000_000 + cleaning.EPOCH_DAY
    o = tracks(spark, sf).obs.select(ROW, OBS, (F.col(ROW) % 4).alias("file"), day.alias("dtnum"), "lon", F.col("lat").alias("p"), F.col("value").alias("t"))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, name = int(key[0]), f"part-{key[0]}-{key[1]}.mat"
        floats = [g.sort_values(OBS) for _, g in pdf.groupby(ROW)]
        variables = {c: [g[c].to_numpy(float) for g in floats] for c in ("dtnum", "lon", "p", "t")}
        variables |= {"indexFlt": np.array([float(g[ROW].iloc[0]) for g in floats]), "indexExp": np.full(len(floats), k + 1.0), "expList": [f"experiment {k}"], "expName": [["name"] for _ in floats]}
        system, path = grids.store(f"{folder}/{name}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            matlab.write(out, variables, compress=k % 2 == 0)
        return pd.DataFrame({"path": [f"{folder}/{name}"]})

    files_of_each = -(-table(spark, sf, "events").count() // (4 * MAT_OBS)) or 1
    written = o.withColumn("part", F.pmod(F.xxhash64(ROW), F.lit(files_of_each))).groupBy("file", "part").applyInPandas(write, "path string")
    paths = [x.path for x in materialize(written, "mat-files").orderBy("path").toLocalIterator()]
    f = providers.subsurface_mat(spark, paths)
    j = f.joined(["indexFlt", "expList"])
    us = F.unix_micros("time")
    true = tracks(spark, sf).obs.select(F.col(ROW).alias("indexFlt"), OBS, "us")
    j = j.join(true, ["indexFlt", OBS])
    near = F.abs(us - F.col("us")) <= 20  # a day number has about that resolution
    return j.select(F.col("indexFlt").alias(ROW), OBS, F.when(near, F.col("us")).alias("us"), r(F.col("pres").cast("double"), 3).alias("pres"), r(F.col("temp").cast("double"), 3).alias("temp"), F.col("expList").alias("experiment"))


_SHIP = "'ship of the long name ' || row_idx"


def _drifter_tables(spark, sf):
    f = tracks(spark, sf)
    fill = lambda c, k: F.when(F.col("event_id") % k == 0, cleaning.FILL).otherwise(c)
    rows = f.rows.select(
        ROW, F.col(ROW).alias("ID"), F.concat(F.lit("ship of the long name "), F.col(ROW).cast("string")).alias("DeployingShip"), F.concat((F.col(ROW) % 7).cast("string"), F.lit(".5 V")).alias("ManufactureVoltage"),
        F.concat((F.col(ROW) % 9).cast("string"), F.lit(".25 cm")).alias("FloatDiameter"), F.when(F.col(ROW) % 3 == 0, "nan").otherwise("12").alias("CurrentProgram"),
        F.when(F.col(ROW) % 4 == 0, cleaning.FILL).otherwise(1704000000.0 + F.col(ROW) * 20000).alias("drogue_lost_date"), F.when(F.col(ROW) % 2 == 0, "Argos").otherwise("GPS").alias("location_type"),
    )
    obs = f.obs.select(ROW, OBS, F.col("t").alias("time"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), fill(F.col("value"), 5).alias("sst"), fill(F.col("value") + 1, 3).alias("temp"), F.col("value").alias("ve"))
    return rows, obs


_DRIFTER = f"""WITH {TRACKS} SELECT row_idx, obs_idx, substr({_SHIP}, 1, 20) AS ship, row_idx % 7 + 0.5::DOUBLE AS voltage, row_idx % 9 + 0.25::DOUBLE AS diameter, CASE WHEN row_idx % 3 = 0 THEN -1 ELSE 12 END::DOUBLE AS program, row_idx % 2 <> 0 AS gps,
 CASE WHEN row_idx % 4 = 0 OR 1704000000.0::DOUBLE + row_idx * 20000 >= max(t) OVER (PARTITION BY row_idx) THEN true ELSE t < 1704000000.0::DOUBLE + row_idx * 20000 END AS drogue, round(lon, 6) + 0.0 AS lon, round(value::FLOAT::DOUBLE, 3) AS ve, {{}} FROM obs"""


def _drifter(f: RaggedFrame, *more) -> DataFrame:
    j = f.joined(["DeployingShip", "ManufactureVoltage", "FloatDiameter", "CurrentProgram", "location_type"])
    return j.select(ROW, OBS, F.col("DeployingShip").alias("ship"), F.col("ManufactureVoltage").alias("voltage"), F.col("FloatDiameter").alias("diameter"), F.col("CurrentProgram").alias("program"), F.col("location_type").alias("gps"), F.col("drogue_status").alias("drogue"), r("lon", 6).alias("lon"), r(F.col("ve").cast("double"), 3).alias("ve"), *more)


@query(_DRIFTER.format("CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value::FLOAT::DOUBLE, 3) END AS sst"))
def drifters_hourly(spark, sf):
    """Hourly drifters: texts cut, units stripped, fills null, casts, renames, drogue status."""
    return _drifter(providers.drifters(*_drifter_tables(spark, sf)), r(F.col("sst").cast("double"), 3).alias("sst"))


@query(_DRIFTER.format("CASE WHEN event_id % 3 = 0 THEN NULL ELSE round((value + 1)::FLOAT::DOUBLE, 3) END AS temp"))
def drifters_six_hourly(spark, sf):
    """Six-hourly drifters: the same with their own fill-valued data; the hourly column is dropped."""
    rows, obs = _drifter_tables(spark, sf)
    return _drifter(providers.drifters(rows, obs.drop("sst"), providers.SIX_HOURLY_DATA), r(F.col("temp").cast("double"), 3).alias("temp"))


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def order_by_date(spark, sf):
    """Ids that are asked for, in the order of a metadata table's dates."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderdate").alias("Start_date"))
    asked = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("ID"))
    return providers.by_date(o, asked).select("place", F.col("ID").alias("id"))


@query(f"WITH {TRACKS}, k AS (SELECT * FROM obs WHERE obs_idx < 10) SELECT row_idx AS id, count(*) AS rowsize, sum(obs_idx)::BIGINT AS lines FROM k GROUP BY 1")
def gdp_limits(spark, sf):
    """Raw fixes of a file for each drifter, the first ten lines of each; the observation index is the line's place."""
    o = tracks(spark, sf).obs
    t = F.timestamp_micros("us")
    month, year = F.month(t).cast("string"), F.year(t).cast("string")
    day = F.concat(F.dayofmonth(t).cast("string"), F.lit(".25"))
    value = F.concat_ws(" ", F.col(ROW).cast("string"), month, day, year, _fixed("lat"), _fixed("lon"), month, day, year, *[F.lit("1.0")] * 7)
    folder = _files(o.select(ROW, F.col(OBS).alias("at"), value.alias("value")), "gdp-files", ROW, ".dat")
    meta = providers.directory(spark, _text(spark.createDataFrame([("0 5000 1 SVP 2024/01/01 00:00 1.0 2.0 2024/02/01 00:00 3.0 4.0 0000/00/00 00:00 1",)], "value string"), "dirfl"))
    g = providers.gdp_source(spark, folder, meta, max_lines=10)
    return g.rows.join(g.obs.groupBy(ROW).agg(F.sum("obs_index").alias("lines")), ROW).select("id", "rowsize", "lines")


@query(f"WITH {TRACKS} SELECT 's' || row_idx AS sid, count(*) OVER (PARTITION BY row_idx) AS rowsize, 2000 + row_idx % 20 AS season, obs_idx, value AS usa_wind, lat FROM obs WHERE row_idx % 20 >= 5")
def ibtracs_records(spark, sf):
    """Storms of a kind (the seasons from 2005 on) from padded records with quadrants, storm columns and counts."""
    f = tracks(spark, sf)
    wide = ragged.to_regular(f, "value", -1.0).withColumnRenamed("value", "usa_wind").join(ragged.to_regular(f, "lat", -1.0), ROW).join(f.rows, ROW)
    wide = wide.select(ROW, F.concat(F.lit("s"), F.col(ROW).cast("string")).alias("sid"), (2000 + F.col(ROW) % 20).cast("long").alias("season"), F.col("rowsize").alias("numobs"), "usa_wind", "lat", F.array(F.lit(1), F.lit(2)).alias("quadrant"))
    g = providers.ibtracs(wide, since=2005)
    return g.joined(["sid", "season", "rowsize"]).select("sid", "rowsize", "season", OBS, "usa_wind", "lat")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity::DOUBLE END AS date, l_linenumber::VARCHAR AS unit, 'A' || l_orderkey AS name FROM lineitem")
def cleaning_units(spark, sf):
    """Unit suffixes, fill dates and ids within names."""
    li = table(spark, sf, "lineitem")
    date = F.when(F.col("l_linenumber") % 2 == 0, F.lit(cleaning.FILL)).otherwise(F.col("l_quantity").cast("double"))
    name = F.format_string("drifter_6h_%d.nc", F.col("l_orderkey"))
    return li.select("l_orderkey", "l_linenumber", cleaning.unfill_date(date).alias("date"), cleaning.drop_unit(F.concat(F.col("l_linenumber").cast("string"), F.lit(" kg")), 3).alias("unit"), F.concat(F.lit("A"), cleaning.number_in(name, r"drifter_6h_([0-9]+)\.nc")).alias("name"))


@query(f"WITH {ORDERS} SELECT row_idx, list(l_quantity::DOUBLE ORDER BY obs_idx)[1:2]::VARCHAR AS first, sum(l_quantity)::DOUBLE AS total FROM obs GROUP BY 1")
def flat_arrays(spark, sf):
    """Arrays in arrays, flattened."""
    u = ragged.unpack(orders(spark, sf), "l_quantity").select(ROW, cleaning.flat(F.transform(F.col("l_quantity"), lambda x: F.array(x.cast("double")))).alias("q"))
    show = F.transform(F.slice("q", 1, 2), lambda x: x.cast("string"))
    return u.select(ROW, F.concat(F.lit("["), F.array_join(show, ", "), F.lit("]")).alias("first"), F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"))


# ---- stored forms ----


@query("SELECT r_regionkey AS row_idx, r_name AS region, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS obs_idx, n_nationkey AS nation, n_name AS name, count(*) OVER (PARTITION BY r_regionkey) AS rowsize FROM region JOIN nation ON r_regionkey = n_regionkey")
def many_files(spark, sf):
    """A file for each region, read by executors into a ragged frame."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.select("r_regionkey", F.col("n_nationkey").cast("long").alias("at"), F.concat_ws(",", "r_name", "n_nationkey", "n_name").alias("value"))
    folder = _files(lines, "regions", "r_regionkey")

    def read(i):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(f"{folder}/x_{i}.csv")
        with system.open_input_file(path) as f:
            return pd.read_csv(f, names=["region", "nation", "name"])

    schema = T.StructType([T.StructField("region", T.StringType()), T.StructField("nation", T.LongType()), T.StructField("name", T.StringType())])
    ids = [x.r_regionkey for x in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").toLocalIterator()]
    f = files.from_files(spark, ids, read, schema, [], ["region"], ["nation", "name"])
    return f.joined(["region", "rowsize"]).select(ROW, "region", OBS, "nation", "name", "rowsize")


@query(f"WITH {ORDERS} SELECT row_idx, obs_idx, l_quantity, l_shipdate, 'pieces' AS unit, 'orders' AS title FROM obs")
def nested_files(spark, sf):
    """Written as nested Parquet with attributes, and read again."""
    f = orders(spark, sf).describe("l_quantity", units="pieces")
    path = fresh_path(spark, "nested")
    files.write_nested(RaggedFrame(f.rows, f.obs, {"title": "orders"}), path)
    g = files.read_nested(spark, path)
    return g.obs.select(ROW, OBS, "l_quantity", "l_shipdate", F.lit(g.attributes("l_quantity")["units"]).alias("unit"), F.lit(g.attrs["title"]).alias("title"))


@query(f"WITH {ORDERS} SELECT row_idx, count(*) AS rowsize, sum(l_quantity)::DOUBLE AS total FROM obs GROUP BY 1")
def catalog_rows(spark, sf):
    """Built once, written, and read from the catalog."""
    c = files.Catalog(spark, fresh_path(spark, "catalog"))
    f = c.get("orders", lambda: orders(spark, sf), needs=["l_quantity"])
    return f.rows.join(f.obs.groupBy(ROW).agg(F.sum("l_quantity").cast("double").alias("total")), ROW).select(ROW, "rowsize", "total")


@query(f"WITH {TRACKS}, n AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM obs WINDOW w AS (PARTITION BY row_idx ORDER BY obs_idx)) SELECT row_idx, count(*) AS rowsize, round(sum({distance('x', 'y', 'lon', 'lat')}) / 1000, 3) AS km FROM n GROUP BY 1")
def catalog_distance(spark, sf):
    """The way of each row, over its stored buckets: window and reduction without an exchange."""
    c = files.Catalog(spark, fresh_path(spark, "catalog"))
    f = c.get("tracks", lambda: tracks(spark, sf), needs=["lon", "lat"])
    w = kinematics.cumulative_distance(f.obs)
    way = w.groupBy(ROW).agg(F.max("distance").alias("m"))
    return f.rows.join(way, ROW).select(ROW, "rowsize", r(F.col("m") / 1000, 3).alias("km"))


@query("SELECT o_orderkey AS row_idx, o_totalprice::DOUBLE AS price, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS rowsize FROM orders")
def two_tables(spark, sf):
    """From a table of rows and one of observations; the counts come from the observations."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_totalprice").cast("double").alias("price"))
    return files.from_dataframes(o, orders(spark, sf).obs).rows.select(ROW, "price", "rowsize")


@query(f"""WITH {TRACKS}, f AS (SELECT row_idx, min(us) AS first, count(*) AS rowsize, row_number() OVER (ORDER BY min(us), row_idx) - 1 AS place FROM obs GROUP BY 1)
 SELECT place AS row_idx, row_number() OVER (PARTITION BY o.row_idx ORDER BY us, event_id) - 1 AS obs_idx, o.row_idx AS id, rowsize, event_id FROM obs o JOIN f USING (row_idx)""")
def ingest_batches(spark, sf):
    """Observations that come in three batches of mixed times, merged into the rows that are there."""
    o = tracks(spark, sf).obs.select(F.col(ROW).alias("id"), F.timestamp_micros("us").alias("time"), "event_id", "value")
    table_ = growing.Growing(spark, fresh_path(spark, "growing"), buckets=16)
    for k in (2, 0, 1):
        table_.ingest(f"batch {k}", o.filter(F.col("event_id") % 3 == k))
    f = table_.frame()
    return f.joined(["id", "rowsize"]).select(ROW, OBS, "id", "rowsize", "event_id")


# ---- functions of rows, pairs of tables ----


@query("WITH e AS (SELECT label AS row_idx, vec_id, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT row_idx, vec_id, j, round(x - avg(x) OVER (PARTITION BY row_idx, j), 6) + 0.0 AS x FROM e")
def axis_map(spark, sf):
    """Observations that are arrays: a function along the row, component by component."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    f = RaggedFrame.from_long(e, "label", ["vec_id"])
    out = apply.map_rows(f, lambda x: x - x.mean(axis=0), ["x"], "y", kind="array<double>")
    return out.join(f.obs.select(ROW, OBS, "vec_id"), [ROW, OBS]).select(ROW, "vec_id", F.posexplode("y").alias("j", "x")).select(ROW, "vec_id", F.col("j").cast("long").alias("j"), r("x", 6).alias("x"))


@query(f"WITH {TRACKS} SELECT a.row_idx AS row_1, b.row_idx AS row_2, a.obs_idx AS obs_1, b.obs_idx AS obs_2, round({distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 1) AS space, round(abs(a.t - b.t), 6) AS gap FROM obs a JOIN obs b ON a.event_type = 'click' AND b.event_type = 'view' AND abs(a.t - b.t) <= 7200 AND {distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2000000")
def pairs_two_tables(spark, sf):
    """Chance pairs of one table's observations with another's."""
    o = tracks(spark, sf).obs
    p = pairs.chance_pairs(o.filter("event_type = 'click'"), 2_000_000.0, 7200.0, b=o.filter("event_type = 'view'"), when="t")
    return p.select("row_1", "row_2", "obs_1", "obs_2", positive("space", 1).alias("space"), positive("gap", 6).alias("gap"))


def _above_mean(x: np.ndarray) -> np.ndarray:
    """Values above the mean of those that there are, added up one by one in their order.

    That is how SQL adds; numpy's sum by halves is rounded otherwise, and a value that is the mean itself falls on either side.
    """
    known = x[~np.isnan(x)]
    return x > np.cumsum(known)[-1] / len(known) if len(known) else np.zeros(len(x), bool)


@query(f"WITH {TRACKS}, m AS (SELECT *, avg(value) OVER (PARTITION BY row_idx) AS m FROM obs) SELECT row_idx, obs_idx FROM m WHERE value > m")
def subset_whole_rows(spark, sf):
    """A criterion that sees a row's whole vector: values above its mean."""
    return ragged.subset(tracks(spark, sf), {"value": ragged.WholeRow(_above_mean)}).obs.select(ROW, OBS)


# ---- wavelets: shapes and positions ----


@query(
    f"""WITH {TRACKS}, q AS (SELECT DISTINCT count(*) AS n FROM obs GROUP BY row_idx), {_morse("(SELECT n FROM q)", [0.4, 0.8, 1.6], 2)} SELECT n::BIGINT AS n, "order"::BIGINT AS "order", freq_idx::BIGINT AS freq_idx, k::BIGINT AS k, round(psi, 7) + 0.0 AS psi FROM psi WHERE k < n // 2"""
)
def morse_wavelets(spark, sf):
    """Wavelets in frequency for each length that rows have, without the phase that centers them."""
    lengths = tracks(spark, sf).rows.select(F.col("rowsize").alias("n")).distinct()

    def run(frames):
        for pdf in frames:
            for n in pdf["n"]:
                _, wave = signals.morse_wavelet(int(n), 3.0, 4.0, [0.4, 0.8, 1.6], 2)
                half = int(n) // 2
                plain = wave[..., :half] * np.exp(-2j * math.pi * np.arange(half) / n * (n + 1) / 2)
                o, f, k = (x.ravel() for x in np.indices(plain.shape))
                yield pd.DataFrame({"n": n, "order": o, "freq_idx": f, "k": k, "psi": plain.real.ravel()})

    return lengths.mapInPandas(run, "n long, order long, freq_idx long, k long, psi double").withColumn("psi", r("psi", 7))


_CUSTOMERS, _SUPPLIERS = ("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")


@query(
    f"WITH {wavelet_shapes(*_CUSTOMERS)}, a AS (SELECT *, pow(beta / gamma, 1 / gamma) AS modal, (2 * beta + 1) / gamma AS rr FROM p) SELECT key, k::BIGINT AS k, round(sqrt(2 * pi() * gamma * pow(2, rr) * exp(lgamma(k) - lgamma(k + rr - 1))), 6) AS energy, round(2 / exp(beta * ln(modal) - pow(modal, gamma)), 6) AS bandpass,"
    " round(exp(lgamma((2 * beta + 2) / gamma) - lgamma((2 * beta + 1) / gamma)) / pow(2, 1 / gamma), 7) AS energy_freq FROM a, range(1, 4) x(k)"
)
def morse_amplitudes(spark, sf):
    """Amplitudes by order and normalization, and energy frequencies, of each customer's wavelet."""
    each = lambda key, g, b: [(key, k, round(signals.morse_amplitude(g, b, k, "energy"), 6), round(signals.morse_amplitude(g, b, k), 6), round(signals.morse_freq(g, b)[1], 7)) for k in (1, 2, 3)]
    return shaped(shapes(spark, sf, *_CUSTOMERS), each, "key long, k long, energy double, bandpass double, energy_freq double")


@query(
    f"""WITH {wavelet_shapes(*_SUPPLIERS)}, a AS (SELECT *, pow(beta / gamma, 1 / gamma) AS modal, sqrt(gamma * beta) AS width FROM p), o AS (SELECT key, gamma, beta, modal, width, i * pi() / 9999 AS om FROM a, range(1, 10000) r(i)),
 h AS (SELECT key, any_value(width) AS width, min(om) AS high FROM o WHERE beta / gamma * ln(exp(1) * gamma / beta) + beta * ln(modal * pi() / om) - pow(modal * pi() / om, gamma) > ln(0.1) GROUP BY 1),
 f AS (SELECT *, greatest(2 * sqrt(2::DOUBLE) * width * 5 / 1000, 0) AS low, 1 + 1 / (4 * width) AS ratio FROM h)
 SELECT key, i AS place, round(high / pow(ratio, i), 7) AS frequency FROM f, range(0, 2000) r(i) WHERE i <= floor(log10(high / low) / log10(ratio))"""
)
def morse_logspace(spark, sf):
    """Frequencies for signals of a thousand values, bound by the wavelets' decay and by five wavelets in the record, for each supplier's wavelet."""
    each = lambda key, g, b: [(key, i, round(float(x), 7)) for i, x in enumerate(signals.morse_logspace(g, b, 1000))]
    return shaped(shapes(spark, sf, *_SUPPLIERS), each, "key long, place long, frequency double")


@query(f"WITH {wavelet_shapes(*_CUSTOMERS)}, c AS (SELECT key, (2 * beta + 1) / gamma - 1 AS c, i / 4.0::DOUBLE AS x, i FROM p, range(0, 9) r(i)) SELECT key, i AS place, round(1 + c - x, 7) + 0.0 AS first, round((c + 1) * (c + 2) / 2 - (c + 2) * x + x * x / 2, 7) + 0.0 AS second FROM c")
def laguerre_values(spark, sf):
    """Generalized Laguerre polynomials of degrees one and two, of each customer's wavelet."""
    def each(key, g, b):
        x, c = np.arange(9) / 4, (2 * b + 1) / g - 1
        one, two = signals.laguerre(x, 1, c), signals.laguerre(x, 2, c)
        return [(key, i, float(one[i]), float(two[i])) for i in range(9)]

    out = shaped(shapes(spark, sf, *_CUSTOMERS), each, "key long, place long, first double, second double")
    return out.select("key", "place", r("first", 7).alias("first"), r("second", 7).alias("second"))


def _sphere_sql() -> str:
    radius = "6378100.0::DOUBLE"
    waves = ", ".join(f"sum(psi * (re{c} * cos(2 * pi() * t * x.k / x.n) - im{c} * sin(2 * pi() * t * x.k / x.n))) / x.n AS r{c}, sum(psi * (re{c} * sin(2 * pi() * t * x.k / x.n) + im{c} * cos(2 * pi() * t * x.k / x.n))) / x.n AS i{c}" for c in "xyz")
    parts = ", ".join(f"sum({c} * cos(-2 * pi() * obs_idx * k / n)) AS re{c}, sum({c} * sin(-2 * pi() * obs_idx * k / n)) AS im{c}" for c in "xyz")
    out = ", ".join(f"round({p}y * cos(lo) - {p}x * sin(lo), 2) + 0.0 AS east_{q}, round({p}z * cos(la) - ({p}x * cos(lo) + {p}y * sin(lo)) * sin(la), 2) + 0.0 AS north_{q}" for p, q in (("r", "re"), ("i", "im")))
    return f"""WITH {DRIFTS}, s AS (SELECT row_idx, obs_idx, count(*) OVER (PARTITION BY row_idx) AS n, {radius} * cos(radians(lat)) * cos(radians(lon)) AS x, {radius} * cos(radians(lat)) * sin(radians(lon)) AS y, {radius} * sin(radians(lat)) AS z FROM drift),
 {_morse("(SELECT DISTINCT n FROM s)", [0.5, 1.0], 1)}, x AS (SELECT row_idx, n, k, {parts} FROM s, range(0, 5000) r(k) WHERE k < (n + 1) // 2 GROUP BY 1, 2, 3),
 w AS (SELECT row_idx, "order", freq_idx, frequency, t, {waves} FROM x JOIN psi ON x.k = psi.k AND x.n = psi.n JOIN range(0, 5000) r(t) ON t < x.n GROUP BY row_idx, x.n, "order", freq_idx, frequency, t),
 a AS (SELECT w.*, s.x - rx AS px, s.y - ry AS py, s.z - rz AS pz FROM w JOIN s ON w.row_idx = s.row_idx AND w.t = s.obs_idx), b AS (SELECT *, atan2(py, px) AS lo, asin(greatest(-1, least(1, pz / sqrt(px * px + py * py + pz * pz)))) AS la FROM a)
 SELECT row_idx, "order"::BIGINT AS "order", freq_idx::BIGINT AS freq_idx, frequency, t AS obs_idx, {out} FROM b"""


@query(_sphere_sql())
def morse_sphere(spark, sf):
    """Transforms of positions in space, as east and north components."""
    w = apply.wavelets_on_sphere(drifts(spark, sf), "lon", "lat", 3.0, 4.0, [0.5, 1.0])
    return w.select(ROW, "order", "freq_idx", "frequency", OBS, *(r(c, 2).alias(c) for c in ("east_re", "east_im", "north_re", "north_im")))


# ---- wind over layers ----

_NODES = 800


def _bessel(points: str, keep: str, m: str = "m", s: str = "sg") -> str:
    """Scaled Bessel functions of z = m (1 + sg i) by quadrature: K exp(z) and I exp(-z), orders 0 and 1, for each row of ``points``, by its columns ``keep``."""
    e = f"exp(-{m} * c)"
    ks = ", ".join(f"sum(w * {e} * {f}({m} * {s} * c) * {g}) * top / {_NODES} AS k{n}{p}" for n, g in ((0, "1"), (1, "(exp(t) + exp(-t)) / 2")) for p, f in (("r", "cos"), ("i", "-sin")))
    js = ", ".join(f"sum(w * exp({m} * d) * {f}({m} * {s} * d) * {g}) / {_NODES} AS i{n}{p}" for n, g in ((0, "1"), (1, "(d + 1)")) for p, f in (("r", "cos"), ("i", "sin")))
    return f"""SELECT {keep}, {ks}, {js} FROM (SELECT *, (exp(t) + exp(-t)) / 2 - 1 AS c, cos(pi() * i / {_NODES}) - 1 AS d, CASE WHEN i IN (0, {_NODES}) THEN 0.5 ELSE 1 END AS w FROM (SELECT q.*, i, ln(1 + 45 / {m} + sqrt(pow(1 + 45 / {m}, 2) - 1)) AS top, top * i / {_NODES} AS t FROM {points} q, range(0, {_NODES + 1}) r(i))) p GROUP BY {keep}, top"""


def _mul(a: str, b: str) -> tuple[str, str]:
    """Product of complex columns a and b, named with r and i at their end."""
    return f"({a}r * {b}r - {a}i * {b}i)", f"({a}r * {b}i + {a}i * {b}r)"


_BESSEL = _bessel("z", "key, m, sg")
_PARTS = [f"{f}{n}{p}" for f in "ki" for n in (0, 1) for p in "ri"]


def _bessel_rows(df: DataFrame, k, i) -> DataFrame:
    """Bessel functions of z = m (1 + i sg), orders 0 and 1, row by row."""

    def run(frames):
        for pdf in frames:
            x = (pdf["m"] * (1 + 1j * pdf["sg"])).to_numpy()
            yield pdf.assign(**dict(zip(_PARTS, (p for g in (k, i) for n in (0, 1) for p in (lambda v: (v.real, v.imag))(g(n, x))), strict=True)))

    return df.mapInPandas(run, "key long, m double, sg double, " + ", ".join(f"{n} double" for n in _PARTS))


@query(f"WITH z AS (SELECT s_suppkey AS key, 0.05::DOUBLE + abs(s_acctbal) / 250 AS m, (s_suppkey % 3 - 1)::DOUBLE AS sg FROM supplier), b AS ({_BESSEL}) SELECT key, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in _PARTS)} FROM b")
def bessel_values(spark, sf):
    """Scaled Bessel functions I and K of complex arguments, near and far, one a supplier."""
    z = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (0.05 + F.abs("s_acctbal") / 250).alias("m"), (F.col("s_suppkey") % 3 - 1).cast("double").alias("sg"))
    return _bessel_rows(z, special.k_scaled, special.i_scaled).select("key", *(r(n, 8).alias(n) for n in _PARTS))


@query(f"WITH z AS (SELECT s_suppkey AS key, 20::DOUBLE + abs(s_acctbal) / 250 AS m, (s_suppkey % 2 * 2 - 1)::DOUBLE AS sg FROM supplier), b AS ({_BESSEL}) SELECT key, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in _PARTS)} FROM b")
def bessel_series(spark, sf):
    """The thirty-term series for large arguments, one a supplier."""
    z = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (20 + F.abs("s_acctbal") / 250).alias("m"), (F.col("s_suppkey") % 2 * 2 - 1).cast("double").alias("sg"))
    return _bessel_rows(z, lambda n, x: special.k_far(n, x, 30), lambda n, x: special.i_far(n, x, 30)).select("key", *(r(n, 9).alias(n) for n in _PARTS))


#: Layers: name, delta, mu, depth, free slip, order of I at a free bottom.
_LAYERS = {
    "mixed": (20.0, 20.0, 50.0, False, 0), "mixed_free": (20.0, 20.0, 50.0, True, 0), "mixed_flat": (20.0, 20.0, 50.0, True, 1), "mixed_deep": (20.0, 20.0, math.inf, False, 0),
    "madsen": (0.0, 30.0, 60.0, False, 0), "madsen_free": (0.0, 30.0, 60.0, True, 1), "madsen_deep": (0.0, 30.0, math.inf, False, 0),
}
_F = 2 * math.pi * 1.5


def _layers_sql(layers: dict) -> str:
    """Responses, at each mooring, of layers whose viscosity grows with depth, by complex arithmetic on the quadratures."""
    cases = ", ".join(f"('{n}', {d!r}::DOUBLE, {m!r}::DOUBLE, {0 if math.isinf(h) else h!r}::DOUBLE, {int(slip)}, {order})" for n, (d, m, h, slip, order) in layers.items())
    grid = f"""{MOORINGS}, g AS (SELECT c.*, key, z, omega, (omega + {_F!r}::DOUBLE) / 86164.091::DOUBLE AS turn, delta * delta * {_F!r}::DOUBLE / 86164.091::DOUBLE / 2 AS v0, mu * {_F!r}::DOUBLE / 86164.091::DOUBLE / 2 AS v1
  FROM (VALUES {cases}) c(layer, delta, mu, depth, slip, ord), moorings)"""
    at = lambda d: f"greatest(2 * sqrt(abs(turn) * (v0 + v1 * {d}) / 2) / v1, 1e-9)"
    points = f"""x AS (SELECT *, sign(turn) AS sg, {at('0')} AS m0, {at('z')} AS mz, {at('depth')} AS mh FROM g),
 p AS (SELECT layer, key, sg, which, CASE which WHEN 0 THEN m0 WHEN 1 THEN mz ELSE mh END AS m FROM x, range(0, 3) r(which)), b AS ({_bessel("p", "layer, key, which, m, sg")})"""
    names = [f"{f}{n}{c}" for f in "ki" for n in (0, 1) for c in "ri"]
    wide = "v AS (SELECT layer, key, " + ", ".join(f"max(CASE WHEN which = {w} THEN {n} END) AS {t}{n}" for w, t in ((0, "a"), (1, "z"), (2, "h")) for n in names) + " FROM b GROUP BY 1, 2)"
    turned = lambda d, n: f"exp({d}) * cos(sg * ({d})) AS {n}r, exp({d}) * sin(sg * ({d})) AS {n}i"
    near = "CASE WHEN v0 > 0 THEN m0 ELSE 0 END"
    j = f"""j AS (SELECT x.*, v.* EXCLUDE (layer, key), CASE WHEN slip = 1 AND ord = 1 THEN hi1r ELSE hi0r END AS ihr, CASE WHEN slip = 1 AND ord = 1 THEN hi1i ELSE hi0i END AS ihi, CASE WHEN slip = 1 THEN hk1r ELSE hk0r END AS khr, CASE WHEN slip = 1 THEN hk1i ELSE hk0i END AS khi, CASE WHEN slip = 1 THEN 1 ELSE -1 END AS s,
  {turned(f"{near} - mz", "e")}, {turned(f"{near} + mz - 2 * mh", "f")}, {turned("2 * m0 - 2 * mh", "q")}, {turned("m0 - mz", "y")},
  CASE WHEN v0 > 0 THEN 1 / (1025 * sqrt(abs(turn) * v0)) * sqrt(0.5) ELSE 2 / (1025 * v1) END AS topr, CASE WHEN v0 > 0 THEN -sg / (1025 * sqrt(abs(turn) * v0)) * sqrt(0.5) ELSE 0 END AS topi FROM x JOIN v USING (layer, key))"""
    two = lambda name, a, b, src: f"{_mul(a, b)[0]} AS {name}r, {_mul(a, b)[1]} AS {name}i"
    steps = f"""j1 AS (SELECT *, {two("a1", "ih", "zk0", "")}, {two("b1", "kh", "zi0", "")}, {two("c1", "ih", "ak1", "")}, {two("d1", "kh", "ai1", "")} FROM j),
 j2 AS (SELECT *, {two("a2", "e", "a1", "")}, {two("b2", "f", "b1", "")}, {two("d2", "q", "d1", "")}, {two("t2", "e", "zk0", "")} FROM j1),
 j3 AS (SELECT *, CASE WHEN depth = 0 THEN t2r ELSE a2r + s * b2r END AS nr, CASE WHEN depth = 0 THEN t2i ELSE a2i + s * b2i END AS ni, CASE WHEN depth = 0 THEN CASE WHEN v0 > 0 THEN ak1r ELSE 1 END WHEN v0 > 0 THEN c1r - s * d2r ELSE ihr END AS dr, CASE WHEN depth = 0 THEN CASE WHEN v0 > 0 THEN ak1i ELSE 0 END WHEN v0 > 0 THEN c1i - s * d2i ELSE ihi END AS di FROM j2),
 j4 AS (SELECT *, (nr * dr + ni * di) / (dr * dr + di * di) AS wr, (ni * dr - nr * di) / (dr * dr + di * di) AS wi FROM j3)"""
    re, im = _mul("top", "w")
    return f"WITH {grid}, {points}, {wide}, {j}, {steps} SELECT layer, key, round({re} * 1e6, 4) + 0.0 AS re, round({im} * 1e6, 4) + 0.0 AS im FROM j4"


def _winds(spark, sf, layers: list[tuple[Column, dict]], name: str, digits: int) -> DataFrame:
    """Responses of layers at all moorings, in 1e-6."""
    out = None
    for label, layer in layers:
        w = apply.wind_response(moorings(spark, sf), "omega", "z", **layer).select(label.alias(name), "key", r(F.col("re") * 1e6, digits).alias("re"), r(F.col("im") * 1e6, digits).alias("im"))
        out = w if out is None else out.unionByName(w)
    return out


@query(_layers_sql(_LAYERS))
def wind_layers(spark, sf):
    """Layers whose viscosity grows with depth: with and without constant part, without and with slip, finite and infinite; in 1e-6."""
    layers = [(F.lit(n), {"f": _F, "delta": d, "mu": m, "depth": h, "boundary": "free-slip" if slip else "no-slip", "corrected": bool(order)}) for n, (d, m, h, slip, order) in _LAYERS.items()]
    return _winds(spark, sf, layers, "layer", 4)


@query(_layers_sql({"mixed": _LAYERS["mixed"]}))
def wind_mixed(spark, sf):
    """Response of a finite layer whose viscosity grows with depth, in 1e-6."""
    return _winds(spark, sf, [(F.lit("mixed"), {"f": _F, "delta": 20.0, "mu": 20.0, "depth": 50.0})], "layer", 4)


@query(
    f"""WITH {MOORINGS}, c AS (SELECT slip, key, z, omega, 6.0::DOUBLE / 86164.091::DOUBLE AS f, (omega + 6) / 86164.091::DOUBLE AS turn FROM moorings, (VALUES (0), (1)) b(slip)),
 s AS (SELECT *, sqrt(abs(turn) / (200 * f) / 2) AS m, sign(turn) AS sg FROM c),
 n AS (SELECT *, exp(-m * z) * cos(m * z) AS dr, -sg * exp(-m * z) * sin(m * z) AS di, exp(-m * (80 - z)) * cos(m * (80 - z)) AS ur, -sg * exp(-m * (80 - z)) * sin(m * (80 - z)) AS ui, exp(-2 * m * 40) * cos(2 * m * 40) AS fr, -sg * exp(-2 * m * 40) * sin(2 * m * 40) AS fi FROM s),
 q AS (SELECT *, CASE WHEN slip = 1 THEN dr + ur ELSE dr - ur END AS nr, CASE WHEN slip = 1 THEN di + ui ELSE di - ui END AS ni, CASE WHEN slip = 1 THEN 1 - fr ELSE 1 + fr END AS br, CASE WHEN slip = 1 THEN -fi ELSE fi END AS bi FROM n),
 h AS (SELECT *, (nr * br + ni * bi) / (br * br + bi * bi) AS hr, (ni * br - nr * bi) / (br * br + bi * bi) AS hi FROM q)
 SELECT slip, key, round((hr + sg * hi) / (1025 * 200 * f * 2 * m) * 1e6, 4) + 0.0 AS re, round((hi - sg * hr) / (1025 * 200 * f * 2 * m) * 1e6, 4) + 0.0 AS im FROM h"""
)
def wind_constant(spark, sf):
    """A finite layer of constant viscosity without and with slip at its bottom, in 1e-6."""
    layer = {"f": 6.0, "delta": 20.0, "mu": 0.0, "depth": 40.0}
    return _winds(spark, sf, [(F.lit(0), layer), (F.lit(1), layer | {"boundary": "free-slip", "method": "unscaled"})], "slip", 4)


@query(f"WITH {MOORINGS}, g AS (SELECT mu, key, z, 6.0::DOUBLE / 86164.091::DOUBLE AS f FROM moorings, (VALUES (0::DOUBLE), (20::DOUBLE)) m(mu)) SELECT mu, key, round(CASE WHEN mu = 0 THEN (40 - z) / (1025 * 200 * f) ELSE ln((200 * f + mu * f / 2 * 40) / (200 * f + mu * f / 2 * z)) / (1025 * mu * f / 2) END * 1e6, 4) AS re FROM g")
def wind_limit(spark, sf):
    """Where the frequency cancels the rotation, at the moorings' depths, in 1e-6."""
    out = None
    for mu in (0.0, 20.0):
        still = moorings(spark, sf).withColumn("omega", F.lit(-6.0))
        w = apply.wind_response(still, "omega", "z", f=6.0, delta=20.0, mu=mu, depth=40.0).select(F.lit(mu).alias("mu"), "key", r(F.col("re") * 1e6, 4).alias("re"))
        out = w if out is None else out.unionByName(w)
    return out


@query(f"WITH {ORDERS}, k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders WHERE o_orderkey IN (SELECT row_idx FROM obs)) SELECT k.row_idx, obs_idx, l_quantity::DOUBLE AS quantity, o_totalprice::DOUBLE AS price, count(*) OVER (PARTITION BY k.row_idx) AS rowsize FROM obs JOIN k ON obs.row_idx = o_orderkey")
def vectors_by_length(spark, sf):
    """Variables as vectors, told apart by their lengths: counts and prices of orders, quantities of all lines."""
    f = orders(spark, sf)
    prices = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_totalprice").cast("double").alias("price"))
    rows = ragged.offsets(ragged.ranked(f.rows.select(ROW, "rowsize").join(prices, ROW), ROW, "at").withColumnRenamed(ROW, "order").withColumnRenamed("at", ROW))
    lines = f.obs.withColumnRenamed(ROW, "order").join(rows.select("order", "start"), "order")
    one = lambda df, name, at, value: df.select(F.lit(name).alias("name"), at.alias("at"), value.cast("double").alias("value"))
    vectors = one(rows, "rowsize", F.col(ROW), F.col("rowsize")).unionByName(one(rows, "price", F.col(ROW), F.col("price"))).unionByName(one(lines, "quantity", F.col("start") + F.col(OBS), F.col("l_quantity")))
    return grids.from_vectors(vectors).joined(["price", "rowsize"]).select(ROW, OBS, "quantity", "price", "rowsize")


# ---- array files ----


def _waves(spark, sf) -> RaggedFrame:
    """Wave buoys: a frame of numbers, some of them missing, and names, with attributes."""
    f = tracks(spark, sf)
    event = F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("int"))
    o = f.obs.select(ROW, OBS, F.col("t").alias("time"), F.col("lat").alias("latitude"), "value", event.alias("event"), "event_type")
    rows = f.rows.select(ROW, "rowsize", (F.col(ROW) * 10).cast("int").alias("trajectory"))
    return RaggedFrame(rows, o, {"title": "waves"}).describe("latitude", units="degrees")


_WAVES = f"WITH {TRACKS} SELECT row_number() OVER (PARTITION BY row_idx ORDER BY obs_idx) - 1 AS obs_idx, row_idx * 10 AS trajectory, count(*) OVER (PARTITION BY row_idx) AS rowsize, t AS time, round(lat, 9) + 0.0 AS latitude, value, CASE WHEN event_id % 7 <> 0 THEN event_id END AS event, event_type, 'degrees' AS units, 'waves' AS title FROM obs"


def _read_back(f: RaggedFrame) -> DataFrame:
    j = f.joined(["trajectory", "rowsize"])
    return j.select(OBS, F.col("trajectory").cast("long").alias("trajectory"), "rowsize", "time", r("latitude", 9).alias("latitude"), "value", F.col("event").cast("long").alias("event"), "event_type", F.lit(f.attributes("latitude")["units"]).alias("units"), F.lit(f.attrs["title"]).alias("title"))


@query(_WAVES)
def netcdf_files(spark, sf):
    """Written to classic files of forty rows each and read back by stretches."""
    paths = grids.write_netcdf(_waves(spark, sf), fresh_path(spark, "netcdf"), rows_in_file=40)
    return _read_back(grids.read_netcdf(spark, paths))


@query(_WAVES)
def netcdf_records(spark, sf):
    """The same with observations that may grow, as interleaved records, in files of ten thousand observations."""
    folder = fresh_path(spark, "netcdf")
    grids.write_netcdf(_waves(spark, sf), folder, obs_in_file=10_000, unlimited=True)
    return _read_back(grids.read_netcdf(spark, folder))


@query(f"WITH {TRACKS} SELECT count(*) AS n, count(DISTINCT row_idx) AS n_rows, round(sum(value), 4) AS total FROM obs")
def netcdf_format(spark, sf):
    """Read as a Spark format by itself, a file a task."""
    folder = fresh_path(spark, "netcdf")
    grids.write_netcdf(_waves(spark, sf), folder, rows_in_file=40)
    df = spark.read.format("netcdf").load(folder)
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ROW).alias("n_rows"), r(F.sum("value"), 4).alias("total"))


@query(_WAVES)
def zarr_folder(spark, sf):
    """Written to a Zarr folder in chunks and read back by chunks."""
    path = fresh_path(spark, "zarr")
    grids.write_zarr(_waves(spark, sf), path, chunk=4096, rows_dim="trajectory", obs_dim="index")
    return _read_back(providers.spotters(spark, path))


@query(_WAVES)
def zarr_blosc(spark, sf):
    """Wave buoys in Blosc frames of Zstandard with shuffled bits."""
    path = fresh_path(spark, "zarr")
    grids.write_zarr(_waves(spark, sf), path, chunk=10_000, rows_dim="trajectory", obs_dim="index", compressor={"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 2})
    return _read_back(providers.spotters(spark, path))


_ARCHIVED = _DRIFTER.replace(" FROM obs", ", round(t, 3) AS seconds FROM obs")


def _archived(spark, sf, rows: DataFrame, obs: DataFrame, cname: str) -> str:
    """Drifters as published: a Zarr folder of Blosc frames, times counted from a date."""
    path = fresh_path(spark, "zarr")
    f = RaggedFrame(rows, obs, {"title": "drifters"}).recounted().describe("time", units="seconds since 1970-01-01 00:00:00")
    grids.write_zarr(f, path, chunk=8192, compressor={"id": "blosc", "cname": cname, "clevel": 5, "shuffle": 1})
    return path


@query(_ARCHIVED.format("CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value::FLOAT::DOUBLE, 3) END AS sst"))
def gdp_hourly_archive(spark, sf):
    """Hourly drifters from a published layout: Blosc frames of LZ4, decoded and cleaned."""
    f = providers.gdp1h(spark, _archived(spark, sf, *_drifter_tables(spark, sf), "lz4"))
    return _drifter(f, r(F.col("sst").cast("double"), 3).alias("sst"), r(F.unix_micros("time") / 1e6, 3).alias("seconds"))


@query(_ARCHIVED.format("CASE WHEN event_id % 3 = 0 THEN NULL ELSE round((value + 1)::FLOAT::DOUBLE, 3) END AS temp"))
def gdp_six_hourly_archive(spark, sf):
    """Six-hourly drifters, in frames of zlib."""
    rows, obs = _drifter_tables(spark, sf)
    f = providers.gdp6h(spark, _archived(spark, sf, rows, obs.drop("sst"), "zlib"))
    return _drifter(f, r(F.col("temp").cast("double"), 3).alias("temp"), r(F.unix_micros("time") / 1e6, 3).alias("seconds"))
