"""Parsers of drifter, float and storm data: text of a provider into a ragged frame.

Files are given by path; nothing is downloaded. What a provider marks as missing becomes null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import cleaning
from ..model import OBS, ROW, RaggedFrame
from ..operators.ragged import ranked
from ..scratch import materialize
from . import matlab
from .files import fields, lines, number_rows, zipped_lines
from .grids import read_zarr, store

# ---- surface drifters in white-space columns ----

# Columns of the files.
SPOT = ("id", "date", "time", "latitude", "longitude", "position_error", "u", "v", "velocity_error")
QUICCHE = ("manufacturer_message_id", "manufacturer_gps_id", "drifter_id", "time_iso8601", "manufacturer_time_seconds", "latitude", "longitude", "gps_record_setting", "battery_state", "predeployment_flag")


def _spot(df: DataFrame) -> RaggedFrame:
    parts = fields(df, SPOT)
    typed = parts.select("id", cleaning.date_time(F.col("date"), F.col("time")).alias("time"), *(F.col(c).try_cast("float").alias(c) for c in SPOT[3:]), "at")
    frame = number_rows(typed, "id", ["time", "at"])
    return RaggedFrame(frame.rows, frame.obs.drop("at"))


def glad(spark: SparkSession, path: str, header: int = 5) -> RaggedFrame:
    """Drifters with ``header`` lines before the data, sorted by id and time."""
    return _spot(lines(spark, path).filter(F.col("at") >= header))


def laser(spark: SparkSession, path: str, member: str = ".dat") -> RaggedFrame:
    """The same columns from a ZIP member (or plain text) with ``%`` comments; equal times keep their order."""
    df = zipped_lines(spark, path, member) if path.endswith(".zip") else lines(spark, path)
    df = df.withColumn("value", F.regexp_replace("value", "%.*$", "")).filter(F.length(F.trim("value")) > 0)
    return _spot(df)


def quicche(spark: SparkSession, path: str, version: str = "qc3") -> RaggedFrame:
    """Drifters with 9 or 10 columns: battery state before qc3, a flag in qc1; missing texts are empty, bad times null."""
    if version not in ("raw", "qc1", "qc2", "qc3"):
        raise ValueError("version must be raw, qc1, qc2 or qc3")
    name = "quicche_spot_xml_data" + ("" if version == "raw" else f"_{version}") + ".dat"
    df = zipped_lines(spark, path, name) if path.endswith(".zip") else lines(spark, path)
    parts = fields(df, QUICCHE)
    cols = [F.col("drifter_id"), cleaning.iso_time(F.col("time_iso8601")).alias("time"), F.col("latitude").try_cast("float").alias("latitude"), F.col("longitude").try_cast("float").alias("longitude")]
    if version != "qc3":
        cols.append(F.coalesce("battery_state", F.lit("")).alias("battery_state"))
    if version == "qc1":
        cols.append(F.coalesce("predeployment_flag", F.lit("")).alias("flag"))
    frame = number_rows(parts.select(*cols, "at"), "drifter_id", ["time", "at"])
    return RaggedFrame(frame.rows, frame.obs.drop("at"))


# ---- storms ----

# Meters of a nautical mile as the data set's users have it, pascals of a millibar, columns, codes.
NAUTICAL_MILE, MILLIBAR = 1825.0, 100.0
STORM = (
    "date", "clock", "record_identifier", "system_status", "lat", "lon", "wind_speed", "pressure",
    "max_low_wind_radius_ne", "max_low_wind_radius_se", "max_low_wind_radius_sw", "max_low_wind_radius_nw",
    "max_med_wind_radius_ne", "max_med_wind_radius_se", "max_med_wind_radius_sw", "max_med_wind_radius_nw",
    "max_high_wind_radius_ne", "max_high_wind_radius_se", "max_high_wind_radius_sw", "max_high_wind_radius_nw", "max_sustained_wind_speed_radius",
)
RECORD_CODES = ("C", "G", "I", "L", "P", "R", "S", "T", "W", "")
STATUS_CODES = ("TD", "TS", "HU", "EX", "SD", "SS", "LO", "WV", "DB", "ET", "PT", "ST", "TY")


def hurdat2(spark: SparkSession, path: str | list[str], convert: bool = True, mile: float = NAUTICAL_MILE) -> RaggedFrame:
    """Storms of best-track files: a header of 4 fields before its data lines of 21; other lines count for nothing.

    A data line belongs to the header last seen in its file, so the last storm ends with the
    file. -999 and negative winds are null; with ``convert`` knots, miles and millibars become
    m/s, meters and pascals. Codes that the format does not know are null.
    """
    df = lines(spark, path).withColumn("value", F.regexp_replace("value", r"[ \r]", ""))
    parts = df.withColumn("p", F.split(F.regexp_replace("value", ",$", ","), ",")).withColumn("n", F.size("p"))
    head = (F.col("n") == 4) & F.col("value").rlike("^[A-Z]{2}[0-9]{6},")
    # a block's lines follow its own headers, or the last one of the blocks before
    mark = F.when(head, F.struct(F.col("p")[0].alias("id"), F.col("at").alias("h")))
    last = parts.withColumn("mark", mark).groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("m"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("m", ignorenulls=True).over(earlier).alias("before"))
    here = Window.partitionBy("file", "block").orderBy("at")
    tagged = parts.join(last, ["file", "block"]).withColumn("head", F.coalesce(F.last(mark, ignorenulls=True).over(here), F.col("before")))
    data = tagged.filter((F.col("n") == 21) & F.col("head").isNotNull() & F.col("value").rlike("^[0-9]{8},[0-9]{4},"))
    raw = {name: F.get("p", F.lit(i)) for i, name in enumerate(STORM)}

    def measure(name: str, unit: float, low: float | None = None) -> Column:
        x = raw[name].try_cast("double")
        good = (x != -999) & (F.lit(True) if low is None else x >= low)
        return F.when(good, x * unit if convert else x)

    cols = {
        "time": F.try_to_timestamp(F.concat(raw["date"], raw["clock"]), F.lit("yyyyMMddHHmm")),
        "record_identifier": F.when(raw["record_identifier"].isin(*RECORD_CODES), raw["record_identifier"]),
        "system_status": F.when(raw["system_status"].isin(*STATUS_CODES), raw["system_status"]),
        "lat": cleaning.heading(raw["lat"]),
        "lon": cleaning.heading(raw["lon"]),
        "wind_speed": measure("wind_speed", mile / 3600, 0.0),
        "pressure": measure("pressure", MILLIBAR),
    }
    cols |= {name: measure(name, mile) for name in STORM[8:]}
    typed = data.select(F.col("head.id").alias("id"), "file", F.col("head.h").alias("h"), "at", *(c.alias(n) for n, c in cols.items()))
    frame = number_rows(typed.withColumn("storm", F.concat_ws(" ", "id", "file", F.col("h").cast("string"))), "storm", ["at"])
    rows = frame.rows.withColumn("id", F.split("storm", " ")[0]).drop("storm")
    rows = rows.withColumn("basin", F.substring("id", 1, 2)).withColumn("year", F.substring("id", 5, 4).cast("int"))
    return RaggedFrame(rows, frame.obs.drop("file", "h", "at", "id"), {"title": "best tracks of storms"})


def padded(df: DataFrame, count: str = "numobs", keep: Sequence[str] = ()) -> RaggedFrame:
    """Ragged from records whose arrays are padded to one length: the first ``count`` of each array stay."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array" and f.name not in keep]
    df = df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())
    cut = df.withColumns({a: F.slice(a, 1, F.col(count).cast("int")) for a in arrays})
    rows = cut.select(*(c for c in cut.columns if c not in (*arrays, count)), F.col(count).cast("long").alias("rowsize"))
    obs = cut.select(ROW, F.posexplode(F.arrays_zip(*arrays)).alias(OBS, "o"))
    return RaggedFrame(rows, obs.select(ROW, F.col(OBS).cast("long").alias(OBS), *(F.col(f"o.{a}").alias(a) for a in arrays)))


#: The kinds of storm archives by their names in files.
KINDS = {"LAST_3_YEARS": "last3years", "SINCE_1980": "since1980"}


def ibtracs_name(version: str = "v04r01", kind: str = "LAST_3_YEARS") -> str:
    """Name of a storm archive's file: a version, and a kind or a basin."""
    return f"IBTrACS.{KINDS.get(kind, kind)}.{version}.nc"


def ibtracs(df: DataFrame, since: int | None = None, count: str = "numobs") -> RaggedFrame:
    """Storms from records whose arrays are padded: a row a storm by its position, with its storm columns and counts.

    Arrays along the storm's fixes (as long as the longest of the record's) are cut to the count;
    shorter ones, as quadrants, and scalars are the storm's. ``since`` takes the seasons from a
    year on. A storm of no fixes stays with a count of 0.
    """
    if since is not None:
        df = df.filter(F.col("season") >= since)
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    most = df.agg(*(F.max(F.size(a)).alias(a) for a in arrays)).first().asDict() if arrays else {}
    longest = max((n or 0 for n in most.values()), default=0)
    return padded(df, count, [a for a in arrays if (most[a] or 0) < longest])


# ---- floats ----

# Columns of the files and the marks of missing values, column by column.
YOMAHA = (
    "lon_d", "lat_d", "pres_d", "time_d", "ve_d", "vn_d", "err_ve_d", "err_vn_d", "lon_s", "lat_s", "time_s", "ve_s", "vn_s", "err_ve_s", "err_vn_s",
    "lon_lp", "lat_lp", "time_lp", "lon_fc", "lat_fc", "time_fc", "lon_lc", "lat_lc", "time_lc", "surf_fix", "id", "cycle", "time_inv",
)
YOMAHA_MISSING = (
    -999.9999, -99.9999, -999.9, -999.999, -999.99, -999.99, -999.99, -999.99, -999.99, -99.99, -999.99, -999.99, -999.99, -999.99, -999.99,
    -999.99, -99.99, -999.99, -999.99, -99.99, -999.99, -999.99, -99.99, -999.99, None, None, None, None,
)
ANDRO = (
    "lon_d", "lat_d", "pres_d", "temp_d", "sal_d", "time_d", "ve_d", "vn_d", "err_ve_d", "err_vn_d", "lon_s", "lat_s", "time_s", "ve_s", "vn_s", "err_ve_s", "err_vn_s",
    "lon_ls", "lat_ls", "time_ls", "ve_ls", "vn_ls", "err_ve_ls", "err_vn_ls", "lon_lp", "lat_lp", "time_lp", "lon_fc", "lat_fc", "time_fc", "lon_lc", "lat_lc", "time_lc",
    "surf_fix", "id", "cycle", "profile_id",
)
ANDRO_MISSING = (
    -999.9999, -99.9999, -999.9, -99.999, -99.999, -9999.999, -999.9, -999.9, -999.9, -999.9, -999.9999, -99.999, -9999.999, -999.99, -999.99, -999.99, -999.99,
    -999.9999, -99.9999, -9999.999, -999.99, -999.99, -999.99, -999.99, -999.9999, -99.9999, -9999.999, -999.9999, -99.9999, -9999.999, -999.9999, -99.9999, -9999.999,
    None, None, None, -99.0,
)


def _floats(df: DataFrame, names: Sequence[str], marks: Sequence[float | None]) -> RaggedFrame:
    parts = fields(df, names)

    def typed(name: str, mark: float | None) -> Column:
        x = F.col(name).try_cast("double")
        x = x if mark is None else cleaning.missing(x, mark)
        if name in ("id", "cycle", "surf_fix", "profile_id", "time_inv"):
            return x.cast("long").alias(name)
        return x.cast("double" if name[:3] in ("lat", "lon") else "double" if name.startswith("time") else "float").alias(name)

    cols = parts.select(*(typed(n, m) for n, m in zip(names, marks, strict=True)), "at").filter("id IS NOT NULL")
    frame = number_rows(cols, "id", ["at"])
    return RaggedFrame(frame.rows, frame.obs.drop("at"))


def yomaha(spark: SparkSession, path: str, wmo: str | None = None, dacs: str | None = None, types: str | None = None) -> RaggedFrame:
    """Float displacements; the lookup files add wmo_id, dac_id, dac, float_type_id and float_type by left joins."""
    frame = _floats(lines(spark, path), YOMAHA, YOMAHA_MISSING)
    if wmo is None:
        return frame
    ids = fields(lines(spark, wmo), ("id", "wmo_id", "dac_id", "float_type_id")).select(*(F.col(c).try_cast("long").alias(c) for c in ("id", "wmo_id", "dac_id", "float_type_id")))
    pair = lambda p, a, b: fields(lines(spark, p), (a, b), ":").select(F.trim(a).try_cast("long").alias(a), F.trim(b).alias(b)).filter(F.col(a).isNotNull())
    rows = frame.rows.join(ids, "id", "left")
    if dacs:
        rows = rows.join(pair(dacs, "dac_id", "dac"), "dac_id", "left")
    if types:
        kinds = pair(types, "float_type_id", "float_type").withColumn("float_type", F.when(F.col("float_type_id") == 0, "METOCEAN").otherwise(F.col("float_type")))
        rows = rows.join(kinds, "float_type_id", "left")
    return RaggedFrame(rows, frame.obs)


def andro(spark: SparkSession, path: str, member: str = "") -> RaggedFrame:
    """Deep displacements of floats, from text or a ZIP member."""
    df = zipped_lines(spark, path, member) if path.endswith(".zip") else lines(spark, path)
    return _floats(df.filter(F.length(F.trim("value")) > 0), ANDRO, ANDRO_MISSING)


def subsurface(df: DataFrame) -> RaggedFrame:
    """Floats from records with arrays dtnum, lon, lat, p, t, u, v: MATLAB days become times, p and t pres and temp."""
    n = df.withColumn("numobs", F.size("dtnum"))
    frame = padded(n)
    names = {"p": "pres", "t": "temp", "u": "ve", "v": "vn"}
    obs = frame.obs.withColumn("time", cleaning.matlab_time(F.col("dtnum"))).drop("dtnum").withColumnsRenamed(names)
    return RaggedFrame(frame.rows, obs.withColumns({c: F.col(c).cast("float") for c in names.values() if c in obs.columns}))


# Variables of the floats' MATLAB file, by observation and by float.
FLOAT_DATA = ("dtnum", "lon", "lat", "p", "t", "u", "v")
FLOAT_META = ("expName", "expOrg", "expPI", "fltType", "indexExp", "indexFlt")
FLOATS_AT_ONCE = 1000  # floats that a task hands over together


def subsurface_mat(spark: SparkSession, paths: str | list[str]) -> RaggedFrame:
    """Floats from MATLAB files, each read by a task: cells of vectors by float, with what is known of each.

    Rows stand in the order of files and of floats in them. An experiment's entry of ``expList`` goes to
    its floats, by the order of their ``indexExp``. A variable that a file lacks, and an empty
    cell, are null; a vector of another length than its times is cut or ends in nulls.
    """
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("place", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in FLOAT_DATA), *(T.StructField(c, T.StringType()) for c in ("expList", *FLOAT_META))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, path in zip(frame["file"], frame["path"], strict=True):
                system, at = store(path)
                with system.open_input_file(at) as f:
                    found = dict(matlab.read(f, frozenset((*FLOAT_DATA, *FLOAT_META, "expList"))))
                n = len(found.get("dtnum", []))
                known = {c: _texts(found.get(c), n) for c in FLOAT_META}
                order = sorted({int(float(x)) for x in known["indexExp"] if x is not None})
                listed = _texts(found.get("expList"), len(order))
                rank = {k: i for i, k in enumerate(order)}
                names = [listed[rank[int(float(x))]] if x is not None else None for x in known["indexExp"]]
                for a in range(0, n, FLOATS_AT_ONCE):
                    b = min(n, a + FLOATS_AT_ONCE)
                    each = {c: [_flat(x) for x in found[c][a:b]] if c in found else [None] * (b - a) for c in FLOAT_DATA}  # lists of these floats alone
                    yield pd.DataFrame({"file": file, "place": range(a, b), **each, "expList": names[a:b], **{c: x[a:b] for c, x in known.items()}})

    paths = [paths] if isinstance(paths, str) else paths
    files_ = spark.createDataFrame(list(enumerate(paths)), "file long, path string").repartition(max(1, min(len(paths), 10_000)), "file")
    read = materialize(files_.mapInPandas(run, schema), "floats")
    numbers = ranked(read.select("file", "place"), ["file", "place"])
    floats = read.join(numbers, ["file", "place"]).drop("file", "place")
    whole = {c: F.coalesce(c, F.array().cast("array<double>")) for c in FLOAT_DATA}  # an empty vector ends in nulls
    return subsurface(floats.withColumns({**whole, **{c: F.col(c).cast("long") for c in ("indexExp", "indexFlt")}}))


def _flat(x) -> list[float] | None:
    """A cell's numbers in column order."""
    values = None if x is None or isinstance(x, str) else np.asarray(x, float).ravel(order="F").tolist()
    return values or None


def _texts(x, n: int) -> list[str | None]:
    """One text for each of ``n`` cells or numbers: whole numbers without a point, of arrays the first element."""
    cells = [None] * n if x is None else x if isinstance(x, list) else np.asarray(x).ravel(order="F").tolist() if not isinstance(x, str) else [x]
    out = []
    for c in cells:
        while isinstance(c, (list, np.ndarray)):
            c = (c.ravel(order="F").tolist() if isinstance(c, np.ndarray) else c) or [None]
            c = c[0]
        out.append(None if c is None else str(int(c)) if isinstance(c, float) and c.is_integer() else str(c))
    return (out + [None] * n)[:n]


# ---- buoys of one expedition: a list of sensors and a file for each ----


def file_urls(xml: DataFrame, column: str = "value") -> DataFrame:
    """(name, url) of the data files that a repository's XML record lists."""
    at = "dataset/dataTable/physical"
    names = F.xpath(F.col(column), F.lit(f"*/{at}/objectName/text()"))
    urls = F.xpath(F.col(column), F.lit(f"*/{at}/distribution/online/url/text()"))
    return xml.select(F.explode(F.arrays_zip(names.alias("name"), urls.alias("url"))).alias("f")).select("f.name", "f.url")


def mosaic(spark: SparkSession, sensors: str, folder: str) -> RaggedFrame:
    """Buoys in the order of the sensor list; a file's sensor is the last part of its name."""
    listed = spark.read.option("header", True).csv(sensors)
    order = ranked(listed.withColumn("__at", F.monotonically_increasing_id()), "__at").drop("__at").withColumnRenamed("Sensor ID", "id")
    few = F.broadcast if order.count() <= 100_000 else (lambda d: d)
    files = spark.read.option("header", True).csv(folder).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    named = files.withColumn("id", F.regexp_extract(F.regexp_replace("file", r"%20", " "), r"_([^_/]+)\.csv$", 1))
    obs = named.join(few(order.select("id", ROW)), "id").withColumn(OBS, F.row_number().over(Window.partitionBy(ROW).orderBy("at")).cast("long") - 1)
    obs = obs.select(ROW, OBS, F.try_to_timestamp("datetime").alias("time"), *(F.col(c).try_cast("double").alias(c) for c in obs.columns if c in ("latitude", "longitude")))
    dates = [c for c in order.columns if c.endswith(("Date", "Datetime"))]
    rows = order.withColumns({c: F.try_to_timestamp(c) for c in dates})
    return RaggedFrame(rows, obs).recounted()


# ---- drifters of the global programme ----

# Columns of the raw file and of the directory file, fills for drifters without metadata.
RAW = ("id", "posObsMonth", "posObsDay", "posObsYear", "latitude", "longitude", "senObsMonth", "senObsDay", "senObsYear", "drogue", "sst", "voltage", "sensor4", "sensor5", "sensor6", "qualityIndex")
DIRECTORY = ("ID", "WMO_number", "program_number", "buoys_type", "Start_date", "Start_lat", "Start_lon", "End_date", "End_lat", "End_lon", "Drogue_off_date", "death_code")
FILLS = {"wmo_number": -999, "program_number": -999, "buoys_type": "N/A", "start_date": "1970-01-01", "start_lat": -999.0, "start_lon": -999.0, "end_date": "1970-01-01", "end_lat": -999.0, "end_lon": -999.0, "drogue_off_date": "1970-01-01", "death_code": -1}


def directory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Metadata of drifters: dates and hours joined, bad ones null, all files together, by start date."""
    raw = [f"c{i}" for i in range(15)]
    df = fields(lines(spark, paths), raw)
    date = lambda i: cleaning.date_time(F.col(f"c{i}"), F.col(f"c{i + 1}"), "yyyy/MM/dd HH:mm")
    number = lambda i, kind: F.col(f"c{i}").try_cast(kind)
    cols = [number(0, "long"), number(1, "long"), number(2, "long"), F.col("c3"), date(4), number(6, "double"), number(7, "double"), date(8), number(10, "double"), number(11, "double"), date(12), number(14, "int")]
    return df.select(*(c.alias(n) for c, n in zip(cols, DIRECTORY, strict=True))).filter("ID IS NOT NULL").orderBy("Start_date", "ID")


def gdp_source(spark: SparkSession, paths: str | list[str], metadata: DataFrame, use_fill_values: bool = True, latest: int = 2100, max_lines: int | None = None, chunk_size: int = 100_000, max_chunks: int | None = None) -> RaggedFrame:
    """Raw fixes of drifters: anomalous lines out, fractional days to times, metadata joined, rows by start date.

    Without ``use_fill_values`` drifters that the metadata lack are left out; with it they stay
    and carry the fills. The observation index is the line's place in its file, from 0;
    ``max_lines`` takes the first lines of each file alone, ``max_chunks`` as many chunks of
    ``chunk_size`` lines of each; of both the smaller counts. ``sources.growing`` takes files batch by batch.
    """
    raw = lines(spark, paths)
    if max_chunks is not None:
        max_lines = min(max_lines, max_chunks * chunk_size) if max_lines is not None else max_chunks * chunk_size
    df = fields(raw if max_lines is None else raw.filter(F.col("at") < max_lines), RAW)
    num = lambda c, kind="double": F.col(c).try_cast(kind)
    good = F.lit(True)
    for c in ("posObsYear", "senObsYear"):
        good = good & num(c).between(0, latest)
    for c in ("posObsMonth", "senObsMonth"):
        good = good & F.col(c).rlike("^[0-9]+$") & num(c).between(1, 12)
    good = good & F.col("drogue").rlike(r"^-?[0-9.]+$")
    kept = df.filter(good)
    when = lambda p: cleaning.fraction_date(num(f"{p}ObsYear"), num(f"{p}ObsMonth"), num(f"{p}ObsDay"))
    obs = kept.select(num("id", "long").alias("id"), F.col("at").alias("obs_index"), num("latitude", "float").alias("latitude"), num("longitude", "float").alias("longitude"), when("pos").alias("position_datetime"), when("sen").alias("sensor_datetime"), *(num(c, "float").alias(c) for c in RAW[9:]))
    # written once, as ids, places and counts are taken from it: files are not opened again for each. Small files make small parts, which are put together
    obs = materialize(obs.hint("rebalance"), "fixes")
    meta = metadata.select(*(F.col(c).alias(c.lower()) for c in DIRECTORY))
    found = obs.select("id").distinct().join(meta, "id", "left" if use_fill_values else "inner")
    if use_fill_values:
        unknown = F.col("wmo_number").isNull() & F.col("start_date").isNull() & F.col("buoys_type").isNull()
        found = found.withColumns({c: F.when(unknown, F.lit(v).cast(dict(found.dtypes)[c])).otherwise(F.col(c)) for c, v in FILLS.items()})
    rows = ranked(found, ["start_date", "id"])
    placed = obs.join(rows.select("id", ROW), "id").withColumn(OBS, F.row_number().over(Window.partitionBy(ROW).orderBy("obs_index")).cast("long") - 1)
    return RaggedFrame(rows, placed.drop("id")).recounted()


# Text attributes of a drifter's file, the characters of units at their ends, and fill-valued data.
TEXTS = {"DeployingShip": 20, "DeploymentStatus": 20, "BuoyTypeManufacturer": 20, "BuoyTypeSensorArray": 20, "PurchaserFunding": 20, "SensorUpgrade": 20, "Transmissions": 20, "DeployingCountry": 20, "DeploymentComments": 20, "ManufactureSensorType": 20, "DrogueType": 7, "DrogueDetectSensor": 20}
NUMBERS = {"CurrentProgram": (0, -1.0), "ManufactureMonth": (0, -1.0), "ManufactureYear": (0, -1.0), "ManufactureVoltage": (2, -1.0), "FloatDiameter": (3, None), "DrogueLength": (2, None), "DrogueBallast": (3, None), "DragAreaAboveDrogue": (4, None), "DragAreaOfDrogue": (4, None), "DragAreaRatio": (0, None), "DrogueCenterDepth": (2, None)}
HOURLY_DATA = ("err_lon", "err_lat", "err_ve", "err_vn", "sst", "sst1", "sst2", "err_sst", "err_sst1", "err_sst2")
SIX_HOURLY_DATA = ("temp", "err_temp", "err_lon", "err_lat")


def drifters(rows: DataFrame, obs: DataFrame, data: Sequence[str] = HOURLY_DATA) -> RaggedFrame:
    """Clean drifter tables as read from one file each: texts cut, units stripped, fills null, drogue status, names.

    ``rows`` has the files' attributes as strings, ``obs`` their variables; dates are seconds or fills.
    A missing float-presence mark is null.
    """
    cols: dict[str, Column] = {c: cleaning.cut(F.coalesce(c, F.lit("")), n) for c, n in TEXTS.items() if c in rows.columns}
    cols |= {c: cleaning.to_float(cleaning.drop_unit(F.col(c), k) if k else F.col(c), d) for c, (k, d) in NUMBERS.items() if c in rows.columns}
    cols |= {c: cleaning.unfill_date(F.col(c)) for c in ("deploy_date", "end_date", "drogue_lost_date", "start_date") if c in rows.columns}
    if "SubsfcFloatPresence" in rows.columns:
        cols["SubsfcFloatPresence"] = cleaning.to_float(F.col("SubsfcFloatPresence")) != 0
    if "location_type" in rows.columns:
        cols["location_type"] = F.coalesce(F.col("location_type") != "Argos", F.lit(True))
    rows = rows.withColumns(cols).withColumnsRenamed({"ID": "id"})
    obs = obs.withColumns({c: cleaning.unfill(F.col(c).cast("double")).cast("float") for c in data if c in obs.columns})
    obs = obs.withColumn("time", cleaning.unfill_date(F.col("time"))).withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    obs = obs.withColumns({c: F.col(c).cast("float") for c, t in obs.dtypes if t == "double" and c not in ("time", "lat", "lon")})
    if "drogue_lost_date" in rows.columns:
        obs = obs.join(rows.select(ROW, "drogue_lost_date"), ROW).withColumn("drogue_status", cleaning.drogue_on(F.col("drogue_lost_date"), F.col("time"))).drop("drogue_lost_date")
    return RaggedFrame(rows, obs).recounted()


def by_date(rows: DataFrame, ids: DataFrame, date: str = "Start_date", key: str = "ID") -> DataFrame:
    """The rows of a metadata table whose id is asked for, with their ``place`` from 0 by date, then id."""
    return ranked(rows.join(ids.select(key).distinct(), key, "left_semi"), [date, key], "place")


# ---- published archives in array files ----

# How array files write times, and microseconds of their units.
SINCE = re.compile(r"^(microsecond|millisecond|second|minute|hour|day)s? since (\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?")
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def decode_times(frame: RaggedFrame) -> RaggedFrame:
    """Timestamps for numeric columns whose ``units`` count from a date ("seconds since 1970-01-01"); NaN becomes null.

    Doubles are rounded to microseconds. Other columns, and units that do not count from a date, stay.
    """
    out = []
    for df in (frame.rows, frame.obs):
        for f in df.schema.fields:
            found = SINCE.match(str(f.metadata.get("units", ""))) if f.dataType.typeName() in ("double", "float", "long", "integer") else None
            if not found:
                continue
            start = datetime.fromisoformat("-".join(x.zfill(2) for x in found[2].split("-")) + "T" + (found[3] or "00:00").zfill(5)).replace(tzinfo=UTC)
            epoch = round((start - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
            col = F.col(f"`{f.name}`")
            micros = F.round(col * MICROS[found[1]]) if f.dataType.typeName() in ("double", "float") else col.cast("long") * MICROS[found[1]]
            df = df.withColumn(f.name, F.when(~F.isnan(col.cast("double")), F.timestamp_micros(micros.cast("long") + epoch)))
            df = df.withMetadata(f.name, {k: v for k, v in f.metadata.items() if k != "units"})
        out.append(df)
    return RaggedFrame(*out, frame.attrs)


def _archive(frame: RaggedFrame, data: Sequence[str], times: bool) -> RaggedFrame:
    """An archive's columns cleaned as those of the files it was made of, with its attributes; times as timestamps."""
    clean = drifters(frame.rows, frame.obs, data)
    out = RaggedFrame(clean.rows, clean.obs, frame.attrs)
    names = {"ID": "id", "longitude": "lon", "latitude": "lat"}
    for df in (frame.rows, frame.obs):
        for f in df.schema.fields:
            if f.metadata and names.get(f.name, f.name) in out.rows.columns + out.obs.columns:
                out = out.describe(names.get(f.name, f.name), **f.metadata)
    return decode_times(out) if times else out


def gdp1h(spark: SparkSession, uri: str, times: bool = True) -> RaggedFrame:
    """The hourly drifters from a Zarr folder with dimensions traj and obs.

    Texts are cut, units stripped, fills null, longitude and latitude renamed and floats single,
    as for the drifters' own files; columns that the archive lacks are left out. ``times`` makes
    timestamps of columns whose units count from a date.
    """
    return _archive(read_zarr(spark, uri), HOURLY_DATA, times)


def gdp6h(spark: SparkSession, uri: str, times: bool = True) -> RaggedFrame:
    """The six-hourly drifters from a Zarr folder with dimensions traj and obs; otherwise as ``gdp1h``."""
    return _archive(read_zarr(spark, uri), SIX_HOURLY_DATA, times)


def spotters(spark: SparkSession, uri: str, times: bool = True) -> RaggedFrame:
    """Wave buoys from a Zarr folder with dimensions trajectory and index; ``times`` as in ``gdp1h``."""
    frame = read_zarr(spark, uri, "trajectory", "index")
    return decode_times(frame) if times else frame
