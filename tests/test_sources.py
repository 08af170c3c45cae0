import datetime as dt
import gzip
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions import cleaning
from tracklake.model import OBS, ROW, RaggedFrame
from tracklake.sources import files, providers


def rows(f):
    return [tuple(r) for r in f.rows.orderBy(ROW).select(*[c for c in ("id", "drifter_id", "rowsize") if c in f.rows.columns]).collect()]


def obs(f, *columns):
    return [tuple(r) for r in f.obs.orderBy(ROW, OBS).select(*columns).collect()]


def test_glad(spark, tmp_path):
    p = tmp_path / "glad.dat"
    p.write_text("h\n" * 5 + "B 2012-07-20 01:15:00.0 28.0 -88.0 5 0.1 0.2 0.01\nA 2012-07-20 00:15:00.0 27.0 -87.0 5 0.1 0.2 0.01\nB 2012-07-20 00:15:00.0 29.0 -89.0 5 0.1 0.2 0.01\n")
    f = providers.glad(spark, str(p))
    assert rows(f) == [("A", 1), ("B", 2)] and obs(f, "latitude") == [(27.0,), (29.0,), (28.0,)]
    assert obs(f, "time")[0] == (dt.datetime(2012, 7, 20, 0, 15),)


def test_laser(spark, tmp_path):
    p = tmp_path / "laser.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("x/laser_v15.dat", "% comment\nL2 2016-01-02 00:00:00 28.0 -88.0 5 0.1 0.2 0.01\nL1 2016-01-01 00:00:00 27.0 -87.0 5 0.1 0.2 0.01 % end\nL2 2016-01-01 00:00:00 29.0 -89.0 5 0.1 0.2 0.01\n")
    f = providers.laser(spark, str(p))
    assert rows(f) == [("L1", 1), ("L2", 2)] and obs(f, "latitude") == [(27.0,), (29.0,), (28.0,)]
    with pytest.raises(Exception, match="no .txt"):
        providers.laser(spark, str(p), ".txt").rows.collect()


def test_quicche(spark, tmp_path):
    p = tmp_path / "q.dat"
    p.write_text("1 11 D2 2024-01-02T00:00:00Z 5 10.0 20.0 X LOW F\n2 12 D1 nonsense 5 11.0 21.0 X\n3 13 D2 2024-01-01T00:00:00Z 5 12.0 22.0 X GOOD\n")
    f = providers.quicche(spark, str(p), "qc1")
    assert rows(f) == [("D1", 1), ("D2", 2)]
    assert obs(f, "time", "battery_state", "flag") == [(None, "", ""), (dt.datetime(2024, 1, 1), "GOOD", ""), (dt.datetime(2024, 1, 2), "LOW", "F")]
    assert "battery_state" not in providers.quicche(spark, str(p), "qc3").obs.columns
    with pytest.raises(ValueError):
        providers.quicche(spark, str(p), "qc9")


STORMS = """<html><head></head><pre>
AL011851,            UNNAMED,      2,
18510625, 0000,  , HU, 28.0N,  94.8W,  80, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999
18510625, 0600, L, HU, 28.0S,  95.4E, -99,  990,   10, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999

AL021851,            UNNAMED,      1,
18510705, 1200,  , TS, 22.2N,  97.6W,  80, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999
"""


def test_hurdat2(spark, tmp_path):
    p = tmp_path / "h.html"
    p.write_text(STORMS)
    f = providers.hurdat2(spark, str(p))
    assert rows(f) == [("AL011851", 2), ("AL021851", 1)] and {r.year for r in f.rows.collect()} == {1851}
    assert obs(f, "lat", "lon", "pressure") == [(28.0, -94.8, None), (-28.0, 95.4, 99000.0), (22.2, -97.6, None)]
    assert obs(f, "wind_speed") == [(80 * 1825 / 3600,), (None,), (80 * 1825 / 3600,)]
    assert obs(f, "record_identifier", "max_low_wind_radius_ne")[1] == ("L", 18250.0)
    assert obs(providers.hurdat2(spark, str(p), convert=False), "wind_speed")[0] == (80.0,)


def test_yomaha(spark, tmp_path):
    line = lambda i, lon: " ".join([str(lon), "10.0", "1000.0", "2000.5"] + ["1.0"] * 4 + ["-999.99"] + ["1.0"] * 16 + [str(i), "7", "0"])
    (tmp_path / "y.txt.gz").write_bytes(gzip.compress("\n".join([line(1002, 5.5), line(1001, -999.9999), line(1001, 6.5)]).encode()))
    (tmp_path / "w.txt").write_text("1001 900 1 0\n1002 901 2 3\n9 9 9 9\n")
    (tmp_path / "d.txt").write_text("1 : AOML \n2: CORIOLIS\n")
    (tmp_path / "t.txt").write_text("0 : X\n3 : APEX\nend\n")
    f = providers.yomaha(spark, str(tmp_path / "y.txt.gz"), str(tmp_path / "w.txt"), str(tmp_path / "d.txt"), str(tmp_path / "t.txt"))
    assert rows(f) == [(1001, 2), (1002, 1)] and obs(f, "lon_d", "lon_s") == [(None, None), (6.5, None), (5.5, None)]
    assert [tuple(r) for r in f.rows.orderBy(ROW).select("wmo_id", "dac", "float_type").collect()] == [(900, "AOML", "METOCEAN"), (901, "CORIOLIS", "APEX")]


def test_andro(spark, tmp_path):
    p = tmp_path / "a.zip"
    line = lambda i, t: " ".join(["1.0"] * 3 + [t] + ["2.0"] * 29 + ["3", str(i), "7", "-99"])
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("andro.dat", "\n".join([line(1001, "-99.999"), line(1002, "4.5"), line(1001, "5.5")]))
    f = providers.andro(spark, str(p))
    assert rows(f) == [(1001, 2), (1002, 1)] and obs(f, "temp_d", "profile_id") == [(None, None), (5.5, None), (4.5, None)]


def test_mosaic(spark, tmp_path):
    (tmp_path / "list.csv").write_text("Sensor ID,leg,Deployment Date\nS2,1,2019-10-01\nS1,2,2019-10-02\n")
    d = tmp_path / "data"
    d.mkdir()
    (d / "buoy_S1.csv").write_text("datetime,latitude,longitude\n2019-10-05 00:00:00,85.0,130.0\n2019-10-05 01:00:00,85.1,130.1\n")
    (d / "buoy_S2.csv").write_text("datetime,latitude,longitude\n2019-10-06 00:00:00,86.0,131.0\n")
    f = providers.mosaic(spark, str(tmp_path / "list.csv"), str(d))
    assert rows(f) == [("S2", 1), ("S1", 2)] and obs(f, "latitude") == [(86.0,), (85.0,), (85.1,)]
    xml = "<eml><dataset><dataTable><physical><objectName>a.csv</objectName><distribution><online><url>http://x/a</url></online></distribution></physical></dataTable></dataset></eml>"
    assert providers.file_urls(spark.createDataFrame([(xml,)], "value string")).collect() == [("a.csv", "http://x/a")]


def test_raw_drifters(spark, tmp_path):
    (tmp_path / "dir.dat").write_text("1002 21 1 SVP 2000/02/01 00:00 1.0 2.0 2001/01/01 00:00 3.0 4.0 0000/00/00 00:00 1\n1001 22 1 SVP 2000/03/01 12:30 1.0 2.0 2001/01/01 00:00 3.0 4.0 2000/05/01 00:00 1\n")
    meta = providers.directory(spark, str(tmp_path / "dir.dat"))
    assert [(r.ID, r.Drogue_off_date) for r in meta.collect()] == [(1002, None), (1001, dt.datetime(2000, 5, 1))]
    asked = spark.createDataFrame([(1001,), (1002,)], "ID long")
    assert [r.ID for r in providers.by_date(meta, asked).orderBy("place").collect()] == [1002, 1001]
    good = "{} 3 15.5 2000 10.0 20.0 3 15.25 2000 1.0 20.5 1 2 3 4 5"
    bad = ["1001 3 15.5 9999 1 2 3 15.5 2000 1 2 3 4 5 6 7", "1001 x 15.5 2000 1 2 3 15.5 2000 1 2 3 4 5 6 7", "1001 3 15.5 2000 1 2 3 15.5 2000 1a 2 3 4 5 6 7"]
    (tmp_path / "raw.dat").write_text("\n".join([good.format(1001), good.format(1002), *bad, good.format(1001), good.format(77)]))
    f = providers.gdp_source(spark, str(tmp_path / "raw.dat"), meta)
    assert rows(f) == [(77, 1), (1002, 1), (1001, 2)] and obs(f, "position_datetime")[0] == (dt.datetime(2000, 3, 15, 12),)
    assert {r.id: r.wmo_number for r in f.rows.collect()} == {77: -999, 1001: 22, 1002: 21}
    assert len(rows(providers.gdp_source(spark, str(tmp_path / "raw.dat"), meta, use_fill_values=False))) == 2


def test_drifter_tables(spark):
    r = spark.createDataFrame([(0, 9, "x" * 30, "55 V", "35.5 cm", "nan", 5.0, None)], "row_idx long, ID long, DeployingShip string, ManufactureVoltage string, FloatDiameter string, CurrentProgram string, drogue_lost_date double, SubsfcFloatPresence string")
    o = spark.createDataFrame([(0, 0, 1.0, 10.0, -1e34), (0, 1, 6.0, 11.0, 3.0)], "row_idx long, obs_idx long, time double, longitude double, sst double")
    f = providers.drifters(r, o)
    row = f.rows.first()
    assert (len(row.DeployingShip), row.ManufactureVoltage, row.FloatDiameter, row.CurrentProgram, row.SubsfcFloatPresence, row.rowsize) == (20, 55.0, 35.5, -1.0, None, 2)
    assert obs(f, "sst", "drogue_status") == [(None, True), (3.0, False)]


def test_subsurface_and_padded(spark):
    df = spark.createDataFrame([(7, [719529.0, 719530.5], [1.0, 2.0], [3.0, 4.0])], "indexFlt long, dtnum array<double>, lon array<double>, p array<double>")
    f = providers.subsurface(df)
    assert obs(f, "time", "pres") == [(dt.datetime(1970, 1, 1), 3.0), (dt.datetime(1970, 1, 2, 12), 4.0)]
    p = providers.padded(spark.createDataFrame([(1, 2, [1, 2, 0]), (2, 0, [0, 0, 0])], "id long, numobs long, x array<int>"))
    assert obs(p, "x") == [(1,), (2,)] and sorted(r.rowsize for r in p.rows.collect()) == [0, 2]


def test_many_files_and_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField(n, k) for n, k in (("id", T.LongType()), ("time", T.LongType()), ("temp", T.DoubleType()))])

    def read(i):
        if i == 9:
            raise OSError("broken")
        return pd.DataFrame({"id": i, "time": range(i), "temp": 0.5})

    with pytest.warns(UserWarning, match="salt"):
        f = files.from_files(spark, [3, 1, 9], read, schema, ["id", "time"], ["rowsize"], ["temp", "salt"], {"title": "t"})
    assert rows(f) == [(3, 3), (1, 1), (None, 0)] and obs(f, "time") == [(0,), (1,), (2,), (0,)]
    files.write_nested(f.describe("temp", units="degC"), str(tmp_path / "n"))
    back = files.read_nested(spark, str(tmp_path / "n"))
    assert back.attrs == {"title": "t"} and back.attributes("temp") == {"units": "degC"} and back.obs.count() == 4
    again = files.from_dataframes(f.rows.drop("rowsize"), f.obs)
    assert rows(again) == rows(f)
    with pytest.raises(ValueError):
        files.from_dataframes(f.rows, f.obs.drop(OBS))


def test_catalog(spark, tmp_path):
    built = []

    def build(extra=False):
        built.append(1)
        o = spark.createDataFrame([(0, 0, 1.0)], "row_idx long, obs_idx long, x double")
        return RaggedFrame(spark.createDataFrame([(0, 1)], "row_idx long, rowsize long"), o.withColumn("y", F.col("x")) if extra else o)

    c = files.Catalog(spark, str(tmp_path))
    for _ in range(2):
        assert c.get("t", build).obs.count() == 1
    assert len(built) == 1
    assert "y" in c.get("t", lambda: build(True), needs=["y"]).obs.columns and len(built) == 2
    c.get("t", build, force=True)
    assert len(built) == 3


def test_cleaning(spark):
    d = spark.createDataFrame([("1.5", "28.0N", "7 m", "2020-01-02T03:04:05+00:00"), ("nan", "94.8W", None, "x"), ("?", "12", "m", None)], "a string, b string, c string, d string")
    got = d.select(cleaning.to_float(F.col("a"), -1.0), cleaning.heading(F.col("b")), cleaning.drop_unit(F.col("c"), 2), cleaning.iso_time(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1.5, 28.0, "7", dt.datetime(2020, 1, 2, 3, 4, 5)), (-1.0, -94.8, None, None), (-1.0, None, "", None)]


def test_lines_keep_their_place_over_blocks(spark, tmp_path):
    """A file that is read in many blocks: each line has its number, and a header's storm goes on in later blocks."""
    texts = [f"line {k} " + "x" * (k % 90) for k in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(texts))
    (tmp_path / "b.txt").write_text("\n".join(texts[:7]))
    storm = "AL012024, A, 3000,\n" + "\n".join(f"20240101, {k // 60 % 24:02d}{k % 60:02d},  , HU, 28.0N,  94.8W,  80, " + ", ".join(["-999"] * 14) for k in range(3000)) + "\nAL022024, B, 1,\n20240102, 0000,  , TS, 22.2N,  97.6W,  80, " + ", ".join(["-999"] * 14) + "\n"
    (tmp_path / "h.dat").write_text(storm)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = files.lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
        assert len({r.block for r in got}) > 5 and len(got) == 5007
        assert all(r.value == texts[r.at] for r in got)
        f = providers.hurdat2(spark, str(tmp_path / "h.dat"))
        assert rows(f) == [("AL012024", 3000), ("AL022024", 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_unreadable_files(spark):
    schema = T.StructType([T.StructField("x", T.DoubleType())])

    def read(i):
        if i == 2:
            raise OSError("broken")
        return pd.DataFrame({"x": [float(i)]})

    f = files.from_files(spark, [1, 2], read, schema, [], [], ["x"])
    assert [(r.rowsize, r.read_error) for r in f.rows.orderBy(ROW).collect()] == [(1, None), (0, "2: broken")]
    with pytest.raises(Exception, match="broken"):
        files.from_files(spark, [1, 2], read, schema, [], [], ["x"], unreadable="raise")
    with pytest.raises(ValueError):
        files.from_files(spark, [1], read, schema, [], [], ["x"], unreadable="no")


def test_storm_archives(spark):
    df = spark.createDataFrame([("a", 2001, 1, [1, 0], [7]), ("b", 2010, 2, [3, 4], [8]), ("c", 2011, 0, [0, 0], [9])], "sid string, season long, numobs long, wind array<int>, quadrant array<int>")
    f = providers.ibtracs(df)
    assert sorted((r.sid, r.rowsize, r.quadrant) for r in f.rows.collect()) == [("a", 1, [7]), ("b", 2, [8]), ("c", 0, [9])] and obs(f, "wind") == [(1,), (3,), (4,)]
    assert sorted(r.sid for r in providers.ibtracs(df, since=2010).rows.collect()) == ["b", "c"]
    assert providers.ibtracs_name() == "IBTrACS.last3years.v04r01.nc" and providers.ibtracs_name("v04r00", "NA") == "IBTrACS.NA.v04r00.nc"


# ---- the catalog's stored layout ----


@pytest.fixture
def stored(spark, tmp_path):
    """Rows of several lengths in a catalog of three buckets, and the same frame unstored."""
    rows = spark.createDataFrame([(i, 1 + i % 5, i % 2 == 0) for i in range(40)], "row_idx long, rowsize long, even boolean")
    obs = spark.createDataFrame([(i, k, 100.0 * i + 7.0 * k, float(i), float(k)) for i in range(40) for k in range(1 + i % 5)], "row_idx long, obs_idx long, time double, lon double, lat double")
    frame = RaggedFrame(rows, obs, {"title": "t"}).describe("lon", units="degrees")
    catalog = files.Catalog(spark, f"file://{tmp_path}/c", buckets=3)
    return catalog, catalog.get("f", lambda: frame), frame


def test_stored_frames_need_no_exchange(spark, stored):
    from tracklake.model import OBS, ROW
    from tracklake.operators import kinematics, ragged

    _, kept, frame = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = {
            "velocity": lambda f: kinematics.velocity(f.obs),
            "segment": lambda f: ragged.segment(f.obs, "time", 10.0),
            "prune": lambda f: ragged.prune(f, 3).obs,
            "subset": lambda f: ragged.subset(f, {"even": True, "lat": (0, 2)}).obs,
            "reduce": lambda f: f.obs.groupBy(ROW).agg(F.avg("lat").alias("lat")),
            "joined": lambda f: f.joined(["even"]),
        }
        for name, make in cases.items():
            mine, plain = make(kept), make(frame)
            plan = mine._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, (name, plan)
            assert sorted(map(repr, mine.select(*plain.columns).collect())) == sorted(map(repr, plain.collect())), name
            assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert kept.attrs == {"title": "t"} and kept.attributes("lon") == {"units": "degrees"} and OBS in kept.obs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_bucket_is_one_sorted_file(stored, tmp_path):
    import pyarrow.parquet as pq

    found = sorted((tmp_path / "c" / "f").glob("*/obs/*.parquet"))
    assert len(found) == 3
    for f in found:
        t = pq.read_table(f).select(["row_idx", "obs_idx"]).to_pylist()
        assert [tuple(x.values()) for x in t] == sorted(tuple(x.values()) for x in t)


def test_versions(spark, stored, tmp_path):
    """A reader of one version reads on while the next is written; the one before last goes; another session finds the last."""
    catalog, kept, frame = stored
    fewer = RaggedFrame(frame.rows.filter("row_idx < 10"), frame.obs.filter("row_idx < 10"))
    catalog.put("f", fewer)
    assert kept.obs.count() == frame.obs.count() and catalog.get("f", None).rows.count() == 10
    catalog.put("f", frame)
    assert len([x for x in (tmp_path / "c" / "f").iterdir() if x.is_dir()]) == 2
    other = spark.newSession()
    again = files.Catalog(other, catalog.folder).get("f", None)
    assert again.obs.count() == frame.obs.count() and again.attrs == {"title": "t"}
    with pytest.raises(Exception, match="broken"):
        catalog.put("f", RaggedFrame(frame.rows, frame.obs.withColumn("lon", F.raise_error(F.lit("broken")).cast("double"))))
    assert catalog.get("f", None).obs.count() == frame.obs.count()
