"""Array files: written and read back, and files made by hand."""

import gzip
import json
import struct

import numpy as np
import pytest
from frames import frame
from pyspark.sql import functions as F

from tracklake.model import OBS, ROW, RaggedFrame
from tracklake.sources import grids


def made(spark):
    f = frame(spark, [{"id": 7}, {"id": 8}, {"id": 9}], [[{"x": 1.5, "n": 3}, {"x": float("nan"), "n": 4}], [], [{"x": -2.0, "n": 5}]])
    return RaggedFrame(f.rows, f.obs, {"title": "t"}).describe("x", units="m")


def content(f):
    rows = [(r.id, r.rowsize) for r in f.rows.orderBy(ROW).collect()]
    obs = [(r[ROW], r[OBS], None if r.x != r.x else r.x, r.n) for r in f.obs.orderBy(ROW, OBS).collect()]
    return rows, obs, f.attrs, f.attributes("x")


WANT = ([(7, 2), (8, 0), (9, 1)], [(0, 0, 1.5, 3), (0, 1, None, 4), (2, 0, -2.0, 5)], {"title": "t"}, {"units": "m"})


@pytest.mark.parametrize("rows_in_file", [1, 2, 100])
def test_netcdf_round_trip(spark, tmp_path, rows_in_file, monkeypatch):
    monkeypatch.setattr(grids, "SLICE", 2)
    f = made(spark)
    if rows_in_file == 1:  # a file of a row without observations has none of their columns' values
        f = RaggedFrame(f.rows, f.obs, f.attrs)
    paths = grids.write_netcdf(f, f"file://{tmp_path}", rows_in_file)
    assert len(paths) == -(-3 // rows_in_file)
    got = content(grids.read_netcdf(spark, paths))
    assert got[0] == WANT[0] and got[1] == WANT[1] and got[2] == WANT[2] and got[3] == WANT[3]


def test_netcdf_by_hand(spark, tmp_path):
    """Version 1 with shorts and padding, and a variable of another dimension that is left out."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = struct.pack(">ii", 10, 3) + name("rows") + struct.pack(">i", 2) + name("obs") + struct.pack(">i", 3) + name("other") + struct.pack(">i", 1)
    att = struct.pack(">ii", 12, 1) + name("k") + struct.pack(">ii", 2, 2) + b"vw\0\0"
    data = [("rowsize", 0, 4, np.array([1, 2], ">i4").tobytes()), ("s", 1, 3, np.array([5, -6, 7], ">i2").tobytes() + b"\0\0"), ("z", 2, 6, np.array([1.0], ">f8").tobytes())]
    size = sum(len(name(n)) + 28 for n, *_ in data)
    at = 8 + len(dims) + len(att) + 8 + size
    var = b""
    for n, d, kind, raw in data:
        var += name(n) + struct.pack(">ii", 1, d) + struct.pack(">ii", 0, 0) + struct.pack(">iii", kind, len(raw), at)
        at += len(raw)
    (tmp_path / "a.nc").write_bytes(b"CDF\x01" + struct.pack(">i", 0) + dims + att + struct.pack(">ii", 11, 3) + var + b"".join(d[3] for d in data))
    f = grids.read_netcdf(spark, [str(tmp_path / "a.nc")])
    assert [(r[ROW], r[OBS], r.s) for r in f.obs.orderBy(ROW, OBS).collect()] == [(0, 0, 5), (1, 0, -6), (1, 1, 7)] and f.attrs == {"k": "vw"} and "z" not in f.obs.columns
    (tmp_path / "b.nc").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a NetCDF classic file"):  # raised by the task that reads the header
        grids.read_netcdf(spark, [str(tmp_path / "b.nc")])


@pytest.mark.parametrize("chunk", [1, 2, 64])
def test_zarr_round_trip(spark, tmp_path, chunk):
    grids.write_zarr(made(spark), f"file://{tmp_path}/z", chunk)
    assert content(grids.read_zarr(spark, f"file://{tmp_path}/z")) == WANT


def test_zarr_by_hand(spark, tmp_path):
    """A gzip array, a plain one, and a chunk that is absent."""
    for n, dim, values, packer in (("rowsize", "traj", [np.array([2, 1], "<i4")], gzip.compress), ("v", "obs", [np.array([1.5, 2.5], "<f4"), None], None)):
        d = tmp_path / "z" / n
        d.mkdir(parents=True)
        size = 2 if dim == "traj" else 3
        (d / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [size], "chunks": [2], "dtype": values[0].dtype.str, "compressor": {"id": "gzip"} if packer else None, "fill_value": 9, "order": "C", "filters": None}))
        (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": [dim]}))
        for k, v in enumerate(values):
            if v is not None:
                (d / str(k)).write_bytes((packer or bytes)(v.tobytes()))
    f = grids.read_zarr(spark, str(tmp_path / "z"))
    assert [(r[ROW], r[OBS], r.v) for r in f.obs.orderBy(ROW, OBS).collect()] == [(0, 0, 1.5), (0, 1, 2.5), (1, 0, 9.0)]


# ---- records, types, missing and packed values ----


def nc(path, records, dims, variables, data, version=1):
    """A classic file by hand: (name, dims, type, attributes, size, begin) variables; the content follows as it is."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    atts = lambda a: struct.pack(">ii", 12 if a else 0, len(a)) + b"".join(name(k) + struct.pack(">ii", t, n) + raw + b"\0" * (-len(raw) % 4) for k, (t, n, raw) in a.items())
    head = b"CDF" + bytes([version]) + struct.pack(">i", records) + struct.pack(">ii", 10, len(dims)) + b"".join(name(d) + struct.pack(">i", n) for d, n in dims) + atts({}) + struct.pack(">ii", 11, len(variables))
    made = lambda base: b"".join(name(n) + struct.pack(">i", len(ds)) + b"".join(struct.pack(">i", d) for d in ds) + atts(a) + struct.pack(">iii", kind, size, base + begin) for n, ds, kind, a, size, begin in variables)
    base = len(head) + len(made(0))
    path.write_bytes(head + made(base) + data)


@pytest.mark.parametrize("records", [5, -1])
def test_interleaved_records_by_hand(spark, tmp_path, records):
    """Shorts padded to four bytes, characters and packed bytes lie side by side, a record for each observation; a count of -1 comes from the size."""
    x = np.array([1, -99, 3, 4, 5], ">i2")
    t = [b"ab", b"c\0", b"\0\0", b"de", b"f\0"]
    p = np.array([0, 1, 2, 3, 127], "i1")
    body = np.array([2, 3], ">i4").tobytes() + b"".join(x[i : i + 1].tobytes() + b"\0\0" + t[i] + b"\0\0" + p[i : i + 1].tobytes() + b"\0\0\0" for i in range(5))
    variables = [
        ("rowsize", [0], 4, {}, 8, 0),
        ("x", [1], 3, {"_FillValue": (3, 1, struct.pack(">h", -99))}, 4, 8),
        ("t", [1, 2], 2, {}, 4, 12),
        ("p", [1], 1, {"scale_factor": (6, 1, struct.pack(">d", 0.5)), "add_offset": (6, 1, struct.pack(">d", 10.0)), "missing_value": (1, 1, b"\x7f")}, 4, 16),
    ]
    nc(tmp_path / "a.nc", records, [("rows", 2), ("obs", 0), ("len", 2)], variables, body)
    f = grids.read_netcdf(spark, str(tmp_path / "a.nc"))
    assert [tuple(r) for r in f.obs.select(ROW, OBS, "x", "t", "p").orderBy(ROW, OBS).collect()] == [(0, 0, 1, "ab", 10.0), (0, 1, None, "c", 10.5), (1, 0, 3, "", 11.0), (1, 1, 4, "de", 11.5), (1, 2, 5, "f", None)]


def test_one_record_variable_is_not_padded(spark, tmp_path):
    nc(tmp_path / "a.nc", 3, [("rows", 1), ("obs", 0)], [("rowsize", [0], 4, {}, 4, 0), ("x", [1], 3, {}, 4, 4)], np.array([3], ">i4").tobytes() + np.array([7, 8, 9], ">i2").tobytes())
    assert [r.x for r in grids.read_netcdf(spark, [str(tmp_path / "a.nc")]).obs.orderBy(OBS).collect()] == [7, 8, 9]


def test_types_are_promoted_over_files(spark, tmp_path):
    for name, code, values in (("a", 4, np.array([1, 2], ">i4")), ("b", 6, np.array([0.5, 3e9], ">f8")), ("c", 3, np.array([5, 6], ">i2"))):
        nc(tmp_path / f"{name}.nc", 0, [("rows", 1), ("obs", 2)], [("rowsize", [0], 4, {}, 4, 0), ("x", [1], code, {}, values.nbytes, 4), *([("only", [1], 4, {}, 8, 4)] if name == "c" else [])], np.array([2], ">i4").tobytes() + values.tobytes() + bytes(8))
    f = grids.read_netcdf(spark, str(tmp_path))
    assert dict(f.obs.dtypes)["x"] == "double"
    got = [(r[ROW], r.x, r.only is None) for r in f.obs.orderBy(ROW, OBS).collect()]
    assert got == [(0, 1.0, True), (0, 2.0, True), (1, 0.5, True), (1, 3e9, True), (2, 5.0, False), (2, 6.0, False)]


def wide(spark):
    """Integers beyond 32 and 53 bits, with nulls, in some rows only; texts, truth values and rows without observations."""
    obs = [[{"n": 1, "s": "é", "b": True, "x": 0.5}, {"n": None, "s": None, "b": None, "x": None}], [], [{"n": 2**53 + 1, "s": "longer text", "b": False, "x": -1.0}], [{"n": -5, "s": "", "b": True, "x": 2.0}]]
    rows = [(i, len(o), name) for i, (o, name) in enumerate(zip(obs, ["a", None, "ccc", "dd"], strict=True))]
    flat = [(i, k, x["n"], x["s"], x["b"], x["x"]) for i, o in enumerate(obs) for k, x in enumerate(o)]
    return RaggedFrame(spark.createDataFrame(rows, f"{ROW} long, rowsize long, name string"), spark.createDataFrame(flat, f"{ROW} long, {OBS} long, n long, s string, b boolean, x double"), {"title": "wide"}).describe("n", units="pieces")


WIDE = [(0, 0, 1, "é", 1, 0.5), (0, 1, None, "", None, None), (2, 0, 2**53 + 1, "longer text", 0, -1.0), (3, 0, -5, "", 1, 2.0)]


def plain(f):
    same = lambda x: None if x is None or x != x else x
    return [tuple(map(same, r)) for r in f.obs.select(ROW, OBS, "n", "s", "b", "x").orderBy(ROW, OBS).collect()], [(r.name, r.rowsize) for r in f.rows.orderBy(ROW).collect()], f.attributes("n")["units"]


@pytest.mark.parametrize("unlimited", [False, True])
@pytest.mark.parametrize("obs_in_file", [1, 2, 100])
def test_what_is_written_comes_back(spark, tmp_path, unlimited, obs_in_file, monkeypatch):
    monkeypatch.setattr(grids, "SLICE", 2)
    paths = grids.write_netcdf(wide(spark), f"file://{tmp_path}/nc", obs_in_file=obs_in_file, unlimited=unlimited)
    assert len(paths) >= min(3, -(-4 // obs_in_file))
    assert plain(grids.read_netcdf(spark, paths)) == (WIDE, [("a", 2), ("", 0), ("ccc", 1), ("dd", 1)], "pieces")
    assert {x.name for x in (tmp_path / "nc").iterdir()} == {p.rsplit("/", 1)[1] for p in paths}  # nothing of the job is left


def test_a_folder_is_replaced_and_a_failed_job_leaves_it(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = f"file://{tmp_path}/nc"
    grids.write_netcdf(wide(spark), folder, rows_in_file=1)
    paths = grids.write_netcdf(made(spark), folder)
    assert len(paths) == 1
    broken = made(spark)
    broken = RaggedFrame(broken.rows.withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))), broken.obs)
    with pytest.raises(Exception, match="broken"):
        grids.write_netcdf(broken, folder)
    assert grids.listed(folder) == paths and content(grids.read_netcdf(spark, folder)) == WANT


def test_empty_frames(spark, tmp_path):
    f = made(spark)
    none = RaggedFrame(f.rows.filter("false"), f.obs.filter("false"))
    assert grids.write_netcdf(none, f"file://{tmp_path}/none") == []
    with pytest.raises(ValueError, match="no files"):
        grids.read_netcdf(spark, f"file://{tmp_path}/none")
    alone = RaggedFrame(f.rows.withColumn("rowsize", f.rows["rowsize"] * 0), f.obs.filter("false"))
    got = grids.read_netcdf(spark, grids.write_netcdf(alone, f"file://{tmp_path}/alone"))
    assert got.obs.count() == 0 and [r.id for r in got.rows.orderBy(ROW).collect()] == [7, 8, 9]


# ---- the data source ----


def test_format_by_itself(spark, tmp_path):
    """Without a survey a file is a task and rows have the numbers of their file."""
    folder = f"file://{tmp_path}/nc"
    grids.write_netcdf(wide(spark), folder, rows_in_file=2)
    df = spark.read.format("netcdf").load(folder)
    assert df.rdd.getNumPartitions() == 2
    got = [(r[ROW], r[OBS], r.n) for r in df.orderBy(ROW, OBS).collect()]
    files = [[(0, 0, 1), (0, 1, None)], [(0, 0, 2**53 + 1), (1, 0, -5)]]
    assert got == [((k << 32) + i, j, n) for k, part in enumerate(files) for i, j, n in part]
    rows = spark.read.format("netcdf").option("role", "rows").load(folder)
    assert [r.name for r in rows.orderBy(ROW).collect()] == ["a", "", "ccc", "dd"]


def test_filters_leave_out_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "SLICE", 10)
    n = 12
    rows = spark.createDataFrame([(i, 7) for i in range(n)], f"{ROW} long, rowsize long")
    obs = spark.createDataFrame([(i, k, float(100 * i + k)) for i in range(n) for k in range(7)], f"{ROW} long, {OBS} long, time double")
    paths = grids.write_netcdf(RaggedFrame(rows, obs), f"file://{tmp_path}/nc", rows_in_file=3)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        f = grids.read_netcdf(spark, paths)
        parts = lambda df: df.rdd.getNumPartitions()
        assert len(paths) == 4 and parts(f.obs) == 4 * 3  # 21 observations a file, 10 a stretch
        one = f.obs.filter(f"{ROW} = 4")
        assert parts(one) == 2 and [r.time for r in one.orderBy(OBS).collect()] == [400.0 + k for k in range(7)]
        late = f.obs.filter("time >= 900")
        assert parts(late) == 3 and late.count() == 21
        few = f.obs.filter(f"{ROW} IN (0, 1) AND time < 3")
        assert parts(few) == 2 and few.count() == 3
        assert f.obs.filter("time > 5000").count() == 0
    finally:
        spark.conf.set(key, before or "false")
    assert grids.read_netcdf(spark, paths).obs.filter(f"{ROW} = 4").count() == 7


def test_a_row_longer_than_a_stretch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "SLICE", 8)
    sizes = [0, 3, 50, 0, 0, 9, 1, 8, 8, 0]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(sizes)], f"{ROW} long, rowsize long")
    obs = spark.createDataFrame([(i, j, i * 1000 + j) for i, k in enumerate(sizes) for j in range(k)], f"{ROW} long, {OBS} long, v long")
    f = grids.read_netcdf(spark, grids.write_netcdf(RaggedFrame(rows, obs), f"file://{tmp_path}/nc"))
    assert [(r[ROW], r[OBS]) for r in f.obs.orderBy("v").collect()] == [(i, j) for i, k in enumerate(sizes) for j in range(k)]
    assert all(r.v == r[ROW] * 1000 + r[OBS] for r in f.obs.collect())
    assert [r.rowsize for r in f.rows.orderBy(ROW).collect()] == sizes


# ---- Zarr: codecs, texts, nulls ----


@pytest.mark.parametrize("how", [{}, {"id": "zlib", "level": 1}, {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1}, {"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 2}, {"id": "blosc", "cname": "zlib", "clevel": 1, "shuffle": 0}])
def test_zarr_keeps_nulls_texts_and_wide_integers(spark, tmp_path, how):
    grids.write_zarr(wide(spark), f"file://{tmp_path}/z", 2, compressor=how)
    assert json.loads((tmp_path / "z" / "n" / ".zarray").read_text())["compressor"] == (how or None)
    assert plain(grids.read_zarr(spark, f"file://{tmp_path}/z")) == (WIDE, [("a", 2), ("", 0), ("ccc", 1), ("dd", 1)], "pieces")


def test_zarr_of_other_writers_by_hand(spark, tmp_path):
    """Chunks of two lengths, LZ4 and Zstandard with their own framing, texts with lengths of their own, truth values, consolidated metadata."""
    import pyarrow as pa

    lz4 = lambda raw: struct.pack("<I", len(raw)) + pa.Codec("lz4_raw").compress(raw, asbytes=True)
    texts = ["SPOT-1", "é"]
    arrays = {
        "rowsize": ("traj", "<i8", [2], [np.array([2, 1], "<i8").tobytes()], None, None),
        "name": ("traj", "|O", [2], [struct.pack("<I", 2) + b"".join(struct.pack("<I", len(t.encode())) + t.encode() for t in texts)], None, [{"id": "vlen-utf8"}]),
        "a": ("obs", "<f4", [2], [lz4(np.array([1.5, 2.5], "<f4").tobytes()), lz4(np.array([3.5, 0], "<f4").tobytes())], {"id": "lz4"}, None),
        "b": ("obs", "|b1", [3], [pa.Codec("zstd").compress(np.array([1, 0, 1], "?").tobytes(), asbytes=True)], {"id": "zstd"}, None),
        "c": ("obs", "<U2", [3], [np.array(["x", "yz", ""], "<U2").tobytes()], None, None),
        "d": ("obs", "<i2", [3], [np.array([10, -1, 30], "<i2").tobytes()], None, None),
    }
    meta = {".zattrs": {"title": "t"}}
    for n, (dim, kind, chunk, parts, codec, filters) in arrays.items():
        (tmp_path / "z" / n).mkdir(parents=True)
        meta[f"{n}/.zarray"] = {"zarr_format": 2, "shape": [2 if dim == "traj" else 3], "chunks": chunk, "dtype": kind, "compressor": codec, "fill_value": 0, "order": "C", "filters": filters}
        meta[f"{n}/.zattrs"] = {"_ARRAY_DIMENSIONS": [dim], **({"_FillValue": -1, "scale_factor": 0.1} if n == "d" else {})}
        for k, raw in enumerate(parts):
            (tmp_path / "z" / n / str(k)).write_bytes(raw)
    (tmp_path / "z" / ".zmetadata").write_text(json.dumps({"metadata": meta}))
    f = grids.read_zarr(spark, f"{tmp_path}/z")
    assert [tuple(r) for r in f.obs.select(ROW, OBS, "a", "b", "c", "d").orderBy(ROW, OBS).collect()] == [(0, 0, 1.5, True, "x", 1.0), (0, 1, 2.5, False, "yz", None), (1, 0, 3.5, True, "", 3.0)]
    assert [r.name for r in f.rows.orderBy(ROW).collect()] == texts


# ---- variables as vectors ----


def test_roles_follow_from_lengths(spark):
    long = [("rowsize", 0, 2.0), ("rowsize", 1, 0.0), ("rowsize", 2, 1.0)] + [("id", i, 10.0 + i) for i in range(3)] + [("x", i, i / 2) for i in range(3)] + [("y", i, None) for i in range(2)]
    vectors = spark.createDataFrame(long, "name string, at long, value double")
    with pytest.warns(UserWarning, match=r"y \(2\)"):
        f = grids.from_vectors(vectors, {"id": "long"}, {"title": "t"})
    assert set(f.rows.columns) == {ROW, "rowsize", "id", "x"} and f.attrs == {"title": "t"}  # as many values as rows: of the rows
    more = vectors.unionByName(spark.createDataFrame([("rowsize", 3, 2.0), ("id", 3, 13.0), ("x", 3, 9.0), ("x", 4, 8.0)], vectors.schema))
    with pytest.warns(UserWarning):
        f = grids.from_vectors(more)
    assert [(r[ROW], r.rowsize, r.id) for r in f.rows.orderBy(ROW).collect()] == [(0, 2, 10.0), (1, 0, 11.0), (2, 1, 12.0), (3, 2, 13.0)]
    assert [(r[ROW], r[OBS], r.x) for r in f.obs.orderBy(ROW, OBS).collect()] == [(0, 0, 0.0), (0, 1, 0.5), (2, 0, 1.0), (3, 0, 9.0), (3, 1, 8.0)]
    with pytest.raises(ValueError, match="rowsize"):
        grids.from_vectors(vectors.filter("name = 'x'"))


def test_attributes_that_were_not_set_are_empty(spark):
    f = made(spark)
    assert f.attributes("n") == f.attributes("id") == {} and f.attributes("x") == {"units": "m"}
    with pytest.raises(ValueError, match="no column"):
        f.attributes("other")


def test_places_find_their_rows_by_equality(spark):
    """Long and empty rows; a place has one candidate, and no side is broadcast."""
    sizes = [0, 70_000, 3, 0, 65_533, 1]
    rows = spark.createDataFrame(list(enumerate(sizes)), "row_idx long, rowsize long")
    obs = grids.ragged_of(rows, spark.range(sum(sizes)).withColumnRenamed("id", "at"), {}).obs
    join = next(x for x in obs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert "SortMergeJoin [at" in join
    got = {r.row_idx: (r.n, r.low, r.high) for r in obs.groupBy("row_idx").agg(F.count("*").alias("n"), F.min("obs_idx").alias("low"), F.max("obs_idx").alias("high")).collect()}
    assert got == {i: (n, 0, n - 1) for i, n in enumerate(sizes) if n}


def test_planner_knows_the_size_of_zarr_arrays(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row_idx"), F.lit(1).cast("long").alias("rowsize"), F.col("id").alias("key"))
    obs = spark.range(1000).select(F.col("id").alias("row_idx"), F.lit(0).cast("long").alias("obs_idx"), F.col("id").cast("double").alias("x"))
    grids.write_zarr(RaggedFrame(rows, obs), str(tmp_path / "sizes"), chunk=300)
    back = grids.read_zarr(spark, str(tmp_path / "sizes"))
    size = int(str(back.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 1000 * 8 * 2 and sorted(r.x for r in back.obs.collect()) == [float(k) for k in range(1000)]
