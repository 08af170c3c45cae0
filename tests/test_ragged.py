import math

import pytest
from frames import frame, of, values
from pyspark.sql import functions as F

from tracklake.model import OBS, ROW, RaggedFrame
from tracklake.operators import lines, ragged


@pytest.fixture
def small(spark):
    # The published example of three rows.
    time = [[1, 2, 3, 4, 5], [4, 5], [2, 3, 4, 5]]
    lon = [[-121.0, -111.0, 51.0, 61.0, 71.0], [103.0, 113.0], [12.0, 22.0, 32.0, 42.0]]
    lat = [[-90.0, -45.0, 45.0, 90.0, 0.0], [10.0, 20.0], [10.0, 20.0, 30.0, 40.0]]
    test = [[True, True, True, False, False], [False, False], [True, False, False, False]]
    return frame(spark, [{"id": 1}, {"id": 3}, {"id": 2}], [[{"time": t, "lon": x, "lat": y, "test": b} for t, x, y, b in zip(*p, strict=True)] for p in zip(time, lon, lat, test, strict=True)])


def ids(f):
    return {(r.id, r.rowsize) for r in f.rows.collect()}


def test_subset(small):
    assert ids(ragged.subset(small, {"test": True})) == {(1, 3), (2, 1)}
    assert ids(ragged.subset(small, {"id": 2})) == {(2, 4)}
    assert ids(ragged.subset(small, {"lat": (0, 30), "lon": (0, 125)})) == {(1, 1), (3, 2), (2, 3)}
    assert ids(ragged.subset(small, {"id": [1, 2], "time": lambda t: t % 2 == 0})) == {(1, 2), (2, 2)}
    assert ids(ragged.subset(small, {("lon", "lat"): lambda x, y: x + y > 100})) == {(1, 1), (3, 2)}
    full = ragged.subset(small, {"lon": (-125, -111)}, full_rows=True)
    assert ids(full) == {(1, 5)} and full.obs.count() == 5


def test_subset_of_nothing(small):
    empty = ragged.subset(small, {"time": (100, 200)})
    with pytest.warns(UserWarning):
        assert ragged.is_empty(empty)
    with pytest.raises(ValueError):
        ragged.subset(small, {"a": 10})
    with pytest.raises(TypeError):
        ragged.subset(small, {("lon", "lat"): [1, 2]})
    with pytest.raises(TypeError):
        ragged.subset(small, {("id", "lat"): lambda a, b: a > b})


def test_offsets_and_rows(spark):
    f = frame(spark, [{}, {}, {}, {}], [[{"x": 1}] * 2, [{"x": 1}] * 5, [], [{"x": 1}] * 3])
    assert [(r.start, r.stop) for r in ragged.offsets(f.rows).orderBy(ROW).collect()] == [(0, 2), (2, 7), (7, 7), (7, 10)]
    index = spark.range(10).select(F.col("id").alias("index"))
    assert [r.row_idx for r in ragged.rows_of(index, f.rows).orderBy("index").collect()] == [0, 0, 1, 1, 1, 1, 1, 3, 3, 3]
    with pytest.raises(Exception, match="out of range"):
        ragged.checked(ragged.rows_of(spark.range(11).select(F.col("id").alias("index")), f.rows)).collect()


def test_prune(spark):
    f = of(spark, [1, 2, 3], [1, 2], [1, 2, 3, 4])
    p = ragged.prune(f, 3)
    assert values(p.obs, "x") == [(1,), (2,), (3,), (1,), (2,), (3,), (4,)] and {r.rowsize for r in p.rows.collect()} == {3, 4}


@pytest.mark.parametrize(
    "x, tolerance, sizes",
    [([0, 1, 1, 1, 2, 2, 3, 3, 3, 3, 4], 0.5, [1, 3, 2, 4, 1]), ([1, 2, 2, 3, 3, 3, 4, 4, 4, 4], 0, [1, 2, 3, 4]), ([0, 1, 1, 1, 2, 0, 3, 3, 3, 4], -1, [5, 5]), ([7], 1, [1])],
)
def test_segment(spark, x, tolerance, sizes):
    assert values(ragged.segment_sizes(of(spark, x).obs, "x", tolerance), "rowsize") == [(n,) for n in sizes]


def test_segment_keeps_rows_apart(spark):
    f = of(spark, [0, 1, 1, 1], [2, 2, 3, 3, 3, 3, 4])
    assert values(ragged.segment_sizes(f.obs, "x", 0.5), "row_idx", "rowsize") == [(0, 1), (0, 3), (1, 2), (1, 4), (1, 1)]


@pytest.mark.parametrize(
    "n, length, overlap, align, want",
    [
        (5, 2, 0, "start", [[1, 2], [3, 4]]),
        (5, 2, 0, "end", [[2, 3], [4, 5]]),
        (8, 3, 0, "end", [[3, 4, 5], [6, 7, 8]]),
        (8, 3, 0, "middle", [[2, 3, 4], [5, 6, 7]]),
        (5, 3, 2, "start", [[1, 2, 3], [2, 3, 4], [3, 4, 5]]),
        (7, 2, -1, "start", [[1, 2], [4, 5]]),
        (2, 3, 0, "start", []),
    ],
)
def test_chunk(spark, n, length, overlap, align, want):
    f = of(spark, list(range(1, n + 1)))
    got: dict = {}
    for chunk, x in values(ragged.chunk(f, length, overlap, align), "chunk", "x"):
        got.setdefault(chunk, []).append(x)
    assert [got[k] for k in sorted(got)] == want
    nested = ragged.unpack(f, "x").select(ragged.chunk_arrays("x", length, overlap, align).alias("c")).first().c
    assert nested == want


def test_chunk_errors(spark):
    f = of(spark, [1, 2])
    for bad in ({"align": "left"}, {"overlap": 2}):
        with pytest.raises(ValueError):
            ragged.chunk(f, 2, **bad)


def test_regular_and_back(spark):
    f = of(spark, [1.0, 2.0], [3.0], [4.0, 5.0])
    p = ragged.to_regular(f, "x").orderBy(ROW).collect()
    assert [len(r.x) for r in p] == [2, 2, 2] and math.isnan(p[1].x[1])
    back = ragged.to_ragged(ragged.to_regular(f, "x"), "x")
    assert values(back.obs, "x") == values(f.obs, "x") and [r.rowsize for r in back.rows.orderBy(ROW).collect()] == [2, 1, 2]


def test_nested_round_trip(small):
    back = RaggedFrame.from_nested(small.describe("lon", units="degrees").to_nested())
    assert values(back.obs, ROW, OBS, "lon", "test") == values(small.obs, ROW, OBS, "lon", "test")
    assert small.describe("lon", units="degrees").attributes("lon") == {"units": "degrees"}


def test_unpack_order(small):
    assert [r.lon for r in ragged.unpack(small, "lon", [2, 1]).collect()] == [[12.0, 22.0, 32.0, 42.0], [103.0, 113.0]]


def test_sample(small):
    a = {r.id for r in ragged.sample_rows(small.rows, 2, 42).collect()}
    assert len(a) == 2 and a == {r.id for r in ragged.sample_rows(small.rows.repartition(3), 2, 42).collect()}
    with pytest.warns(UserWarning):
        assert ragged.sample_rows(small.rows, 9).count() == 3


def test_line_pieces(spark):
    f = frame(spark, [{}], [[{"lon": x, "lat": 0.0} for x in (170.0, 179.0, -179.0, -170.0)]])
    got = lines.pieces(f.obs).orderBy("piece").collect()
    assert [[p.lon for p in r.points] for r in got] == [[170.0, 179.0], [-179.0, -170.0]]
    colors = lines.line_colors(f.obs.withColumn("c", F.col(OBS)), "c").orderBy(OBS).collect()
    assert [r.color for r in colors] == [0.5, 2.5]
