import datetime as dt
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import binning

# The published example of coordinates and values.
X = [-0.2, 0.3, 0.6, 0.7, 1.2, 1.3, 1.8, 2.1, 2.7, 2.8, 3.1]
V = [1, 2, 3, 4, 5, 6, 9, 20, 20, 20, 20]


@pytest.fixture(scope="module")
def points(spark):
    day = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(x, v, day + dt.timedelta(days=i)) for i, (x, v) in enumerate(zip(X, V, strict=True))], "x double, v long, day timestamp").cache()


def column(df, name):
    return [r[0] for r in df.orderBy("bin_0").select(name).collect()]


def test_all_statistics(points):
    b = binning.binned_statistics(points, "x", "v", bins=3, ranges=(0, 3), statistics=list(binning.NAMES))
    assert column(b, "v_count") == [3, 3, 3] and column(b, "v_sum") == [9, 20, 60]
    assert column(b, "v_mean") == [3, 20 / 3, 20] and column(b, "v_median") == [3, 6, 20]
    assert np.allclose(column(b, "v_std"), [np.std([2, 3, 4]), np.std([5, 6, 9]), 0])
    assert column(b, "v_min") == [2, 5, 20] and column(b, "v_max") == [4, 9, 20] and column(b, "center_0") == [0.5, 1.5, 2.5]


def test_empty_bins(points):
    b = binning.binned_statistics(points, "x", "v", bins=[-5, -4, 0, 10], statistics=["count", "sum", "mean", "min"])
    assert column(b, "v_count") == [0, 1, 10] and column(b, "v_sum") == [0, 1, 109]
    assert column(b, "v_mean")[0] is None and column(b, "v_min")[0] is None


def test_last_edge(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert column(binning.binned_statistics(df, "x"), "count") == [1] * 9 + [2]
    assert column(binning.binned_statistics(df, "x", last_edge="exclusive"), "count") == [1] * 10
    assert sum(column(binning.binned_statistics(df, "x", bins=[0, 5, 10]), "count")) == 11


def test_edges_are_exact(spark):
    edges = np.linspace(0, 1, 8)
    df = spark.createDataFrame([(float(e), i) for i, e in enumerate(edges)], "x double, i long")
    got = [r[0] for r in df.orderBy("i").select(binning.bin_index(F.col("x"), edges)).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 6]


def test_times(points):
    b = binning.binned_statistics(points, "day", "v", bins=2, statistics="count")
    assert column(b, "v_count") == [5, 6] and column(b, "center_0")[0] == dt.datetime(2020, 1, 3, 12)
    b = binning.binned_statistics(points, "x", "day", bins=1, ranges=(0, 3), statistics=["mean", "min", "std"])
    assert column(b, "day_min") == [dt.datetime(2020, 1, 2)] and isinstance(column(b, "day_std")[0], float)
    with pytest.raises(ValueError):
        binning.binned_statistics(points, "x", "day", statistics="sum")


def test_functions_and_names(points):
    def reach(x):
        return float(x.max() - x.min())

    b = binning.binned_statistics(points, "x", "v", bins=3, ranges=(0, 3), statistics=[reach, lambda x: float(len(x)), partial(reach), "count"])
    assert b.columns[2:] == ["v_count", "v_reach", "v_stat", "v_reach_1"]
    assert column(b, "v_reach") == [2, 4, 0] and column(b, "v_stat") == [3, 3, 3]
    both = binning.binned_statistics(points, "x", ["v", "x"], bins=3, ranges=(0, 3), statistics=[("v,x", lambda vx: float((vx[0] * vx[1]).sum()))])
    assert np.allclose(column(both, "stat"), [2 * 0.3 + 3 * 0.6 + 4 * 0.7, 5 * 1.2 + 6 * 1.3 + 9 * 1.8, 20 * 7.6])


def test_missing_and_infinite(spark):
    df = spark.createDataFrame([(0.5, float("nan")), (0.5, None), (0.5, float("inf")), (0.5, 2.0), (1.5, float("inf"))], "x double, v double")
    b = binning.binned_statistics(df, "x", "v", bins=[0, 1, 2], statistics=["count", "min", "max"])
    assert column(b, "v_count") == [2, 1] and column(b, "v_min") == [2.0, None] and column(b, "v_max") == [float("inf")] * 2
    for bad in (float("nan"), None, float("inf")):
        with pytest.raises(ValueError):
            binning.binned_statistics(spark.createDataFrame([(bad,), (1.0,)], "x double"), "x")


def test_two_dimensions_and_errors(points):
    b = binning.binned_statistics(points, ["x", "v"], bins=[3, 2], ranges=[(0, 3), (0, 30)])
    assert b.count() == 6 and b.agg(F.sum("count")).first()[0] == 9
    for bad in ({"statistics": "mode", "data": "v"}, {"statistics": 3, "data": "v"}, {"statistics": "mean"}):
        with pytest.raises(ValueError):
            binning.binned_statistics(points, "x", **bad)
    with pytest.raises(ValueError):
        binning.binned_statistics(points, ["x", "v"], bins=[3])


def test_one_aggregation_for_all(points):
    b = binning.binned_statistics(points, "x", ["v", "x"], bins=3, statistics=list(binning.NAMES))
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


# ---- medians of crowded cells ----


def crowd(spark, seed=1):
    """A cell with most rows and many ties, one with a single value, even and odd counts, nulls, NaN and infinities."""
    rng = np.random.default_rng(seed)
    rows = [(0.5, float(x)) for x in rng.integers(0, 40, 401)] + [(0.5, None)] * 30 + [(0.5, float("nan"))] * 30
    rows += [(1.5, 7.0)] * 200 + [(2.5, float(x)) for x in rng.normal(size=100)] + [(3.5, x) for x in (1.0, 2.0)] + [(4.5, None), (4.5, float("nan"))] * 40
    rows += [(5.5, x) for x in [float("-inf")] * 30 + [1.0, 2.0] + [float("inf")] * 30] + [(6.5, -0.0), (6.5, 0.0)] * 40
    return rows, spark.createDataFrame(rows, "x double, v double").repartition(5)


@pytest.mark.parametrize("crowd_size", [1, 50, 150, 10**9])
def test_medians_of_cells_of_any_size(spark, monkeypatch, crowd_size):
    monkeypatch.setattr(binning, "CROWD", crowd_size)
    rows, df = crowd(spark)
    got = {r.bin_0: (r.v_count, r.v_median, r.v_max) for r in binning.binned_statistics(df, "x", "v", 8, (0, 8), ["count", "median", "max"]).collect()}
    for cell in range(8):
        real = [v for x, v in rows if x == cell + 0.5 and v is not None and v == v]
        count, median, _ = got[cell]
        assert count == len(real) and median == (float(np.median(real)) if real else None)


def test_medians_of_two_columns_and_times(spark, monkeypatch):
    monkeypatch.setattr(binning, "CROWD", 10)
    df = spark.range(101).selectExpr("id % 2 + 0.5 AS x", "double(id) AS a", "timestamp_seconds(id * 10) AS t", "double(id % 7) AS b")
    got = binning.binned_statistics(df, "x", ["a", "t", "b"], 2, (0, 2), ["median", "mean"]).orderBy("bin_0").collect()
    assert [(r.a_median, r.t_median.timestamp(), r.b_median) for r in got] == [(50.0, 500.0, 3.0), (50.0, 500.0, 3.0)]


def test_medians_by_key_spread_a_group(spark):
    """All rows in one group: the range sort deals its values to several tasks."""
    df = spark.range(20_000).selectExpr("1 AS k", "double(id) AS v")
    assert [tuple(r) for r in binning.medians(df, ["k"], "v", "m").collect()] == [(1, 9999.5)]
    assert binning.medians(df.limit(0), ["k"], "v", "m").collect() == []
