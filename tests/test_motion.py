import math
import re

import duckdb
import numpy as np
import pytest
from frames import frame, values
from pyspark.sql import functions as F

from tracklake.functions import sphere
from tracklake.operators import kinematics, pairs
from tracklake.plans.queries import QUERIES, SQL

DEGREE = math.pi / 180 * sphere.EARTH_RADIUS_METERS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_distance_and_bearing(spark):
    d = one(spark, *(sphere.distance(*p) for p in ((0, 0, 0, 1), (0, 0, 1, 0), (179.5, 0, -179.5, 0), (0, 0, 180, 0))), sphere.distance(F.lit(None).cast("double"), 0, 1, 1))
    assert np.allclose(d[:4], [DEGREE, DEGREE, DEGREE, 180 * DEGREE]) and d[4] is None
    steps = [(0.1, 0), (0.1, 0.1), (0, 0.1), (-0.1, 0.1), (-0.1, 0), (-0.1, -0.1), (0, -0.1), (0.1, -0.1)]
    b = one(spark, *(sphere.bearing(0, 0, x, y) for x, y in steps))
    want = [0, math.pi / 4, math.pi / 2, 3 * math.pi / 4, math.pi, -3 * math.pi / 4, -math.pi / 2, -math.pi / 4]
    assert np.allclose(b, want, atol=1e-5)


def test_step_is_the_inverse_of_distance_and_bearing(spark):
    p = one(spark, sphere.step(10, 40, sphere.distance(10, 40, 12, 43), sphere.bearing(10, 40, 12, 43)))[0]
    assert np.allclose(p, (12, 43))


def test_recast(spark):
    got = one(spark, sphere.recast_lon180(200), sphere.recast_lon180(180), sphere.recast_lon(200, 220.0), sphere.recast_lon360(-10))
    assert tuple(got) == (-160, -180, 560, 350)


def test_space_and_back(spark):
    q = spark.range(1).withColumn("p", sphere.to_cartesian(-170, 45)).select(sphere.to_spherical("p.x", "p.y", "p.z")).first()[0]
    assert np.allclose(q, (-170, 45))
    pole = one(spark, sphere.to_spherical(0, 0, 5), sphere.to_spherical(0, 0, 0))
    assert tuple(pole[0]) == (0, 90) and pole[1].lat is None
    t = spark.range(1).withColumn("c", sphere.from_tangent(3, 4, 20, 30)).select(sphere.to_tangent("c.u", "c.v", "c.w", 20, 30)).first()[0]
    assert np.allclose(t, (3, 4))


def track(spark, lon, lat, time):
    return frame(spark, [{}], [[{"lon": float(x), "lat": float(y), "time": float(t)} for x, y, t in zip(lon, lat, time, strict=True)]])


def test_cumulative_distance(spark):
    o = track(spark, [0, 1, 2], [0, 1, 2], [0, 1, 2]).obs
    assert np.allclose(values(kinematics.cumulative_distance(o), "distance"), [[0], [157424.62387233], [314825.27182116]])


@pytest.mark.parametrize("scheme", ["forward", "backward"])
def test_velocity_and_position_are_inverse(spark, scheme):
    lon, lat, time = np.linspace(-180, 180, 60, endpoint=False), np.linspace(0, 45, 60), np.linspace(0, 1e7, 60)
    o = kinematics.velocity(track(spark, lon, lat, time).obs, scheme=scheme)
    back = kinematics.position(o.drop("lon", "lat"), x0=-180.0, y0=0.0, out=("lon", "lat"), scheme=scheme)
    got = np.array(values(back, "lon", "lat"))
    assert np.allclose(got, np.c_[lon, lat], atol=1e-6)


def test_velocity_of_short_rows_and_bad_names(spark):
    o = track(spark, [1], [2], [3]).obs
    assert values(kinematics.velocity(o), "u", "v") == [(None, None)]
    with pytest.raises(ValueError):
        kinematics.velocity(o, scheme="sideways")
    with pytest.raises(ValueError):
        kinematics.velocity(o, coordinates="polar")


def test_centered_velocity_crosses_the_date_line(spark):
    o = kinematics.velocity(track(spark, [179, -180, -179], [0, 0, 0], [0, 1, 2]).obs, scheme="centered")
    assert np.allclose(values(o, "u"), DEGREE)


def test_spin_of_a_circle(spark):
    t = np.linspace(0, 1, 101)
    f = frame(spark, [{}], [[{"u": math.cos(2 * math.pi * x), "v": math.sin(2 * math.pi * x), "time": float(x)} for x in t]])
    s = np.array(values(kinematics.spin(f.obs, scheme="centered"), "spin"))[1:-1]
    assert np.allclose(s, 2 * math.pi, rtol=1e-2)


def test_plane_and_sphere(spark):
    f = frame(spark, [{}], [[{"x": 1e4 * k, "y": 2e4 * k} for k in range(6)]])
    o = kinematics.sphere_to_plane(kinematics.plane_to_sphere(f.obs), out=("x2", "y2"))
    assert np.allclose(values(o, "x2", "y2"), values(o, "x", "y"), atol=1e-6)


def test_unwrap_is_numpys(spark):
    x = np.cumsum(np.random.default_rng(1).uniform(-170, 170, 200))
    wrapped = (x + 180) % 360 - 180
    o = track(spark, wrapped, wrapped * 0, range(200)).obs
    assert np.allclose(np.array(values(kinematics.unwrap(o, "lon"), "lon")).ravel(), np.unwrap(wrapped, period=360))


def test_steps_of_half_a_circle_in_both_engines(spark, tmp_path):
    at = [190, 10, 10, 190, 190, 10]  # longitudes of -110 and 70: up by half a circle, down by as much, up again
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for k, x in enumerate(at):
        con.execute("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01' + to_seconds(?), 1, 'view', ?, '{\"k\": 3}')", [36_000 * k, k, x])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    mine = QUERIES["unwrap_lon"](spark, str(tmp_path)).orderBy("obs_idx").toPandas().lon
    theirs = con.execute(f"SELECT lon FROM ({SQL['unwrap_lon']}) ORDER BY obs_idx").df().lon
    assert np.allclose(mine, theirs) and np.allclose(mine, np.unwrap([-110, 70, 70, -110, -110, 70], period=360))


@pytest.mark.parametrize("meters, gap", [(300e3, 2.0), (2000e3, None), (9000e3, 0.0), (21000e3, 1.0)])
def test_pairs_are_those_of_brute_force(spark, meters, gap):
    rng = np.random.default_rng(7)
    data = [[{"lon": float(rng.uniform(-180, 180)), "lat": float(rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), -89.9])), "time": float(rng.integers(0, 6))} for _ in range(12)] for _ in range(8)]
    f = frame(spark, [{}] * 8, data)
    got = {tuple(r) for r in pairs.chance_pairs(f.obs, meters, gap).select("row_1", "row_2", "obs_1", "obs_2").collect()}

    def far(p, q):
        a, b, c, d = map(math.radians, (p["lon"], p["lat"], q["lon"], q["lat"]))
        h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
        return 2 * sphere.EARTH_RADIUS_METERS * math.asin(min(1, math.sqrt(h)))

    want = {(i, j, k, m) for i in range(8) for j in range(i + 1, 8) for k, p in enumerate(data[i]) for m, q in enumerate(data[j]) if far(p, q) <= meters and (gap is None or abs(p["time"] - q["time"]) <= gap)}
    assert got == want and pairs.chance_pairs(f.obs, meters, gap).count() == len(want)


def test_grouped_pairs_carry_only_what_is_asked_for(spark):
    f = frame(spark, [{}] * 2, [[{"lon": 1.0, "lat": 2.0, "time": k} for k in range(2)]] * 2)
    p = pairs.chance_pairs(f.obs, 1.0, 0.0)
    assert [tuple(map(tuple, r.pairs)) for r in pairs.grouped(p, "obs_1", "obs_2").collect()] == [((0, 0), (1, 1))]
    assert len(pairs.grouped(p).first().pairs[0]) == 4


def test_overlaps(spark):
    f = frame(spark, [{}, {}], [[{"lon": float(k), "lat": float(k), "time": k} for k in range(4)], [{"lon": float(k), "lat": float(k), "time": k} for k in range(2, 6)]])
    a, b = f.obs.filter("row_idx = 0"), f.obs.filter("row_idx = 1")
    places = lambda pair: [[r[0] for r in values(d, "obs_idx")] for d in pair]
    assert places(pairs.time_overlap(a, b)) == [[2, 3], [0, 1]]
    assert places(pairs.box_overlap(a, b)) == [[2, 3], [0, 1]]
    assert places(pairs.box_overlap(a, b, 1.0)) == [[1, 2, 3], [0, 1, 2]]
    assert pairs.overlap_pairs(f.obs, "time").collect() == [(0, 1)]


def test_pair_join_plan_has_no_nested_loop(spark):
    f = track(spark, [1], [2], [3])
    plan = pairs.chance_pairs(f.obs, 1000.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan


def test_observations_of_pairs_have_few_records(spark):
    cells = pairs.Cells(300e3)
    o = spark.range(2000).select((F.rand(1) * 360 - 180).alias("x"), (F.degrees(F.asin(F.rand(2) * 2 - 1))).alias("y"))
    n = o.agg(F.avg(F.size(cells.near(F.col("x"), F.col("y"))))).first()[0]
    assert n < 5  # nine with cells as wide as the distance


def test_time_of_spherical_positions_grows_with_the_row(spark):
    """A row of 400,000 fixes is walked in seconds, and twice as many take about twice as long."""
    import time

    from pyspark.sql import functions as F

    def took(n):
        o = spark.range(n).select(F.lit(0).cast("long").alias("row_idx"), F.col("id").alias("obs_idx"), (F.col("id") * 3600.0).alias("time"), F.lit(0.3).alias("u"), F.lit(-0.1).alias("v"))
        start = time.time()
        kinematics.position(o, out=("lon", "lat")).write.format("noop").mode("overwrite").save()
        return time.time() - start

    took(1000)
    assert took(400_000) < 3 * took(200_000) + 3 < 60


def test_pairs_of_a_crowded_cell(spark, monkeypatch):
    """A cell with more observations than one task takes: the same pairs."""
    rows = [(i % 9, i // 9, 10.0 + (i % 13) * 1e-4, 45.0 + (i % 7) * 1e-4, float(i % 5)) for i in range(180)]
    o = spark.createDataFrame(rows, "row_idx long, obs_idx long, lon double, lat double, time double")
    find = lambda: sorted(map(tuple, pairs.chance_pairs(o, 60.0, 1.0).collect()))
    want = find()
    monkeypatch.setattr(pairs, "CROWD", 20)
    assert want and find() == want


def test_rows_walked_side_by_side():
    """Runs of many lengths, one of which goes on from the batch before, give what each gives alone; NaN ends its own row only."""

    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 9, 40), 200, 150, 1, 90]
    rng.shuffle(sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    turn, arc = rng.uniform(-3, 3, len(rows)), rng.uniform(0, 0.2, len(rows))
    broken = np.flatnonzero(rows == 7)[0]
    arc[broken] = np.nan
    steps = np.cos(turn), np.sin(turn), np.sin(arc), np.cos(arc)
    lons, lats = kinematics._side_by_side(rows, *steps, (0.1, 0.2), (1.0, -0.5))
    for r in range(len(sizes)):
        mine = rows == r
        alone = kinematics._side_by_side(rows[mine], *(x[mine] for x in steps), (0.1, 0.2), (1.0, -0.5) if r == 0 else (0.1, 0.2))
        assert np.allclose(lons[mine], alone[0], equal_nan=True, atol=1e-9) and np.allclose(lats[mine], alone[1], equal_nan=True, atol=1e-9)
        assert np.isnan(lats[mine]).any() == (r == 7)


def test_pairs_work_out_few_distances(spark):
    """a box around the first keeps most candidates from any sine, a distance is worked out once, and nothing is lost by either."""
    rng = np.random.default_rng(11)
    data = [[{"lon": float(rng.choice([rng.uniform(-180, 180), -180, 179.9, 540.0, -0.05])), "lat": float(rng.choice([rng.uniform(-90, 90), 86.5, -87, 90.0])), "time": 0.0} for _ in range(30)] for _ in range(6)]
    f = frame(spark, [{}] * 6, data)
    for meters in (150e3, 400e3, 15000e3):
        p = pairs.chance_pairs(f.obs, meters, 5.0)
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Join Inner")]
        assert above.count("Generate explode") == 1 and not re.search(r"\bSIN\(", above[: above.index("Generate explode")])
        assert "wide_1" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]  # the box is part of the join's condition
        got = {tuple(r) for r in p.select("row_1", "row_2", "obs_1", "obs_2").collect()}

        def far(p, q):
            a, b, c, d = map(math.radians, (p["lon"], p["lat"], q["lon"], q["lat"]))
            return 2 * sphere.EARTH_RADIUS_METERS * math.asin(min(1, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))

        assert got == {(i, j, k, m) for i in range(6) for j in range(i + 1, 6) for k, p in enumerate(data[i]) for m, q in enumerate(data[j]) if far(p, q) <= meters}


def test_numbers_of_many_pairs_are_rounded_as_sql_does(spark):
    """half away from zero, by a product, as DuckDB rounds."""
    from tracklake.plans.queries import positive

    x = [0.0, 0.05, 0.15, 0.25, 0.35, 1.05, 2.675, 1e-9, 0.04999999999999999, 0.049999999999999996, 123456.75, 123456.65, 1999999.95, 7199.9999995]
    got = [(r.a, r.b) for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(positive("x", 1).alias("a"), positive("x", 6).alias("b")).collect()]
    assert got == [duckdb.execute(f"SELECT round({v!r}::DOUBLE, 1), round({v!r}::DOUBLE, 6)").fetchone() for v in x]
