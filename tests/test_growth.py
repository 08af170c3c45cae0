"""Work that grows with the input alone: plans, shuffles and memory of queries on larger tables."""

import datetime as dt

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklake.model import ROW, RaggedFrame
from tracklake.operators import intervals, pairs
from tracklake.plans import more
from tracklake.plans.queries import QUERIES, SQL, _text
from tracklake.sources import files, grids, providers

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrices_of_two_rows(spark):
    """F8: a filter on rows passes below the numbering of observations, and no product of partitions is planned."""
    df = spark.range(4000).select((F.col("id") % 40).alias("user_id"), (F.col("id") % 7 * 1.0).alias("lon"), (F.col("id") % 5 * 1.0).alias("lat"), (F.col("id") * 1.0).alias("time"))
    obs = RaggedFrame.from_long(df, "user_id", ["time"]).obs
    a, b = obs.filter("row_idx = 1"), obs.filter("row_idx = 2")
    text = plan(a)
    assert text.index("Window") < text.index("Filter")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = pairs.distance_matrix(a, b)
        assert "CartesianProduct" not in plan(both) and "NestedLoop" not in plan(both)
        got = {(r.obs_1, r.obs_2): (r.space, r.gap) for r in both.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == both.count() == 100 * 100
    assert all(g == abs(40 * (i - j) - 1) for (i, j), (_, g) in got.items())
    assert {(r.obs_1, r.obs_2): r.space for r in pairs.space_matrix(a, b).collect()} == {k: s for k, (s, _) in got.items()}
    assert {(r.obs_1, r.obs_2): r.gap for r in pairs.time_matrix(a, b).collect()} == {k: g for k, (_, g) in got.items()}


def test_crowded_buckets_have_few_parts(spark, monkeypatch):
    """probes go to a bounded number of parts, equal spans to several, and tasks do not follow the few bytes."""
    monkeypatch.setattr(intervals, "CROWD", 10)
    monkeypatch.setattr(intervals, "PARTS", 4)
    a, b = (spark.range(300).select(F.col("id").alias(f"id_{k}"), F.lit(5.0).alias(f"low_{k}"), F.lit(6.0).alias(f"high_{k}")) for k in (1, 2))
    index = intervals.indexed(a, "low_1", "high_1", 0)
    assert intervals._crowds(index).agg(F.max("interval_parts")).first()[0] == 4
    assert index.select(intervals.spread(index, F.lit(4))).distinct().count() == 4
    got = intervals.overlap_join(a, b, ("low_1", "high_1"), ("low_2", "high_2"), F.col("id_1") < F.col("id_2"))
    assert plan(got).count("REPARTITION_BY_NUM") >= 2
    assert sorted((r.id_1, r.id_2) for r in got.collect()) == [(i, j) for i in range(300) for j in range(i + 1, 300)]


def test_combinations_without_a_product(spark):
    """rows of any ids, each two once, by an equality of parts."""
    ids = sorted({(i * i * 7919) % 10_007 - 500 for i in range(1500)})  # more than one part
    got = pairs.combinations(spark.createDataFrame([(i,) for i in reversed(ids)], "row_idx long"))
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    assert got.count() == got.distinct().count() == len(ids) * (len(ids) - 1) // 2
    assert got.filter("row_1 >= row_2").count() == 0 and {r.row_1 for r in got.select("row_1").distinct().collect()} == set(ids[:-1])
    assert pairs.combinations(spark.createDataFrame([], "row_idx long")).count() == 0


def test_matlab_files_are_bounded(spark, monkeypatch):
    """more observations go to more files, not to longer ones, with the same rows."""
    seen, read = [], providers.subsurface_mat
    monkeypatch.setattr(providers, "subsurface_mat", lambda s, paths: seen.append(paths) or read(s, paths))
    whole = sorted(map(repr, QUERIES["subsurface_file"](spark, SF).collect()))
    monkeypatch.setattr(more, "MAT_OBS", 40)
    assert sorted(map(repr, QUERIES["subsurface_file"](spark, SF).collect())) == whole
    assert len(seen[0]) == 4 and len(seen[1]) > 12


def test_raw_files_are_read_twice(spark, tmp_path, monkeypatch):
    """files are opened to count their lines and to parse them; a line is split once, and only if it is asked for."""
    folder = tmp_path / "raw"
    folder.mkdir()
    for i in range(6):
        (folder / f"x_{i}.dat").write_text("\n".join(f"{i} 1 {1 + k % 28}.25 2024 10.0 20.0 1 2.5 2024 " + " ".join(["1.0"] * 7) for k in range(40)))
    meta = spark.createDataFrame([], ", ".join(f"{c} {'timestamp' if 'date' in c else 'long' if c == 'ID' else 'string'}" for c in providers.DIRECTORY))
    written = []
    keep = providers.materialize
    monkeypatch.setattr(providers, "materialize", lambda df, label: written.append(plan(df)) or keep(df, label))
    g = providers.gdp_source(spark, str(folder), meta, use_fill_values=True, max_lines=10)
    assert len(written) == 1 and written[0].count("FileScan text") == 1
    assert all("FileScan text" not in plan(df) for df in (g.rows, g.obs))
    assert written[0].count("split(") == 1 and written[0].index("Generate") < written[0].index("Join")
    assert {(r.id, r.rowsize) for r in g.rows.collect()} == {(i, 10) for i in range(6)}
    assert sorted(r.obs_index for r in g.obs.collect()) == sorted(6 * list(range(10)))


def test_fields_of_missing_lines(spark):
    df = spark.createDataFrame([("a  b",), (None,), ("",)], "value string")
    assert [tuple(r) for r in files.fields(df, ["p", "q"]).collect()] == [("a", "b"), (None, None), ("", None)]


def test_small_array_files_share_tasks(spark, tmp_path, monkeypatch):
    """tasks that write, survey and read files follow cores and observations, not the number of files."""
    n, cores = 300, spark.sparkContext.defaultParallelism
    rows = spark.range(n).select(F.col("id").alias("row_idx"), F.lit(3).cast("long").alias("rowsize"))
    obs = spark.range(3 * n).select(F.expr("id div 3").alias("row_idx"), (F.col("id") % 3).alias("obs_idx"), F.col("id").alias("v"))
    paths = grids.write_netcdf(RaggedFrame(rows, obs), f"file://{tmp_path}/nc", rows_in_file=2)
    assert n // 2 <= len(paths) <= n // 2 + 4 * cores
    f = grids.read_netcdf(spark, paths)
    for df in (f.rows, f.obs):
        assert cores <= df.rdd.getNumPartitions() <= 6 * cores
    assert [(r.row_idx, r.obs_idx, r.v) for r in f.obs.orderBy("v").collect()] == [(i // 3, i % 3, i) for i in range(3 * n)]
    assert [(r.row_idx, r.rowsize) for r in f.rows.orderBy("row_idx").collect()] == [(i, 3) for i in range(n)]
    monkeypatch.setattr(grids, "MOST_TASKS", 10)  # in this process; Spark plans in another
    bare = grids.ArrayFiles({"path": f"file://{tmp_path}/nc"})
    reader = bare.reader(bare.schema())
    parts = reader.partitions()
    assert len(parts) <= 10
    assert sorted(v for p in parts for batch in reader.read(p) for v in batch.to_pydict()["v"]) == list(range(3 * n))


def test_lines_of_a_row_stay_together(spark, monkeypatch):
    """lines of a union whose sides are dealt by row already are still one file's run for each row."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1b")  # the larger side keeps its partitions, as it does at 0.1 GB
    floor = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    least = spark.conf.get(floor)
    spark.conf.set(floor, "2kb")
    try:
        obs = spark.range(20_000).select((F.col("id") % 100).alias(ROW), F.col("id").alias("at"), F.lit("x" * 40).alias("value"))
        obs = obs.withColumn("at", F.row_number().over(Window.partitionBy(ROW).orderBy("at")))
        head = obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).select(ROW, F.lit(0).alias("at"), F.lit("head").alias("value"))
        path = _text(head.unionByName(obs), "together")
    finally:
        spark.conf.set(size, before)
        spark.conf.set(floor, least)
    texts = [r.value.split("\n")[:-1] for r in spark.read.text(path, wholetext=True).collect()]
    for text in texts:
        heads = [i for i, line in enumerate(text) if line == "head"]
        assert heads == list(range(0, len(text), 201))
    assert sum(map(len, texts)) == 20_100


def test_values_that_are_the_mean(spark, tmp_path):
    """the mean is rounded as SQL's, so a value that is the mean itself falls on the same side; values that are missing don't count."""
    x = [round(0.1 * (7 * i % 23) + 0.03, 2) for i in range(40)]
    tied = []
    for user in range(400):  # the mean of each user's values is one of them, but for rounding
        values = [x[(i * (user % 7 + 1) + user) % 40] for i in range(20 + user % 19)]
        total, n = round(sum(values), 2), len(values)
        tied += [(user, v) for v in [*values, round(total / n, 2), round(round(total / n, 2) * (n + 1) - total, 2)]]
    tied += [(400, None), (401, 1.0), (401, None), (401, 2.0)]
    day = dt.datetime(2024, 1, 1)
    events = pd.DataFrame([(i, day + dt.timedelta(seconds=i), u, "click", v, '{"k": 5}') for i, (u, v) in enumerate(tied)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    with duckdb.connect() as con:
        con.execute("SET threads = 1")
        con.execute(f"COPY (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, props FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW stored AS SELECT * FROM '{tmp_path}/events.parquet'")
        theirs = con.execute(SQL["subset_whole_rows"].replace("FROM events", "FROM stored")).fetchall()
    mine = [tuple(r) for r in QUERIES["subset_whole_rows"](spark, str(tmp_path)).collect()]
    assert sorted(mine) == sorted(theirs)


def test_crowded_pairs_of_intervals_cost_little(spark, monkeypatch):
    """what a pair's bucket is, is known by record; parts are ranges, and a probe goes to those alone that have later rows."""
    monkeypatch.setattr(intervals, "CROWD", 10)
    monkeypatch.setattr(intervals, "PARTS", 4)
    ends = [(7 * i % 300, 5.0 + i % 3 * 0.5, 6.0 + i % 50 * 0.1) for i in range(300)]
    a, b = (spark.createDataFrame(ends, f"id_{k} long, low_{k} double, high_{k} double") for k in (1, 2))
    want = sorted((x[0], y[0]) for x in ends for y in ends if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2])
    for most in (50_000, 20):  # the second: more parts than ranges
        monkeypatch.setattr(intervals, "MOST", most)
        got = intervals.overlap_join(a, b, ("low_1", "high_1"), ("low_2", "high_2"), ascending=("id_1", "id_2"))
        conditions = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "_begins" in line]
        assert conditions and not any("POWER" in line.upper() for line in conditions)
        assert sorted((r.id_1, r.id_2) for r in got.collect()) == want
    index = intervals.indexed(a, "low_1", "high_1", 0)
    assert max(len(r.interval_bounds) for r in intervals._crowds(index, "id_1").collect()) == 3


def test_times_of_rows_are_probed_once(spark, monkeypatch):
    """of two rows the earlier alone looks for the later one, so that a probe has half of the copies."""
    monkeypatch.setattr(intervals, "CROWD", 10)
    seen, beside = [], intervals.beside
    monkeypatch.setattr(intervals, "beside", lambda packed, probes, keys: seen.append(probes.count()) or beside(packed, probes, keys))
    obs = spark.range(4000).select((F.col("id") % 2000).alias("row_idx"), F.floor(F.col("id") / 2000).alias("obs_idx"), (F.col("id") * 0.001).alias("t"))
    assert pairs.overlap_pairs(obs, "t", 1.0).count() == 2000 * 1999 // 2
    assert 0 < sum(seen) < 0.6 * 2000 * intervals.PARTS * 2  # a record for each part, in one or two buckets


def test_parts_of_combinations_are_short_and_whole_eights(spark, monkeypatch):
    """F8: a written result repeats part by part, so parts are short, and of whole bytes in a packed column."""
    seen, beside = [], pairs.beside
    monkeypatch.setattr(pairs, "beside", lambda packed, each, keys: seen.append(packed) or beside(packed, each, keys))
    pairs.combinations(spark.range(70_000).select(F.col("id").alias("row_idx")))
    assert seen[0].agg(F.max(F.size("ids"))).first()[0] == 1000
    monkeypatch.setattr(pairs, "COMBINED", 3)
    got = pairs.combinations(spark.range(3_031).select((F.col("id") * 3 - 50).alias("row_idx")))
    assert {r[0] for r in seen[1].select(F.size("ids")).distinct().collect()} == {1016, 999}
    assert got.count() == got.distinct().count() == 3_031 * 3_030 // 2 and got.filter("row_1 >= row_2").count() == 0
