"""Tables that take batches."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tracklake.model import OBS, ROW
from tracklake.sources.growing import Growing

DAY = dt.datetime(2024, 1, 1)
KINDS = "id long, time timestamp, v double, name string"


def batches():
    """Ids of the first only, of the second only and of both, with times that interleave, ties and repeated observations."""
    at = lambda k: DAY + dt.timedelta(hours=k)
    one = [(7, at(k), float(k), None) for k in (0, 4, 8)] + [(i, at(i), 1.0, f"n{i}") for i in range(20, 40)] + [(5, at(3), 2.0, "x"), (5, at(3), 1.0, "x")]
    two = [(7, at(k), float(k), "seven") for k in (2, 6, 8, 9)] + [(3, at(-5), 0.0, "three"), (5, at(3), 1.0, None), (None, at(0), 9.0, None)]
    return one, two


def content(f):
    rows = [tuple(r) for r in f.rows.orderBy(ROW).select(ROW, "id", "rowsize", "name").collect()]
    return rows, [tuple(r) for r in f.obs.orderBy(ROW, OBS).select(ROW, OBS, "time", "v").collect()]


@pytest.fixture
def tables(spark):
    return [spark.createDataFrame(rows, KINDS) for rows in batches()]


def test_either_order_gives_the_table_of_one(spark, tmp_path, tables):
    one, two = tables
    made = []
    for name, parts in (("ab", [one, two]), ("ba", [two, one]), ("all", [one.unionByName(two)])):
        g = Growing(spark, f"file://{tmp_path}/{name}", buckets=8)
        for k, p in enumerate(parts):
            assert g.ingest(f"{k}", p, ["name"])
        made.append(content(g.frame()))
    assert made[0] == made[1] == made[2]
    rows, obs = made[0]
    assert rows[0] == (0, 3, 1, "three") and (7, 7, "seven") in [r[1:] for r in rows] and (5, 3, "x") in [r[1:] for r in rows]
    seven = next(r[0] for r in rows if r[1] == 7)
    assert [o[3] for o in obs if o[0] == seven] == [0.0, 2.0, 4.0, 6.0, 8.0, 8.0, 9.0] and len(obs) == 25 + 6


def test_other_buckets_keep_their_bytes(spark, tmp_path, tables):
    one, two = tables
    g = Growing(spark, f"file://{tmp_path}/g", buckets=8)
    g.ingest("one", one, ["name"])
    files = lambda: {p.relative_to(tmp_path): hashlib.md5(p.read_bytes()).hexdigest() for p in (tmp_path / "g").rglob("*.parquet")}
    before, reader = files(), g.frame()
    seen = reader.obs.count()
    g.ingest("two", two.filter("id = 7"))
    after = files()
    assert all(after[p] == h for p, h in before.items())  # what the reader of the version before is at is there, and the same
    assert {str(p).split("bucket_of_id=")[1][0] for p in set(after) - set(before)} == {str(spark.sql("SELECT pmod(hash(7L), 8)").first()[0])}
    assert reader.obs.count() == seen and g.frame().obs.count() == seen + 4
    numbers = {r.id: r[ROW] for r in spark.read.parquet(*(str(tmp_path / p) for p in before)).select("id", ROW).distinct().collect()}
    g.ingest("three", two.filter("id = 3"))
    now = g.pointer.get()
    stored = spark.read.parquet(*(f"{g.folder}/{v}/bucket_of_id={b}" for b, v in now["at"].items())).select("id", ROW).distinct().collect()
    assert {r.id: r[ROW] for r in stored} == numbers | {3: len(numbers)}  # known ids keep their stored rows, a new one takes the next


def test_repeated_and_failed_batches_change_nothing(spark, tmp_path, tables):
    one, two = tables
    g = Growing(spark, f"file://{tmp_path}/g", buckets=4)
    g.ingest("one", one, ["name"])
    want = content(g.frame())
    assert not g.ingest("one", one) and content(g.frame()) == want
    with pytest.raises(Exception, match="broken"):
        g.ingest("two", two.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v"))))
    assert content(g.frame()) == want
    assert g.ingest("none", two.limit(0)) and content(g.frame()) == want
    assert Growing(spark, g.folder).buckets == 4 and content(Growing(spark, g.folder).frame()) == want


def test_nothing_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        Growing(spark, f"file://{tmp_path}/g").frame()
