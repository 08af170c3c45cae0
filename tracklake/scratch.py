"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder, as a URI, that the driver and all executors see: below ``spark.checkpoint.dir``.

    Where that setting is absent a local master takes a folder of its machine; any other raises.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own.get(sc.applicationId)
        if not top:
            top = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracklake-")
            sc.setCheckpointDir(top)
    if "://" not in top and top.startswith("/"):
        top = f"file://{top}" if str(sc._jsc.hadoopConfiguration().get("fs.defaultFS")).startswith("file:") else top
    return f"{top.rstrip('/')}/tracklake-{sc.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; it goes when the application ends."""
    top = shared_dir(spark)
    if top not in _own:
        _own[top] = ""
        atexit.register(_drop, spark, top)
    return f"{top}/{label}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already; the folder is the cluster's scratch space
        return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage at a copy that outlives any executor and later stages read only the
    columns they need.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files as they end, not when the driver collects its garbage; the setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, so that a long session does not fill the shared folder."""
    for df in tables:
        _drop(df.sparkSession, df._scratch_path)
