"""Many files into one ragged frame, nested Parquet, and a catalog of built tables."""

from __future__ import annotations

import io
import json
import uuid
import warnings
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..model import OBS, ROW, RaggedFrame
from ..operators.ragged import ranked
from ..scratch import materialize
from .pointer import Pointer


def from_files(
    spark: SparkSession,
    indices: Sequence,
    read: Callable[[object], pd.DataFrame],
    schema: T.StructType,
    coords: Sequence[str],
    meta: Sequence[str],
    data: Sequence[str],
    attrs: dict[str, str] | None = None,
    unreadable: str = "empty",
) -> RaggedFrame:
    """A row for each index, in their order: ``read(index)`` gives its observations.

    Executors read the files, each once, under a declared schema. Row-level columns (``meta`` and
    coordinates of the row) take their first value. Wanted columns that the schema lacks are
    named in a warning and left out. A file that cannot be read gives an empty row, whose
    ``read_error`` says why, or fails the read (``unreadable="raise"``).
    """
    if unreadable not in ("empty", "raise"):
        raise ValueError("unreadable must be empty or raise")
    absent = [c for c in (*coords, *meta, *data) if c not in schema.names and c != "rowsize"]
    if absent:
        warnings.warn(f"not found: {', '.join(absent)}", stacklevel=2)
    wanted = T.StructType([f for f in schema.fields if f.name in {*coords, *meta, *data}])
    full = T.StructType([T.StructField(ROW, T.LongType()), T.StructField(OBS, T.LongType()), T.StructField("read_error", T.StringType()), *wanted.fields])
    items = list(indices)
    work = spark.createDataFrame([(i,) for i in range(len(items))], f"{ROW} long").repartition(max(1, min(len(items), 1000)), ROW)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame[ROW]:
                try:
                    pdf = read(items[i])
                except (OSError, ValueError) as e:
                    if unreadable == "raise":
                        raise
                    yield pd.DataFrame({ROW: [i], "read_error": [f"{items[i]}: {e}"]}).reindex(columns=full.names).astype({OBS: "Int64"})
                    continue
                pdf = pdf.reindex(columns=wanted.names).reset_index(drop=True)
                pdf.insert(0, "read_error", None)
                pdf.insert(0, OBS, range(len(pdf)))
                pdf.insert(0, ROW, i)
                yield pdf

    read_ = materialize(work.mapInPandas(run, full), "files")  # each file is read once
    errors, obs = read_.filter(F.col(OBS).isNull()).select(ROW, "read_error"), read_.filter(F.col(OBS).isNotNull()).drop("read_error")
    held = [c for c in (*coords, *meta) if c in wanted.names and c not in data and c not in ("time",)]
    rows = obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("rowsize"), *(F.min_by(c, OBS).alias(c) for c in held))
    rows = work.join(rows, ROW, "left").withColumn("rowsize", F.coalesce("rowsize", F.lit(0))).join(errors, ROW, "left")
    return RaggedFrame(rows, obs.drop(*held), attrs or {})


def from_dataframes(rows: DataFrame, obs: DataFrame, attrs: dict[str, str] | None = None) -> RaggedFrame:
    """From the two tables; each column's role is the table that it stands in."""
    for name, df, keys in (("rows", rows, (ROW,)), ("obs", obs, (ROW, OBS))):
        for k in keys:
            if k not in df.columns:
                raise ValueError(f"{name} has no {k}")
    frame = RaggedFrame(rows, obs, attrs or {})
    return frame if "rowsize" in rows.columns else frame.recounted()


def write_nested(frame: RaggedFrame, path: str) -> None:
    """One record a row with nested observations, as Parquet; global attributes beside it as JSON.

    Column attributes travel as field metadata of a flat schema, which is kept with them.
    """
    frame.to_nested().write.mode("overwrite").parquet(path)
    spark = frame.rows.sparkSession
    side = {"attrs": frame.attrs, "columns": {f.name: f.metadata for df in (frame.rows, frame.obs) for f in df.schema.fields if f.metadata}}
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_attrs")


def read_nested(spark: SparkSession, path: str) -> RaggedFrame:
    """The frame that ``write_nested`` wrote, with its attributes and those of its columns; rows without observations have none."""
    frame = RaggedFrame.from_nested(spark.read.parquet(path))
    side = json.loads(spark.read.text(f"{path.rstrip('/')}_attrs").first()[0])
    for column, attributes in side["columns"].items():
        frame = frame.describe(column, **attributes)
    return RaggedFrame(frame.rows, frame.obs, side["attrs"])


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block, at): lines of text files (gz too) with their place in the file, from 0.

    Spark reads a file in blocks, in any order. A block's lines are counted first, a row a block;
    a line's place is the lines of the blocks before and its own in the block.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__id"))
    blocks = raw.groupBy("file", "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "blocks")
    few = F.broadcast if blocks.count() <= 100_000 else (lambda d: d)
    return raw.join(few(blocks), ["file", "block"]).select("value", "file", "block", (F.col("__before") + F.col("__id") - F.col("__first")).alias("at"))


def zipped_lines(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """The same for a member of a ZIP file; a member is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.namelist() if m.endswith(ending)]
                    if not members:
                        raise FileNotFoundError(f"no {ending} in {name}")
                    with z.open(members[0]) as f:
                        text = io.TextIOWrapper(f, "utf-8", "replace").read().splitlines()
                yield pd.DataFrame({"value": text, "file": name, "block": 0, "at": range(len(text))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "value string, file string, block long, at long")


def fields(df: DataFrame, names: Sequence[str], pattern: str = r"\s+") -> DataFrame:
    """Split ``value`` into string columns; missing ones at the end are null. A generator splits a line once, whatever filters ask of its parts."""
    held = [c for c in df.columns if c != "value"]
    parts = df.select(*held, F.explode(F.array(F.split(F.trim("value"), pattern))).alias("__p"))
    return parts.select(*held, *(F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(names)))


def number_rows(df: DataFrame, key: str, order: Sequence[str]) -> RaggedFrame:
    """Rows by a string or number key in its order, observations by ``order``: indices are ranks.

    Records without a key are left out.
    """
    keys = ranked(df.select(key).distinct().filter(F.col(key).isNotNull()), key)
    obs = df.join(keys, key).withColumn(OBS, F.row_number().over(Window.partitionBy(ROW).orderBy(*order)).cast("long") - 1)
    rows = obs.groupBy(ROW).agg(F.first(key).alias(key), F.count(F.lit(1)).alias("rowsize"))
    return RaggedFrame(rows, obs.drop(key))


class Catalog:
    """Ragged tables that are built once and then read: Parquet under a folder, by name.

    Rows and observations are stored by buckets of ``row_idx``, sorted, a file a bucket. Windows along
    rows, segments, joins and reductions by row over a stored table therefore move nothing between
    tasks. Each ``put`` writes a version of its own; a pointer file, replaced in one step, says which
    one counts. The version before stays for readers that are at it, older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def get(self, name: str, build: Callable[[], RaggedFrame], needs: Sequence[str] = (), force: bool = False) -> RaggedFrame:
        """The stored frame; built if absent, without a needed column, or ``force``. Tables that cannot be read raise."""
        known = None if force else self._pointer(name).get()
        if known is None or set(needs) - {c for part in known["columns"].values() for c in part}:
            self.put(name, build())
            known = self._pointer(name).get()
        frame = RaggedFrame(self._table(name, known, "rows"), self._table(name, known, "obs"), known["attrs"])
        for column, attributes in known["described"].items():
            frame = frame.describe(column, **attributes)
        return frame

    def put(self, name: str, frame: RaggedFrame) -> None:
        """Write a version and point to it; until then readers get the one before."""
        pointer = self._pointer(name)
        before = pointer.get() or {}
        version = uuid.uuid4().hex[:12]
        known = {"version": version, "before": before.get("version"), "buckets": self.buckets, "attrs": frame.attrs, "columns": {}, "ddl": {}}
        known["described"] = {f.name: f.metadata for df in (frame.rows, frame.obs) for f in df.schema.fields if f.metadata}
        for part, df, keys in (("rows", frame.rows, [ROW]), ("obs", frame.obs, [ROW, OBS])):
            where = f"{self.path(name)}/{version}/{part}"
            df = df.withColumns({c: F.col(c).cast("long") for c in keys})
            # rows are dealt to tasks as they are to buckets, so a bucket is one file
            df.repartition(self.buckets, ROW).sortWithinPartitions(*keys).write.format("parquet").bucketBy(self.buckets, ROW).sortBy(*keys).option("path", where).saveAsTable(self._named(name, version, part))
            known["columns"][part], known["ddl"][part] = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        pointer.put(known)
        if before.get("before"):
            for part in ("rows", "obs"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._named(name, before['before'], part)}")
            pointer.delete([f"{self.path(name)}/{before['before']}"])

    def _pointer(self, name: str) -> Pointer:
        return Pointer(self.spark, f"{self.path(name)}/current.json")

    def _named(self, name: str, version: str, part: str) -> str:
        return f"`ragged_{''.join(c if c.isalnum() else '_' for c in name)}_{version}_{part}`"

    def _table(self, name: str, known: dict, part: str) -> DataFrame:
        """A version's table, made known to this session if another one wrote it."""
        table = self._named(name, known["version"], part)
        keys = f"{ROW}, {OBS}" if part == "obs" else ROW
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({known['ddl'][part]}) USING parquet CLUSTERED BY ({ROW}) SORTED BY ({keys}) INTO {known['buckets']} BUCKETS LOCATION '{self.path(name)}/{known['version']}/{part}'")
        return self.spark.table(table)
