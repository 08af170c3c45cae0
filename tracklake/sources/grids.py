"""Ragged data in array files: NetCDF classic files and Zarr folders, read and written by tasks a slice or a chunk at a time.

Both hold a ``rowsize`` for each row, columns of rows and columns of observations, told apart by
their dimension. Files lie in a store that executors reach by its URI.
"""

from __future__ import annotations

import json
import math
import uuid
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from ..model import OBS, ROW, RaggedFrame
from ..operators.ragged import offsets, ranked, running_total
from ..scratch import discard, materialize
from . import blosc
from .classic import TYPES, Header, column, decoded, file_bytes, type_of, widest

#: Spark's column types.
SPARK = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
BATCH = 1 << 16  # observations that go to Spark at a time
SLICE = 1 << 20  # observations that a task reads at a time
FILES_AT_ONCE = 64  # headers that a task reads
MOST_TASKS = 1000  # tasks that read files without a survey


def store(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ---- NetCDF classic ----


def _tasks(spark: SparkSession, n: int) -> int:
    """How many tasks look into ``n`` files: their names are few bytes, by which Spark would take one."""
    return max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // FILES_AT_ONCE))))


def survey(spark: SparkSession, paths: list[str], rows_dim: str = "rows", obs_dim: str = "obs") -> DataFrame:
    """What is in each file, written: its place, counts, columns with types and attributes, ranges. Headers are read by tasks."""

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, path in zip(frame["file"], frame["path"], strict=True):
                system, at = store(path)
                with system.open_input_file(at) as f:
                    h = Header(f, f.size())
                columns = {role: {n: [v.type, v.attrs] for n, v in h.along(dim).items()} for role, dim in (("rows", rows_dim), ("obs", obs_dim))}
                if "rowsize" not in columns["rows"]:
                    raise ValueError(f"{path}: no rowsize along {rows_dim}")
                ranges = {n: v.attrs["actual_range"] for n, v in h.along(obs_dim).items() if len(v.attrs.get("actual_range", ())) == 2}
                yield pd.DataFrame({"file": [file], "path": [path], "n_rows": [h.dims[rows_dim]], "n_obs": [h.dims.get(obs_dim, 0)], "columns": [json.dumps(columns)], "ranges": [json.dumps(ranges)], "attrs": [json.dumps(h.attrs)]})

    listed = spark.createDataFrame(list(enumerate(paths)), "file long, path string").repartition(_tasks(spark, len(paths)), "file")
    return materialize(listed.mapInPandas(heads, "file long, path string, n_rows long, n_obs long, columns string, ranges string, attrs string"), "headers")


def _columns(files: DataFrame) -> dict[str, dict[str, tuple[str, dict]]]:
    """By role and name, the one type of a column over all files, and its attributes in the first file that has it."""
    parsed = F.from_json("columns", "rows map<string, string>, obs map<string, string>")
    each = files.select("file", F.posexplode(F.array(F.map_entries(parsed["rows"]), F.map_entries(parsed["obs"]))).alias("role", "c")).select("file", "role", F.explode("c").alias("c")).select("file", "role", "c.*")
    kind = F.from_json("value", "array<string>")[0]
    # as many rows come to the driver as there are names and types of columns, however many files
    found = each.groupBy("role", "key").agg(F.collect_set(kind).alias("kinds"), F.min_by("value", "file").alias("value"), F.min("file").alias("file")).orderBy("role", "file", "key").collect()
    out: dict = {"rows": {}, "obs": {}}
    for r in found:
        out["rows" if r.role == 0 else "obs"][r.key] = (widest(r.kinds), json.loads(r.value)[1])
    return out


def _pieces(files: DataFrame, rows_dim: str) -> DataFrame:
    """Stretches of observations, ``SLICE`` long at most, with the rows they belong to: (file, path, base, a, b, first, last, skip).

    Row counts are read by tasks, a slice of rows each; a row longer than a stretch is in several.
    """
    cut = SLICE
    based = running_total(files.select("file", "path", "n_rows", "ranges"), "file", "n_rows", "base")
    slices = based.filter("n_rows > 0").select("file", "path", "base", "ranges", "n_rows", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1, F.lit(cut))).alias("row"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, path, base, ranges, n_rows, row in frame.itertuples(index=False):
                sizes = _row_sizes(path, row, min(row + cut, n_rows))
                ends = np.cumsum(sizes)
                total, begin = int(ends[-1]), 0
                starts = list(range(0, total, cut))
                firsts = np.searchsorted(ends, starts, "right")
                lasts = np.searchsorted(ends, [min(x + cut, total) - 1 for x in starts], "right")
                skips = [x - int(ends[i] - sizes[i]) for x, i in zip(starts, firsts, strict=True)]
                yield pd.DataFrame({"file": file, "path": path, "base": base, "ranges": ranges, "row": row, "total": total, "a": [begin, *starts], "b": [begin, *(min(x + cut, total) for x in starts)], "first": [-1, *(firsts + row)], "last": [-1, *(lasts + row)], "skip": [0, *skips]})

    walked = materialize(slices.repartition(_tasks(files.sparkSession, slices.count()), "file", "row").mapInPandas(walk, "file long, path string, base long, ranges string, row long, total long, a long, b long, first long, last long, skip long"), "pieces")
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    shift = walked.filter("first < 0").select("file", "row", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    pieces = walked.filter("first >= 0").join(shift, ["file", "row"])
    return pieces.select("file", "path", "base", "ranges", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"), "first", "last", "skip")


def _row_sizes(path: str, a: int, b: int) -> np.ndarray:
    system, at = store(path)
    with system.open_input_file(at) as f:
        h = Header(f, f.size())
        return np.frombuffer(h.read(["rowsize"], a, b)["rowsize"], h.variables["rowsize"].kind).astype(np.int64)


@dataclass
class Stretch(InputPartition):
    """A stretch of rows or observations of a file; ``b`` of None is its end."""

    path: str
    base: int
    a: int = 0
    b: int | None = None
    first: int = 0
    last: int | None = None
    skip: int = 0
    ranges: dict = field(default_factory=dict)


@dataclass
class Stretches(InputPartition):
    """Neighbouring stretches that one task reads, one after another."""

    parts: list[Stretch]


def _shared(stretches: list[Stretch], share: int) -> list[Stretches]:
    """Neighbours together, as long as they have no more than ``share`` rows or observations."""
    out, total = [], 0
    for s in stretches:
        n = s.b - s.a
        if out and total + n <= share:
            out[-1].parts.append(s)
            total += n
        else:
            out.append(Stretches([s]))
            total = n
    return out


class ArrayReader(DataSourceReader):
    """Reads stretches of classic files as Arrow batches; a task has a long one or several short ones."""

    def __init__(self, options: dict, schema: T.StructType):
        self.dim, self.rows_dim, self.role = options["dim"], options["rows_dim"], options["role"]
        self.plan, self.paths, self.share = options["plan"], options["paths"], options["share"]
        self.types = {f.name: {v: k for k, v in SPARK.items()}[f.dataType] for f in schema.fields}
        self.bounds: dict[str, tuple[float, float]] = {}

    def partitions(self) -> list[Stretches]:
        """The stretches, or without a plan one for each file, whose rows have numbers from file number times 2 ** 32."""
        if self.plan is None:
            each = max(1, -(-len(self.paths) // MOST_TASKS))
            files = [Stretch(p, i << 32) for i, p in enumerate(self.paths)]
            return [Stretches(files[i : i + each]) for i in range(0, len(files), each)]
        return _shared([s for s in (Stretch(**x) for x in self.plan) if self._may_match(s)], self.share)

    def _may_match(self, s: Stretch) -> bool:
        low, high = self.bounds.get(ROW, (-math.inf, math.inf))
        rows = (s.base + s.first, s.base + s.last) if s.last is not None else (-math.inf, math.inf)
        return rows[0] <= high and rows[1] >= low and all(r[0] <= self.bounds[c][1] and r[1] >= self.bounds[c][0] for c, r in s.ranges.items() if c in self.bounds)

    def read(self, partition: Stretches | None) -> Iterator[pa.RecordBatch]:
        for s in partition.parts if partition else ():  # Spark asks once where there is no partition
            yield from self._batches(s)

    def _batches(self, s: Stretch) -> Iterator[pa.RecordBatch]:
        system, at = store(s.path)
        with system.open_input_file(at) as f:
            h = Header(f, f.size())
            b = h.dims.get(self.dim, 0) if s.b is None else s.b
            mine = {n: v for n, v in h.along(self.dim).items() if n in self.types}
            sizes = _row_sizes(s.path, s.first, h.dims[self.rows_dim] if s.last is None else s.last + 1) if self.role == "obs" else None
            ends = None if sizes is None else np.cumsum(sizes) - s.skip
            for x in range(s.a, b, BATCH):
                y = min(b, x + BATCH)
                n, place = y - x, np.arange(x, y)
                raw = h.read(list(mine), x, y)
                data = {c: column(v, raw[c], n, self.types[c]) for c, v in mine.items()}
                if ends is None:
                    data[ROW] = pa.array(s.base + place)
                else:
                    row = np.searchsorted(ends, place - s.a, "right")
                    data[ROW] = pa.array(s.base + s.first + row)
                    data[OBS] = pa.array(place - s.a - (ends[row] - sizes[row]))
                yield pa.RecordBatch.from_arrays([data[c] if c in data else pa.nulls(n, TYPES[t]) for c, t in self.types.items()], names=list(self.types))


class PruningReader(ArrayReader):
    """The same, leaving out stretches that filters on rows, or on columns whose range a file states, rule out."""

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            column_, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
            values = list(value) if isinstance(f, In) else [value]
            if column_ and values and all(isinstance(v, (int, float)) for v in values):
                low, high = self.bounds.get(column_, (-math.inf, math.inf))
                if isinstance(f, (EqualTo, In)):
                    low, high = max(low, min(values)), min(high, max(values))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, value)
                self.bounds[column_] = (low, high)
            yield f  # Spark looks at each row all the same


class ArrayFiles(DataSource):
    """``spark.read.format("netcdf")`` and ``df.write.format("netcdf")`` for NetCDF classic files.

    Reading takes ``load(path)`` of a file, or of a folder, whose files count in the order of their
    names, with the options ``role`` (obs, as set, or rows), ``rows_dim`` and ``obs_dim``. Columns
    are those of the first file. ``read_netcdf`` surveys all files first, numbers rows without
    gaps and deals long files to many tasks. With the option ``prune`` set to true, which needs the
    session's ``spark.sql.python.filterPushdown.enabled``, filters leave out files and stretches.

    Writing takes one record a row with nested observations; see ``write_netcdf``.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _settings(self) -> dict:
        o = self.options
        role, rows_dim, obs_dim = o.get("role", "obs"), o.get("rows_dim", "rows"), o.get("obs_dim", "obs")
        plan = o.get("plan")
        return {"role": role, "rows_dim": rows_dim, "dim": rows_dim if role == "rows" else obs_dim, "plan": json.loads(plan) if plan else None, "share": int(o.get("share", 0)), "paths": None if plan else listed(o["path"])}

    def schema(self) -> T.StructType:
        s = self._settings()
        if not s["paths"]:
            raise ValueError("no files")
        system, path = store(s["paths"][0])
        with system.open_input_file(path) as f:
            h = Header(f, f.size())
        return _schema(s["role"], {n: v.type for n, v in h.along(s["dim"]).items()})

    def reader(self, schema: T.StructType) -> ArrayReader:
        kind = PruningReader if self.options.get("prune") == "true" else ArrayReader
        return kind(self._settings(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], json.loads(self.options["layout"]), overwrite)


def listed(path: str) -> list[str]:
    """A file, or the files of a folder by name, as URIs of the same kind."""
    from pyarrow import fs

    system, at = store(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    top = path.rstrip("/")
    return [f"{top}/{x.base_name}" for x in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.base_name) if x.type == fs.FileType.File and x.base_name.endswith(".nc")]


def _schema(role: str, types: dict[str, str]) -> T.StructType:
    keys = [ROW] if role == "rows" else [ROW, OBS]
    return T.StructType([*(T.StructField(k, T.LongType()) for k in keys), *(T.StructField(n, SPARK[t]) for n, t in types.items())])


def read_netcdf(spark: SparkSession, paths: str | list[str], rows_dim: str = "rows", obs_dim: str = "obs", columns: list[str] | None = None) -> RaggedFrame:
    """A ragged frame of classic files, one after another; stretches of observations are read by tasks of their own.

    ``paths`` is a file, a folder or a list in order. Rows are numbered through all files.
    Variables along the two dimensions, one of which may grow, become columns (``columns`` takes
    those named alone): numbers, and texts as characters. A column has one type over all files,
    the widest of theirs; files without it have nulls. Fill values and missing values are null,
    packed values are unpacked. Attributes are those of the first file, or of the first that has
    the column. Where ``spark.sql.python.filterPushdown.enabled`` is set, filters on ``row_idx``,
    and on columns with a stated ``actual_range``, leave out files and stretches.
    """
    paths = listed(paths) if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files")
    spark.dataSource.register(ArrayFiles)
    files = survey(spark, paths, rows_dim, obs_dim)
    found = _columns(files)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")

    def load(role: str, plan: list[dict]) -> DataFrame:
        types = {n: t for n, (t, _) in found[role].items() if columns is None or n in columns or n == "rowsize"}
        share = min(SLICE, -(-sum(x["b"] - x["a"] for x in plan) // (4 * spark.sparkContext.defaultParallelism)))  # small files go to few tasks, but to all cores
        df = spark.read.format("netcdf").schema(_schema(role, types)).options(share=share, role=role, rows_dim=rows_dim, obs_dim=obs_dim, plan=json.dumps(plan) if plan else "[]", prune=prune).load()
        return df.withColumn("rowsize", F.col("rowsize").cast("long")) if role == "rows" else df

    # a record for each slice and stretch, as many as Spark itself keeps partitions
    plan = [dict(path=r.path, base=r.base, a=r.a, b=r.b, first=r["first"], last=r["last"], skip=r["skip"], ranges=json.loads(r.ranges)) for r in _pieces(files, rows_dim).orderBy("file", "a").collect()]
    based = running_total(files.select("file", "path", "n_rows"), "file", "n_rows", "base").orderBy("file").collect()
    slices = [dict(path=r.path, base=r.base, a=i, b=min(i + SLICE, r.n_rows), first=i, last=min(i + SLICE, r.n_rows) - 1) for r in based for i in range(0, r.n_rows, SLICE)]
    attrs = json.loads(files.orderBy("file").first().attrs)
    discard(files)
    frame = RaggedFrame(load("rows", slices), load("obs", plan), {k: v if isinstance(v, str) else str(v) for k, v in attrs.items()})
    for role in ("rows", "obs"):
        for n, (_, a) in found[role].items():
            texts = {k: x for k, x in a.items() if isinstance(x, str)}
            if texts and n != "rowsize" and n in frame.rows.columns + frame.obs.columns:
                frame = frame.describe(n, **texts)
    return frame


class ArrayWriter(DataSourceArrowWriter):
    """Writes partitions of nested rows as classic files; they appear under their names when all tasks are done."""

    def __init__(self, folder: str, layout: dict, overwrite: bool):
        self.folder, self.layout, self.overwrite, self.attempt = folder.rstrip("/"), layout, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Files of whole rows, as many of them as a file may have, or one longer row."""
        part, made = TaskContext.get().partitionId(), []
        most_rows, most, held, rows, n = self.layout["rows_in_file"], self.layout["obs_in_file"], [], 0, 0
        system, top = store(self.folder)
        temporary = f"{top}/_temporary/{self.attempt}"

        def put() -> None:
            system.create_dir(temporary, recursive=True)
            name = f"part-{part:06d}-{len(made):06d}.nc"
            mine = f"{name}.{uuid.uuid4().hex[:8]}"  # each attempt of a task has files of its own
            with system.open_output_stream(f"{temporary}/{mine}") as out:
                for piece in self._file(pa.Table.from_batches(held)):
                    out.write(piece)
            made.append((mine, name))

        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("rowsize")).to_numpy(zero_copy_only=False)
            begin = 0
            for i, k in enumerate(sizes):
                if rows and (n + k > most or rows == most_rows):
                    held.append(batch.slice(begin, i - begin))
                    put()
                    held.clear()
                    rows, n, begin = 0, 0, i
                rows, n = rows + 1, n + int(k)
            held.append(batch.slice(begin))
        if sum(b.num_rows for b in held):
            put()
        return Written(made)

    def _file(self, table: pa.Table) -> Iterator[bytes]:
        layout, variables = self.layout, []
        obs = table["obs"].combine_chunks()
        arrays = dict(zip((f.name for f in obs.type), obs.flatten(), strict=True))  # null where the row has no observations
        for role, columns in (("rows", {c: table[c].combine_chunks() for c in layout["rows"]}), ("obs", {c: pa.compute.list_flatten(arrays[c]) for c in layout["obs"]})):
            for name, values in columns.items():
                kind, attrs = layout[role][name]
                variables.append((name, role, *_stored(values, kind, attrs, role == "obs")))
        dims = {"rows": table.num_rows, "obs": len(variables[-1][2]) if layout["obs"] else 0}
        return file_bytes(layout["version"], layout["attrs"], dims, variables, "obs" if layout["unlimited"] else None)

    def commit(self, messages: list) -> None:
        """Give files their names, which sort by partition; what stood in the folder goes if it is to be overwritten."""
        system, top = store(self.folder)
        system.create_dir(top, recursive=True)
        made = [m for w in messages if w is not None for m in w.files]
        if self.overwrite:
            for old in listed(self.folder):
                system.delete_file(store(old)[1])
        for mine, name in made:
            system.move(f"{top}/_temporary/{self.attempt}/{mine}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, top = store(self.folder)
        for path in (f"{top}/_temporary/{self.attempt}", f"{top}/_temporary"):
            if system.get_file_info(path).type == fs.FileType.Directory and (path.endswith(self.attempt) or not system.get_file_info(fs.FileSelector(path))):
                system.delete_dir(path)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: (name while the job runs, name)."""

    files: list[tuple[str, str]]


def _stored(values: pa.Array, kind: str, attrs: dict, ranged: bool) -> tuple[np.ndarray, dict]:
    """Values in the file's type, missing ones by the column's fill, and their attributes; numbers of observations state their range."""
    attrs = dict(attrs)
    if kind.startswith("S"):
        return np.array([(x or "").encode() for x in values.to_pylist()], kind), attrs
    fill = attrs.pop("_FillValue", math.nan)
    dtype = np.dtype(kind)
    if dtype.kind == "f":
        x = values.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).astype(dtype)
        real = x[np.isfinite(x)]
    else:
        whole = values.cast(pa.int64())
        real = whole.drop_null().to_numpy(zero_copy_only=False).astype(dtype)
        x = whole.fill_null(0 if math.isnan(fill) else int(fill)).to_numpy(zero_copy_only=False).astype(dtype)
        if not math.isnan(fill):
            attrs["_FillValue"] = np.array([fill], dtype)
    if ranged and len(real):
        attrs["actual_range"] = np.array([real.min(), real.max()], dtype)
    return x, attrs


def _layout(frame: RaggedFrame) -> tuple[int, dict, dict]:
    """(version, row columns, observation columns) with a type and attributes each, decided over all values once.

    Integers have 32 bits where all fit and 64 in version 5; nulls get a value beyond the column's
    range. Texts are as wide as the widest. Doubles and floats have NaN for null.
    """
    version, out = 2, []
    for df in (frame.rows, frame.obs):
        fields_ = [f for f in df.schema.fields if f.name not in (ROW, OBS, "rowsize")]
        whole = [f.name for f in fields_ if f.dataType.typeName() in ("byte", "short", "integer", "long", "boolean")]
        texts = [f.name for f in fields_ if f.dataType.typeName() == "string"]
        of = lambda c: F.col(f"`{c}`").cast("long")
        ask = [x for i, c in enumerate(whole) for x in (F.min(of(c)).alias(f"low{i}"), F.max(of(c)).alias(f"high{i}"), F.bool_or(F.col(f"`{c}`").isNull()).alias(f"none{i}"))] + [F.max(F.octet_length(F.col(f"`{c}`"))).alias(f"wide{i}") for i, c in enumerate(texts)]
        found = df.agg(*ask).first() if ask else {}
        columns = {}
        for f in fields_:
            attrs = {k: str(v) for k, v in (f.metadata or {}).items()}
            if f.name in whole:
                i = whole.index(f.name)
                low, high, none = found[f"low{i}"] or 0, found[f"high{i}"] or 0, found[f"none{i}"]
                fill = (high + 1 if high < 2**62 else low - 1) if none else None
                ends = [low, high] + ([fill] if fill is not None else [])
                kind = "i4" if -(2**31) <= min(ends) and max(ends) < 2**31 else "i8"
                version = 5 if kind == "i8" else version
                columns[f.name] = (kind, attrs | ({"_FillValue": fill} if fill is not None else {}))
            elif f.name in texts:
                columns[f.name] = (f"S{max(1, found[f'wide{texts.index(f.name)}'] or 0)}", attrs)
            elif f.dataType.typeName() in ("double", "float"):
                columns[f.name] = ("f8" if f.dataType.typeName() == "double" else "f4", attrs)
        out.append(columns)
    return version, *out


def write_netcdf(frame: RaggedFrame, folder: str, rows_in_file: int = 100_000, obs_in_file: int = 1 << 24, unlimited: bool = False) -> list[str]:
    """Write a folder of classic files, each with whole rows in their order; returns their paths in order.

    Rows are sorted by range over the tasks, with their observations as arrays; a file ends before
    the row that would take it over ``rows_in_file`` rows or ``obs_in_file`` observations. With ``unlimited`` observations
    may grow: they are interleaved records. Numbers, truth values (as 0 and 1) and texts are
    written, each column in one type over all files; other columns are left out. Files appear
    when all are written, or not at all. A folder that exists is replaced.
    """
    spark = frame.rows.sparkSession
    spark.dataSource.register(ArrayFiles)
    version, rows, obs = _layout(frame)
    rowsize = F.coalesce(F.col("rowsize"), F.lit(0)).cast("long")
    slim = RaggedFrame(frame.rows.select(ROW, rowsize.alias("rowsize"), *(F.col(f"`{c}`") for c in rows)), frame.obs.select(ROW, OBS, *(F.col(f"`{c}`") for c in obs)))
    nested = slim.to_nested() if obs else slim.rows.withColumn("obs", F.struct(F.array().cast("array<int>").alias("none")))
    size, n_rows, n_obs = (x or 0 for x in frame.rows.agg(F.max("rowsize"), F.count(F.lit(1)), F.sum("rowsize")).first())
    parts = max(1, -(-n_rows // rows_in_file), -(-n_obs // obs_in_file))
    parts = min(parts, max(4 * spark.sparkContext.defaultParallelism, -(-n_obs // SLICE)))  # a task writes many small files
    layout = {"version": version, "attrs": {k: str(v) for k, v in frame.attrs.items()}, "rows": {"rowsize": ("i4" if size < 2**31 else "i8", {}), **rows}, "obs": obs, "rows_in_file": rows_in_file, "obs_in_file": obs_in_file, "unlimited": unlimited}
    nested.repartitionByRange(parts, ROW).sortWithinPartitions(ROW).write.format("netcdf").mode("overwrite").option("layout", json.dumps(layout)).save(folder)
    return listed(folder)


def ragged_of(rows: DataFrame, flat: DataFrame, attrs: dict[str, str]) -> RaggedFrame:
    """A ragged frame of rows with their counts and flat observations numbered by ``at``: each finds its row by the counts."""
    placed = offsets(rows.withColumn("rowsize", F.col("rowsize").cast("long"))).filter("rowsize > 0").select(ROW, "start", "stop")
    # a record for each place, in pieces of bounded length; the planner sees rows only and would broadcast it
    piece = 1 << 16
    cut = placed.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("stop") - 1) / piece))))
    each = cut.select(ROW, "start", F.explode(F.sequence(F.greatest("start", F.col("__b") * piece), F.least(F.col("stop"), (F.col("__b") + 1) * piece) - 1)).alias("at"))
    found = flat.join(each.hint("merge"), "at")
    obs = found.withColumn(OBS, F.col("at") - F.col("start")).select(ROW, OBS, *(c for c in flat.columns if c != "at"))
    return RaggedFrame(rows.withColumn("rowsize", F.col("rowsize").cast("long")), obs, attrs)


def from_vectors(vectors: DataFrame, types: dict[str, str] | None = None, attrs: dict[str, str] | None = None) -> RaggedFrame:
    """A ragged frame of variables as vectors: records (name, at, value), ``at`` from 0, of which ``rowsize`` has the counts.

    A variable's length says what it is along: as many values as rows, or as there are observations
    in all. Others are named in a warning and left out. Values are doubles, or of ``types`` by
    name. One job counts; a record a variable comes to the driver.
    """
    sizes = {r.name: (r.n, r.total) for r in vectors.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("name") == "rowsize", F.col("value"))).alias("total")).collect()}
    if "rowsize" not in sizes:
        raise ValueError("no rowsize")
    n_rows, n_obs = sizes["rowsize"][0], int(sizes["rowsize"][1] or 0)
    along_rows = sorted(n for n, (k, _) in sizes.items() if k == n_rows)
    along_obs = sorted(n for n, (k, _) in sizes.items() if k == n_obs and n not in along_rows)
    odd = {n: k for n, (k, _) in sizes.items() if n not in along_rows and n not in along_obs}
    if odd:
        warnings.warn(f"neither {n_rows} nor {n_obs} values: {', '.join(f'{n} ({k})' for n, k in sorted(odd.items()))}", stacklevel=2)
    kinds = types or {}

    def wide(names: list[str]) -> DataFrame:
        out = vectors.filter(F.col("name").isin(names)).groupBy("at").pivot("name", names).agg(F.first("value"))
        return out.select(F.col("at").cast("long").alias("at"), *(F.col(f"`{n}`").cast(kinds.get(n, "double")).alias(n) for n in names))

    return ragged_of(wide(along_rows).withColumnRenamed("at", ROW), wide(along_obs), attrs or {})


# ---- Zarr (version 2) ----


def _json(system, path: str) -> dict:
    """A JSON file's content; nothing where there is none."""
    try:
        with system.open_input_file(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {}


def _zarr_arrays(uri: str) -> dict[str, tuple[dict, dict]]:
    """(metadata, attributes) of the arrays of a folder by name: from its consolidated metadata, or array by array."""
    from pyarrow import fs

    system, path = store(uri)
    whole = _json(system, f"{path}/.zmetadata").get("metadata", {})
    if whole:
        return {k.removesuffix("/.zarray"): (m, whole.get(k.removesuffix(".zarray") + ".zattrs", {})) for k, m in whole.items() if k.endswith("/.zarray")}
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory]
    return {n: (m, _json(system, f"{path}/{n}/.zattrs")) for n in sorted(names) if (m := _json(system, f"{path}/{n}/.zarray"))}


def unpacked(raw: bytes, meta: dict) -> np.ndarray | list[str]:
    """The values of a chunk: packed by nothing, zlib, gzip, Zstandard, LZ4 or Blosc; texts may have lengths of their own."""
    codec = (meta.get("compressor") or {}).get("id")
    if codec in ("zlib", "gzip"):
        raw = zlib.decompress(raw, 47)  # 47: zlib or gzip, as its head says
    elif codec == "blosc":
        raw = blosc.decode(raw)
    elif codec == "zstd":
        raw = pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read()
    elif codec == "lz4":
        raw = pa.Codec("lz4_raw").decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True)
    elif codec:
        raise ValueError(f"no decoder for chunks packed by {codec}")
    if meta["dtype"] != "|O":
        return np.frombuffer(raw, meta["dtype"])
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


def packed(values: np.ndarray, compressor: dict | None) -> bytes:
    """A chunk's bytes: as they are, by zlib, or as a Blosc frame."""
    raw, how = values.tobytes(), compressor or {}
    if not how:
        return raw
    if how["id"] == "zlib":
        return zlib.compress(raw, how.get("level", 1))
    if how["id"] == "blosc":
        return blosc.encode(raw, values.dtype.itemsize, how.get("cname", "lz4"), {0: "none", 1: "bytes", 2: "bits"}[how.get("shuffle", 1)], how.get("clevel", 5))
    raise ValueError(f"no encoder for chunks packed by {how['id']}")


def _zarr_type(meta: dict, attrs: dict) -> str:
    if meta["dtype"] == "|O":
        return "string"
    return "double" if {"scale_factor", "add_offset"} & set(attrs) else type_of(meta["dtype"])


def _known(meta: dict) -> bool:
    """One-dimensional arrays of numbers, truth values and texts; objects only as texts."""
    return len(meta["shape"]) == 1 and (np.dtype(meta["dtype"]).kind in "biufSU" or [f.get("id") for f in meta.get("filters") or []] == ["vlen-utf8"])


def _chunked(system, path: str, meta: dict, a: int, b: int) -> np.ndarray | list[str]:
    """Values from ``a`` to before ``b``, of all chunks that they are in; an absent chunk has the fill value."""
    size, out = meta["chunks"][0], []
    for k in range(a // size, (b - 1) // size + 1):
        try:
            with system.open_input_file(f"{path}/{k}") as f:
                values = unpacked(f.read(), meta)
        except FileNotFoundError:
            fill = meta["fill_value"]
            values = [fill or ""] * size if meta["dtype"] == "|O" else np.full(size, float(fill.replace("Infinity", "inf")) if isinstance(fill, str) and np.dtype(meta["dtype"]).kind == "f" else fill or 0, meta["dtype"])
        out.append(values[max(0, a - k * size) : b - k * size])
    return out[0] if len(out) == 1 else sum(out, []) if meta["dtype"] == "|O" else np.concatenate(out)


def _zarr_column(values, meta: dict, attrs: dict) -> pa.Array:
    if meta["dtype"] == "|O":
        return pa.array(values, pa.string())
    kind = np.dtype(meta["dtype"]).kind
    if kind in "SU":
        return pa.array([x.decode(errors="replace") if kind == "S" else str(x) for x in values], pa.string())
    return decoded(values, attrs, _zarr_type(meta, attrs))


def read_zarr(spark: SparkSession, uri: str, rows_dim: str = "traj", obs_dim: str = "obs", columns: list[str] | None = None) -> RaggedFrame:
    """A ragged frame of a Zarr folder (version 2) with one-dimensional arrays; a chunk of the longest kind a task.

    Chunks may be packed by zlib, gzip, Zstandard, LZ4 or Blosc. Arrays hold numbers, truth values or
    texts of fixed or own width; others are left out. An array's dimension is its
    ``_ARRAY_DIMENSIONS`` attribute. A chunk that is absent has the fill value. Values that the
    attributes ``_FillValue`` and ``missing_value`` name are null; packed values are unpacked.
    """
    arrays = {n: a for n, a in _zarr_arrays(uri).items() if _known(a[0]) and (columns is None or n in columns or n == "rowsize")}

    def table(dim: str) -> DataFrame:
        mine = {n: (m, a) for n, (m, a) in arrays.items() if a.get("_ARRAY_DIMENSIONS") == [dim]}
        sizes = {m["shape"][0] for m, _ in mine.values()}
        if len(sizes) != 1:
            raise ValueError(f"arrays along {dim} must have one length")
        size, chunk = sizes.pop(), max(m["chunks"][0] for m, _ in mine.values())
        schema = T.StructType([T.StructField("at", T.LongType()), *(T.StructField(n, SPARK[_zarr_type(m, a)]) for n, (m, a) in mine.items())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = store(uri)
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    a, b = k * chunk, min(size, (k + 1) * chunk)
                    out = [pa.array(np.arange(a, b)), *(_zarr_column(_chunked(system, f"{path}/{n}", m, a, b), m, t) for n, (m, t) in mine.items())]
                    yield from pa.Table.from_arrays(out, names=schema.names).to_batches(BATCH)

        chunks = -(-size // chunk)
        # the planner takes the size of the numbers for that of the values, so there is a number for each value
        each = chunk * len(schema)
        numbers = spark.range(0, chunks * each, 1, max(1, min(chunks, 10_000))).filter(F.col("id") % each == 0).select(F.expr(f"id div {each}").alias("id"))
        return numbers.mapInArrow(run, schema)

    system, path = store(uri)
    attrs = {k: v if isinstance(v, str) else json.dumps(v) for k, v in _json(system, f"{path}/.zattrs").items()}
    frame = ragged_of(table(rows_dim).withColumnRenamed("at", ROW), table(obs_dim), attrs)
    for n, (_, a) in arrays.items():
        if n != "rowsize" and n in frame.rows.columns + frame.obs.columns:
            frame = frame.describe(n, **{k: v for k, v in a.items() if isinstance(v, str)})
    return frame


def write_zarr(frame: RaggedFrame, uri: str, chunk: int = 1 << 20, rows_dim: str = "traj", obs_dim: str = "obs", compressor: dict | None = None) -> None:
    """Write a Zarr folder: numbers, truth values (as 0 and 1) and texts as arrays, each chunk by one task; rows numbered from 0 in their order.

    ``compressor`` is that of the archive's metadata, zlib unless given: ``{"id": "blosc", "cname":
    "lz4", "clevel": 5, "shuffle": 1}`` packs frames, and an empty one nothing. An integer null is
    a value beyond the column's range, which the attribute ``_FillValue`` names; floats have NaN.
    """
    how = {"id": "zlib", "level": 1} if compressor is None else compressor
    _, row_kinds, obs_kinds = _layout(frame)
    placed = offsets(ranked(frame.rows, ROW, "__at").withColumn("__row", F.col(ROW)).withColumn(ROW, F.col("__at")))
    rows = placed.select(F.col(ROW).alias("at"), F.coalesce(F.col("rowsize"), F.lit(0)).cast("long").alias("rowsize"), *(F.col(f"`{c}`") for c in row_kinds))
    starts = placed.select(F.col("__row").alias(ROW), "start")
    obs = frame.obs.join(starts, ROW).select((F.col("start") + F.col(OBS)).alias("at"), *(F.col(f"`{c}`") for c in obs_kinds))
    system, path = store(uri)

    def put(name: str, content: dict) -> None:
        system.create_dir(f"{path}/{name}".rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(json.dumps(content).encode())

    put(".zgroup", {"zarr_format": 2})
    put(".zattrs", frame.attrs)
    for dim, df, kinds in ((rows_dim, rows, {"rowsize": ("i8", {}), **row_kinds}), (obs_dim, obs, obs_kinds)):
        size = df.count()
        df.groupBy(F.floor(F.col("at") / chunk).alias("k")).applyInArrow(_chunk_writer(uri, kinds, chunk, how), "n long").count()
        for c, (kind, attrs) in kinds.items():
            code = np.dtype(kind).str
            fill = "NaN" if code[1] == "f" else "" if code[1] == "S" else 0
            put(f"{c}/.zarray", {"zarr_format": 2, "shape": [size], "chunks": [chunk], "dtype": code, "compressor": how or None, "fill_value": fill, "order": "C", "filters": None})
            put(f"{c}/.zattrs", {"_ARRAY_DIMENSIONS": [dim], **attrs})


def _chunk_writer(uri: str, kinds: dict[str, tuple[str, dict]], chunk: int, compressor: dict):
    """Writes a chunk's columns, each to its file, whole or not at all."""

    def write(key: tuple, table: pa.Table) -> pa.Table:
        system, path = store(uri)
        table = table.sort_by("at")
        for c, (kind, attrs) in kinds.items():
            values, _ = _stored(table[c].combine_chunks(), kind, attrs, False)
            full = np.concatenate([values, np.zeros(chunk - len(values), values.dtype)])
            target = f"{path}/{c}/{key[0].as_py()}"
            system.create_dir(f"{path}/{c}", recursive=True)
            part = f"{target}.{uuid.uuid4().hex[:8]}.part"  # each attempt of a task has a file of its own
            with system.open_output_stream(part) as out:
                out.write(packed(full, compressor))
            system.move(part, target)
        return pa.table({"n": [table.num_rows]})

    return write
