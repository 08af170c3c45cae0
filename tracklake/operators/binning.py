"""Statistics over the cells of an N-dimensional grid."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize
from .ragged import running_total

DEFAULT_BINS = 10
NAMES = ("count", "sum", "mean", "median", "std", "min", "max")
Statistic = str | Callable | tuple[str, Callable]


def _is_time(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName().startswith("timestamp")


def _is_complex(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "struct"


def _number(df: DataFrame, column: str) -> Column:
    """A column as a double; timestamps as seconds since 1970."""
    c = F.col(column)
    return F.unix_micros(c.cast("timestamp")) / 1e6 if _is_time(df, column) else c.cast("double")


def _plain(x) -> float:
    if isinstance(x, (dt.datetime, np.datetime64, pd.Timestamp)):
        return pd.Timestamp(x).value / 1e9
    return float(x)


def bin_edges(df: DataFrame, coords: Sequence[str], bins, ranges) -> list[np.ndarray]:
    """Edges of each dimension: given, or so many equal bins over a range; default ten from least to most."""
    return _survey(df, coords, bins, ranges)[0]


def _survey(df: DataFrame, coords: Sequence[str], bins, ranges) -> tuple[list[np.ndarray], int]:
    """Edges of each dimension, and the number of rows.

    One job finds all ranges that are not given, whether a coordinate is not finite, and the count.
    """
    if bins is None or isinstance(bins, int):
        many = [bins] * len(coords)
    elif len(coords) == 1 and not np.ndim(bins[0]) and len(bins) > 1:
        many = [bins]  # the edges of the one dimension
    else:
        many = list(bins)
    if len(many) != len(coords):
        raise ValueError("bins must be given for each coordinate")
    spans = [None] * len(coords) if ranges is None else [ranges] if len(coords) == 1 and not np.ndim(ranges[0]) and ranges[0] is not None else list(ranges)
    if len(spans) != len(coords):
        raise ValueError("a range must be given for each coordinate")
    xs = [_number(df, c) for c in coords]
    lean = df.select(*(x.alias(f"x{i}") for i, x in enumerate(xs)))
    xs = [F.col(f"x{i}") for i in range(len(xs))]
    bad = reduce(Column.__or__, (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for x in xs))
    found = lean.agg(F.max(F.coalesce(bad, F.lit(True)).cast("int")), *(f(x) for x in xs for f in (F.min, F.max)), F.count(F.lit(1))).first()
    if found[0]:
        raise ValueError("coordinates must be finite")
    out = []
    for i, (b, span) in enumerate(zip(many, spans, strict=True)):
        if b is not None and np.ndim(b):
            out.append(np.array([_plain(x) for x in b]))
            continue
        low, high = (found[1 + 2 * i], found[2 + 2 * i]) if span is None else map(_plain, span)
        if low is None:
            low, high = 0.0, 1.0
        if low == high:
            low, high = low - 0.5, high + 0.5
        out.append(np.linspace(low, high, int(b or DEFAULT_BINS) + 1))
    return out, found[-1]


def bin_index(x: Column, edges: np.ndarray, last_edge: str = "inclusive") -> Column:
    """Number of the half-open bin [e_i, e_i+1) that holds x; the last edge belongs to the last bin, unless exclusive.

    Equal bins are guessed by division and put right against the exact edges; other edges are counted.
    """
    n = len(edges) - 1
    low, high = float(edges[0]), float(edges[-1])
    step = (high - low) / n
    if np.array_equal(edges, np.linspace(low, high, n + 1)):
        at = lambda i: F.when(i >= n, high).otherwise(i * step + low)
        guess = F.floor((x - low) / step)
        place = guess + F.when(x < at(guess), -1).when(x >= at(guess + 1), 1).otherwise(0)
    else:
        known = F.array(*(F.lit(float(e)) for e in edges))
        place = F.size(F.filter(known, lambda e: e <= x)) - 1
    if last_edge == "inclusive":
        place = F.when(x == high, n - 1).otherwise(place)
    return F.when((x >= low) & (x <= high) & (place >= 0) & (place < n), place.cast("long"))


def statistic_name(stat: Statistic, taken: set[str]) -> str:
    """Name of a statistic: its own, a function's (``stat`` for a lambda), with _1, _2, ... after a name that is taken."""
    if isinstance(stat, tuple):
        stat = stat[0]
    if callable(stat):
        while isinstance(stat, partial):
            stat = stat.func
        name = getattr(stat, "__name__", "stat")
        stat = "stat" if name == "<lambda>" else name
    name, k = stat, 0
    while name in taken:
        k += 1
        name = f"{stat}_{k}"
    taken.add(name)
    return name


def _native(stat: str, x: Column) -> Column:
    clean = F.when(~F.isnan(x), x)
    if stat == "count":
        return F.count(clean)
    if stat == "sum":
        return F.sum(clean)
    if stat == "mean":
        return F.avg(clean)
    if stat == "std":
        return F.stddev_pop(clean)
    out = F.min(clean) if stat == "min" else F.max(clean)
    return F.when(out != (float("inf") if stat == "min" else float("-inf")), out)


def binned_statistics(
    df: DataFrame,
    coords: Sequence[str] | str,
    data: Sequence[str] | str | None = None,
    bins=None,
    ranges=None,
    statistics: Statistic | Sequence[Statistic] = "count",
    last_edge: str = "inclusive",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """A row for each cell of the grid, empty ones too: bin_i, center_i, and a column for each statistic.

    Statistics are names of ``NAMES``, functions of a cell's values, or (column names joined by
    commas are taken by) a function of several columns: ``("a,b", f)``. Columns are called
    variable_statistic, or just statistic without data. Missing values (null, NaN) are left out,
    infinite ones stay; for several columns a point stays if one of them is there. Counts and
    sums of empty cells are 0, other statistics null. Times give times (whole seconds), their
    spread seconds. Built-in statistics of all variables are one hash aggregation; functions get
    a cell's values together.

    A median is that of the cell's values in one task, or, in cells of more than ``CROWD`` rows, of
    a sort by range over all tasks: a cell of all rows needs no more memory than others.
    """
    coords = [coords] if isinstance(coords, str) else list(coords)
    data = [data] if isinstance(data, str) else list(data or [])
    stats = list(statistics) if isinstance(statistics, list) else [statistics]
    for s in stats:
        if isinstance(s, str) and s not in NAMES:
            raise ValueError(f"unknown statistic {s!r}")
        if not (isinstance(s, str) or callable(s) or (isinstance(s, tuple) and len(s) == 2 and callable(s[1]))):
            raise ValueError(f"not a statistic: {s!r}")
        if not data and s != "count":
            raise ValueError("statistics other than count need data")
    stats.sort(key=lambda s: NAMES.index(s) if isinstance(s, str) else len(NAMES))
    shown = list(names or data)
    edges, n_rows = _survey(df, coords, bins, ranges)
    keys = [f"bin_{i}" for i in range(len(coords))]
    # each coordinate is computed once, whatever its expression: the bin is made of an array's only element
    place = lambda c, e: F.transform(F.array(_number(df, c)), lambda x: bin_index(x, e, last_edge))[0]
    placed = df.withColumns({k: place(c, e) for k, c, e in zip(keys, coords, edges, strict=True)})
    aggs, back, zero, calls = [], {}, [], []
    crowded = _crowded(placed, keys) if "median" in stats and n_rows > CROWD else None
    if crowded is not None:
        placed = placed.join(crowded, keys, "left")
    middles: list[tuple[str, Column]] = []

    def native(s: str, x: Column, name: str) -> Column:
        if s != "median":
            return _native(s, x)
        real = F.when(~F.isnan(x), x)
        if crowded is None:
            return F.median(real)
        middles.append((name, real))
        return F.median(F.when(F.col(CROWDED).isNull(), real))

    taken: set[str] = set()
    if not data:
        aggs.append(F.count(F.lit(1)).alias(statistic_name("count", taken)))
        zero.append("count")
    for variable, label in zip(data, shown, strict=True):
        own: set[str] = set()
        for s in stats:
            if isinstance(s, tuple):
                continue
            name = f"{label}_{statistic_name(s, own)}"
            if callable(s):
                calls.append((name, [variable], s))
                continue
            if _is_complex(df, variable):
                if s in ("min", "max", "median"):
                    raise ValueError(f"{s} of complex values")
                re, im = F.col(f"{variable}.re"), F.col(f"{variable}.im")
                if s == "count":
                    aggs.append(_native(s, re).alias(name))
                elif s == "std":
                    spread = F.avg(re * re + im * im) - F.avg(re) * F.avg(re) - F.avg(im) * F.avg(im)
                    aggs.append(F.sqrt(F.greatest(spread, F.lit(0.0))).alias(name))
                else:
                    aggs.append(F.struct(_native(s, re).alias("re"), _native(s, im).alias("im")).alias(name))
            elif _is_time(df, variable):
                if s == "sum":
                    raise ValueError("sum of times")
                aggs.append(native(s, _number(df, variable), name).alias(name))
                if s not in ("count", "std"):
                    back[name] = F.timestamp_seconds(F.floor(F.col(name)))
            else:
                aggs.append(native(s, _number(df, variable), name).alias(name))
            if s in ("count", "sum") and not _is_complex(df, variable):
                zero.append(name)
    many: set[str] = set()
    for s in stats:
        if isinstance(s, tuple):
            columns = [c.strip() for c in s[0].split(",")] if all(c.strip() in df.columns for c in s[0].split(",")) else data
            calls.append((statistic_name(s[1] if "," in s[0] else s[0], many), columns, s[1]))
    out = grid(df.sparkSession, edges, [_is_time(df, c) for c in coords])
    if aggs:
        found = placed.groupBy(*keys).agg(*aggs)
        for name, real in middles:
            apart = medians(placed.filter(F.col(CROWDED)).withColumn("value_of_cell", real), keys, "value_of_cell", "middle_of_cell")
            found = found.join(apart, keys, "left").withColumn(name, F.coalesce(name, "middle_of_cell")).drop("middle_of_cell")
        out = out.join(found, keys, "left").withColumns(back)
    for name, columns, f in calls:
        out = out.join(_called(placed, keys, columns, f, name), keys, "left")
    return out.fillna(0, subset=[z for z in zero if z in out.columns])


CROWD = 250_000  # rows of a cell whose distinct values one task holds for a median
CROWDED = "cell_is_crowded"


def _crowded(placed: DataFrame, keys: list[str]) -> DataFrame | None:
    """The cells with more than ``CROWD`` rows, written and marked; None where there is none."""
    found = materialize(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select(*keys, F.lit(True).alias(CROWDED)).dropna(subset=keys), "crowded")
    return found if found.limit(1).count() else None


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the exact median of a column by keys, for groups of any size.

    Equal values of a group are counted first, so a value of any number of rows is one record. The
    counts are sorted by range of (keys, value), which spreads a group over tasks, and added up in
    that order; the records in which a group's middle ranks fall hold its median. The mean
    of both middle values stands for even counts. Nulls and NaN are left out; groups without other
    values have no row.
    """
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ordered = running_total(counts, [*keys, "x"], "n", "before")
    ends = materialize(ordered.groupBy(*keys).agg(F.min("before").alias("first"), F.sum("n").alias("total")), "cells")
    at = F.col("before") - F.col("first")
    holds = lambda rank: (at <= rank) & (rank < at + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = ordered.join(ends, keys).filter(holds(low) | holds(high))
    return middle.groupBy(*keys).agg((0.5 * F.max(F.when(holds(low), F.col("x"))) + 0.5 * F.max(F.when(holds(high), F.col("x")))).alias(out))


def _called(placed: DataFrame, keys: list[str], columns: list[str], f: Callable, name: str) -> DataFrame:
    there = reduce(Column.__or__, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns))
    schema = T.StructType([*(T.StructField(k, T.LongType()) for k in keys), T.StructField(name, T.DoubleType())])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = [frame[c].to_numpy(float) for c in columns]
        return pd.DataFrame([[*key, float(f(values[0] if len(values) == 1 else values))]], columns=[*keys, name])

    return placed.dropna(subset=keys).filter(there).select(*keys, *columns).groupBy(*keys).applyInPandas(run, schema)


def grid(spark, edges: list[np.ndarray], times: list[bool]) -> DataFrame:
    """All cells: bin numbers and centers. Its size is that of the answer, whatever the data.

    Cells are numbered, and each dimension's bin and center follow from the number.
    """
    sizes = [len(e) - 1 for e in edges]
    cells = math.prod(sizes)
    out, stride = spark.range(0, cells, 1, max(1, cells // 100_000)), cells
    for i, (e, is_time) in enumerate(zip(edges, times, strict=True)):
        stride //= sizes[i]
        at = F.pmod(F.floor(F.col("id") / stride), F.lit(sizes[i])).cast("long")
        out = out.withColumn(f"bin_{i}", at)
        center = (e[:-1] + e[1:]) / 2
        if sizes[i] <= 1000:
            value = F.get(F.array(*(F.lit(float(c)) for c in center)), F.col(f"bin_{i}").cast("int"))
            out = out.withColumn(f"center_{i}", F.timestamp_seconds(F.floor(value)) if is_time else value)
            continue
        one = spark.createDataFrame([(k, float(c)) for k, c in enumerate(center)], f"bin_{i} long, center_{i} double")
        out = out.join(one, f"bin_{i}")
        if is_time:
            out = out.withColumn(f"center_{i}", F.timestamp_seconds(F.floor(F.col(f"center_{i}"))))
    return out.select(*(f"{n}_{i}" for i in range(len(edges)) for n in ("bin", "center")))
