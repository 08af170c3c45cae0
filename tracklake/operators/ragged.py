"""Index, filter, segment, window and reshape operators."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import OBS, ROW, RaggedFrame, along
from ..scratch import materialize

# ---- index ----


def running_total(df: DataFrame, order: str | list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows in ``order``: by range partition, then within it.

    The range-sorted table is written once, since partition bounds are sampled anew each time.
    """
    keys = [order] if isinstance(order, str) else order
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are partitions
    parts = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(parts), "__part").withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__part", "__before")


def ranked(df: DataFrame, order: str | list[str], out: str = ROW) -> DataFrame:
    """Number rows from 0 in ``order``, without gathering them in one task."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out).drop("__one")


def offsets(rows: DataFrame) -> DataFrame:
    """Add ``start`` and ``stop``, a row's place in the flat order of all observations."""
    return running_total(rows, ROW, "rowsize", "start").withColumn("stop", F.col("start") + F.col("rowsize"))


def rows_of(index: DataFrame, rows: DataFrame, at: str = "index", bucket: int = 1 << 16) -> DataFrame:
    """Row of each flat observation index: ``index`` with ``row_idx``.

    Starts are spread over the index buckets that their row touches, which makes the range join
    an equi-join; empty rows own nothing. An index that no row owns gets null; see ``checked``.
    """
    placed = offsets(rows).filter("stop > start").select(ROW, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))).alias("__b"))
    wanted = index.withColumn("__b", F.floor(F.col(at) / bucket))
    return wanted.join(placed, (wanted["__b"] == placed["__b"]) & (F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop")), "left").select(*index.columns, ROW)


def checked(found: DataFrame) -> DataFrame:
    """Raise at run time where an index is out of range."""
    return found.withColumn(ROW, F.when(F.col(ROW).isNull(), F.raise_error(F.lit("index out of range"))).otherwise(F.col(ROW)))


# ---- filters ----

@dataclass(frozen=True)
class WholeRow:
    """A criterion that sees the whole vector of a row (an array for each column) and gives a truth value for each observation."""

    function: Callable


Criterion = tuple | list | Column | Callable | WholeRow | int | float | str | bool


def predicate(name: str | tuple[str, ...], criterion: Criterion) -> Column:
    """Column of a criterion: (low, high) inclusive, a list of values, one value, or a function of columns."""
    if isinstance(name, tuple):
        if not callable(criterion):
            raise TypeError("several columns need a function")
        return criterion(*map(F.col, name))
    c = F.col(name)
    if callable(criterion) and not isinstance(criterion, Column):
        return criterion(c)
    if isinstance(criterion, Column):
        return criterion
    if isinstance(criterion, tuple):
        return c.between(*criterion)
    if isinstance(criterion, list):
        return c.isin(criterion)
    return c == criterion


def subset(frame: RaggedFrame, criteria: dict[str | tuple[str, ...], Criterion], full_rows: bool = False) -> RaggedFrame:
    """Rows and observations that meet all criteria.

    A row stays if it meets the row criteria and one of its observations the others. With
    ``full_rows`` all observations of such a row stay. ``rowsize`` is counted anew, by row. A
    ``WholeRow`` criterion gets each row's vector as it is before the other criteria.
    """
    on_rows, on_obs, whole = [], [], []
    for name, criterion in criteria.items():
        names = name if isinstance(name, tuple) else (name,)
        if isinstance(criterion, WholeRow):
            if not all(n in frame.obs.columns for n in names):
                raise ValueError(f"a criterion of whole rows needs columns of observations: {names}")
            whole.append((names, criterion.function))
            continue
        if all(n in frame.rows.columns for n in names) and not all(n in frame.obs.columns for n in names if n != ROW):
            on_rows.append(predicate(name, criterion))
        elif all(n in frame.obs.columns for n in names):
            on_obs.append(predicate(name, criterion))
        elif all(n in frame.rows.columns or n in frame.obs.columns for n in names):
            raise TypeError(f"columns of rows and observations mixed: {names}")
        else:
            raise ValueError(f"unknown column {name!r}")
    rows = frame.rows.filter(reduce(Column.__and__, on_rows)) if on_rows else frame.rows
    kept = frame.obs.filter(reduce(Column.__and__, on_obs)) if on_obs else frame.obs
    for names, function in whole:
        from .apply import map_rows

        mask = map_rows(frame, function, names, "__keep", kind="boolean").filter("__keep").select(ROW, OBS)
        kept = kept.join(mask, [ROW, OBS], "left_semi")
    if full_rows and (on_obs or whole):
        kept = frame.obs.join(kept.select(ROW).distinct(), ROW, "left_semi")
    if on_rows:
        kept = kept.join(rows.select(ROW), ROW, "left_semi")
    sizes = kept.groupBy(ROW).agg(F.count(F.lit(1)).alias("rowsize"))
    return RaggedFrame(rows.drop("rowsize").join(sizes, ROW), kept, frame.attrs)


def is_empty(frame: RaggedFrame) -> bool:
    """Whether nothing is left, with a warning if so."""
    if empty := frame.rows.isEmpty():
        warnings.warn("no data match the criteria", stacklevel=2)
    return empty


def prune(frame: RaggedFrame, least: int) -> RaggedFrame:
    """Rows of at least ``least`` observations."""
    rows = frame.rows.filter(F.col("rowsize") >= least)
    return RaggedFrame(rows, frame.obs.join(rows.select(ROW), ROW, "left_semi"), frame.attrs)


def unpack(frame: RaggedFrame, column: str, rows: list[int] | None = None) -> DataFrame:
    """(row_idx, column as an array in order) of the asked rows, in the order asked."""
    obs = frame.obs if rows is None else frame.obs.filter(F.col(ROW).isin(rows))
    out = obs.groupBy(ROW).agg(F.transform(F.array_sort(F.collect_list(F.struct(OBS, column))), lambda x: x[column]).alias(column))
    if rows is None:
        return out.orderBy(ROW)
    return out.orderBy(F.array_position(F.array(*(F.lit(r).cast("long") for r in rows)), F.col(ROW)))


# ---- segments and windows ----


def segment(obs: DataFrame, column: str, tolerance: float, out: str = "segment") -> DataFrame:
    """Add the number (from 0) of an observation's segment within its row.

    A segment starts where the step from the observation before is above ``tolerance``, or below
    it if it is negative. Rows always start one. Timestamps step in seconds.
    """
    here = F.col(column)
    if obs.schema[column].dataType.typeName().startswith("timestamp"):
        here = F.unix_micros(here.cast("timestamp")) / 1e6
    jump = here - F.lag(here).over(along())
    new = (jump > tolerance) if tolerance >= 0 else (jump < tolerance)
    return obs.withColumn("__new", F.coalesce(new.cast("long"), F.lit(0))).withColumn(out, F.sum("__new").over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def segment_both(obs: DataFrame, column: str, tolerance: float, out: str = "segment") -> DataFrame:
    """The same for steps of either sign larger than ``tolerance``, in one pass."""
    jump = F.abs(F.col(column) - F.lag(column).over(along()))
    return obs.withColumn("__new", F.coalesce((jump > tolerance).cast("long"), F.lit(0))).withColumn(out, F.sum("__new").over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def segment_sizes(obs: DataFrame, column: str, tolerance: float) -> DataFrame:
    """(row_idx, segment, rowsize) of the segments."""
    return segment(obs, column, tolerance).groupBy(ROW, "segment").agg(F.count(F.lit(1)).alias("rowsize"))


def chunk(frame: RaggedFrame, length: int, overlap: int = 0, align: str = "start") -> DataFrame:
    """Observations dealt to windows of ``length``: ``obs`` columns with ``chunk`` and ``place``.

    Windows start every length - overlap observations (a negative overlap leaves gaps). Only whole
    windows count; what is left over is cut from the end, the start, or both (one more at the end).
    An observation goes into each window that holds it, by arithmetic on its index.
    """
    if align not in ("start", "middle", "end"):
        raise ValueError("align must be start, middle or end")
    if length < 1 or overlap >= length:
        raise ValueError("length must be positive and above overlap")
    stride = length - overlap
    n = F.col("rowsize")
    count = F.greatest(F.floor((n - length) / stride) + 1, F.lit(0)).cast("long")
    spare = n - ((F.col("__count") - 1) * stride + length)
    skip = {"start": F.lit(0), "middle": F.floor(spare / 2), "end": spare}[align].cast("long")
    sized = frame.rows.select(ROW, "rowsize").withColumn("__count", count).filter("__count > 0").withColumn("__skip", skip)
    at = F.col(OBS) - F.col("__skip")
    low = F.greatest(F.ceil((at - length + 1) / stride), F.lit(0))
    high = F.least(F.floor(at / stride), F.col("__count") - 1)
    dealt = frame.obs.join(sized.select(ROW, "__count", "__skip"), ROW).withColumn("__low", low).withColumn("__high", high).filter((at >= 0) & (F.col("__low") <= F.col("__high")))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence("__low", "__high")))
    return dealt.withColumn("place", at - F.col("chunk") * stride).drop("__count", "__skip", "__low", "__high")


def chunk_arrays(values: str, length: int, overlap: int = 0, align: str = "start") -> Column:
    """Array of windows of an array column, for data in nested form."""
    stride = length - overlap
    if align not in ("start", "middle", "end"):
        raise ValueError("align must be start, middle or end")
    n = F.size(values)
    count = F.greatest(F.floor((n - length) / stride) + 1, F.lit(0)).cast("int")
    spare = n - ((count - 1) * stride + length)
    skip = {"start": F.lit(0), "middle": F.floor(spare / 2), "end": spare}[align].cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(F.col(values), (i * stride + skip + 1).cast("int"), length))


def to_regular(frame: RaggedFrame, column: str, fill: float = float("nan")) -> DataFrame:
    """(row_idx, column): arrays padded at the right to the longest row."""
    most = frame.rows.agg(F.max("rowsize")).first()[0] or 0
    lists = unpack(frame, column)
    return lists.select(ROW, F.concat(F.col(column), F.array_repeat(F.lit(fill).cast(frame.obs.schema[column].dataType), F.lit(most) - F.size(column))).alias(column))


def to_ragged(df: DataFrame, column: str, fill: float | None = None) -> RaggedFrame:
    """Rows of an array column without fill values (NaN and null if None), wherever they stand; numbered anew."""
    good = (lambda x: x.isNotNull() & ~F.isnan(x)) if fill is None else (lambda x: x.isNotNull() & (x != fill))
    clean = df.withColumn(column, F.filter(column, good))
    rows = clean.select(*(c for c in df.columns if c != column), F.size(column).cast("long").alias("rowsize"))
    obs = clean.select(ROW, F.posexplode(column).alias(OBS, column)).withColumn(OBS, F.col(OBS).cast("long"))
    return RaggedFrame(rows, obs)


def sample_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their index: the same at any partitioning; all, with a warning, if fewer."""
    if rows.limit(n + 1).count() <= n:
        warnings.warn("fewer rows than asked for; all are taken", stacklevel=2)
        return rows
    mixed = F.pmod(F.col(ROW) + seed, F.lit(MODULUS))
    for _ in range(2):
        mixed = F.pmod(mixed * FACTOR, F.lit(MODULUS))
    return rows.orderBy(mixed, ROW).limit(n)


#: A multiplicative generator of pseudo-random numbers: its factor and prime modulus.
FACTOR, MODULUS = 48271, 2147483647
