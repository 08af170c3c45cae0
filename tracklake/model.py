"""Ragged data: many rows (trajectories), each a run of observations of its own length."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ROW, OBS = "row_idx", "obs_idx"


def along() -> WindowSpec:
    """The observations of a row in their order."""
    return Window.partitionBy(ROW).orderBy(OBS)


@dataclass(frozen=True)
class RaggedFrame:
    """Two tables joined by ``row_idx``: ``rows`` (one record a row) and ``obs`` (with ``obs_idx`` from 0 in each row).

    Order is data here: operators that look at neighbours sort by ``obs_idx``, never by arrival.
    ``attrs`` describes the whole; a column's own attributes are its field metadata.
    """

    rows: DataFrame
    obs: DataFrame
    attrs: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_long(df: DataFrame, key: str, order: list[str | Column], row_columns: list[str] | None = None, attrs: dict[str, str] | None = None) -> RaggedFrame:
        """From one table of observations: rows by an integer ``key``, observations by ``order``.

        ``row_columns`` hold the same value all along a row and move to ``rows``.
        """
        w = Window.partitionBy(ROW).orderBy(*order)  # so that filters on rows pass below it
        obs = df.withColumn(ROW, F.col(key).cast("long")).withColumn(OBS, F.row_number().over(w).cast("long") - 1)
        held = row_columns or []
        rows = obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("rowsize"), *(F.first(c, ignorenulls=True).alias(c) for c in held))
        return RaggedFrame(rows, obs.drop(*(c for c in held if c != key)), attrs or {})

    @staticmethod
    def from_nested(df: DataFrame, obs: str = "obs", rowsize: str = "rowsize") -> RaggedFrame:
        """From one record a row with ``obs`` a struct of arrays; scalars inside it are the row's."""
        fields = df.schema[obs].dataType.fields
        arrays = [f.name for f in fields if f.dataType.typeName() == "array"]
        single = [f.name for f in fields if f.name not in arrays]
        if ROW not in df.columns:
            df = df.withColumn(ROW, F.monotonically_increasing_id())
        rows = df.select(ROW, *(c for c in df.columns if c not in (ROW, obs, rowsize)), *(F.col(f"{obs}.{c}").alias(c) for c in single), F.coalesce(F.col(rowsize), F.lit(0)).alias(rowsize) if rowsize in df.columns else F.size(F.col(f"{obs}.{arrays[0]}")).cast("long").alias("rowsize"))
        zipped = F.arrays_zip(*(F.col(f"{obs}.{c}").alias(c) for c in arrays))
        flat = df.select(ROW, F.posexplode(zipped).alias(OBS, "o"))
        return RaggedFrame(rows, flat.select(ROW, F.col(OBS).cast("long").alias(OBS), *(F.col("o").getField(c).alias(c) for c in arrays)))

    def to_nested(self) -> DataFrame:
        """One record a row: its columns, and ``obs`` a struct of arrays in observation order."""
        names = [c for c in self.obs.columns if c not in (ROW, OBS)]
        packed = self.obs.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct(OBS, *names))).alias("o"))
        nested = packed.select(ROW, F.struct(*(F.col(f"o.{c}").alias(c) for c in names)).alias("obs"))
        return self.rows.join(nested, ROW, "left")

    def with_obs(self, **columns: Column) -> RaggedFrame:
        return replace(self, obs=self.obs.withColumns(columns))

    def describe(self, column: str, **attributes: str) -> RaggedFrame:
        """Set attributes of a column, kept with its field."""
        put = lambda df: df.withMetadata(column, {**df.schema[column].metadata, **attributes}) if column in df.columns else df
        return replace(self, rows=put(self.rows), obs=put(self.obs))

    def attributes(self, column: str) -> dict[str, str]:
        """Attributes of a column; empty where none were set."""
        for df in (self.obs, self.rows):
            if column in df.columns:
                return dict(df.schema[column].metadata or {})
        raise ValueError(f"no column {column}")

    def joined(self, columns: list[str] | None = None) -> DataFrame:
        """Observations with columns of their row beside them."""
        held = columns or [c for c in self.rows.columns if c not in (ROW, *self.obs.columns)]
        return self.obs.join(self.rows.select(ROW, *held), ROW)

    def recounted(self) -> RaggedFrame:
        """``rowsize`` counted anew by row, whatever ids the rows carry; rows without observations have 0."""
        sizes = self.obs.groupBy(ROW).agg(F.count(F.lit(1)).alias("rowsize"))
        rows = self.rows.drop("rowsize").join(sizes, ROW, "left").withColumn("rowsize", F.coalesce("rowsize", F.lit(0)))
        return replace(self, rows=rows)
