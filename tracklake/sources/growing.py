"""Ragged tables that take batch after batch: new ids take the next rows, known ones are merged by time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..model import OBS, ROW, RaggedFrame
from ..operators.ragged import ranked
from ..scratch import discard, materialize
from .pointer import Pointer

BUCKETS = 256


class Growing:
    """Observations of many ids, stored by buckets of the id under a folder.

    A batch rewrites the buckets that its ids are in, under a version of its own, and nothing else;
    a pointer file, replaced in one step, says which version of each bucket counts. So
    readers see a batch whole or not at all, files of other buckets keep their bytes, and a batch that
    failed, or was given twice under one name, changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", time: str = "time", buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.time = spark, folder.rstrip("/"), key, time
        self.pointer = Pointer(spark, f"{self.folder}/current.json")
        self.buckets = (self.pointer.get() or {}).get("buckets", buckets)

    def ingest(self, name: str, batch: DataFrame, row_columns: list[str] | None = None) -> bool:
        """Take a batch of observations with the id, the time and data; False if one of this ``name`` was taken before.

        Observations of an id stand by time, of equal times by their other columns. ``row_columns``
        hold the same value along a row; the latest that is not null counts. Observations without an
        id are left out, those without a time stand first. Batches have the columns of the first.
        """
        known = self.pointer.get() or {"buckets": self.buckets, "batches": [], "at": {}, "old": [], "n_rows": 0, "schema": None, "row_columns": row_columns or []}
        if name in known["batches"]:
            return False
        held = known["row_columns"]
        schema = T.StructType.fromJson(known["schema"]) if known["schema"] else None
        wanted = [f.name for f in schema.fields if f.name not in (ROW, OBS)] if schema else [self.key, self.time, *(c for c in batch.columns if c not in (self.key, self.time, ROW, OBS))]
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        new = materialize(batch.select(*wanted).filter(F.col(self.key).isNotNull()).withColumn("bucket_of_id", bucket), "batch")
        touched = sorted(r.bucket_of_id for r in new.select("bucket_of_id").distinct().collect())  # a number a bucket
        version = f"v{len(known['batches']):06d}-{uuid.uuid4().hex[:8]}"
        if touched:
            stored = [f"{self.folder}/{known['at'][str(b)]}/bucket_of_id={b}" for b in touched if str(b) in known["at"]]
            before = self.spark.read.schema(schema).parquet(*stored) if stored else None
            # ids of the batch that no bucket has yet take the next rows, by their first time
            fresh = new.groupBy(self.key).agg(F.min(self.time).alias("first_time"))
            rows = None if before is None else before.groupBy(self.key).agg(F.first(ROW).alias(ROW))
            if rows is not None:
                fresh = fresh.join(rows, self.key, "left_anti")
            numbered = materialize(ranked(fresh, ["first_time", self.key], ROW).select(self.key, (F.col(ROW) + known["n_rows"]).alias(ROW)), "ids")
            numbers = numbered if rows is None else numbered.unionByName(rows.select(self.key, ROW))
            both = new.drop("bucket_of_id") if before is None else new.drop("bucket_of_id").unionByName(before.select(*wanted))
            order = Window.partitionBy(self.key).orderBy(F.col(self.time).asc_nulls_first(), *(c for c in wanted if c not in (self.key, self.time)))
            merged = both.join(numbers, self.key).withColumn(OBS, F.row_number().over(order).cast("long") - 1).select(ROW, OBS, *wanted)
            merged.withColumn("bucket_of_id", bucket).repartition(len(touched), "bucket_of_id").sortWithinPartitions("bucket_of_id", ROW, OBS).write.partitionBy("bucket_of_id").parquet(f"{self.folder}/{version}")
            known["n_rows"] += numbered.count()
            known["schema"] = merged.schema.jsonValue()
            discard(numbered)
        gone = known["old"]
        known["old"] = [f"{known['at'][str(b)]}/bucket_of_id={b}" for b in touched if str(b) in known["at"]]
        known["at"] |= {str(b): version for b in touched}
        known["batches"], known["row_columns"] = [*known["batches"], name], held
        self.pointer.put(known)
        self.pointer.delete([f"{self.folder}/{x}" for x in gone])  # readers of the version before may still be at its files
        discard(new)
        return True

    def frame(self) -> RaggedFrame:
        """All rows in the order of their first times, then ids, whatever order their batches came in."""
        known = self.pointer.get()
        if known is None or not known["at"]:
            raise ValueError("nothing was ingested")
        schema = T.StructType.fromJson(known["schema"])
        obs = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{v}/bucket_of_id={b}" for b, v in sorted(known["at"].items())))
        held = known["row_columns"]
        rows = obs.groupBy(ROW).agg(F.first(self.key).alias(self.key), F.count(F.lit(1)).alias("rowsize"), F.min(self.time).alias("first_time"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(OBS))).alias(c) for c in held))
        rows = ranked(rows.withColumnRenamed(ROW, "stored_row"), ["first_time", self.key], ROW)
        placed = obs.withColumnRenamed(ROW, "stored_row").join(rows.select("stored_row", ROW), "stored_row").drop("stored_row")
        return RaggedFrame(rows.drop("stored_row", "first_time"), placed.drop(self.key, *held))
