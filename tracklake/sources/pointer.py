"""A small JSON file that is replaced in one step and says which files count."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Pointer:
    """A file in any store that Spark writes to; readers get the old content or the new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(sc._jsc.hadoopConfiguration())

    def get(self) -> dict | None:
        at, system = self._at(self.path)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, content: dict) -> None:
        sc = self.spark.sparkContext
        (new, system), (at, _) = self._at(f"{self.path}.new"), self._at(self.path)
        out = system.create(new, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration()).rename(system.makeQualified(new), system.makeQualified(at), how)

    def delete(self, paths: list[str]) -> None:
        """Delete files and folders that nothing points to any more."""
        for path in paths:
            at, system = self._at(path)
            system.delete(at, True)
