"""What the operators share: the cluster's shared folder, written tables, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, fresh_path, materialize, released, shared_dir

__all__ = ["discard", "fresh_path", "materialize", "released", "shared_dir"]

TYPES = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "int": T.IntegerType()}

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a lower-cased text between which words stand: A-Z fall on a-z, other ASCII but letters and digits on a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def ascii_words(data: bytes) -> list[bytes]:
    """Runs of ASCII letters (lowered), digits and all characters beyond ASCII, of a text in UTF-8."""
    return data.translate(LETTERS).split()


def struct(fields: str) -> T.StructType:
    """A struct type of "name type, ..."; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in map(str.split, fields.split(","))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names count without their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text):
    """Words of a string column; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def files(uri: str):
    """(file system, path) of a URI, for executors that write or range-read files themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write a file so that it appears whole or not at all: ``write(handle)``, then a rename.

    A task that is run again writes the same bytes under the same name.
    """
    system, path = files(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers by the thousand: they are long. A batch size that was set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give freed memory of a worker back to the machine, as its next task may be of another kind."""
    import ctypes

    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        return
