"""Importance resampling towards a target: hashed features, gains by bucket, Gumbel noise, a global draw."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ragged import ranked
from .common import ascii_words, discard, materialize, struct, unused

#: Words a feature has at most, buckets, seed of the noise, least words of a document, per cent drawn.
RUNS, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
#: A text with a thousandth of all rows or more is hot; there are a thousand such texts at most, which are broadcast.
HOT = 1000


def hashed(data: bytes, runs: int, buckets: int) -> tuple[int, int, bytes, bytes]:
    """Words, features, and the buckets that features fall in with their counts, packed as 32-bit numbers."""
    words = ascii_words(data)
    names, n = words, len(words)
    for k in range(2, runs + 1):
        names = names + [b" ".join(words[i : i + k]) for i in range(n - k + 1)]
    at, count = np.unique(np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) % buckets, return_counts=True)
    return n, len(names), at.astype("<u4").tobytes(), count.astype("<u4").tobytes()


def collapsed(df: DataFrame, text: str, runs: int, buckets: int) -> DataFrame:
    """A row for each distinct text, written: its digest, copies, words, features and hashed counts.

    Rows are grouped by their full text; copies are added up before the shuffle, so a text of any
    number of rows sends one row a task. Null is the empty text.
    """

    @F.pandas_udf(struct("n_words long, n_features long, buckets binary, counts binary"))
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hashed(x, runs, buckets) for x in texts], columns=["n_words", "n_features", "buckets", "counts"])

    once = df.select(_text(text).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return materialize(once.select(_digest(F.col("text")).alias("digest"), "copies", features(F.col("text").cast("binary")).alias("f")).select("digest", "copies", "f.*"), "texts")


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def bucket_totals(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket; a task sends a row for each of its buckets, the driver gets ``buckets`` numbers."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (np.frombuffer(b"".join(b[c]), "<u4").astype(np.int64) for c in ("buckets", "counts"))
            np.add.at(total, at, n * np.repeat(b["copies"].to_numpy(np.int64), [len(x) // 4 for x in b["buckets"]]))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("copies", "buckets", "counts").mapInPandas(add, struct("bucket long, n long")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log ratio of smoothed shares, rounded down."""
    n, have, want = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (have + n) / ((s + 1.0) * (want + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight) of distinct texts; a text without features weighs 0."""

    @F.pandas_udf("long")
    def weight(at: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([int(gain[np.frombuffer(a, "<u4")] @ np.frombuffer(n, "<u4").astype(np.int64)) for a, n in zip(at, count, strict=True)], dtype="int64")

    return materialize(texts.select("digest", "copies", "n_words", "n_features", weight("buckets", "counts").alias("weight")), "weights")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths of a row's key, the same in each run; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(
    df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", *,
    runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``df``: which rows to draw so that they look like ``target``.

    Identical texts are collapsed first; features and weight are made once for each and multiplied
    by its copies in all counts. Weights go back to rows by the text's digest: hot texts, a
    thousand at most, by a broadcast, the others by a join. The ``percent`` of rows with ``least``
    words or more that have the highest scores get ranks from 1, ties by the smaller id; the order
    is global, by range partition, of numbers only.

    Null texts are empty, weigh 0 and are not drawn. A null id has the noise of an empty one and
    stands before others at a tie. Repeated rows each get a rank of their own. Without target
    texts all gains come from the source alone; without rows there are none. Other columns of
    ``df`` do not go on, so no name can clash.
    """
    texts = collapsed(df, text, runs, buckets)
    wanted = collapsed(target, target_text, runs, buckets)
    weights = weighted(texts, gains(bucket_totals(texts, buckets), bucket_totals(wanted, buckets)))
    discard(texts, wanted)
    rows = materialize(df.select(F.col(doc_id).alias("id"), _digest(_text(text)).alias("digest")), "digests")
    is_hot = F.col("copies") * HOT >= rows.count()
    hot, many = weights.filter(is_hot), weights.filter(~is_hot)
    few = F.broadcast(hot.select("digest"))
    joined = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(few, "digest", "left_anti").join(many, "digest"))
    scored = materialize(joined.select("id", "digest", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")), "scores")
    discard(rows, weights)
    n = scored.filter(F.col("n_words") >= least).count()
    # equal rows stand in the order of the written table, which is the same whenever it is read
    order = scored.filter(F.col("n_words") >= least).withColumn("down", -F.col("score")).withColumn("place", F.monotonically_increasing_id())
    rank = F.col("before") + 1
    drawn = ranked(order, ["down", "id", "digest", "place"], "before").withColumn("rank", F.when(rank <= percent * n // 100, rank))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    keep = [F.col("id").alias(doc_id), "n_features", "weight", "score", "rank"]
    return drawn.select(*keep).unionByName(rest.select(*keep))


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that the draw takes, with all their columns, whatever their names.

    Rows come back by their id: those that share the id of a drawn row come with it, and rows
    without an id do not. Null and empty texts are never drawn by themselves.
    """
    key = unused(df, "drawn_id")
    ids = importance(df, target, doc_id, text, **options).filter("rank IS NOT NULL").select(F.col(doc_id).alias(key)).distinct()
    return df.join(ids, F.col(doc_id) == F.col(key), "left_semi")
