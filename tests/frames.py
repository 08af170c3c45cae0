"""Small ragged frames."""

from tracklake.model import RaggedFrame


def frame(spark, rows: list[dict], obs: list[list[dict]]) -> RaggedFrame:
    r = [{"row_idx": i, "rowsize": len(o)} | row for i, (row, o) in enumerate(zip(rows, obs, strict=True))]
    o = [{"row_idx": i, "obs_idx": k} | x for i, part in enumerate(obs) for k, x in enumerate(part)]
    return RaggedFrame(spark.createDataFrame(r), spark.createDataFrame(o))


def of(spark, *rows: list[float], name: str = "x") -> RaggedFrame:
    return frame(spark, [{} for _ in rows], [[{name: v} for v in row] for row in rows])


def values(df, *columns: str) -> list:
    return [tuple(x) for x in df.orderBy("row_idx", *(c for c in ("chunk", "segment", "obs_idx", "place") if c in df.columns)).select(*columns).collect()]
