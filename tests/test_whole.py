"""Queries without SQL run over all rows at full length."""

import numpy as np

from tracklake.operators import signals
from tracklake.plans import more  # noqa: F401  registers its queries
from tracklake.plans.queries import QUERIES
from tracklake.plans.tables import drifts

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # the second has more than 20 rows of positions


def test_wavelets_of_whole_vectors(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = QUERIES["morse_transform"](spark, SF).toPandas()
    assert len(got) == 6 * sum(map(len, vectors.values())) and set(got.row_idx) == set(vectors)
    parts = dict(list(got.sort_values(["order", "freq_idx", "obs_idx"]).groupby("row_idx")))
    for i in (min(vectors), max(vectors)):
        want = signals.morse_transform(vectors[i], 3.0, 4.0, [0.5, 1.0, 2.0], 2)
        assert np.allclose(parts[i].re + 1j * parts[i].im, np.ravel(want))


def test_positions_of_all_rows(spark):
    rows = {r.row_idx: r["count"] for r in drifts(spark, MORE).obs.groupBy("row_idx").count().collect()}
    for name, times in (("morse_sphere", 2), ("inertial", 1)):
        assert {r.row_idx: r["count"] for r in QUERIES[name](spark, MORE).groupBy("row_idx").count().collect()} == {i: times * n for i, n in rows.items()}
