"""Nearest vectors of every row of the table (F12)."""

import numpy as np

from refspark.operators import records
from refspark.plans import record_plans

SF = "/root/testdata/sf0.001"


def test_every_vector_is_a_query(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id is not null").select("vec_id").distinct().count()
    assert record_plans.vectors(spark, SF).select("vec_id").distinct().count() == n


def test_nearest_against_all_pairs_with_ties(spark, monkeypatch):
    monkeypatch.setattr(records, "CORPUS_PART", 7)
    monkeypatch.setattr(records, "QUERY_PART", 5)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    x[5] = 0
    ids = rng.permutation(200)[:90]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame([*rows, (300, None), (301, [1.0])], "vec_id long, embedding array<double>")
    size = np.sqrt((x * x).sum(1))
    u = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
    u, ids = np.vstack((u, np.zeros((2, 4)))), [*ids.tolist(), 300, 301]
    c = np.round(u @ u.T, 9)
    want = {}
    for k, i in enumerate(ids):
        want[i] = min((-c[k, j] + 0.0, ids[j]) for j in range(len(ids)) if j != k)
    got = {r.vec_id: (-r.cosine + 0.0, r.best_id) for r in records.nearest_vectors(df.repartition(3), df, block=40).collect()}
    assert got == want
    assert records.nearest_vectors(df.filter("vec_id = 300"), df.filter("vec_id = 300")).count() == 0
