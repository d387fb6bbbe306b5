import math
import random
from fractions import Fraction

import numpy as np
import pytest

from refspark.llm import whitening as w

SF = "/root/testdata/sf0.001"


def determinant(m):
    """By Fractions, plainly."""
    a, out = [[Fraction(v) for v in row] for row in m], Fraction(1)
    for c in range(len(a)):
        pivot = next((r for r in range(c, len(a)) if a[r][c]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != c:
            a[c], a[pivot], out = a[pivot], a[c], -out
        out *= a[c][c]
        for r in range(c + 1, len(a)):
            f = a[r][c] / a[c][c]
            a[r] = [x - f * y for x, y in zip(a[r], a[c], strict=True)]
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomial_is_the_determinant(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-9, 10, (d, max(1, d - 2)))  # with zero eigenvalues
    m = (a @ a.T).tolist()
    poly = w.characteristic_polynomial(spark, m)
    for t in (-3, 0, 5, 1000):
        assert sum(c * t**k for k, c in enumerate(poly)) == determinant([[(t if i == j else 0) - v for j, v in enumerate(row)] for i, row in enumerate(m)])


def test_roots_with_multiplicity_and_tiny_gaps():
    def product(pairs):
        poly = [1]
        for root, k in pairs:
            for _ in range(k):
                poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
        return poly

    pairs = [(10**15 + 1, 1), (10**15, 2), (77, 3), (5, 1), (0, 2)]
    got = w.roots(product(pairs), 10**17, 9)
    assert [(round(v), k) for v, k, _ in got] == pairs[:-1]
    assert all(abs(v - r) <= Fraction(1, 1 << 90) and 0 < g <= 10**15 for (v, _, g), (r, _) in zip(got, pairs, strict=False))
    assert [k for _, k, _ in w.roots(product(pairs), 10**17, 2)] == [1, 2]
    assert w.roots([0, 0, 1], 5, 2) == []


def test_null_vectors_of_close_and_double_roots(spark):
    m = [[10**15, 1, 0], [1, 10**15, 0], [0, 0, 10**15 - 1]]  # 10^15 + 1, and 10^15 - 1 twice
    poly = w.characteristic_polynomial(spark, m)
    found = w.roots(poly, 3 * 10**15 - 1, 3)
    assert [(round(v), k) for v, k, _ in found] == [(10**15 + 1, 1), (10**15 - 1, 2)]
    v = w.components(spark, m, found)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.allclose(np.abs(v[0]), [math.sqrt(0.5), math.sqrt(0.5), 0], atol=1e-15)
    assert np.allclose(v[1:] @ v[0], 0, atol=1e-15)


def plain(rows):
    """By exact sums and numpy's eigenvectors: vec_id -> (deviation, coordinates), shares."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    scatter = np.array([[float(Fraction(sum((n * r[i] - total[i]) * (n * r[j] - total[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(scatter)
    e, v = e[::-1], v[:, ::-1]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, total, strict=True)] for r in x])
    return [i for i, _ in good], [sum((n * c - s) ** 2 for c, s in zip(r, total, strict=True)) for r in x], centred @ v, e


def test_digest_against_plain_arithmetic(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(80)]
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [1.0, float("nan")] + [0.0] * 4), (903, [float("inf")] + [0.0] * 5), rows[3], (None, rows[4][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as whitened", "1 as deviation", "2 as n").repartition(4)
    got = w.whitening_digest(vectors).collect()
    ids, deviation, projected, e = plain(rows)
    assert len(got) == 6 * len(ids) == 6 * 82
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[k + 1] for k in range(6)], e / e.sum(), rtol=1e-12)
    assert {r.n for r in got} == {82} and max(r.identity_error for r in got) < 1e-12
    for k in range(6):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, abs(r.whitened)) for r in got if r.component == k + 1)
        want = sorted((i is None, i or 0, s, abs(p)) for i, s, p in zip(ids, deviation, projected[:, k] / math.sqrt(e[k]), strict=True))
        assert [m[:3] for m in mine] == [x[:3] for x in want]
        assert np.allclose([m[3] for m in mine], [x[3] for x in want], atol=1e-9)


def test_whole_table_is_white(spark):
    got = w.whitening_digest(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert wide.shape[1] == 32
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-9 and got.identity_error.max() < 1e-9
    assert (np.diff(got.drop_duplicates("component").sort_values("component").explained) <= 0).all()


def test_odd_tables(spark):
    fields = "vec_id long, embedding array<float>"
    assert w.whitening_digest(spark.createDataFrame([], fields)).count() == 0
    assert w.whitening_digest(spark.createDataFrame([(1, None), (2, [])], fields)).count() == 0
    one = w.whitening_digest(spark.createDataFrame([(1, [0.5, 2.0])], fields)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = w.whitening_digest(spark.createDataFrame([(1, [0.0, 1.0, 5.0]), (2, [1.0, 0.0, 5.0]), (3, [2.0, 2.0]), (4, [1.0, 0.0, 5.0])], fields)).collect()
    assert {r.vec_id for r in flat} == {1, 2, 4} and {r.component for r in flat if r.whitened is None} == {2, 3} and {r.explained for r in flat} == {1.0, 0.0}


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(v), float(v * v % 10**15), 0.0]) for i, v in enumerate((10**13, -(10**13) + 7, 3, 123456789012))]
    vectors = w.finite(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding")
    by = w.fit(vectors, "embedding")
    x = [[math.floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(r[j] for r in x) for j in range(3)]
    assert by.total == total
    assert w.scatter(vectors, "embedding", 4, total, 64, 1_000_000) == [[4 * sum(r[i] * r[j] for r in x) - total[i] * total[j] for j in range(3)] for i in range(3)]
    assert all(r.deviation is None or r.deviation == sum((4 * c - s) ** 2 for c, s in zip(x[r.vec_id], total, strict=True)) for r in w.whiten(vectors, by, ["vec_id"]).collect())
