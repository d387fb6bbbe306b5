"""Properties of the scoring operators on small planted series."""

import math
import random
from statistics import NormalDist

from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf, norm_ppf
from refspark.operators import scores


def net(spark, values):
    return spark.createDataFrame([(k, "f", i + 1, float(v), 1.0) for k, vs in values.items() for i, v in enumerate(vs)], "series_id string, family string, seq int, net double, position double")


def test_normal_functions(spark):
    xs = [-40.0, -8.0, -7.0, -1.5, 0.0, 0.3, 2.0, 7.5, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(norm_cdf("x")).alias("p")).collect()
    assert all(math.isclose(r.p, NormalDist().cdf(r.x), rel_tol=1e-6, abs_tol=1e-15) for r in got)
    got = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.5, 0.9, 0.999)], "p double").select("p", F.expr(norm_ppf("p")).alias("x")).collect()
    assert all(math.isclose(r.x, NormalDist().inv_cdf(r.p), rel_tol=1e-7, abs_tol=1e-8) for r in got)


def test_holdout_does_not_reach_the_gates(spark):
    base = [0.01 * math.sin(7 * i) + 0.002 for i in range(200)]
    other = base[:160] + [9.0] * 40
    a, b = (scores.referee(net(spark, {"s": v})).first() for v in (base, other))
    for c in ("psr", "dsr", "edge_t", "fold_1", "fold_2", "fold_3", "n_oos"):
        assert a[c] == b[c]


def test_short_and_flat_series(spark):
    rows = {r.series_id: r for r in scores.referee(net(spark, {"short": [0.1] * 10, "flat": [0.1] * 200, "one": [0.2]})).collect()}
    assert rows["short"].verdict == rows["one"].verdict == "insufficient_data"
    assert rows["flat"].psr is None and rows["flat"].verdict == "kill"


def test_parts_are_counted_by_rows_whatever_the_numbers_are(spark):
    rng = random.Random(2)
    values = [rng.gauss(0.1, 1) for _ in range(120)]
    frames = {"one": [(k + 1, x) for k, x in enumerate(values)], "zero": list(enumerate(values)), "gaps": [(7 * k - 50, x) for k, x in enumerate(values)]}
    rows = [(name, "f", k, x) for name, xs in frames.items() for k, x in xs]
    net = spark.createDataFrame(rows, "series_id string, family string, seq long, net double")
    got = {r.series_id: r.asDict() for r in scores.score_split(net).collect()}
    same = [{c: round(v, 9) if isinstance(v, float) else v for c, v in got[n].items() if c != "series_id"} for n in frames]
    assert same[0] == same[1] == same[2] and same[0]["n_oos"] == 36
    parts = {(r.part, r.n) for r in scores.part(net.filter("series_id = 'gaps'")).groupBy("part").count().selectExpr("part", "count n").collect()}
    assert parts == {("is", 60), ("oos", 36), ("holdout", 24)}
