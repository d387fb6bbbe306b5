"""Computations in ranges and blocks against windows over whole series."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.operators import claims, scan, scores, series


@pytest.fixture(scope="module")
def rows(spark):
    """One series with most of the rows, others of few, one with ties in time, one with nulls, and a null key."""
    rng = random.Random(2)
    out = [("long", k, rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))]) if k % 7 == 0 else rng.gauss(0, 1)) for k in range(1500)]
    out += [("b", k, float(k % 3)) for k in range(40)] + [("one", 0, 2.0), ("nulls", 0, None), ("nulls", 1, None)] + [(None, k, float(-k)) for k in range(9)]
    rng.shuffle(out)
    return spark.createDataFrame(out, "series_id string, seq long, value double").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(seq)) ts").repartition(5)


def same(got, want, key=("series_id", "seq"), places=9):
    plain = lambda df: sorted(([round(x, places) + 0.0 if isinstance(x, float) else x for x in r] for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert plain(got) == plain(want)


def test_numbers(rows):
    want = rows.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy("seq")).cast("long") - 1)
    same(scan.numbered(rows, ["series_id"], ["seq"]), want)
    ranges = scan.ranged(rows, ["series_id"], ["seq"])
    assert ranges.filter("series_id = 'long'").select(scan.RANGE).distinct().count() > 3  # the long series is in many tasks
    assert scan.numbered(rows.limit(0), ["series_id"], ["seq"]).count() == 0


@pytest.mark.parametrize("exclusive", [False, True])
def test_running(rows, exclusive):
    w = W.partitionBy("series_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    v = F.col("value")
    states = {"s": ("sum", v), "n": ("count", v), "lo": ("min", v), "hi": ("max", v), "l": ("last", v), "p": ("product", F.when(v > 0, v).otherwise(1.0))}
    made = {"s": F.sum(v), "n": F.count(v), "lo": F.min(v), "hi": F.max(v), "l": F.last(v, ignorenulls=True), "p": F.product(F.when(v > 0, v).otherwise(1.0))}
    same(scan.running(rows.withColumn("s", F.lit("clash")), ["series_id"], ["seq"], states, exclusive).drop("p"), rows.withColumns({n: c.over(w) for n, c in made.items()}).drop("p"))
    got = {(r.series_id, r.seq): r.p for r in scan.running(rows, ["series_id"], ["seq"], states, exclusive).collect()}
    want = {(r.series_id, r.seq): r.p for r in rows.withColumn("p", made["p"].over(w)).collect()}
    assert got.keys() == want.keys() and all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) <= 1e-9 * abs(want[k])) for k, a in got.items())


@pytest.mark.parametrize("size", [20, 64, 10_000])
def test_blocks(rows, size):
    r = rows.filter("series_id is not null and value is not null")
    for work, before, after in ((lambda t: series.features(t, 20), 20, 0), (series.lagged, 1, 0), (lambda t: series.benchmarks(t, 5).drop("expanding_mean"), 1, 6), (series.lagged_pnl, 3, 0)):
        same(scan.in_blocks(r, work, ["seq"], before, after, size), work(r))
    with pytest.raises(ValueError, match="block"):
        scan.in_blocks(r, series.features, ["seq"], size + 1, 0, size)


def test_drawdowns(rows):
    n = rows.filter("series_id is not null").withColumn("net", F.col("value"))
    want = {r.series_id: r.max_drawdown for r in scores.max_drawdown(n).collect()}
    got = {r.series_id: r.max_drawdown for r in scan.drawdowns(n).collect()}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(want[k]) if want[k] is not None else a in (None, 0.0) for k, a in got.items())


def test_earlier_against_counting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 200):
        for _ in range(5):
            x = rng.integers(0, max(1, n // 3) + 1, n).astype(float)
            lower, upto = scan.earlier(x)
            assert lower.tolist() == [sum(x[j] < x[i] for j in range(i)) for i in range(n)]
            assert upto.tolist() == [sum(x[j] <= x[i] for j in range(i)) for i in range(n)]


def test_expanding_ranks(rows):
    r = rows.filter("value is not null and series_id is not null").select("series_id", "seq", F.round("value", 1).alias("value"))
    by = {}
    for x in r.orderBy("series_id", "seq").collect():
        by.setdefault(x.series_id, []).append(x.value)
    got = scan.expanding_ranks(r, ["series_id"], ["seq"], "value").collect()
    assert len(got) == r.count()
    for x in got:
        past = by[x.series_id][: x.k]
        assert (x.below, x.upto) == (sum(p < x.value for p in past), sum(p <= x.value for p in past))
    assert scan.expanding_ranks(r.limit(0), ["series_id"], ["seq"], "value").count() == 0


def test_regimes_of_volatility_against_sorted_lists(spark):
    from bisect import insort

    rng = random.Random(6)
    rows = [(s, k, round(100 * (1 + 0.1 * rng.random()), 1)) for s, n in (("a", 500), ("b", 130), ("c", 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "series_id string, k long, value double").selectExpr("series_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(k)) ts", "value")
    vol = {}
    for r in df.withColumn("r", F.log(F.col("value") / F.lag("value").over(series.over()))).withColumn("vol", series.full(10, F.stddev_samp("r"), "r")).filter("vol is not null").orderBy("series_id", "ts").collect():
        vol.setdefault(r.series_id, []).append((r.ts, r.vol))
    want = set()
    for s, xs in vol.items():
        seen = []
        for ts, x in xs:
            insort(seen, x)
            n = len(seen)
            if n >= 30:
                low, high = np.quantile(seen, [1 / 3, 2 / 3])
                want.add((s, ts, "high_vol" if x >= high - 1e-15 else "low_vol" if x <= low + 1e-15 else "mid_vol"))
    assert {tuple(r) for r in claims.vol_regime(df, 10, 30).collect()} == want and len(want) > 500


def test_folds_keep_their_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(8)
        rows = [(rng.choice(["a", "b", None]), k, rng.randrange(10)) for k in range(200)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, k long, x long").withColumn("kept", F.lit("clash"))
        step = lambda last, row: (row[2], (True, last)) if last is None or row[2] > last else (last, (False, last))
        got = {(r.key, r.k): (r.kept, r.before) for r in scan.folded(df, ["key"], ["k"], "kept boolean, before bigint", None, step).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for key, k, x in sorted(rows, key=lambda r: r[1]):
        before = last.get(key)
        want[key, k] = (before is None or x > before, before)
        last[key] = x if want[key, k][0] else before
    assert got == want
    assert scan.folded(df.limit(0), ["key"], ["k"], "kept boolean", None, lambda s, r: (s, (True,))).count() == 0
