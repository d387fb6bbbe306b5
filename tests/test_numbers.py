import math
import random

from pyspark.sql import functions as F

from refspark.functions import numbers
from refspark.operators import receipts, records


def test_significant_digits_as_c_writes_them(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 123456789.0, 1234567890.0, 12345678901.0, 0.0001, 0.00001, 9999999999.0, 99999999999.0, 1e-7, 1e100, 1.5e-300, 2.5e22, math.inf, -math.inf, math.nan, 100.0, 1e5]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 14) for _ in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(-1, None)], "i long, x double")
    got = {r.i: (r.a, r.b) for r in df.select("i", numbers.significant(F.col("x")).alias("a"), numbers.exact(F.col("x")).alias("b")).collect()}
    assert got[-1][0] is None
    assert {i: got[i][0] for i in range(len(xs))} == {i: f"{x:.10g}" for i, x in enumerate(xs)}
    assert all(float(got[i][1]) == x or math.isnan(x) for i, x in enumerate(xs) if math.isfinite(x))


def test_series_that_differ_by_little_differ(spark):
    rows = [("a", 1.0), ("b", 1.0 + 1e-7), ("c", 1.0 + 2e-16), ("d", 1.0), ("e", None)]
    df = spark.createDataFrame(rows, "series_id string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    prints = {r.series_id: r.fingerprint for r in records.fingerprint(df).collect()}
    assert prints["a"] == prints["d"] and len({prints[k] for k in "abce"}) == 4
    roots = {r.series_id: r.root for r in receipts.merkle_root(df).collect()}
    assert roots["a"] == roots["c"] == roots["d"] != roots["b"]  # ten digits
    assert roots["e"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
