"""The scalar functions as temporary SQL functions, without Python: `register_sql(spark)`, then `spark.sql("select fee_frac(0.4, 0.07, 1)")`."""

from __future__ import annotations

from pyspark.sql import SparkSession

from refspark.functions.normal import norm_cdf, norm_ppf
from refspark.operators.scores import deflation_benchmark

_P = "least(greatest(p, 1e-4), 1 - 1e-4)"


def register_sql(spark: SparkSession) -> list[str]:
    """Create normal_cdf, normal_ppf, fee_frac, kelly_size, expected_value, psr and dsr in this session; their names."""
    made = {
        "normal_cdf(x DOUBLE)": norm_cdf("x"),
        "normal_ppf(q DOUBLE)": norm_ppf("q"),
        "fee_frac(p DOUBLE, rate DOUBLE, c DOUBLE)": f"CASE WHEN p IS NOT NULL AND NOT isnan(p) THEN c * rate * {_P} * (1 - {_P}) END",
        "expected_value(prob DOUBLE, price DOUBLE)": "prob - price",
        "kelly_size(prob DOUBLE, price DOUBLE, fraction DOUBLE, cap DOUBLE)": "CASE WHEN prob IS NULL OR price IS NULL OR isnan(prob) OR isnan(price) OR fraction IS NULL OR cap IS NULL THEN NULL WHEN price >= 1 THEN 0D ELSE least(cap, fraction * greatest(0D, (prob - price) / (1 - price))) END",
        "psr(sr DOUBLE, n DOUBLE, skew DOUBLE, kurt DOUBLE, bench DOUBLE)": norm_cdf("((sr - bench) * sqrt(n - 1) / sqrt(CASE WHEN skew * sr + kurt IS NOT NULL THEN greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr) END))"),
    }
    made["dsr(sr DOUBLE, n DOUBLE, skew DOUBLE, kurt DOUBLE, trials DOUBLE, variance DOUBLE)"] = f"psr(sr, n, skew, kurt, {deflation_benchmark('trials', 'variance')})"
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    return [h.split("(")[0] for h in made]
