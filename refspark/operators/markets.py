"""Binary brackets: contract, fees, sizes and the back-test, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf

TAKER = 0.07


def violations(df: DataFrame, underlying: str | None = None) -> DataFrame:
    """df with reasons: what breaks the bracket contract (an empty array is a good row)."""
    price, outcome = F.col("entry_price"), F.col("outcome")
    rules = [
        ("null_id", F.col("event_id").isNull()),
        *([("null_underlying", F.col(underlying).isNull())] if underlying else []),
        ("null_time", F.col("decision_time").isNull() | F.col("close_time").isNull()),
        ("price_range", price.isNull() | ~price.between(0, 1)),
        ("outcome", outcome.isNull() | ~outcome.isin(0, 1)),
        ("close_before_decision", F.col("close_time") < F.col("decision_time")),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])))


def _known(*values: Column) -> Column:
    """None of them is null or NaN. (Spark's greatest and least skip nulls and take NaN as the largest, so a clamp needs a guard.)"""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v.cast("double"))
    return out


def fee_frac(p: Column, rate: float, c: float = 1.0) -> Column:
    """Null for a price that is null or NaN."""
    held = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.when(_known(p), c * rate * held * (1 - held))


def taker_fee(price: Column) -> Column:
    return F.when(_known(price), TAKER * price * (1 - price))


def kelly_size(prob: Column, price: Column, fraction: float, cap: float) -> Column:
    """Null where either is null or NaN; nothing at a price of 1 or over."""
    size = F.least(F.lit(cap), fraction * F.greatest(F.lit(0.0), F.try_divide(prob - price, 1 - price)))
    return F.when(_known(prob, price), F.when(price >= 1, 0.0).otherwise(size))


def bracket_probability(mu: str, sigma: str, low: str, high: str) -> Column:
    """Mass of a normal within [low, high], which may be infinite; null, an error of the bracket's specification, unless all are known and sigma is above zero."""
    m, s, a, b = (F.expr(x).cast("double") for x in (mu, sigma, low, high))
    z = lambda x: norm_cdf(f"try_divide(CAST({x} AS DOUBLE) - {mu}, CASE WHEN {sigma} > 0 THEN {sigma} END)")
    return F.when(_known(m, s, a, b) & (s > 0), F.expr(f"greatest(0e0, least(1e0, {z(high)} - {z(low)}))"))


def backtest(df: DataFrame, prob: str, least_ev: float = 0.0, most_price: float = 0.9, fraction: float = 0.25, cap: float = 0.1) -> DataFrame:
    """Rows that are traded, with size and net = size x (outcome - price - fee)."""
    p, q = F.col(prob), F.col("entry_price")
    out = df.filter((p - q > least_ev) & (q <= most_price)).withColumn("size", kelly_size(p, q, fraction, cap)).filter("size > 0")
    return out.withColumn("net", F.col("size") * ((F.col("outcome") - q) - taker_fee(q)))
