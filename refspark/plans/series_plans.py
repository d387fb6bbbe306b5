"""Queries of the series, panel and bracket operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf
from refspark.operators import markets as m
from refspark.operators import series as o
from refspark.operators import scan
from refspark.plans import views
from refspark.plans.score_plans import rounded

_TICKS = "ticks AS (SELECT event_type AS series_id, ts, value, event_id FROM events)"
_W = "(PARTITION BY series_id ORDER BY ts)"


def ticks(s, d):
    return views.table(s, d, "events").selectExpr("event_type series_id", "ts", "value", "event_id")


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _roll(agg: str, n: int = 20) -> str:
    w = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(value) OVER {w} = {n} THEN {agg} OVER {w} END"


def asof_query(s, d):
    orders = views.table(s, d, "orders").selectExpr("o_custkey entity", "o_orderdate ts", "o_totalprice val")
    days = views.table(s, d, "customer").selectExpr("c_custkey entity", "timestamp'1997-06-30' ts")
    return o.asof(days, orders, "entity", "ts", "val")


def align_query(s, d):
    p = views.pairs(s, d)
    return rounded(o.align_lead(p.drop("y"), p.drop("x"), 5), "series_id", "ts", "x", "target_time", y_h=4)


def book_query(s, d):
    return rounded(o.dollar_neutral_book(views.panel(s, d), "characteristic", "ret"), "ts", port_return=6, gross=6)


# Prices, probabilities and parameters with gaps, in both engines' SQL: a null or NaN anywhere must come out as null.
PRICE = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 17 = 0 THEN 1e0 ELSE entry_price END"
PROB = "CASE WHEN part % 11 = 0 THEN NULL WHEN part % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 0.6e0 END"
MU = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE mu END"
SIGMA = "CASE event_id % 6 WHEN 0 THEN 0e0 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN NULL WHEN 3 THEN -1e0 WHEN 4 THEN 0.5e0 ELSE 1e0 END"
LOW = "CASE WHEN event_id % 5 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE 0e0 END"


def fees_and_sizes(s, d):
    b = views.bracket(s, d).selectExpr("event_id", "line", "part", "size", f"{PRICE} price", f"{PROB} prob")
    price, prob = F.col("price"), F.col("prob")
    return b.select("event_id", "line", "part", "size", F.round(m.fee_frac(price, 0.07), 6).alias("fee"), F.round(m.taker_fee(price), 6).alias("taker"), F.round(m.kelly_size(prob, price, 0.25, 0.1), 6).alias("kelly"))


def bracket_probabilities(s, d):
    b = views.bracket(s, d).groupBy("event_id").agg(F.max("mu").alias("mu")).selectExpr("event_id", f"{MU} mu", f"{SIGMA} sigma", f"{LOW} low")
    return b.select("event_id", F.round(m.bracket_probability("mu", "sigma", "low", "1e0"), 6).alias("p"))


QUERIES = {
    "a11_clean_series": lambda s, d: o.clean_series(ticks(s, d), "event_id"),
    "a13_coverage": lambda s, d: o.coverage(ticks(s, d)),
    "d13_per_year": lambda s, d: rounded(o.observations_per_year(ticks(s, d)), "series_id", "n", per_year=4),
    "d15_infer_bpy": lambda s, d: rounded(o.infer_bpy(views.price(s, d)), "series_id", "label", bpy=4),
    "d17_resample_ohlc": lambda s, d: o.resample_ohlc(ticks(s, d), "event_id"),
    "e1_e4_features": lambda s, d: rounded(o.features(views.price(s, d)), "series_id", "ts", lag_1=4, delta_1=4, log_return=6, sum_n=3, mean_n=4, std_n=4, z_n=6),
    "e5_e6_benchmarks": lambda s, d: rounded(o.benchmarks(views.price(s, d)), "series_id", "ts", expanding_mean=4, random_walk=4, forward_vol=6),
    "e8_e9_regimes": lambda s, d: o.regimes(views.price(s, d)).select("series_id", "ts", "trend", "part_of_week"),
    "d10_equity": lambda s, d: rounded(o.equity_curve(views.price(s, d)), "series_id", "ts", equity=5),
    "e16_lagged_pnl": lambda s, d: rounded(o.lagged_pnl(views.price(s, d)), "series_id", "ts", position=1, net=6),
    "d19_ols_single": lambda s, d: rounded(o.ols_single(views.pair(s, d)), "n", beta=4, r=6, r2=6, t=5),
    "c2_c3_align_lead": align_query,
    "c4_asof": asof_query,
    "e10_e12_cross_section": lambda s, d: rounded(o.cross_section(views.panel(s, d), "ret"), "ts", "entity", "bucket", rank_pct=6, z=5),
    "f9_neutral_book": book_query,
    "d26_information_coefficient": lambda s, d: rounded(o.information_coefficient(views.panel(s, d), "characteristic", "ret"), "dates", ic=6),
    "e15_liquidity_screen": lambda s, d: rounded(o.liquidity_screen(views.panel(s, d), 5), "ts", "entity", "k", median=3),
    "a8_bracket_contract": lambda s, d: m.violations(views.bracket(s, d)).select(F.explode_outer("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    "b3_b6_fees_and_sizes": fees_and_sizes,
    "b7_bracket_probability": bracket_probabilities,
    "f7_bracket_backtest": lambda s, d: m.backtest(views.bracket(s, d).withColumn("prob", F.lit(0.6)), "prob").groupBy(F.to_date("close_time").cast("timestamp").alias("day")).agg(F.count("*").alias("trades"), F.round(F.sum("net"), 5).alias("net")),
}
_BR = views.BRACKET_SQL
_K = "CASE WHEN entry_price >= 1 THEN 0 ELSE least(0.1e0, 0.25e0 * greatest(0e0, (0.6e0 - entry_price) / (1 - entry_price))) END"
_PP = "least(greatest(entry_price, 1e-4), 1 - 1e-4)"
SQL = {
    "a11_clean_series": f"WITH {_TICKS} SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_max(value, (ts, event_id)) AS value FROM ticks WHERE value IS NOT NULL GROUP BY ALL",
    "a13_coverage": f"WITH {_TICKS} SELECT series_id, min(ts) AS first, max(ts) AS last, count(value) AS n, count(value) >= 30 AS available FROM ticks GROUP BY ALL",
    "d13_per_year": f"WITH {_TICKS} SELECT series_id, count(value) AS n, round(count(value) / ((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400e0 / 365.25e0), 4) AS per_year FROM ticks GROUP BY ALL",
    "d15_infer_bpy": f"WITH {views.PRICE_SQL}, g AS (SELECT series_id, epoch(ts) - lag(epoch(ts)) OVER {_W} AS gap FROM price), b AS (SELECT series_id, 365.25e0 * 86400 / quantile_cont(gap, 0.5) FILTER (gap > 0) AS bpy FROM g GROUP BY ALL) SELECT series_id, round(bpy, 4) AS bpy, CASE WHEN bpy <= 3 THEN 'annual' WHEN bpy <= 24 THEN 'monthly' WHEN bpy <= 90 THEN 'weekly' WHEN bpy <= 400 THEN 'daily' WHEN bpy <= 5000 THEN 'hourly' ELSE 'intraday' END AS label FROM b",
    "d17_resample_ohlc": f"WITH {_TICKS} SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM ticks WHERE value IS NOT NULL GROUP BY ALL",
    "e1_e4_features": f"WITH {views.PRICE_SQL}, f AS (SELECT series_id, ts, value, lag(value) OVER {_W} AS p, {_roll('sum(value)')} AS s, {_roll('avg(value)')} AS a, {_roll('stddev_samp(value)')} AS d FROM price) SELECT series_id, ts, round(p, 4) AS lag_1, round(value - p, 4) AS delta_1, round(ln(value / p), 6) AS log_return, round(s, 3) AS sum_n, round(a, 4) AS mean_n, round(d, 4) AS std_n, round(CASE WHEN d > 0 THEN (value - a) / d END, 6) AS z_n FROM f",
    "e5_e6_benchmarks": f"WITH {views.PRICE_SQL}, r AS (SELECT *, ln(value / lag(value) OVER {_W}) AS r FROM price) SELECT series_id, ts, round(avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS expanding_mean, round(lag(value) OVER {_W}, 4) AS random_walk, round(stddev_pop(r) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 6) AS forward_vol FROM r",
    "e8_e9_regimes": f"WITH {views.PRICE_SQL}, f AS (SELECT series_id, ts, value, {_roll('avg(value)', 200)} AS a FROM price) SELECT series_id, ts, CASE WHEN a IS NOT NULL THEN CASE WHEN value > a THEN 'above' ELSE 'below' END END AS trend, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS part_of_week FROM f",
    "d10_equity": f"WITH {views.PRICE_SQL} SELECT series_id, ts, round(value / first_value(value) OVER {_W}, 5) AS equity FROM price",
    "e16_lagged_pnl": f"WITH {views.PRICE_SQL}, c AS (SELECT *, value / lag(value) OVER {_W} - 1 AS change FROM price), h AS (SELECT *, lag(sign(change)) OVER {_W} AS position FROM c), k AS (SELECT *, position * change - 0.0005e0 * abs(position - coalesce(lag(position) OVER {_W}, 0)) AS net FROM h) SELECT series_id, ts, CAST(position AS DOUBLE) AS position, round(net, 6) AS net FROM k WHERE net IS NOT NULL",
    "d19_ols_single": f"WITH {views.PAIR_SQL} SELECT count(*) AS n, round(regr_slope(y, x), 4) AS beta, round(corr(y, x), 6) AS r, round(power(corr(y, x), 2), 6) AS r2, round(corr(y, x) * sqrt((count(*) - 2) / greatest(1e-12, 1 - power(corr(y, x), 2))), 5) AS t FROM pair",
    "c2_c3_align_lead": f"WITH {views.PAIRS_SQL}, l AS (SELECT series_id, ts, x, lead(y, 5) OVER {_W} AS y_h, lead(ts, 5) OVER {_W} AS target_time FROM pair), k AS (SELECT *, row_number() OVER {_W} - 1 AS k FROM l WHERE x IS NOT NULL AND y_h IS NOT NULL) SELECT series_id, ts, x, round(y_h, 4) AS y_h, target_time FROM k WHERE k % 5 = 0",
    "c4_asof": "WITH r AS (SELECT o_custkey AS entity, o_orderdate AS ts, max(o_totalprice) AS val FROM orders GROUP BY ALL), l AS (SELECT c_custkey AS entity, TIMESTAMP '1997-06-30' AS ts FROM customer) SELECT l.entity, l.ts, r.val FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts >= r.ts",
    "e10_e12_cross_section": f"WITH {views.PANEL_SQL}, r AS (SELECT *, CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY ts, ret IS NOT NULL ORDER BY ret, entity) END AS k, count(ret) OVER (PARTITION BY ts) AS n, avg(ret) OVER (PARTITION BY ts) AS a, stddev_samp(ret) OVER (PARTITION BY ts) AS d FROM panel) SELECT ts, entity, CASE WHEN k IS NOT NULL THEN CAST(least(10, greatest(1, ceil(k * 10.0e0 / n))) AS INT) END AS bucket, round(k / n, 6) AS rank_pct, round(CASE WHEN n >= 2 AND d > 0 THEN (ret - a) / d END, 5) AS z FROM r",
    "f9_neutral_book": f"WITH {views.PANEL_SQL}, z AS (SELECT ts, ret, (characteristic - avg(characteristic) OVER (PARTITION BY ts)) / (stddev_pop(characteristic) OVER (PARTITION BY ts) + 1e-9) AS z FROM panel WHERE ret IS NOT NULL AND characteristic IS NOT NULL), w AS (SELECT *, z / nullif(sum(abs(z)) OVER (PARTITION BY ts), 0) AS w FROM z) SELECT ts, round(sum(w * ret), 6) AS port_return, round(sum(abs(w)), 6) AS gross FROM w GROUP BY ts",
    "d26_information_coefficient": f"WITH {views.PANEL_SQL}, c AS (SELECT ts, covar_pop(characteristic, ret) AS c, var_pop(characteristic) AS a, var_pop(ret) AS b FROM panel WHERE ret IS NOT NULL GROUP BY ts) SELECT count(*) AS dates, round(avg(c / sqrt(a * b)), 6) AS ic FROM c WHERE a > 0 AND b > 0",
    "e15_liquidity_screen": f"WITH {views.PANEL_SQL}, m AS (SELECT ts, entity, quantile_cont(dvol, 0.5) OVER (PARTITION BY entity ORDER BY year(ts) * 12 + month(ts) RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS med FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY med DESC, entity) AS k FROM m) SELECT ts, entity, k, round(med, 3) AS median FROM k WHERE k <= 5",
    "a8_bracket_contract": f"WITH {_BR}, v AS (SELECT CASE WHEN close_time < decision_time THEN 'close_before_decision' END AS reason FROM bracket) SELECT reason, count(*) AS n FROM v GROUP BY reason",
    "b3_b6_fees_and_sizes": f"""WITH {_BR}, q AS (SELECT event_id, line, part, size, {PRICE} AS price, {PROB} AS prob FROM bracket),
k AS (SELECT *, price IS NOT NULL AND NOT isnan(price) AS priced, CASE WHEN price < 1e-4 THEN 1e-4 WHEN price > 0.9999e0 THEN 0.9999e0 ELSE price END AS held, CASE WHEN price < 1 THEN 0.25e0 * (prob - price) / (1 - price) END AS bet FROM q)
SELECT event_id, line, part, size, CASE WHEN priced THEN round(0.07e0 * held * (1 - held), 6) END AS fee, CASE WHEN priced THEN round(0.07e0 * price * (1 - price), 6) END AS taker,
  CASE WHEN NOT priced OR prob IS NULL OR isnan(prob) THEN NULL WHEN price >= 1 OR bet < 0 THEN 0 WHEN bet > 0.1e0 THEN 0.1e0 ELSE round(bet, 6) END AS kelly FROM k""",
    "b7_bracket_probability": f"""WITH {_BR}, g AS (SELECT event_id, max(mu) AS mu FROM bracket GROUP BY ALL), q AS (SELECT event_id, {MU} AS mu, {SIGMA} AS sigma, {LOW} AS low FROM g),
z AS (SELECT event_id, CASE WHEN sigma > 0 AND NOT isnan(sigma) THEN (low - mu) / sigma END AS a, CASE WHEN sigma > 0 AND NOT isnan(sigma) THEN (1 - mu) / sigma END AS b FROM q)
SELECT event_id, round({norm_cdf('b')} - {norm_cdf('a')}, 6) AS p FROM z""",
    "f7_bracket_backtest": f"WITH {_BR}, t AS (SELECT *, {_K} AS kelly FROM bracket WHERE 0.6e0 - entry_price > 0 AND entry_price <= 0.9e0) SELECT CAST(CAST(close_time AS DATE) AS TIMESTAMP) AS day, count(*) AS trades, round(sum(kelly * ((outcome - entry_price) - 0.07e0 * entry_price * (1 - entry_price))), 5) AS net FROM t WHERE kelly > 0 GROUP BY ALL",
}

QUERIES |= {
    "a12_availability": lambda s, d: o.availability(ticks(s, d).withColumn("series_id", F.concat_ws("-", "series_id", F.col("event_id") % 40)), "2024-01-05", "2024-01-20"),
    "a13_panel_coverage": lambda s, d: o.panel_coverage(views.table(s, d, "events").selectExpr("event_type panel", "to_date(ts) ts", "user_id entity", "value"), "panel"),
    "a13_bracket_coverage": lambda s, d: o.bracket_coverage(views.bracket(s, d), "city"),
    "e1_e2_lagged": lambda s, d: rounded(o.lagged(views.price(s, d), 3), "series_id", "ts", lag_3=4, delta_3=4, log_return_3=6, pct_change=6),
    "e9_calendar_regimes": lambda s, d: o.regimes(ticks(s, d), 3).select("series_id", "event_id", "day_name", "session", "part_of_week"),
    "e13_rebalance_rules": lambda s, d: _union([o.rebalance_dates(views.price(s, d), rule).select(F.lit(rule).alias("rule"), "ts") for rule in ("D", "W", "W-FRI", "W-MON", "M", "2M", "QE", "Y")]),
    "a12_clip_window": lambda s, d: o.clip_window(ticks(s, d), "2024-01-05", "2024-01-20"),
    "d18_resample_agg": lambda s, d: rounded(o.resample_agg(ticks(s, d), "event_id"), "series_id", "day", "last", "first", "count", "max", "min", sum=4, mean=5),
    "e13_rebalance_dates": lambda s, d: o.rebalance_dates(views.price(s, d)),
    "e17_funding_carry": lambda s, d: rounded(o.funding_carry(views.price(s, d).withColumn("value", F.col("value") / 30000 - 1)), "series_id", "ts", position=1, net=6),
}
SQL |= {
    "a12_availability": f"WITH {_TICKS}, g AS (SELECT series_id || '-' || (event_id % 40) AS series_id, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS n FROM ticks GROUP BY ALL) SELECT series_id, n, n >= 30 AS available, CASE WHEN n < 30 THEN 'data_unavailable: ' || n || ' of 30 observations' END AS reason FROM g",
    "a13_panel_coverage": "SELECT event_type AS panel, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(DISTINCT CAST(ts AS DATE)) AS dates, count(DISTINCT user_id) AS entities, count(*) AS cells FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "a13_bracket_coverage": f"WITH {_BR} SELECT city, min(close_time) AS first, max(close_time) AS last, count(DISTINCT event_id) AS events, count(*) AS brackets FROM bracket GROUP BY ALL",
    "e1_e2_lagged": f"WITH {views.PRICE_SQL}, p AS (SELECT *, lag(value, 3) OVER {_W} AS p FROM price) SELECT series_id, ts, round(p, 4) AS lag_3, round(value - p, 4) AS delta_3, round(ln(value / p), 6) AS log_return_3, round(value / p - 1, 6) AS pct_change FROM p",
    "e9_calendar_regimes": f"WITH {_TICKS} SELECT series_id, event_id, dayname(ts) AS day_name, CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'europe' ELSE 'us' END AS session, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS part_of_week FROM ticks",
    "e13_rebalance_rules": f"""WITH {views.PRICE_SQL}, r AS (SELECT 'D' AS rule, CAST(ts AS DATE) AS d FROM price UNION ALL SELECT 'W', CAST(date_trunc('week', ts) AS DATE) + 6 FROM price UNION ALL SELECT 'W-FRI', CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INT) FROM price UNION ALL SELECT 'W-MON', CAST(ts AS DATE) + CAST((8 - isodow(ts)) % 7 AS INT) FROM price UNION ALL SELECT 'M', last_day(ts) FROM price
  UNION ALL SELECT '2M', last_day(make_date(year(ts), CAST(ceil(month(ts) / 2.0) * 2 AS INT), 1)) FROM price UNION ALL SELECT 'QE', last_day(make_date(year(ts), CAST(ceil(month(ts) / 3.0) * 3 AS INT), 1)) FROM price UNION ALL SELECT 'Y', make_date(year(ts), 12, 31) FROM price)
SELECT DISTINCT rule, CAST(d AS TIMESTAMP) AS ts FROM r""",
    "a12_clip_window": f"WITH {_TICKS}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') SELECT series_id, ts, value, event_id FROM c WHERE n >= 30",
    "d18_resample_agg": f"WITH {_TICKS} SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, arg_max(value, (ts, event_id)) AS last, arg_min(value, (ts, event_id)) AS first, count(*) AS count, max(value) AS max, min(value) AS min, round(sum(value), 4) AS sum, round(avg(value), 5) AS mean FROM ticks WHERE value IS NOT NULL GROUP BY ALL",
    "e13_rebalance_dates": "SELECT DISTINCT CAST(last_day(l_shipdate) AS TIMESTAMP) AS ts FROM lineitem",
    "e17_funding_carry": f"WITH {views.PRICE_SQL}, v AS (SELECT series_id, ts, value / 30000 - 1 AS value FROM price), p AS (SELECT *, CAST(sign(lag(value) OVER {_W}) AS DOUBLE) AS position FROM v), k AS (SELECT *, position * value - CASE WHEN position <> coalesce(lag(position) OVER {_W}, 0) THEN 0.0005e0 ELSE 0 END AS net FROM p) SELECT series_id, ts, position, round(net, 6) AS net FROM k WHERE net IS NOT NULL",
}

_BLOCK = 300  # so that the series of the smallest table are in several blocks


def split_features(s, d):
    """The features of e1_e4, each series in blocks, and the expanding mean over ranges."""
    f = scan.in_blocks(views.price(s, d), o.features, ["ts"], 20, 0, _BLOCK)
    return rounded(f, "series_id", "ts", lag_1=4, delta_1=4, log_return=6, sum_n=3, mean_n=4, std_n=4, z_n=6)


def split_benchmarks(s, d):
    p = views.price(s, d)
    past = scan.running(p, ["series_id"], ["ts"], {"s": ("sum", F.col("value")), "n": ("count", F.col("value"))}, exclusive=True).select("series_id", "ts", F.try_divide("s", "n").alias("expanding_mean"))
    near = scan.in_blocks(p, lambda t: o.benchmarks(t).drop("expanding_mean"), ["ts"], 1, 6, _BLOCK)
    return rounded(near.join(past, ["series_id", "ts"]), "series_id", "ts", expanding_mean=4, random_walk=4, forward_vol=6)


def split_equity(s, d):
    steps = scan.in_blocks(views.price(s, d), lambda t: o.lagged(t), ["ts"], 1, 0, _BLOCK).withColumn("step", F.coalesce(1 + F.col("pct_change"), F.lit(1.0)))
    return rounded(scan.running(steps, ["series_id"], ["ts"], {"equity": ("product", F.col("step"))}), "series_id", "ts", equity=5)


def split_pnl(s, d):
    return rounded(scan.in_blocks(views.price(s, d), o.lagged_pnl, ["ts"], 3, 0, _BLOCK), "series_id", "ts", "position", net=6)


def split_drawdowns(s, d):
    return rounded(scan.drawdowns(views.net(s, d)), "series_id", max_drawdown=6)


def split_numbers(s, d):
    """Places of ticks in their series, few series and many rows."""
    return scan.numbered(views.table(s, d, "events").selectExpr("event_type series_id", "ts", "event_id"), ["series_id"], ["ts", "event_id"]).select("series_id", "event_id", "k")


QUERIES |= {"e1_e4_split_features": split_features, "e5_e6_split_benchmarks": split_benchmarks, "d10_split_equity": split_equity, "e16_split_pnl": split_pnl, "d9_split_drawdown": split_drawdowns, "c2_split_numbers": split_numbers}
SQL |= {
    "e1_e4_split_features": SQL["e1_e4_features"],
    "e5_e6_split_benchmarks": SQL["e5_e6_benchmarks"],
    "d10_split_equity": SQL["d10_equity"],
    "e16_split_pnl": SQL["e16_lagged_pnl"],
    "d9_split_drawdown": f"WITH {views.NET_SQL}, e AS (SELECT *, sum(net) OVER (PARTITION BY series_id ORDER BY seq) AS eq FROM net), f AS (SELECT *, max(eq) OVER (PARTITION BY series_id ORDER BY seq) - eq AS down FROM e) SELECT series_id, round(max(down), 6) AS max_drawdown FROM f GROUP BY ALL",
    "c2_split_numbers": "SELECT event_type AS series_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events",
}
