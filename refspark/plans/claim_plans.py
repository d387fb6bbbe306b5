"""Queries of the claim executors and of the gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import claims as c
from refspark.operators import gates as g
from refspark.operators import scores
from refspark.operators import series as o
from refspark.plans import views
from refspark.plans.score_plans import _PART, _SCORES, rounded

WINDOWS = [("1997-01-01", "1997-06-30"), ("1999-07-01", "1999-12-31")]
REPS = 2000


def regression(s, d):
    p = views.pairs(s, d)
    return rounded(c.predictive_regression(o.align_lead(p.drop("y"), p.drop("x"), 5), ("series_id",)), "series_id", "ts", position=5, net=5)


def factors(s, d):
    """Net results with two daily factors: the deviations of orders and of mean prices from fixed levels."""
    days = views.pair(s, d).selectExpr("to_date(ts) day", "x / 100 a", "y / 1000000 b")
    return views.net(s, d).withColumn("day", F.to_date("ts")).join(days, "day")


def returns(s, d):
    return views.price(s, d).selectExpr("series_id", "ts", "ts seq", "ln(value / lag(value) over (partition by series_id order by ts)) ret")


def price_signal(s, d):
    change = F.col("value") / F.lag("value").over(o.over()) - 1
    return rounded(c.signal_pnl(views.price(s, d), change), "series_id", "ts", position=1, net=6)


QUERIES = {
    "e7_vol_regime": lambda s, d: c.vol_regime(views.price(s, d)),
    "e14_momentum": lambda s, d: rounded(c.momentum(views.panel(s, d)), "entity", "ts", momentum=6),
    "e19_signal_pnl": price_signal,
    "f1_predictive_regression": regression,
    "f3_form_factor": lambda s, d: rounded(c.form_factor(views.panel(s, d), "characteristic", "ret")[0], "ts", net=6),
    "f3_membership": lambda s, d: c.form_factor(views.panel(s, d), "characteristic", "ret")[1],
    "f6_forecast_skill": lambda s, d: rounded(c.forecast_skill(views.price(s, d), F.lag("value").over(o.over()), 5), "series_id", "ts", net=1),
    "d20_d22_two_factor": lambda s, d: rounded(c.exposure_decomposition(c.two_factor(factors(s, d), "net", "a", "b", ("series_id",))), "series_id", "n", "survives", intercept=6, beta_a=5, beta_b=5, mean=6),
    "d23_crisis_leave_one_out": lambda s, d: rounded(c.crisis_leave_one_out(views.net(s, d), WINDOWS), "series_id", "dominated", base_mean=7, without_0=7, without_1=7),
    "d43_best_of_k": lambda s, d: rounded(c.best_of_k(views.net(s, d)), "family", "series_id", "k", sharpe=5),
    "g1_block_bootstrap": lambda s, d: rounded(g.block_bootstrap(views.net(s, d), REPS), "series_id", "n", "includes_zero", edge_lo=7, edge_hi=7, p_positive=5, sharpe_lo=5, sharpe_hi=5, drawdown_median=6, drawdown_p95=6),
    "g2_permutation_test": lambda s, d: rounded(g.permutation_test(views.net(s, d), REPS), "series_id", observed=7, p=5),
    "g4_cpcv": lambda s, d: rounded(g.cpcv(views.net(s, d)), "series_id", "paths", "overfit", median_sharpe=5, p_loss=5),
    "g7_regime_buckets": lambda s, d: rounded(g.regime_buckets(views.net(s, d)), "series_id", "scheme", "label", "n", mean=7),
    "g7_drop_best": lambda s, d: rounded(g.drop_best_regime(views.net(s, d)), "series_id", "scheme", "best", "concentrated", rest_mean=7),
    "g16_sign_flip_null": lambda s, d: rounded(g.sign_flip_null(returns(s, d)), "series_id", "block", mean=7, sd=7, p95=7),
}


_N, _P, _W = views.NET_SQL, views.PRICE_SQL, "(PARTITION BY series_id ORDER BY ts)"
_M = "year(ts) * 12 + month(ts)"
_FORM = f"""{views.PANEL_SQL}, x AS (SELECT *, {_M} AS m FROM panel), y AS (SELECT *, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY characteristic, entity) AS k FROM x WHERE characteristic IS NOT NULL),
mem AS (SELECT CAST(last_day(ts) AS TIMESTAMP) AS rb, m, entity, CAST(least(10, greatest(1, ceil(k * 10e0 / n))) AS INT) AS bucket FROM y WHERE n >= 20)"""
_BUCKETS = f"""{_N}, v AS (SELECT series_id, net, ts, count(*) OVER (PARTITION BY series_id) AS n FROM net),
u AS (SELECT series_id, net, 'part_of_week' AS scheme, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS label FROM v WHERE n >= 24 UNION ALL SELECT series_id, net, 'day_of_week', CAST(dayofweek(ts) + 1 AS VARCHAR) FROM v WHERE n >= 24),
b AS (SELECT series_id, scheme, label, count(*) AS n, avg(net) AS mean FROM u GROUP BY ALL HAVING count(*) >= 8)"""
_CRISIS = [f"avg(net) FILTER (NOT ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}')" for a, b in WINDOWS]

SQL = {
    "e7_vol_regime": f"WITH {_P}, r AS (SELECT *, ln(value / lag(value) OVER {_W}) AS r FROM price), v AS (SELECT series_id, ts, CASE WHEN count(r) OVER f = 60 THEN stddev_samp(r) OVER f END AS vol FROM r WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), q AS (SELECT *, count(*) OVER f AS n, quantile_cont(vol, 1e0 / 3) OVER f AS lo, quantile_cont(vol, 2e0 / 3) OVER f AS hi FROM v WHERE vol IS NOT NULL WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT series_id, ts, CASE WHEN vol >= hi THEN 'high_vol' WHEN vol <= lo THEN 'low_vol' ELSE 'mid_vol' END AS label FROM q WHERE n >= 120",
    "e14_momentum": f"WITH {views.PANEL_SQL}, m AS (SELECT entity, ts, {_M} AS m, sum(ret) AS r FROM panel GROUP BY ALL) SELECT entity, ts, round(CASE WHEN count(r) OVER w = 12 THEN exp(sum(r) OVER w) - 1 END, 6) AS momentum FROM m WINDOW w AS (PARTITION BY entity ORDER BY m RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)",
    "e19_signal_pnl": f"WITH {_P}, c AS (SELECT *, value / lag(value) OVER {_W} - 1 AS r FROM price), h AS (SELECT *, CAST(sign(r) AS DOUBLE) AS position FROM c), k AS (SELECT series_id, ts, position, position * lead(r) OVER {_W} - CASE WHEN position <> coalesce(lag(position) OVER {_W}, 0) THEN 0.0005e0 ELSE 0 END AS net FROM h) SELECT series_id, ts, position, round(net, 6) AS net FROM k WHERE net IS NOT NULL",
    "f1_predictive_regression": f"""WITH {views.PAIRS_SQL}, l AS (SELECT series_id, ts, x, lead(y, 5) OVER {_W} AS y_h, lead(ts, 5) OVER {_W} AS target_time FROM pair), j AS (SELECT *, row_number() OVER {_W} - 1 AS j FROM l WHERE y_h IS NOT NULL),
a AS (SELECT *, row_number() OVER {_W} AS k, count(*) OVER (PARTITION BY series_id) AS n FROM j WHERE j % 5 = 0), s AS (SELECT series_id, min(ts) AS oos FROM a WHERE k > floor(n * 0.5e0) GROUP BY series_id),
m AS (SELECT series_id, avg(x) AS mx, avg(y_h) AS my, stddev_samp(x) AS sx, stddev_samp(y_h) AS sy, covar_samp(x, y_h) AS c FROM a JOIN s USING (series_id) WHERE k <= floor(n * 0.5e0) AND target_time < oos AND n >= 20 GROUP BY series_id HAVING count(*) >= 3)
SELECT series_id, ts, round(sign(c) * (x - mx) / sx, 5) AS position, round(sign(c) * (x - mx) / sx * (y_h - my) / sy, 5) AS net FROM a JOIN m USING (series_id) WHERE sx > 0 AND sy > 0""",
    "f3_form_factor": f"WITH {_FORM}, g AS (SELECT x.ts, mem.m, avg(ret) FILTER (bucket = 10) - avg(ret) FILTER (bucket = 1) AS d FROM x JOIN mem ON x.entity = mem.entity AND x.m = mem.m + 1 WHERE ret IS NOT NULL GROUP BY ALL) SELECT ts, round(avg(d), 6) AS net FROM g GROUP BY ts",
    "f3_membership": f"WITH {_FORM} SELECT rb, entity, bucket FROM mem WHERE bucket IN (1, 10)",
    "f6_forecast_skill": f"WITH {_P}, f AS (SELECT *, lag(value) OVER {_W} AS f, avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM price), k AS (SELECT *, row_number() OVER {_W} - 1 AS k FROM f WHERE f IS NOT NULL) SELECT series_id, ts, round((b - value) * (b - value) - (f - value) * (f - value), 1) AS net FROM k WHERE k % 5 = 0",
    "d20_d22_two_factor": f"""WITH {_N}, {views.PAIR_SQL}, j AS (SELECT series_id, net AS y, x / 100 AS a, pair.y / 1000000 AS b FROM net JOIN pair ON pair.ts = date_trunc('day', net.ts)),
m AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb FROM j GROUP BY ALL),
f AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS q FROM m WHERE n >= 10)
SELECT series_id, n, my - p * ma - q * mb > 0 AND CASE WHEN my > 1e-12 THEN (my - p * ma - q * mb) / my ELSE 0 END >= 0.5 AS survives, round(my - p * ma - q * mb, 6) AS intercept, round(p, 5) AS beta_a, round(q, 5) AS beta_b, round(my, 6) AS mean FROM f""",
    "d23_crisis_leave_one_out": f"WITH {_N}, m AS (SELECT series_id, avg(net) AS b, {_CRISIS[0]} AS u, {_CRISIS[1]} AS v FROM net GROUP BY ALL) SELECT series_id, b > 0 AND (coalesce(u <= 0, false) OR coalesce(v <= 0, false)) AS dominated, round(b, 7) AS base_mean, round(u, 7) AS without_0, round(v, 7) AS without_1 FROM m",
    "d43_best_of_k": f"WITH {_N}, s AS (SELECT family, series_id, CASE WHEN count(*) >= 20 THEN avg(net) / stddev_samp(net) * sqrt(252) END AS sharpe FROM net GROUP BY ALL) SELECT family, arg_max(series_id, (sharpe, -series_id)) AS series_id, count(*) AS k, round(max(sharpe), 5) AS sharpe FROM s GROUP BY family",
    "g4_cpcv": f"""WITH {_N}, t AS (SELECT series_id, net, ntile(8) OVER (PARTITION BY series_id ORDER BY seq) AS g, count(*) OVER (PARTITION BY series_id) AS n FROM net), u AS (SELECT DISTINCT series_id, g FROM t WHERE n >= 40), p AS (SELECT a.series_id, a.g AS g, b.g AS h FROM u a JOIN u b ON a.series_id = b.series_id AND a.g < b.g),
s AS (SELECT p.series_id, p.g AS g, p.h AS h, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS sharpe FROM p JOIN t ON t.series_id = p.series_id AND (t.g = p.g OR t.g = p.h) GROUP BY ALL) SELECT series_id, count(sharpe) AS paths, avg(CAST(sharpe <= 1e-9 AS INT)) >= 0.5 AS overfit, round(median(sharpe), 5) AS median_sharpe, round(avg(CAST(sharpe <= 1e-9 AS INT)), 5) AS p_loss FROM s GROUP BY series_id""",
    "g7_regime_buckets": f"WITH {_BUCKETS} SELECT series_id, scheme, label, n, round(mean, 7) AS mean FROM b",
    "g7_drop_best": f"WITH {_BUCKETS}, k AS (SELECT *, n * mean AS t, row_number() OVER (PARTITION BY series_id, scheme ORDER BY round(n * mean, 9) DESC, label DESC) AS k FROM b), s AS (SELECT series_id, scheme, max(label) FILTER (k = 1) AS best, sum(t) AS t, sum(n) AS n, sum(t) FILTER (k > 1) AS rt, sum(n) FILTER (k > 1) AS rn FROM k GROUP BY ALL HAVING count(*) >= 2) SELECT series_id, scheme, best, t > 0 AND rt / rn <= 0.25e0 * t / n AS concentrated, round(rt / rn, 7) AS rest_mean FROM s",
}


def tails(s, d):
    b = views.bracket(s, d).selectExpr("*", "2 * volume open_interest", "entry_price <= 0.35D is_tail")
    return rounded(c.tail_fade(b, pair=("1", "2"), pair_gross=0.002, least_interest=10), "day", "trades", net=6)


def forward_frame(s, d):
    w = "over (partition by series_id order by ts)"
    return views.price(s, d).selectExpr("series_id", "ts", "value signal", f"abs(ln(lead(value) {w} / value)) fut_rv", f"abs(ln(value / lag(value) {w})) iv")


QUERIES |= {
    "f8_tail_fade": tails,
    "d12_capacity": lambda s, d: c.capacity(views.net(s, d), scores.score_split(views.net(s, d))),
    "d21_market_model": lambda s, d: rounded(c.market_model(factors(s, d), "net", "a", ("series_id",)), "series_id", "n", alpha=6, beta=5),
    "d25_pooled_score": lambda s, d: rounded(scores.score_split(c.pool_series(views.net(s, d), "family", views.parts(views.table(s, d, "lineitem"))), 1.0, numbered=True), "series_id", "n", "n_oos", per_trade_sharpe=5, ann_ret=5),
    "g6_rolling": lambda s, d: rounded(c.walk_forward(forward_frame(s, d), rolling=True), "series_id", "window", "trades", mean=6, sharpe=4),
    "g6_consistent": lambda s, d: c.walk_forward_consistent(c.walk_forward(forward_frame(s, d))),
    "g6_walk_forward": lambda s, d: rounded(c.walk_forward(forward_frame(s, d)), "series_id", "window", "trades", mean=6, sharpe=5),
}
_PP = "entry_price * (1 - entry_price)"
SQL |= {
    "f8_tail_fade": f"""WITH {views.BRACKET_SQL}, t AS (SELECT date_trunc('day', close_time) AS day, city IN (1, 2) AS pair, 0.1e0 * volume AS size, CASE WHEN outcome = 0 THEN entry_price ELSE entry_price - 1 END - 0.07e0 * {_PP} AS unit FROM bracket WHERE entry_price <= 0.35e0 AND volume > 0 AND 2 * volume >= 10),
g AS (SELECT *, sum(size) FILTER (pair) OVER (PARTITION BY day) AS gross FROM t) SELECT CAST(day AS TIMESTAMP) AS day, count(*) AS trades, round(sum(CASE WHEN pair AND gross > 2 THEN size * 2 / gross ELSE size END * unit) / 1000, 6) AS net FROM g GROUP BY day""",
    "d12_capacity": f"WITH {_PART}, {_SCORES}, q AS (SELECT series_id, abs(position - lag(position) OVER (PARTITION BY series_id ORDER BY seq)) AS step FROM net), t AS (SELECT series_id, avg(coalesce(step, 0)) AS turn FROM q GROUP BY ALL) SELECT series_id, CASE WHEN seen_mean > 0 AND turn > 0 THEN round(seen_mean * 252 / (turn * 252 * 2.5e-9) / 1000) * 1000 END AS capacity_usd FROM s JOIN t USING (series_id)",
    "d21_market_model": f"WITH {_N}, {views.PAIR_SQL}, j AS (SELECT series_id, net AS y, x / 100 AS a FROM net JOIN pair ON pair.ts = date_trunc('day', net.ts)) SELECT series_id, count(*) AS n, round(regr_intercept(y, a), 6) AS alpha, round(regr_slope(y, a), 5) AS beta FROM j GROUP BY series_id",
    "d25_pooled_score": f"WITH {_PART.replace('net AS (', 'net0 AS (', 1).replace('c AS (SELECT', 'net AS (SELECT family AS series_id, family, row_number() OVER (PARTITION BY family ORDER BY ts, series_id, seq) AS seq, net FROM net0), c AS (SELECT', 1)}, {_SCORES} SELECT series_id, n, k AS n_oos, round(m / sd, 5) AS per_trade_sharpe, round(seen_mean, 5) AS ann_ret FROM s",
    "g6_walk_forward": f"""WITH {_P}, f AS (SELECT series_id, ts, value AS signal, abs(ln(lead(value) OVER {_W} / value)) AS rv, abs(ln(value / lag(value) OVER {_W})) AS iv FROM price),
r AS (SELECT *, row_number() OVER {_W} - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n, avg(signal) OVER p AS mu, stddev_samp(signal) OVER p AS sd FROM f WHERE rv IS NOT NULL AND iv IS NOT NULL WINDOW p AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, ntile(4) OVER {_W} AS w FROM r WHERE k % 5 = 0 AND k < n - 5 AND k >= floor(n * 0.3e0)), g AS (SELECT *, first_value(mu) OVER (PARTITION BY series_id, w ORDER BY k) AS m0, first_value(sd) OVER (PARTITION BY series_id, w ORDER BY k) AS s0 FROM e),
z AS (SELECT *, greatest(-1, least(1, (signal - m0) / s0)) AS z FROM g), t AS (SELECT series_id, w, z * (rv - iv) - abs(z) * 0.0008e0 AS net FROM z) SELECT series_id, w AS "window", count(*) AS trades, round(avg(net), 6) AS mean, round(CASE WHEN count(*) >= 20 THEN avg(net) / stddev_samp(net) * sqrt(73e0) END, 5) AS sharpe FROM t GROUP BY series_id, w""",
}
SQL |= {
    "g6_consistent": f"SELECT series_id, count(*) AS windows, bool_and(sharpe > 0) FILTER (sharpe IS NOT NULL) AS consistent FROM ({SQL['g6_walk_forward']}) GROUP BY series_id",
    "g6_rolling": f"""WITH {_P}, f AS (SELECT series_id, ts, value AS signal, abs(ln(lead(value) OVER {_W} / value)) AS rv, abs(ln(value / lag(value) OVER {_W})) AS iv FROM price),
r AS (SELECT *, row_number() OVER {_W} - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM f WHERE rv IS NOT NULL AND iv IS NOT NULL), e AS (SELECT *, ntile(4) OVER {_W} AS w FROM r WHERE k % 5 = 0 AND k < n - 5 AND k >= floor(n * 0.3e0)),
b AS (SELECT series_id, w, min(k) AS k0, CAST(floor(max(n) * 0.3e0) AS BIGINT) AS cut FROM e GROUP BY ALL), m AS (SELECT b.series_id, b.w, avg(signal) AS m0, stddev_samp(signal) AS s0 FROM b JOIN r ON r.series_id = b.series_id AND r.k >= b.k0 - b.cut AND r.k < b.k0 GROUP BY ALL),
t AS (SELECT e.series_id, e.w, greatest(-1, least(1, (signal - m0) / s0)) AS z, rv, iv FROM e JOIN m ON m.series_id = e.series_id AND m.w = e.w), u AS (SELECT series_id, w, z * (rv - iv) - abs(z) * 0.0008e0 AS net FROM t)
SELECT series_id, w AS "window", count(*) AS trades, round(avg(net), 6) AS mean, round(CASE WHEN count(*) >= 20 THEN avg(net) / stddev_samp(net) * sqrt(73e0) END, 4) AS sharpe FROM u GROUP BY series_id, w""",
}
