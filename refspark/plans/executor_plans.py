"""Queries of the executors and of the search as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import claims as c
from refspark.operators import evidence as e
from refspark.operators import executors as x
from refspark.operators import gates as g
from refspark.operators import markets as m
from refspark.operators import records as r
from refspark.operators import series as o
from refspark.plans import views
from refspark.plans.claim_plans import WINDOWS, factors
from refspark.plans.score_plans import SQL_SLICE, rounded


def long_pairs(s, d):
    o = views.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("claim"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.count("*").cast("double").alias("x"), F.avg("o_totalprice").alias("y"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("z"))
    return o.selectExpr("claim", "ts", "stack(3, 'x', x, 'y', y, 'z', z) as (name, value)")


def panel_signal(s, d):
    return views.panel(s, d).selectExpr("ts", "entity", "characteristic signal")


def panel_returns(s, d):
    return views.panel(s, d).selectExpr("ts", "entity", "ret")


def months(s, d):
    return panel_returns(s, d).select(F.col("ts").alias("rb")).distinct()


def book(s, d):
    weights = views.panel(s, d).selectExpr("ts", "entity", "if(entity % 11 = 0, -1, dvol) weight")
    eligible = views.panel(s, d).filter("entity % 7 > 0").selectExpr("ts rb", "entity")
    return x.sorted_book(panel_signal(s, d), panel_returns(s, d), 5, weights=weights, eligible=eligible)[0]


def positions(s, d):
    members = x.sorted_book(panel_signal(s, d), panel_returns(s, d), 5)[1]
    return rounded(x.sort_positions(members, panel_returns(s, d), 2), "ts", "entity", position=8)


def spanning(s, d):
    f = factors(s, d).groupBy("series_id", F.col("day").cast("timestamp").alias("ts")).agg(F.avg("net").alias("net"), F.max("a").alias("a"), F.max("b").alias("b"))
    return rounded(x.factor_spanning(f, "net", ("a", "b")), "series_id", "ts", net=7)


def timing(s, d):
    frame = views.price(s, d).selectExpr("series_id", "ts", "value signal", "abs(value - lag(value) over (partition by series_id order by ts)) / 1000 rv", "value / 40000 iv")
    return rounded(x.execute(x.vol_timing, frame), "series_id", "ts", net=6, position=6)


def simple(s, d):
    n = views.net(s, d)
    return rounded(x.simpler_variant(n, n.selectExpr("series_id", "payoff / 5 net")), "series_id", "survives", mean=7, simpler_mean=7)


def lenses(s, d):
    rows = factors(s, d)
    fragile = g.drop_best_regime(views.net(s, d)).groupBy("series_id").agg(F.bool_or("concentrated").alias("fragile"))
    return x.competing_explanations(rows, ("a", "b"), WINDOWS, views.net(s, d).selectExpr("series_id", "seq", "payoff / 5 net"), fragile)


def windows(s, d):
    """Daily returns of each flag around the days with more orders of top priority than two deviations over the mean."""
    r = views.price(s, d).selectExpr("series_id", "ts", "ln(value / lag(value) over (partition by series_id order by ts)) ret")
    days = views.table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.date_trunc("day", "o_orderdate").alias("event_ts")).agg(F.count("*").alias("n"))
    busy = days.agg((F.avg("n") + 2 * F.stddev_samp("n")).alias("most"))
    days = days.join(F.broadcast(busy), F.col("n") > F.col("most"))
    calendar = days.agg(F.array_sort(F.collect_list("event_ts")).alias("days"))  # at most one for each day of the calendar
    return r, r.select("series_id").distinct().select("series_id", F.explode(calendar.scalar()).alias("event_ts"))


def candidates(s, d):
    ret, ev = windows(s, d)
    return rounded(x.event_candidates(ret, ev, (-1, 3), 20), "series_id", "event_ts", "start", "flaw", car=6)


def study(s, d):
    ret, ev = windows(s, d)
    market = ret.groupBy("ts").agg(F.avg("ret").alias("market"))
    return rounded(x.event_study(ret.join(market, "ts"), ev, (-1, 3), 20, "market"), "series_id", "event_ts", "skipped", car=6)


def bracket_prices(s, d):
    p = x.priced(views.bracket(s, d), lambda mu: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mu / 2)), 6), "mu")
    return m.backtest(p, "prob").groupBy("city").agg(F.count("*").alias("trades"), F.round(F.sum("net"), 5).alias("net"))


def scopes(s, d):
    return x.verdict_shares(x.search_scopes(views.net(s, d)), "scope").select("scope", "verdict", "n", F.round("share", 6).alias("share"), F.round("survivors", 6).alias("survivors"))


def many_factors(s, d):
    return views.panel(s, d).selectExpr("ts", "entity", "ret", "stack(3, 'discount', characteristic, 'volume', ln(dvol), 'name', cast(entity % 17 as double)) as (factor, value)")


def skill(s, d):
    return rounded(c.forecast_skill(views.price(s, d), F.avg("value").over(o.over().rowsBetween(-5, -1)), 3, "random_walk", 20), "series_id", "ts", net=1)


def exposures(s, d):
    fit = x.ols_multi(factors(s, d), "net", ("a", "b"))
    out = c.exposure_decomposition(fit.filter("n >= 10 and alpha is not null").withColumn("intercept", F.col("alpha")))
    return rounded(out, "series_id", "n", "survives", intercept=6, share=4)


def cohorts(s, d):
    claims = views.table(s, d, "orders").selectExpr("o_custkey source", "o_orderpriority family", "o_orderstatus <> 'P' ready", "o_orderkey % 2 = 0 single")
    return e.cohort_denominators(claims)


def fused(s, d):
    near = views.table(s, d, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_custkey query_id", "o_orderkey id", "o_totalprice score")
    words = views.table(s, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_custkey query_id", "o_orderkey id", "-o_totalprice score")
    return rounded(r.fused_ranks(near, words), "query_id", "id", score=8)


def city_positions(s, d):
    b = views.bracket(s, d).selectExpr("*", "2 * volume open_interest", "entry_price <= 0.35e0 is_tail")
    return rounded(c.tail_positions(b), "day", "city", position=6)


QUERIES = {
    "a8_underlying": lambda s, d: m.violations(views.bracket(s, d).withColumn("underlying", F.expr("if(event_id % 5 = 0, null, mu)")), "underlying").select(F.explode_outer("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    "d5_cohorts": cohorts,
    "d22_exposures": exposures,
    "d26_ranked_coefficients": lambda s, d: rounded(o.ranked_coefficients(many_factors(s, d), 3), "factor", "dates", "rank", ic=6),
    "f6_random_walk_skill": skill,
    "f8_city_positions": city_positions,
    "f9_neutral_books": lambda s, d: rounded(o.neutral_books(many_factors(s, d)), "factor", "ts", port_return=6, gross=6),
    "h4_fused_ranks": fused,
    "c1_align_inner": lambda s, d: rounded(x.align_inner(long_pairs(s, d), ("x", "y", "z")), "claim", "ts", x=1, y=3, z=3),
    "c5_c7_known_at": lambda s, d: rounded(x.known_at(panel_signal(s, d), months(s, d).selectExpr("rb + interval 10 days rb"), "signal"), "rb", "entity", signal=6),
    "c6_holding_window": lambda s, d: x.holding_window(panel_returns(s, d), months(s, d), 3).groupBy("rb").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")),
    "c8_event_windows": candidates,
    "d20_ols_multi": lambda s, d: rounded(x.ols_multi(factors(s, d), "net", ("a", "b")).withColumns({"beta_a": F.col("betas")[0], "beta_b": F.col("betas")[1]}), "series_id", "n", alpha=6, beta_a=5, beta_b=5, r2=6, alpha_t=4),
    "d24_simpler_variant": simple,
    "d28_f10_scopes": scopes,
    "d42_competing_explanations": lenses,
    "e18_u1_vol_timing": timing,
    "f2_factor_spanning": spanning,
    "f3_u3_weighted_book": lambda s, d: rounded(book(s, d), "ts", net=6),
    "f4_sort_positions": positions,
    "f5_event_study": study,
    "f10_search_scopes": lambda s, d: rounded(x.search_scopes(views.net(s, d)), "scope", "series_id", "n_trials", "verdict", dsr=6),
    "u2_priced_brackets": bracket_prices,
}

_FACT = f"""{views.NET_SQL}, {views.PAIR_SQL}, fact AS (SELECT net.*, x / 100 AS a, y / 1000000 AS b FROM net JOIN pair ON CAST(pair.ts AS DATE) = CAST(net.ts AS DATE))"""
_FIT = """mo AS (SELECT series_id, count(*) AS n, avg(net) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(net) AS vy, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(net, a) AS vya, covar_pop(net, b) AS vyb FROM {src} GROUP BY ALL),
fit AS (SELECT *, vaa * vbb - vab * vab AS det, (vya * vbb - vyb * vab) / (vaa * vbb - vab * vab) AS ba, (vyb * vaa - vya * vab) / (vaa * vbb - vab * vab) AS bb FROM mo)"""
_PANEL = f"{views.PANEL_SQL}, sig AS (SELECT ts, entity, characteristic AS signal FROM panel)"
_RANK = """r AS (SELECT ts AS rb, entity, row_number() OVER (PARTITION BY ts ORDER BY signal, entity) AS k, count(*) OVER (PARTITION BY ts) AS n FROM {src} WHERE signal IS NOT NULL),
mem AS (SELECT rb, entity, CASE WHEN least(5, greatest(1, ceil(k * 5.0 / n))) = 5 THEN 'high' WHEN least(5, greatest(1, ceil(k * 5.0 / n))) = 1 THEN 'low' END AS leg FROM r WHERE n >= 20)"""
_W = "(PARTITION BY series_id ORDER BY ts"
_REFEREE = SQL_SLICE
_ALONE = SQL_SLICE.replace("n_name AS family", "CAST(l_suppkey AS VARCHAR) AS family")
assert _ALONE != SQL_SLICE
_CANDIDATES = f"""{views.PRICE_SQL}, ret AS (SELECT series_id, ts, ln(value / lag(value) OVER {_W})) AS ret FROM price),
days AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS event_ts, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), ev AS (SELECT event_ts FROM days WHERE n > (SELECT avg(n) + 2 * stddev_samp(n) FROM days)),
k AS (SELECT *, row_number() OVER {_W}) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM ret),
p AS (SELECT s.series_id, event_ts, (SELECT count(*) FROM ret r WHERE r.series_id = s.series_id AND r.ts < event_ts) - 1 AS start FROM (SELECT DISTINCT series_id FROM ret) s, ev),
z AS (SELECT p.*, (SELECT max(n) FROM k WHERE k.series_id = p.series_id) AS n, (SELECT count(ret) FROM k WHERE k.series_id = p.series_id AND k.k BETWEEN start - 20 AND start - 1) AS e_n, (SELECT avg(ret) FROM k WHERE k.series_id = p.series_id AND k.k BETWEEN start - 20 AND start - 1) AS e_mean,
  (SELECT count(ret) FROM k WHERE k.series_id = p.series_id AND k.k BETWEEN start AND start + 4) AS v_n, (SELECT sum(ret) FROM k WHERE k.series_id = p.series_id AND k.k BETWEEN start AND start + 4) AS v_sum FROM p)"""
_MANY = f"""{views.PANEL_SQL}, f AS (SELECT ts, entity, ret, 'discount' AS factor, characteristic AS value FROM panel UNION ALL SELECT ts, entity, ret, 'volume', ln(dvol) FROM panel UNION ALL SELECT ts, entity, ret, 'name', CAST(entity % 17 AS DOUBLE) FROM panel), ok AS (SELECT * FROM f WHERE value IS NOT NULL AND ret IS NOT NULL)"""
SQL = {
    "a8_underlying": f"""WITH {views.BRACKET_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 5 = 0 AND close_time < decision_time THEN ['null_underlying', 'close_before_decision'] WHEN event_id % 5 = 0 THEN ['null_underlying'] WHEN close_time < decision_time THEN ['close_before_decision'] ELSE [NULL] END) AS reason FROM bracket) GROUP BY reason""",
    "d5_cohorts": """SELECT o_custkey AS source, o_orderpriority AS family, o_custkey || ':' || substr(sha256(o_orderpriority), 1, 16) AS cohort_id, CASE WHEN bool_and(o_orderkey % 2 = 0) AND count(*) = 1 THEN 1 ELSE count(*) END AS denominator FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""",
    "d22_exposures": f"""WITH {_FACT}, {_FIT.format(src='fact')}, q AS (SELECT *, my - ba * ma - bb * mb AS a FROM fit WHERE n >= 10), h AS (SELECT *, CASE WHEN my > 1e-12 THEN a / my ELSE 0 END AS share FROM q)
SELECT series_id, n, a > 0 AND share >= 0.5 AS survives, round(a, 6) AS intercept, round(share, 4) AS share FROM h""",
    "d26_ranked_coefficients": f"""WITH {_MANY}, c AS (SELECT factor, ts, covar_pop(value, ret) / sqrt(var_pop(value) * var_pop(ret)) AS ic FROM ok GROUP BY ALL HAVING var_pop(value) > 0 AND var_pop(ret) > 0), g AS (SELECT factor, count(*) AS dates, avg(ic) AS ic FROM c GROUP BY ALL)
SELECT factor, dates, round(ic, 6) AS ic, row_number() OVER (ORDER BY round(ic, 12) DESC, factor) AS rank FROM g""",
    "f6_random_walk_skill": f"""WITH {views.PRICE_SQL}, f AS (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f, lag(value) OVER {_W}) AS b FROM price), k AS (SELECT *, row_number() OVER {_W}) - 1 AS k FROM f WHERE f IS NOT NULL AND b IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM k WHERE k % 3 = 0) SELECT series_id, ts, round((b - value) * (b - value) - (f - value) * (f - value), 1) AS net FROM n WHERE n >= 20""",
    "f8_city_positions": f"""WITH {views.BRACKET_SQL} SELECT CAST(date_trunc('day', close_time) AS TIMESTAMP) AS day, city, round(sum(0.1e0 * least(volume, 2 * volume)) / 1000, 6) AS position FROM bracket WHERE entry_price <= 0.35e0 AND volume > 0 GROUP BY ALL""",
    "f9_neutral_books": f"""WITH {_MANY}, z AS (SELECT *, (value - avg(value) OVER p) / (stddev_pop(value) OVER p + 1e-9) AS z FROM ok WINDOW p AS (PARTITION BY factor, ts)), w AS (SELECT *, z / nullif(sum(abs(z)) OVER (PARTITION BY factor, ts), 0) AS w FROM z)
SELECT factor, ts, round(sum(w * ret), 6) AS port_return, round(sum(abs(w)), 6) AS gross FROM w GROUP BY ALL""",
    "h4_fused_ranks": """WITH v AS (SELECT o_custkey AS q, o_orderkey AS id, 1.0 / (60 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) AS s FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT o_custkey AS q, o_orderkey AS id, 1.0 / (60 + row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice DESC, o_orderkey)) AS s FROM orders WHERE o_orderkey % 2 = 0)
SELECT q AS query_id, id, round(sum(s), 8) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM l WHERE (q, id) NOT IN (SELECT (q, id) FROM v)) GROUP BY q, id""",
    "c1_align_inner": """SELECT claim, ts, round(x, 1) AS x, round(y, 3) AS y, round(z, 3) AS z FROM (SELECT o_orderpriority AS claim, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS x, avg(o_totalprice) AS y,
  max(o_totalprice) FILTER (o_orderstatus = 'F') AS z FROM orders GROUP BY ALL) WHERE z IS NOT NULL""",
    "c5_c7_known_at": f"WITH {_PANEL}, dates AS (SELECT DISTINCT ts + INTERVAL 10 DAY AS rb FROM panel) SELECT rb, entity, round(signal, 6) AS signal FROM dates, sig WHERE sig.ts = (SELECT max(t.ts) FROM sig t WHERE t.ts <= rb) AND signal IS NOT NULL",
    "c6_holding_window": f"WITH {_PANEL}, dates AS (SELECT DISTINCT ts AS rb FROM panel) SELECT rb, count(*) AS n, min(ts) AS first, max(ts) AS last FROM dates JOIN panel ON ts > rb AND ts <= rb + INTERVAL 3 MONTH GROUP BY rb",
    "c8_event_windows": f"""WITH {_CANDIDATES} SELECT series_id, event_ts, CAST(start AS BIGINT) AS start, CASE WHEN start < 0 OR start + 4 >= n THEN 'event_window_out_of_range' WHEN start < 20 THEN 'insufficient_pre_event_estimation_window'
  WHEN e_n < 20 THEN 'incomplete_pre_event_estimation_window' WHEN v_n < 5 THEN 'incomplete_event_window' END AS flaw, CASE WHEN start >= 0 THEN round(v_sum - 5 * e_mean, 6) END AS car FROM z""",
    "d20_ols_multi": f"""WITH {_FACT}, {_FIT.format(src='fact')}, q AS (SELECT *, vy - ba * vya - bb * vyb AS rest, my - ba * ma - bb * mb AS alpha FROM fit)
SELECT series_id, n, round(alpha, 6) AS alpha, round(ba, 5) AS beta_a, round(bb, 5) AS beta_b, round(1 - rest / vy, 6) AS r2,
  round(alpha / sqrt(n * rest / (n - 3) * (1e0 / n + (ma * ma * vbb - 2 * ma * mb * vab + mb * mb * vaa) / det / n)), 4) AS alpha_t FROM q""",
    "d24_simpler_variant": f"WITH {views.NET_SQL} SELECT series_id, round(avg(net), 7) AS mean, round(avg(payoff / 5), 7) AS simpler_mean, avg(payoff / 5) >= avg(net) AS survives FROM net GROUP BY series_id",
    "d28_f10_scopes": f"""WITH u AS (SELECT 'alone' AS scope, verdict FROM ({_ALONE}) UNION ALL SELECT 'pooled', verdict FROM ({_REFEREE})), g AS (SELECT scope, verdict, count(*) AS n FROM u GROUP BY ALL)
SELECT scope, verdict, n, round(n / sum(n) OVER (PARTITION BY scope), 6) AS share, round(sum(CASE WHEN verdict IN ('watch', 'research-supported') THEN n ELSE 0 END) OVER (PARTITION BY scope) / sum(n) OVER (PARTITION BY scope), 6) AS survivors FROM g""",
    "e18_u1_vol_timing": f"""WITH {views.PRICE_SQL}, f0 AS (SELECT series_id, ts, value AS signal, abs(value - lag(value) OVER {_W})) / 1000 AS rv, value / 40000 AS iv FROM price),
f AS (SELECT *, row_number() OVER {_W}) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM f0 WHERE rv IS NOT NULL),
h AS (SELECT *, avg(CASE WHEN k < floor(n * 0.5) THEN signal END) OVER (PARTITION BY series_id) AS mu, stddev_samp(CASE WHEN k < floor(n * 0.5) THEN signal END) OVER (PARTITION BY series_id) AS sd, lead(rv, 5) OVER {_W}) AS fut FROM f WHERE n >= 60),
z AS (SELECT *, greatest(-1, least(1, (signal - mu) / sd)) AS position FROM h WHERE k % 5 = 0 AND k < n - 5)
SELECT series_id, ts, round(position * (fut - iv) - abs(position) * 0.0008, 6) AS net, round(position, 6) AS position FROM z""",
    "f2_factor_spanning": f"""WITH {_FACT}, dayly AS (SELECT series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, avg(net) AS net, max(a) AS a, max(b) AS b FROM fact GROUP BY ALL),
kk AS (SELECT *, row_number() OVER {_W}) AS k, count(*) OVER (PARTITION BY series_id) AS cnt FROM dayly), half AS (SELECT * FROM kk WHERE k <= floor(cnt * 0.5)), {_FIT.format(src='half')}
SELECT series_id, ts, round(net - ba * a - bb * b, 7) AS net FROM kk JOIN fit USING (series_id) WHERE fit.n > 3""",
    "f3_u3_weighted_book": f"""WITH {_PANEL}, ok AS (SELECT * FROM sig WHERE entity % 7 > 0), {_RANK.format(src='ok')},
wt AS (SELECT rb, m.entity, leg, dvol AS w FROM mem m JOIN panel p ON p.ts = m.rb AND p.entity = m.entity WHERE leg IS NOT NULL AND m.entity % 11 <> 0),
held AS (SELECT wt.rb, p.ts, leg, ret, w FROM wt JOIN panel p ON p.entity = wt.entity AND p.ts > wt.rb AND p.ts <= wt.rb + INTERVAL 1 MONTH WHERE ret IS NOT NULL),
legs AS (SELECT rb, ts, sum(ret * w) FILTER (leg = 'high') / sum(w) FILTER (leg = 'high') - sum(ret * w) FILTER (leg = 'low') / sum(w) FILTER (leg = 'low') AS net FROM held GROUP BY ALL)
SELECT ts, round(avg(net), 6) AS net FROM legs WHERE net IS NOT NULL GROUP BY ts""",
    "f4_sort_positions": f"""WITH {_PANEL}, {_RANK.format(src='sig')}, w AS (SELECT rb, entity, CASE WHEN leg = 'high' THEN 0.5e0 ELSE -0.5e0 END / count(*) OVER (PARTITION BY rb, leg) AS w FROM mem WHERE leg IS NOT NULL),
days AS (SELECT DISTINCT rb, ts FROM (SELECT DISTINCT rb FROM w) JOIN panel ON ts > rb AND ts <= rb + INTERVAL 2 MONTH) SELECT ts, entity, round(avg(w), 8) AS position FROM days JOIN w USING (rb) GROUP BY ALL""",
    "f10_search_scopes": f"SELECT 'alone' AS scope, series_id, n_trials, verdict, dsr FROM ({_ALONE}) UNION ALL SELECT 'pooled', series_id, n_trials, verdict, dsr FROM ({_REFEREE})",
    "u2_priced_brackets": f"""WITH {views.BRACKET_SQL}, p AS (SELECT *, round(greatest(0e0, least(1e0, 1 - mu / 2)), 6) AS prob FROM bracket),
t AS (SELECT *, CASE WHEN entry_price >= 1 THEN 0 ELSE least(0.1e0, 0.25e0 * greatest(0e0, (prob - entry_price) / (1 - entry_price))) END AS k FROM p WHERE prob - entry_price > 0 AND entry_price <= 0.9)
SELECT city, count(*) AS trades, round(sum(k * (outcome - entry_price - 0.07e0 * entry_price * (1 - entry_price))), 5) AS net FROM t WHERE k > 0 GROUP BY city""",
}
