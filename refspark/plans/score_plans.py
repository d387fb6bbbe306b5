"""Queries of the scoring operators over the net series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf, norm_ppf
from refspark.operators import scores
from refspark.plans import views


def rounded(df: DataFrame, *keep: str, **places: int) -> DataFrame:
    """The columns `keep` as they are, and the others rounded."""
    return df.select(*keep, *[F.round(c, n).alias(c) for c, n in places.items()])


def _psr(k: str, m: str, s: str, a: str, b: str, bench: str = "0e0") -> str:
    root = f"sqrt(greatest(1e-12, 1 - {a} * ({m} / {s}) + ({b} + 2) / 4 * power({m} / {s}, 2)))"
    return f"CASE WHEN {k} >= 20 AND {s} > 0 THEN {norm_cdf(f'(({m} / {s} - ({bench})) * sqrt({k} - 1e0) / {root})')} END"


_PART = views.NET_SQL + """, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM net),
p AS (SELECT *, CASE WHEN seq <= floor(n * 0.5e0) THEN 'is' WHEN seq <= floor(n * 0.8e0) THEN 'oos' ELSE 'holdout' END AS part FROM c)"""
_FOLDS = """f AS (SELECT *, ntile(3) OVER (PARTITION BY series_id ORDER BY seq) AS fold FROM p WHERE part <> 'holdout'),
g AS (SELECT series_id, fold, count(*) AS k, CASE WHEN count(*) >= 5 AND stddev_samp(net) > 0 THEN round(avg(net) / (stddev_samp(net) / sqrt(count(*))), 3) END AS t FROM f GROUP BY ALL),
h AS (SELECT series_id, sum(k) AS seen, max(t) FILTER (fold = 1) AS a, max(t) FILTER (fold = 2) AS b, max(t) FILTER (fold = 3) AS c3, min(t) AS low, count(*) FILTER (t > 0) AS up FROM g GROUP BY series_id),
folds AS (SELECT series_id, CASE WHEN seen >= 30 THEN a END AS fold_1, CASE WHEN seen >= 30 THEN b END AS fold_2, CASE WHEN seen >= 30 THEN c3 END AS fold_3, CASE WHEN seen >= 30 THEN low END AS min_fold_t, seen >= 30 AND up = 3 AS consistent FROM h)"""
_SCORES = """s AS (SELECT series_id, family, max(n) AS n, count(*) FILTER (part = 'oos') AS k, avg(net) FILTER (part = 'oos') AS m, stddev_samp(net) FILTER (part = 'oos') AS sd, skewness(net) FILTER (part = 'oos') AS g3, kurtosis(net) FILTER (part = 'oos') AS g4,
  count(*) FILTER (part = 'holdout') AS hk, avg(net) FILTER (part = 'holdout') AS hm, stddev_samp(net) FILTER (part = 'holdout') AS hs, skewness(net) FILTER (part = 'holdout') AS h3, kurtosis(net) FILTER (part = 'holdout') AS h4,
  count(*) FILTER (part = 'is') AS ik, avg(net) FILTER (part = 'is') AS im, stddev_samp(net) FILTER (part = 'is') AS isd, avg(net) FILTER (part <> 'holdout') AS seen_mean FROM p GROUP BY ALL)"""
_OTHERS = "(SELECT count(*) FROM s o WHERE o.family = s.family) AS trials, (SELECT var_samp(o.m / o.sd) FROM s o WHERE o.family = s.family AND o.series_id <> s.series_id AND o.sd > 0) AS var_others, (SELECT count(*) FROM s o WHERE o.family = s.family AND o.series_id <> s.series_id AND o.sd > 0) AS others"
_E1, _E2 = norm_ppf("(1 - 1e0 / n_trials)"), norm_ppf("(1 - 1e0 / (n_trials * 2.718281828459045e0))")
_BENCH = f"(CASE WHEN n_trials >= 2 AND sr_variance > 0 THEN sqrt(sr_variance) * ({1 - scores.EULER} * {_E1} + {scores.EULER} * {_E2}) ELSE 0e0 END)"


def minimum_slice(spark, d):
    out = scores.referee(views.net(spark, d))
    return rounded(out, "series_id", "n_oos", "verdict", "kill_reason", "n_trials", psr=6, dsr=6, edge_t=6)


SQL_SLICE = f"""WITH {_PART}, {_FOLDS}, {_SCORES}, t AS (SELECT s.*, {_OTHERS} FROM s),
u AS (SELECT *, greatest(trials, 10) AS n_trials, CASE WHEN others >= 3 THEN greatest(0e0, var_others) ELSE 0.01e0 END AS sr_variance FROM t),
v AS (SELECT *, {_psr('k', 'm', 'sd', 'g3', '(g4)')} AS psr, {_psr('k', 'm', 'sd', 'g3', '(g4)', 'bench')} AS dsr, {_psr('hk', 'hm', 'hs', 'h3', '(h4)')} AS hp, CASE WHEN sd > 0 THEN m / (sd / sqrt(k)) END AS edge_t FROM (SELECT *, {_BENCH} AS bench FROM u)),
w AS (SELECT *, CASE WHEN k < 30 THEN 'insufficient_data' WHEN NOT coalesce(consistent, false) THEN 'kill' WHEN coalesce(dsr, 0) < 0.9 OR coalesce(edge_t, 0) < 1 THEN 'kill' WHEN dsr < 0.95 THEN 'watch' WHEN hm > 0 AND hk >= 20 AND hp >= 0.9 THEN 'research-supported' ELSE 'watch' END AS v0,
 CASE WHEN k < 30 THEN 'data_unavailable' WHEN NOT coalesce(consistent, false) THEN 'in_sample_only' WHEN coalesce(dsr, 0) < 0.9 THEN 'no_oos_edge' WHEN coalesce(edge_t, 0) < 1 THEN 'low_edge_t' END AS r0, 1.645 / sqrt(k) > 0.05 AS weak FROM v LEFT JOIN folds USING (series_id))
SELECT series_id, k AS n_oos, CASE WHEN weak AND r0 IN ('no_oos_edge', 'low_edge_t') THEN 'underpowered' ELSE v0 END AS verdict, CASE WHEN weak AND r0 IN ('no_oos_edge', 'low_edge_t') THEN 'below_detection_floor' ELSE r0 END AS kill_reason,
 CAST(n_trials AS BIGINT) AS n_trials, round(psr, 6) AS psr, round(dsr, 6) AS dsr, round(edge_t, 6) AS edge_t FROM w"""

def ledger(spark, d):
    o = views.table(spark, d, "orders")
    rows = o.selectExpr("o_custkey strategy", "o_orderpriority family", "if(o_custkey % 5 = 4, null, o_custkey % 5) cohort", "o_orderkey % 40 denominator", "if(o_orderkey % 6 = 0, null, o_totalprice / 500000 - 0.3e0) per_trade_sharpe", "o_orderkey at")
    claims = views.table(spark, d, "customer").selectExpr("c_custkey strategy", "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', 'none'), int(c_custkey % 5) + 1) family", "if(c_custkey % 3 = 0, null, c_custkey % 7) cohort", "c_custkey % 4 = 0 generated", "c_custkey % 8 = 0 single", "c_custkey % 300 registered", "c_custkey * 40 grid")
    return rounded(scores.ledger_stats(rows, claims), "strategy", "n_trials", sr_variance=8)


QUERIES = {
    "d4_ledger_stats": ledger,
    "minimum_slice": minimum_slice,
    "d6_score_split": lambda s, d: rounded(scores.score_split(views.net(s, d)), "series_id", "n", "n_oos", oos_sharpe=6, is_sharpe=6, per_trade_sharpe=6, edge_t=6, psr=6, ann_ret=6),
    "d7_three_fold": lambda s, d: scores.three_fold(views.net(s, d)),
    "d9_max_drawdown": lambda s, d: rounded(scores.max_drawdown(views.net(s, d)), "series_id", max_drawdown=6),
    "d8_tail_metrics": lambda s, d: rounded(scores.tail_metrics(views.net(s, d)), "series_id", "n", "asymmetric", worst_vs_typical=6, skew=6, cvar_5=6, cvar_95=6, tail_ratio=6, max_loss=6, max_gain=6),
    "d11_turnover": lambda s, d: rounded(scores.turnover(views.net(s, d)), "series_id", turnover=6, traded=6),
    "g13_holdout": lambda s, d: rounded(scores.score_split(views.net(s, d)), "series_id", holdout_sharpe=6, holdout_psr=6),
    "g12_power": lambda s, d: rounded(scores.part(views.net(s, d)).filter("part = 'oos'").groupBy("series_id").agg(F.count("*").alias("n_oos")).withColumns(scores.power("n_oos")), "series_id", "n_oos", "sufficient", "needed_bars", mde=6, mde_annual=6),
    "d28_verdict_tally": lambda s, d: scores.referee(views.net(s, d)).rollup("family", "verdict").agg(F.count("*").alias("n")),
}
SQL = {
    "minimum_slice": SQL_SLICE,
    "d6_score_split": f"WITH {_PART}, {_SCORES} SELECT series_id, n, k AS n_oos, round(CASE WHEN k >= 20 AND sd > 0 THEN m / sd * sqrt(252) END, 6) AS oos_sharpe, round(CASE WHEN ik >= 20 AND isd > 0 THEN im / isd * sqrt(252) END, 6) AS is_sharpe, round(CASE WHEN sd > 0 THEN m / sd END, 6) AS per_trade_sharpe, round(CASE WHEN sd > 0 THEN m / (sd / sqrt(k)) END, 6) AS edge_t, round({_psr('k', 'm', 'sd', 'g3', '(g4)')}, 6) AS psr, round(seen_mean * 252, 6) AS ann_ret FROM s",
    "d4_ledger_stats": """WITH l AS (SELECT o_custkey AS strategy, o_orderpriority AS family, CASE WHEN o_custkey % 5 <> 4 THEN o_custkey % 5 END AS cohort, o_orderkey % 40 AS den, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 500000 - 0.3e0 END AS x
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1),
c AS (SELECT c_custkey AS strategy, (['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', 'none'])[CAST(c_custkey % 5 AS INT) + 1] AS family, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END AS cohort, c_custkey % 4 = 0 AS generated, c_custkey % 8 = 0 AS single, c_custkey % 300 AS registered, c_custkey * 40 AS grid FROM customer),
d AS (SELECT family, sum(m) AS declared FROM (SELECT family, cohort, max(den) AS m FROM l WHERE cohort IS NOT NULL GROUP BY ALL) GROUP BY family), t AS (SELECT family, count(*) AS n FROM l GROUP BY family),
v AS (SELECT c.strategy, count(x) AS k, coalesce(var_samp(x), 0) AS var FROM c LEFT JOIN l ON l.family = c.family AND (c.cohort IS NULL OR l.cohort IS DISTINCT FROM c.cohort) GROUP BY c.strategy)
SELECT c.strategy, CAST(greatest(1, coalesce(t.n, 0) + CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.family = c.family AND l.strategy = c.strategy) THEN 0 ELSE 1 END, coalesce(declared, 0), registered, CASE WHEN single OR generated THEN 1 ELSE 10 END, CASE WHEN single THEN 1 ELSE least(10000, greatest(1, grid)) END) AS BIGINT) AS n_trials,
  round(CASE WHEN k < 3 THEN greatest(var, 0.01) ELSE (k * var + 0.03) / (k + 3) END, 8) AS sr_variance FROM c LEFT JOIN t USING (family) LEFT JOIN d USING (family) JOIN v ON v.strategy = c.strategy""",
    "d7_three_fold": f"WITH {_PART}, {_FOLDS} SELECT * FROM folds",
    "d9_max_drawdown": f"WITH {views.NET_SQL}, e AS (SELECT *, sum(net) OVER (PARTITION BY series_id ORDER BY seq) AS eq FROM net), f AS (SELECT *, max(eq) OVER (PARTITION BY series_id ORDER BY seq) - eq AS down FROM e) SELECT series_id, round(max(down), 6) AS max_drawdown FROM f GROUP BY ALL",
    "d8_tail_metrics": f"WITH {views.NET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY net, seq) AS up, row_number() OVER (PARTITION BY series_id ORDER BY net DESC, seq) AS down, count(*) OVER (PARTITION BY series_id) AS n, avg(net) OVER (PARTITION BY series_id) AS mu FROM net), a AS (SELECT series_id, max(n) AS n, avg(power(net - mu, 3)) / power(avg(power(net - mu, 2)), 1.5) AS skew, avg(net) FILTER (up <= greatest(1, ceil(n * 0.05e0))) AS lo, avg(net) FILTER (down <= greatest(1, ceil(n * 0.05e0))) AS hi, min(net) AS max_loss, max(net) AS max_gain, quantile_cont(net, 0.95) FILTER (net > 0) AS gain FROM r GROUP BY series_id) SELECT series_id, n, coalesce((skew <= -3 AND n >= 40) OR (skew <= -0.5 AND hi > 0 AND abs(lo) / hi >= 3), false) AS asymmetric, round(CASE WHEN gain > 0 THEN abs(max_loss) / gain END, 6) AS worst_vs_typical, round(skew, 6) AS skew, round(lo, 6) AS cvar_5, round(hi, 6) AS cvar_95, round(CASE WHEN hi > 0 THEN abs(lo) / hi END, 6) AS tail_ratio, round(max_loss, 6) AS max_loss, round(max_gain, 6) AS max_gain FROM a",
    "d11_turnover": f"WITH {views.NET_SQL}, t AS (SELECT series_id, abs(position - coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY seq), 0)) AS step FROM net) SELECT series_id, round(avg(step), 6) AS turnover, round(sum(step), 6) AS traded FROM t GROUP BY ALL",
    "g13_holdout": f"WITH {_PART}, {_SCORES} SELECT series_id, round(CASE WHEN hk >= 20 AND hs > 0 THEN hm / hs * sqrt(252) END, 6) AS holdout_sharpe, round({_psr('hk', 'hm', 'hs', 'h3', '(h4)')}, 6) AS holdout_psr FROM s",
    "g12_power": f"WITH {_PART} SELECT series_id, count(*) AS n_oos, 1.645 / sqrt(count(*)) <= 0.05 AS sufficient, CAST(1083 AS BIGINT) AS needed_bars, round(1.645 / sqrt(count(*)), 6) AS mde, round(1.645 / sqrt(count(*)) * sqrt(252), 6) AS mde_annual FROM p WHERE part = 'oos' GROUP BY series_id",
    "d28_verdict_tally": f"SELECT n_name AS family, verdict, count(*) AS n FROM ({SQL_SLICE}) JOIN supplier ON s_suppkey = series_id JOIN nation ON n_nationkey = s_nationkey GROUP BY ROLLUP (n_name, verdict)",
}
