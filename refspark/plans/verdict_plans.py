"""Queries of the gates and of the verdict in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf
from refspark.operators import claims as c
from refspark.operators import gates as g
from refspark.operators import scores
from refspark.operators import verdicts as v
from refspark.plans import views
from refspark.plans.score_plans import SQL_SLICE, rounded
from refspark.plans.text_plans import CLAIMS, _pick

#: Net results with an edge that differs from series to series, so that some survive to meet the gates.
EDGE = "0.0006e0 * (series_id % 5)"
GATE_SQL = """CASE WHEN series_id % 31 = 0 THEN false WHEN series_id % 31 = 1 THEN true END AS adheres, series_id % 29 = 0 AS regime_fragile, series_id % 23 = 0 AS includes_zero, CASE WHEN series_id % 19 = 0 THEN 0.5e0 WHEN series_id % 2 = 0 THEN 0.01e0 END AS permutation_p,
  CASE WHEN series_id % 17 = 0 THEN false WHEN series_id % 3 = 0 THEN true END AS walk_forward_consistent, series_id % 13 = 0 AS cpcv_overfit, series_id % 11 = 0 AS parameter_fragile, series_id % 7 = 0 AS tail_asymmetric,
  CASE WHEN series_id % 6 = 0 THEN 'event_study' WHEN series_id % 6 = 1 THEN 'provided_series_statistic' ELSE 'trading_strategy' END AS claim_type, series_id % 10 = 4 AS unanchored, series_id % 4 > 0 AS costs_measured, CASE WHEN series_id % 5 > 1 THEN 2e0 END AS post_years,
  series_id % 3 = 0 AS external, CASE WHEN series_id % 9 = 0 THEN 1.2e0 ELSE 3e0 END AS cost_margin, CASE WHEN series_id % 37 = 0 THEN 'implausible_sharpe' END AS implausible, CASE series_id % 8 WHEN 0 THEN 0.7e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.59e0 WHEN 3 THEN 0.1e0 END AS fold_power"""


def net(s, d):
    return views.net(s, d).withColumn("net", F.expr(f"net + {EDGE}"))


def referee(s, d):
    out = scores.referee(net(s, d))
    return out.drop("verdict", "kill_reason")


def decided(s, d):
    gates = referee(s, d).selectExpr("*", *[x.strip() for x in _split(GATE_SQL)])
    return v.decide(gates, cost_gate=True)


def _split(text: str) -> list[str]:
    """The items of a select list; commas within CASE don't occur."""
    return text.split(",")


def claim_texts(s, d):
    """A claim for each supplier: what it says, its source and the end of its sample."""
    return views.table(s, d, "supplier").selectExpr(
        "s_suppkey series_id", f"{_pick([c for c, _ in CLAIMS], 's_suppkey')} text", "'' source_text", "element_at(array('external_source', 'External_Source', 'generated', 'chat'), int(s_suppkey % 4) + 1) source_type",
        "if(s_suppkey % 6 = 0, null, date_add(date'1992-01-01', int(s_suppkey * 97 % 2500))) sample_end", "if(s_suppkey % 3 = 0, 'Measured ', 'modelled') costs")


def forward_rows(s, d):
    """The payoff of each order as a signal of how much its supplier's net result moves next, beside how much it moves on average."""
    order, every = "over (partition by series_id order by seq)", "over (partition by series_id)"
    return net(s, d).selectExpr("series_id", "seq ts", "payoff signal", f"lead(abs(net)) {order} fut_rv", f"avg(abs(net)) {every} iv")


def all_gates(s, d, report_only=False):
    """Every series with what all gates say of it; for the report alone, with what they say of those that it asks about."""
    n = net(s, d)
    grid = n.selectExpr("series_id claim", "seq", "net", "explode(array(0, 1, 2, 3, 4)) k").selectExpr("claim", "concat('c', k) config", "seq", "net + (k - 3) * 0.0004e0 * (claim % 3) net")
    declared = views.table(s, d, "supplier").filter("s_suppkey % 7 < 2").selectExpr("s_suppkey series_id", "'part_of_week' scheme", "if(s_suppkey % 7 = 0, 'weekday', 'weekend') label")
    return v.join_gates(n, scores.referee(n), claim_texts(s, d), grid, forward_rows(s, d), g.regime_rows(n), declared, report_only=report_only)


def full_gates(s, d):
    """All gates that a verdict, a reason or a rationale hangs on, the verdicts that they leave, and why."""
    return v.claim_report(v.rationale(v.decide(all_gates(s, d, report_only=True), cost_gate=True)))


def capacity(s, d):
    return g.capacity_ci(net(s, d))


def regimes(s, d):
    return rounded(g.regime_gate(net(s, d)), "series_id", "scheme", "best", "p", "fragile", rest_mean=7)


def adherence(s, d):
    rows = g.regime_rows(views.net(s, d))
    declared = views.table(s, d, "supplier").selectExpr("s_suppkey series_id", "if(s_suppkey % 9 = 0, 'volatility', 'Part_of_week ') scheme", "if(s_suppkey % 2 = 0, 'Weekday', 'weekend') label")
    return rounded(g.regime_adherence(rows, declared), "series_id", "top_label", "adheres", trade_share=5, declared_edge=6)


def costs(s, d):
    bench = referee(s, d).select("series_id", "bench")
    return g.cost_sensitivity(net(s, d), bench, 0.0005)


def grids(s, d):
    specs = views.table(s, d, "supplier").selectExpr("s_suppkey claim", "map('window', transform(sequence(1, 2 + s_suppkey % 7), x -> string(10 * x)), 'hold', transform(sequence(1, 1 + s_suppkey % 5), x -> string(x)), 'side', array('a', 'b')) params")
    return g.param_grid(specs)


def fragility(s, d):
    rows = views.net(s, d).selectExpr("series_id claim", "seq", "net", "explode(array(0, 1, 2, 3, 4)) k").selectExpr("claim", "concat('c', k) config", "seq", "net + (k - 2) * 0.0004e0 * (claim % 3) net")
    return rounded(g.parameter_fragility(rows), "claim", "configs", "fragile", positive_share=5)


def overfit_probability(s, d):
    """Each family's candidates over their common length, that of its shortest."""
    return rounded(g.pbo(g.common_length(views.net(s, d))), "family", "splits", pbo=6)


def holdouts(s, d):
    requests = views.table(s, d, "orders").selectExpr("o_custkey % 120 + 1 claim")
    burned = views.table(s, d, "supplier").filter("s_suppkey % 4 = 0").selectExpr("s_suppkey claim")
    return rounded(g.holdout_once(requests, burned, scores.score_split(views.net(s, d))), "claim", "status", holdout_sharpe=6, holdout_psr=6)


def resolution(s, d):
    n = views.net(s, d)
    seen = scores.part(n).groupBy("series_id").agg(F.count_if(F.col("part") != "holdout").alias("seen"), F.count_if(F.col("part") == "oos").alias("n_oos"))
    return rounded(v.power_resolution(seen), "series_id", "n_oos", "needed_bars", "more_bars", "needed_breadth", mde=4, fold_power=6)


def split_by_nation(s, d):
    return rounded(g.cpcv(views.net(s, d)), "series_id", "paths", "purged", "embargoed", "overfit", median_sharpe=5, iqr_sharpe=5, p_loss=5, haircut=4)


QUERIES = {
    "g3_capacity_ci": capacity,
    "g4_cpcv_full": split_by_nation,
    "g5_pbo": overfit_probability,
    "g7_regime_gate": regimes,
    "g8_regime_adherence": adherence,
    "g9_cost_sensitivity": costs,
    "g10_param_grid": grids,
    "g11_parameter_fragility": fragility,
    "g12_power_resolution": resolution,
    "g13_holdout_once": holdouts,
    "g14_decide": lambda s, d: decided(s, d).select("series_id", "verdict", "kill_reason", F.array_join("reasons", ";").alias("reasons")),
    "g14_g15_claim_report": full_gates,
}

_SLICE = SQL_SLICE.replace("(l_discount - 0.048e0) / 10 AS net", f"(l_discount - 0.048e0) / 10 + {EDGE.replace('series_id', 'l_suppkey')} AS net")
assert _SLICE != SQL_SLICE
_BASE = _SLICE[: _SLICE.rindex("SELECT series_id, k AS n_oos")] + "SELECT series_id, v0, r0, weak, min_fold_t FROM w"
_FOLD = " * ".join(norm_cdf(f"(0.05 * sqrt(floor(seen / 3) + least(1, greatest(0, seen % 3 - {k}))))") for k in range(3))
_GROUPS = f"""{views.NET_SQL}, k AS (SELECT *, seq - 1 AS k, count(*) OVER (PARTITION BY series_id) AS cnt, ntile(8) OVER (PARTITION BY series_id ORDER BY seq) - 1 AS g FROM {{src}}),
m AS (SELECT series_id, max(family) AS family, g, count(*) AS n, avg(net) AS m, var_pop(net) * count(*) AS q, min(k) AS f, max(k) AS l, max(cnt) AS cnt FROM k GROUP BY series_id, g)"""
SQL = {
    "g4_cpcv_full": f"""WITH {_GROUPS.format(src='net')}, p AS (SELECT a.series_id, a.n + b.n AS n, (a.n * a.m + b.n * b.m) / (a.n + b.n) AS mm, a.q + b.q + power(a.m - b.m, 2) * a.n * b.n / (a.n + b.n) AS q,
  CASE WHEN a.f > 0 THEN 1 ELSE 0 END + CASE WHEN a.g + 1 = b.g THEN 0 WHEN b.f - a.l = 2 THEN 1 ELSE 2 END + CASE WHEN b.l < a.cnt - 1 THEN 1 ELSE 0 END AS purged,
  CASE WHEN a.g + 1 = b.g THEN 0 ELSE least(greatest(1, ceil(0.01 * a.cnt)), b.f - a.l - 1) END + least(greatest(1, ceil(0.01 * a.cnt)), a.cnt - 1 - b.l) AS emb
  FROM m a JOIN m b ON a.series_id = b.series_id AND a.g < b.g WHERE a.cnt >= 40), s AS (SELECT *, mm / sqrt(q / (n - 1)) * sqrt(252) AS sh FROM p),
w AS (SELECT series_id, avg(net) / stddev_samp(net) * sqrt(252) AS full_ FROM net GROUP BY series_id),
o AS (SELECT series_id, count(*) AS paths, median(sh) AS med, quantile_cont(sh, 0.75) - quantile_cont(sh, 0.25) AS iqr, avg(CAST(sh <= 1e-9 AS INT)) AS p_loss, CAST(sum(purged) AS BIGINT) AS purged, CAST(sum(emb) AS BIGINT) AS embargoed FROM s GROUP BY series_id)
SELECT series_id, paths, purged, embargoed, p_loss >= 0.5 AS overfit, round(med, 5) AS median_sharpe, round(iqr, 5) AS iqr_sharpe, round(p_loss, 5) AS p_loss, CASE WHEN full_ > 1e-9 THEN round(med / full_, 4) END AS haircut FROM o JOIN w USING (series_id)""",
    "g5_pbo": f"""WITH {_GROUPS.format(src="(SELECT net.* FROM net JOIN (SELECT family, min(n) AS common FROM (SELECT family, series_id, count(*) AS n FROM net GROUP BY ALL) GROUP BY family) USING (family) WHERE seq <= common)")}, ok AS (SELECT family FROM m GROUP BY family HAVING count(DISTINCT series_id) >= 2 AND min(cnt) >= 10),
t AS (SELECT series_id, sum(n * m) AS at_, sum(n) AS an FROM m GROUP BY series_id),
p AS (SELECT a.family, a.series_id, a.g AS x, b.g AS y, round((a.n * a.m + b.n * b.m) / (a.n + b.n), 12) AS oos, round((at_ - a.n * a.m - b.n * b.m) / (an - a.n - b.n), 12) AS train FROM m a JOIN m b ON a.series_id = b.series_id AND a.g < b.g JOIN t ON t.series_id = a.series_id WHERE a.family IN (SELECT family FROM ok)),
r AS (SELECT *, row_number() OVER (PARTITION BY family, x, y ORDER BY train DESC, series_id) AS k FROM p), b AS (SELECT family, x, y, oos AS best FROM r WHERE k = 1),
c AS (SELECT family, x, y, (count(*) FILTER (oos < best) + 1) / (count(*) + 1) AS sh FROM r JOIN b USING (family, x, y) GROUP BY ALL)
SELECT family, count(*) AS splits, round(avg(CAST(ln(sh / (1 - sh)) < -1e-12 AS INT)), 6) AS pbo FROM c GROUP BY family""",
    "g8_regime_adherence": f"""WITH {views.NET_SQL}, r AS (SELECT series_id, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS label, net FROM net), g AS (SELECT series_id, label, count(*) AS n, sum(net) AS t FROM r GROUP BY ALL),
d AS (SELECT s_suppkey AS series_id, s_suppkey % 9 = 0 AS none, CASE WHEN s_suppkey % 2 = 0 THEN 'weekday' ELSE 'weekend' END AS want FROM supplier),
o AS (SELECT d.series_id, none, want, sum(n) AS total, sum(n) FILTER (label = want) AS n, sum(t) FILTER (label = want) AS t, arg_max(label, (round(t, 12), label)) AS top FROM d LEFT JOIN g USING (series_id) GROUP BY d.series_id, none, want)
SELECT series_id, CASE WHEN NOT none THEN top END AS top_label, NOT none AND coalesce(n >= 8 AND n / total >= 0.6 AND top = want, false) AS adheres, CASE WHEN none THEN 0 ELSE round(coalesce(n / total, 0), 5) END AS trade_share, CASE WHEN none THEN 0 ELSE round(coalesce(t, 0), 6) END AS declared_edge FROM o""",
    "g10_param_grid": """WITH s AS (SELECT s_suppkey AS claim, (2 + s_suppkey % 7) * (1 + s_suppkey % 5) * 2 AS total, unnest(range(1, 3 + s_suppkey % 7)) AS w, s_suppkey FROM supplier), h AS (SELECT *, unnest(range(1, 2 + s_suppkey % 5)) AS h FROM s), a AS (SELECT *, unnest(['a', 'b']) AS side FROM h),
c AS (SELECT claim, CAST(total AS BIGINT) AS total, '{"hold":"' || h || '","side":"' || side || '","window":"' || (10 * w) || '"}' AS config FROM a) SELECT claim, config, total FROM c QUALIFY row_number() OVER (PARTITION BY claim ORDER BY sha256('0:' || config), config) <= 24""",
    "g11_parameter_fragility": f"""WITH {views.NET_SQL}, x AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM net), e AS (SELECT series_id AS claim, k, avg(net + (k - 2) * 0.0004e0 * (series_id % 3)) AS edge FROM x, range(5) t(k) WHERE seq > floor(n * 0.5) AND seq <= floor(n * 0.8) GROUP BY ALL)
SELECT claim, count(*) AS configs, CASE WHEN count(DISTINCT round(edge, 12)) > 1 THEN avg(CAST(edge > 0 AS INT)) < 0.5 END AS fragile, round(avg(CAST(edge > 0 AS INT)), 5) AS positive_share FROM e GROUP BY claim""",
    "g12_power_resolution": f"""WITH {views.NET_SQL}, c AS (SELECT series_id, count(*) AS n FROM net GROUP BY ALL), s AS (SELECT series_id, CAST(floor(n * 0.8e0) AS BIGINT) AS seen, CAST(floor(n * 0.8e0) - floor(n * 0.5e0) AS BIGINT) AS k FROM c)
SELECT series_id, k AS n_oos, round(1.645 / sqrt(greatest(2, k)), 4) AS mde, 1083 AS needed_bars, greatest(0, 1083 - k) AS more_bars, greatest(1, CAST(ceil(power(1.645 / 0.05, 2) / greatest(1, k)) AS BIGINT)) AS needed_breadth, round({_FOLD}, 6) AS fold_power FROM s""",
    "g13_holdout_once": SQL_SLICE[: SQL_SLICE.rindex("SELECT series_id, k AS n_oos")].rstrip() + """, q AS (SELECT DISTINCT o_custkey % 120 + 1 AS claim FROM orders), z AS (SELECT claim, claim IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) AS used, hm / hs * sqrt(252) AS hsh, hp FROM q LEFT JOIN w ON w.series_id = q.claim)
SELECT claim, CASE WHEN used THEN 'refused' WHEN hp IS NULL THEN 'too_small' ELSE 'evaluated' END AS status, CASE WHEN NOT used THEN round(hsh, 6) END AS holdout_sharpe, CASE WHEN NOT used THEN round(hp, 6) END AS holdout_psr FROM z""",
    "g14_decide": f"""WITH b AS ({_BASE}), t AS (SELECT *, {GATE_SQL} FROM b), a AS (SELECT *, v0 IN ('watch', 'research-supported') AS s0 FROM t),
g AS (SELECT *, CASE WHEN NOT s0 THEN r0 WHEN adheres = false THEN 'regime_mismatch' WHEN regime_fragile THEN 'regime_fragile' WHEN includes_zero THEN 'edge_ci_zero' WHEN coalesce(permutation_p, 0) > 0.1 THEN 'no_signal_alignment' WHEN walk_forward_consistent = false THEN 'walk_forward_drift' WHEN cpcv_overfit THEN 'overfit_cpcv' WHEN parameter_fragile THEN 'parameter_fragile' END AS r1 FROM a),
h AS (SELECT *, CASE WHEN s0 AND r1 IS NOT NULL THEN 'kill' ELSE v0 END AS v1, claim_type <> 'event_study' AS trades FROM g),
i AS (SELECT *, v1 = 'research-supported' AS top, v1 IN ('watch', 'research-supported') AS s1, tail_asymmetric AND trades AS n1, v1 = 'research-supported' AND trades AND NOT costs_measured AS n2, v1 = 'research-supported' AND unanchored AS n3,
  v1 IN ('watch', 'research-supported') AND claim_type <> 'trading_strategy' AS n4, v1 IN ('watch', 'research-supported') AND external AND coalesce(post_years, -1) < 1 AS n5 FROM h),
j AS (SELECT *, CASE WHEN top AND (n1 OR n2 OR n3 OR n4 OR n5) THEN 'watch' ELSE v1 END AS v2 FROM i), k AS (SELECT *, s1 AND trades AND cost_margin < 1.5 AS thin FROM j),
l AS (SELECT *, CASE WHEN thin AND v2 = 'watch' THEN 'kill' WHEN thin THEN 'watch' ELSE v2 END AS v3, CASE WHEN thin AND v2 = 'watch' THEN 'cost_sensitive' ELSE r1 END AS r3 FROM k),
o AS (SELECT *, v3 = 'kill' AND ((r3 IN ('no_oos_edge', 'edge_ci_zero', 'overfit_cpcv', 'low_edge_t') AND weak) OR (r3 = 'in_sample_only' AND NOT coalesce(min_fold_t <= -1, false) AND (fold_power IS NULL OR fold_power < 0.6))) AS under, implausible IS NOT NULL AND claim_type <> 'provided_series_statistic' AS odd FROM l)
SELECT series_id, CASE WHEN odd THEN 'needs_review' WHEN under THEN 'underpowered' ELSE v3 END AS verdict, CASE WHEN odd THEN NULL WHEN under THEN 'below_detection_floor' ELSE r3 END AS kill_reason,
  concat_ws(';', r3, CASE WHEN n1 THEN 'tail_asymmetric' END, CASE WHEN n2 THEN 'costs_modelled' END, CASE WHEN n3 THEN 'no_external_anchor' END, CASE WHEN n4 THEN 'capped_claim_type' END, CASE WHEN n5 THEN 'no_post_sample_data' END, CASE WHEN under THEN 'below_detection_floor' END, CASE WHEN odd THEN implausible END) AS reasons FROM o""",
}
