"""Queries of the reserve, provenance and plausibility operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import reserve as r
from refspark.plans import views
from refspark.plans.score_plans import rounded

EPOCHS = """SELECT o_custkey AS reserve, CAST(o_orderkey AS VARCHAR(20)) AS epoch_id, CAST(o_orderdate AS DATE) AS start,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS "end", o_orderpriority AS domain, o_orderstatus AS dataset FROM orders"""


def epochs(s, d):
    return views.table(s, d, "orders").selectExpr("o_custkey reserve", "cast(o_orderkey as string) epoch_id", "to_date(o_orderdate) start", "date_add(to_date(o_orderdate), int(o_orderkey % 90)) end", "array(o_orderpriority) domains", "array(o_orderstatus) datasets")


def lines(s, d):
    return views.table(s, d, "lineitem").filter("l_shipdate is not null").selectExpr("l_suppkey lineage", "array(l_returnflag) domains", "array(concat('dataset', l_linestatus)) datasets", "to_date(l_shipdate) start", "date_add(to_date(l_shipdate), int(l_quantity)) end").distinct()


def supplier_spans(s, d):
    return lines(s, d).groupBy("lineage").agg(F.min("start").alias("start"), F.expr("date_add(min(start), 40)").alias("end"), F.expr("array(substr('ANR', int(lineage % 3 + 1), 1)) domains"), F.expr("array('none')").alias("datasets"))


def overlap(s, d):
    """All lineages against the epochs of all orders."""
    e = epochs(s, d).withColumn("domains", F.expr("array(if(domains[0] like '1%', 'A', 'X'))"))
    return r.reserve_overlap(supplier_spans(s, d), e, "lineage")


def assign(s, d):
    candidates = views.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("reserve")).agg(F.expr("count(distinct month(l_shipdate)) % 4 + 1").alias("n"))
    candidates = candidates.select("reserve", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("candidate"))
    e = epochs(s, d).filter("cast(epoch_id as long) % 3 = 0")
    return r.assign_epochs(candidates, e, "reserve", "candidate")


def plausible(s, d):
    g = views.net(s, d).groupBy("series_id").agg(F.avg("net").alias("m"), F.stddev_samp("net").alias("sd"), F.max("ts").alias("last"), F.max("family").alias("family"))
    g = g.withColumn("sharpe", F.expr("m / sd * sqrt(252) * (series_id % 50)"))
    source = F.expr("case series_id % 4 when 0 then 'chat' when 1 then 'paper' when 2 then 'Generated' end")
    return g.select("series_id", r.implausible(F.col("sharpe"), F.col("m"), F.col("sd") / (F.col("series_id") % 7 * 400 + 1)).alias("implausible"), F.round(r.post_sample_years(F.col("last"), F.expr("if(series_id % 5 = 0, null, date'2000-01-01')")), 6).alias("years"), r.anchored(source).alias("anchored"))


RULES = "CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'D' WHEN 1 THEN '1B' WHEN 2 THEN 'w-fri' WHEN 3 THEN 'M' WHEN 4 THEN '3ME' WHEN 5 THEN '6M' WHEN 6 THEN ' q ' WHEN 7 THEN '1YE' WHEN 8 THEN '24M' WHEN 9 THEN 'odd' END"


def cadences(s, d):
    o = views.table(s, d, "orders").select("o_orderkey", "o_totalprice", F.expr(RULES.replace(" AS INT", " AS int")).alias("rule"))
    return o.select("o_orderkey", F.round(r.cadence(F.col("rule"), F.col("o_totalprice") / 100000), 6).alias("per_year"))


def survivorship(s, d):
    meta = views.table(s, d, "part").selectExpr("p_partkey", "if(p_size % 2 = 0, 'return', 'price') kind", "case when p_size % 3 = 0 then ' Corrected' when p_size % 3 = 1 then 'raw' end survivorship")
    return r.require_survivorship(meta).select("p_partkey", "available", "reason")


def summary(s, d):
    inputs = views.table(s, d, "orders").selectExpr("o_orderkey claim", "explode(array(o_custkey, o_custkey + 1)) name").distinct()
    cov = views.table(s, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"), F.min("o_orderstatus").alias("source"), F.bool_or(F.col("o_totalprice") > 450000).alias("synthetic"))
    return r.provenance_summary(inputs, cov.filter("name % 4 <> 0"), "claim")


def ledger(s, d):
    rows = views.table(s, d, "orders").selectExpr("o_orderkey strategy", "o_custkey cohort", "if(o_orderkey % 3 = 0, 'paper', 'search') source", "if(o_orderstatus = 'P', null, o_orderstatus = 'F') scored")
    return r.cleanup_unscored(rows, rows.filter("cohort % 2 = 0").select("cohort")).select("strategy", "cohort", "source", "scored")


def lookahead(s, d):
    """A trailing mean doesn't change with what comes later; a mean over the whole series does."""
    p = views.price(s, d)
    w = "over (partition by series_id order by ts rows between 9 preceding and current row)"
    k = p.withColumns({"k": F.expr("row_number() over (partition by series_id order by ts)"), "n": F.expr("count(*) over (partition by series_id)")})
    head = k.filter("k <= floor(0.7 * n)")
    both = lambda x: x.selectExpr("series_id || ':trailing' series_id", "ts", f"avg(value) {w} value").unionByName(x.selectExpr("series_id || ':whole' series_id", "ts", "value / avg(value) over (partition by series_id) value"))
    return r.lookahead_diff(both(k), both(head))


def tolerance(s, d):
    g = views.net(s, d).groupBy("series_id").agg(F.avg("net").alias("m"), F.stddev_samp("net").alias("sd"), F.count("*").alias("n"))
    pairs = g.alias("a").join(g.alias("b"), F.expr("b.series_id = a.series_id + 1")).selectExpr(
        "a.series_id key", "a.m ref_edge", "b.m cand_edge", "a.m - 2 * a.sd / sqrt(a.n) edge_lo", "a.m + 2 * a.sd / sqrt(a.n) edge_hi", "a.m / a.sd ref_sharpe", "if(a.series_id % 5 = 0, null, b.m / b.sd) cand_sharpe",
        "a.m / a.sd - 0.1 sharpe_lo", "a.m / a.sd + 0.1 sharpe_hi", "a.m * 1e7 ref_capacity", "b.m * 1e7 cand_capacity")
    return r.tolerance_check(pairs)


def decay(s, d):
    returns = views.table(s, d, "lineitem").selectExpr("l_suppkey signal", "year(l_shipdate) year", "l_discount - 0.048e0 ret")
    papers = views.table(s, d, "supplier").selectExpr("s_suppkey signal", "1996 + s_suppkey % 3 sample_end", "1998 + s_suppkey % 3 published")
    return rounded(r.decay_by_period(returns, papers), "signal", "n_in", "n_post", in_sample=6, post_sample=6, post_publication=6, decay=4)


QUERIES = {
    "a4_survivorship": survivorship,
    "a14_provenance_summary": summary,
    "a19_cleanup_unscored": ledger,
    "b9_b10_b15_plausibility": plausible,
    "b11_reserve_overlap": overlap,
    "b12_valid_epochs": lambda s, d: r.valid_epochs(epochs(s, d)).select("reserve", "epoch_id", "start", "end"),
    "b13_checkable": lambda s, d: supplier_spans(s, d).select("lineage", r.provenance_checkable(F.col("end") >= F.col("start"), F.expr("if(lineage % 3 = 0, null, datasets)"), F.expr("filter(domains, x -> x <> 'N')"), F.col("lineage") % 2 == 0, F.lit(True)).alias("checkable")),
    "b14_assign_epochs": assign,
    "b16_restrict_datasets": lambda s, d: r.restrict_datasets(views.table(s, d, "lineitem").selectExpr("l_orderkey", "l_suppkey dataset"), views.table(s, d, "supplier").filter("s_acctbal > 5000").selectExpr("s_suppkey dataset"), "dataset").groupBy("dataset").agg(F.count("*").alias("n")),
    "c10_lookahead_diff": lookahead,
    "d14_cadence": cadences,
    "d27_decay_by_period": decay,
    "d41_tolerance_check": tolerance,
}

_SPANS = "spans AS (SELECT l_suppkey AS lineage, CAST(min(l_shipdate) AS DATE) AS start, CAST(min(l_shipdate) AS DATE) + 40 AS \"end\", [substr('ANR', CAST(l_suppkey % 3 + 1 AS INT), 1)] AS domains FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL)"
SQL = {
    "a4_survivorship": """SELECT p_partkey, NOT bad AS available, CASE WHEN bad THEN 'data_unavailable: returns are not corrected for survivorship' END AS reason
FROM (SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS bad FROM part)""",
    "a14_provenance_summary": """WITH i AS (SELECT DISTINCT o_orderkey AS claim, unnest([o_custkey, o_custkey + 1]) AS name FROM orders),
c AS (SELECT o_custkey AS name, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n, min(o_orderstatus) AS source, bool_or(o_totalprice > 450000) AS synthetic FROM orders WHERE o_custkey % 4 <> 0 GROUP BY ALL)
SELECT claim, i.name, n IS NOT NULL AS available, CASE WHEN n IS NULL THEN 'data_unavailable' END AS reason, first, last, n, source,
  coalesce(bool_or(synthetic) OVER (PARTITION BY claim), false) AS any_synthetic FROM i LEFT JOIN c USING (name)""",
    "a19_cleanup_unscored": """SELECT o_orderkey AS strategy, o_custkey AS cohort, CASE WHEN o_orderkey % 3 = 0 THEN 'paper' ELSE 'search' END AS source,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS scored FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderstatus <> 'F')""",
    "b9_b10_b15_plausibility": f"""WITH {views.NET_SQL}, g AS (SELECT series_id, avg(net) AS m, stddev_samp(net) AS sd, max(ts) AS last FROM net GROUP BY ALL)
SELECT series_id, CASE WHEN abs(m / sd * sqrt(252) * (series_id % 50)) > 6 THEN 'implausible_sharpe' WHEN m <> 0 AND sd / (series_id % 7 * 400 + 1) < 0.02 * abs(m) THEN 'degenerate_series' END AS implausible,
  CASE WHEN series_id % 5 <> 0 THEN round(date_diff('day', DATE '2000-01-01', CAST(last AS DATE)) / 365.25, 6) END AS years,
  CASE series_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false END AS anchored FROM g""",
    "b11_reserve_overlap": f"""WITH e AS (SELECT * FROM ({EPOCHS})), {_SPANS}, b AS (SELECT start AS d, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT "end" AS d, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT lineage, CAST(coalesce((SELECT sum(n) FROM b WHERE d <= s."end"), 0) - coalesce((SELECT sum(n) FROM f WHERE d < s.start), 0) AS BIGINT) AS n_day_epochs, domains[1] = 'A' AND (SELECT count(*) FROM e WHERE domain LIKE '1%') > 0 AS shares_name, EXISTS (SELECT 1 FROM e WHERE s.start <= e."end" AND e.start <= s."end") AS shares_day FROM spans s)
SELECT *, shares_name OR shares_day AS overlap FROM x""",
    "b12_valid_epochs": f"""WITH e AS ({EPOCHS}), f AS (SELECT *, coalesce(start <= lag("end") OVER (PARTITION BY reserve ORDER BY start, "end", epoch_id), false) OR count(*) OVER (PARTITION BY reserve, epoch_id) > 1 AS bad FROM e)
SELECT reserve, epoch_id, start, "end" FROM f QUALIFY NOT bool_or(bad) OVER (PARTITION BY reserve)""",
    "b13_checkable": f"WITH {_SPANS} SELECT lineage, (lineage % 2 <> 0 OR lineage % 3 <> 0) AND domains[1] <> 'N' AS checkable FROM spans",
    "b14_assign_epochs": f"""WITH e0 AS ({EPOCHS}), e AS (SELECT reserve, epoch_id, row_number() OVER (PARTITION BY reserve ORDER BY start, epoch_id) AS k FROM e0 WHERE CAST(epoch_id AS BIGINT) % 3 = 0),
c AS (SELECT l_suppkey AS reserve, count(DISTINCT month(l_shipdate)) % 4 + 1 AS n FROM lineitem GROUP BY ALL), x AS (SELECT reserve, n, unnest(range(1, n + 1)) AS candidate FROM c),
h AS (SELECT reserve, count(*) AS epochs FROM e GROUP BY ALL)
SELECT x.reserve, x.candidate, CASE WHEN epochs >= n THEN epoch_id END AS epoch_id, CASE WHEN epochs >= n THEN 'assigned' ELSE 'refused' END AS status
FROM x LEFT JOIN h USING (reserve) LEFT JOIN e ON e.reserve = x.reserve AND e.k = x.candidate""",
    "b16_restrict_datasets": "SELECT l_suppkey AS dataset, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY ALL",
    "c10_lookahead_diff": f"""WITH {views.PRICE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM price), h AS (SELECT * FROM k WHERE k <= floor(0.7 * n)),
a AS (SELECT series_id, ts, value / avg(value) OVER (PARTITION BY series_id) AS value FROM k), b AS (SELECT series_id, ts, value / avg(value) OVER (PARTITION BY series_id) AS value FROM h),
w AS (SELECT series_id, count(*) AS common, count(*) FILTER (abs(a.value - b.value) > 1e-9 + 1e-6 * abs(b.value)) AS differ FROM a JOIN b USING (series_id, ts) GROUP BY ALL)
SELECT series_id || ':whole' AS series_id, common, differ, CASE WHEN differ > 0 THEN 'lookahead' ELSE 'ok' END AS status FROM w UNION ALL SELECT series_id || ':trailing', common, 0, 'ok' FROM w""",
    "d14_cadence": f"""SELECT o_orderkey, round(CASE trim(rule) WHEN 'D' THEN 365.25 WHEN '1B' THEN 252 WHEN 'w-fri' THEN 52 WHEN 'M' THEN 12 WHEN '3ME' THEN 4 WHEN '6M' THEN 2 WHEN 'q' THEN 4 WHEN '1YE' THEN 1 WHEN '24M' THEN 1
  ELSE greatest(1e0, o_totalprice / 100000) END, 6) AS per_year FROM (SELECT o_orderkey, o_totalprice, {RULES} AS rule FROM orders)""",
    "d27_decay_by_period": """WITH j AS (SELECT l_suppkey AS signal, year(l_shipdate) AS y, l_discount - 0.048e0 AS ret, 1996 + l_suppkey % 3 AS a, 1998 + l_suppkey % 3 AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT signal, avg(ret) FILTER (y <= a) AS i, avg(ret) FILTER (y > a AND y <= b) AS p, avg(ret) FILTER (y > b) AS q, count(*) FILTER (y <= a) AS n_in, count(*) FILTER (y > b) AS n_post FROM j GROUP BY ALL)
SELECT signal, n_in, n_post, round(i, 6) AS in_sample, round(p, 6) AS post_sample, round(q, 6) AS post_publication, round(1 - q / i, 4) AS decay FROM g WHERE n_in >= 24 AND n_post >= 24""",
    "d41_tolerance_check": f"""WITH {views.NET_SQL}, g AS (SELECT series_id, avg(net) AS m, stddev_samp(net) AS sd, count(*) AS n FROM net GROUP BY ALL),
p AS (SELECT a.series_id AS key, (a.m >= 0) = (b.m >= 0) AS direction, abs(a.m - b.m) <= 2 * a.sd / sqrt(a.n) AS edge, CASE WHEN a.series_id % 5 <> 0 THEN abs(b.m / b.sd - a.m / a.sd) <= 0.1 END AS sharpe,
  CASE WHEN a.m > 0 AND b.m > 0 THEN abs(log10(b.m) - log10(a.m)) <= 1 END AS capacity FROM g a JOIN g b ON b.series_id = a.series_id + 1)
SELECT *, true AS conclusive, direction AND edge AND coalesce(sharpe, true) AND coalesce(capacity, true) AS passed FROM p""",
}
