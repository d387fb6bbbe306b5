"""Queries of the ledger, decision, kill, vector and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import records as r
from refspark.operators import scores
from refspark.operators import series as o
from refspark.plans import views
from refspark.plans.score_plans import SQL_SLICE, rounded
from refspark.plans.series_plans import SQL as SERIES_SQL


def kills(s, d):
    net = views.net(s, d)
    return scores.referee(net).filter("verdict = 'kill'").select(F.col("series_id").alias("id"), F.col("kill_reason").alias("reason"), F.col("family").alias("domain"))


def trials(s, d):
    rows = views.table(s, d, "orders").selectExpr("o_custkey strategy", "o_orderkey % 2 half", "o_totalprice p")
    g = rows.groupBy("strategy", "half").agg(F.count("*").alias("denominator"), (F.max("p") > 300000).alias("scored"))
    return r.register_trials(g.filter("half = 0").drop("half"), g.filter("half = 1").drop("half", "scored"))


def decisions(s, d):
    return views.table(s, d, "orders").selectExpr("o_custkey claim_id", "o_orderpriority source", "o_orderstatus run_id", "o_orderdate at", "o_orderkey seq", "if(o_totalprice > 100000, 'kill', 'watch') verdict", "if(o_orderstatus = 'O', 'open', 'done') status", "o_custkey request_id")


def anti(s, d):
    e = views.table(s, d, "events").selectExpr("event_id", "user_id", "md5(concat_ws(':', event_type, props, user_id % 10)) receipt", "concat_ws(':', user_id, event_type) claim")
    return r.anti_known(e.filter("user_id >= 30"), e.filter("user_id < 30"), ("receipt", "claim"), "event_id").select("event_id")


def vectors(s, d):
    e = views.table(s, d, "embeddings")
    return rounded(r.nearest_vectors(e, e), "vec_id", "best_id", "status", cosine=5)


def ranks(s, d):
    g = views.table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n"))
    return rounded(r.reciprocal_ranks(g.select("id", F.expr("stack(2, 'total', round(total, 4), 'n', n) as (map, score)"))), "id", score=6)


def graph(s, d):
    w = "over (partition by source order by doc_id)"
    edges = views.table(s, d, "documents").selectExpr("doc_id a", f"lead(doc_id) {w} b").filter("b is not null")
    return r.graph_expand(views.table(s, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("id")), edges)


def new_sources(s, d):
    docs = views.table(s, d, "documents").select("doc_id", "text")
    return r.unprocessed(docs, docs.filter("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))).select("doc_id", "hash")


def labelled(s, d):
    labels = views.pair(s, d).selectExpr("to_date(ts) day", "if(y > 150000, 'high', 'low') label").filter("day < date'2001-01-01'")
    j = views.net(s, d).withColumn("day", F.to_date("ts")).join(labels, "day", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))
    return j.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("net"), 7).alias("mean"))


QUERIES = {
    "a18_register_trials": trials,
    "a20_supersede": lambda s, d: r.supersede(decisions(s, d), "1-URGENT", "F"),
    "a21_open_requests": lambda s, d: r.open_requests(decisions(s, d)).select("request_id", "seq"),
    "b1_b2_b5_scalars": lambda s, d: views.net(s, d).select("series_id", "seq", F.round(r.winsorize(F.col("net"), -0.003, 0.003), 6).alias("clipped"), F.round(r.position_map(F.col("net") * 400, "zscore_clip"), 6).alias("position"), r.fee_gate(F.col("net")).alias("gate")),
    "c9_label_join": labelled,
    "c15_nearest_vectors": vectors,
    "c16_anti_known": anti,
    "d16_check_granularity": lambda s, d: o.check_granularity(views.price(s, d), views.price(s, d).selectExpr("series_id", "if(series_id = 'R', 'weekly', 'daily') expected").distinct()),
    "d32_failure_clusters": lambda s, d: r.failure_clusters(kills(s, d)),
    "d33_cross_domain_links": lambda s, d: r.cross_domain_links(kills(s, d)),
    "d40_fingerprint": lambda s, d: r.fingerprint(views.table(s, d, "events").filter("value is not null").selectExpr("event_type series_id", "ts", "value")),
    "h4_reciprocal_ranks": ranks,
    "h5_graph_expand": graph,
    "h12_domains": lambda s, d: views.table(s, d, "documents").select("doc_id", r.infer_domain(F.col("text")).alias("domain")),
    "h16_guess_title": lambda s, d: views.table(s, d, "documents").select("doc_id", r.guess_title(F.col("text")).alias("title")),
    "h31_unprocessed": new_sources,
}
_DEC = "dec AS (SELECT o_custkey AS claim_id, o_orderpriority AS source, o_orderstatus AS run_id, o_orderdate AS t, o_orderkey AS seq, CASE WHEN o_totalprice > 100000 THEN 'kill' ELSE 'watch' END AS verdict, o_orderstatus = 'O' AS open FROM orders)"
_KILLS = f"k AS (SELECT series_id AS id, kill_reason AS reason, n_name AS domain FROM ({SQL_SLICE}) JOIN supplier ON s_suppkey = series_id JOIN nation ON n_nationkey = s_nationkey WHERE verdict = 'kill')"
_CASES = " ".join(f"WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in words)} THEN '{name}'" for name, words in r.DOMAINS)
SQL = {
    "a18_register_trials": "WITH g AS (SELECT o_custkey AS strategy, o_orderkey % 2 AS half, count(*) AS n, max(o_totalprice) > 300000 AS scored FROM orders GROUP BY ALL), o AS (SELECT * FROM g WHERE half = 0), n AS (SELECT * FROM g WHERE half = 1) SELECT coalesce(o.strategy, n.strategy) AS strategy, CASE WHEN o.scored THEN o.n ELSE greatest(o.n, n.n) END AS denominator, coalesce(o.scored, false) AS scored FROM o FULL JOIN n ON o.strategy = n.strategy",
    "a20_supersede": f"WITH {_DEC}, l AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY t DESC, seq DESC) AS k FROM dec WHERE source = '1-URGENT') SELECT claim_id, source, 'F' AS run_id, 'superseded' AS verdict, verdict AS prior_verdict, run_id AS prior_run_id FROM l WHERE k = 1 AND run_id <> 'F'",
    "a21_open_requests": f"WITH {_DEC}, l AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY t DESC, seq DESC) AS k FROM dec) SELECT claim_id AS request_id, seq FROM l WHERE k = 1 AND open",
    "b1_b2_b5_scalars": f"WITH {views.NET_SQL} SELECT series_id, seq, round(greatest(-0.003e0, least(0.003e0, net)), 6) AS clipped, round(greatest(-1e0, least(1e0, net * 400)), 6) AS position, CASE WHEN net < 0.0008e0 THEN 'kill' ELSE 'pass' END AS gate FROM net",
    "c9_label_join": f"WITH {views.NET_SQL}, {views.PAIR_SQL}, l AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN y > 150000 THEN 'high' ELSE 'low' END AS label FROM pair WHERE ts < TIMESTAMP '2001-01-01') SELECT coalesce(label, 'unknown') AS label, count(*) AS n, round(avg(net), 7) AS mean FROM net LEFT JOIN l ON l.day = CAST(net.ts AS DATE) GROUP BY ALL",
    "c15_nearest_vectors": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id, e.vec_id AS o, round(list_cosine_similarity(q.v, e.v), 9) AS c FROM e q JOIN e ON q.vec_id <> e.vec_id), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, o) AS k FROM p) SELECT vec_id, o AS best_id, CASE WHEN c >= 0.92 THEN 'duplicate' WHEN c >= 0.75 THEN 'review' ELSE 'novel' END AS status, round(c, 5) AS cosine FROM b WHERE k = 1",
    "c16_anti_known": "WITH e AS (SELECT event_id, user_id, md5(event_type || ':' || props || ':' || user_id % 10) AS receipt, user_id || ':' || event_type AS claim FROM events), n AS (SELECT * FROM e WHERE user_id >= 30 AND receipt NOT IN (SELECT receipt FROM e WHERE user_id < 30) AND claim NOT IN (SELECT claim FROM e WHERE user_id < 30)), a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY receipt ORDER BY event_id) = 1) SELECT event_id FROM a QUALIFY row_number() OVER (PARTITION BY claim ORDER BY event_id) = 1",
    "d16_check_granularity": f"SELECT series_id, label, CASE WHEN series_id = 'R' THEN 'weekly' ELSE 'daily' END AS expected, label IN (CASE WHEN series_id = 'R' THEN 'weekly' ELSE 'daily' END, 'unknown') AS ok FROM ({SERIES_SQL['d15_infer_bpy']})",
    "d32_failure_clusters": f"WITH {_KILLS} SELECT reason, domain, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "d33_cross_domain_links": f"WITH {_KILLS}, b AS (SELECT reason, domain, count(*) AS n, min(id) AS id, row_number() OVER (PARTITION BY reason ORDER BY domain) AS r FROM k WHERE reason IS NOT NULL GROUP BY reason, domain) SELECT reason, count(*) AS domains, CAST(sum(n) AS BIGINT) AS total, array_to_string(list_sort(list(CAST(id AS VARCHAR)) FILTER (r <= 3)), ',') AS first FROM b GROUP BY reason HAVING count(*) >= 2",
    "d40_fingerprint": "WITH m AS (SELECT event_type AS series_id, strftime(ts, '%Y-%m') AS m, sha256(array_to_string(list_sort(list(CAST(floor(epoch(ts)) AS BIGINT) || ':' || printf('%.15g', value))), ',')) AS h FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT series_id, sha256(array_to_string(list_sort(list(m || '=' || h)), ',')) AS fingerprint FROM m GROUP BY series_id",
    "h4_reciprocal_ranks": "WITH g AS (SELECT user_id AS id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT id, row_number() OVER (ORDER BY total DESC, id) AS a, row_number() OVER (ORDER BY n DESC, id) AS b FROM g) SELECT id, round(1e0 / (60 + a) + 1e0 / (60 + b), 6) AS score FROM r",
    "h5_graph_expand": "WITH e AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents), u AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL), s AS (SELECT doc_id AS id, 1e0 AS score FROM documents WHERE doc_id % 100 = 0), x AS (SELECT u.b AS id, score / 2 AS score FROM s JOIN u ON u.a = s.id), y AS (SELECT u.b AS id, score / 2 AS score FROM x JOIN u ON u.a = x.id) SELECT id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY id",
    "h12_domains": f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE {_CASES} ELSE 'other' END AS domain FROM d",
    "h16_guess_title": f"SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r')[1:30], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND length(x) <= 200 AND NOT regexp_matches(x, '{r.NO_TITLE}'))[1] AS title FROM documents",
    "h31_unprocessed": "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents) SELECT doc_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0)",
}
