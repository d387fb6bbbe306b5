"""Queries of the evidence corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import evidence as e
from refspark.plans import views


def lexical(s, d):
    items = views.table(s, d, "benchmark").selectExpr("item_id query_id", "text")
    return e.lexical_scores(items, views.table(s, d, "documents").select("doc_id", "text")).withColumn("score", F.round("score", 5))


def traces(s, d):
    return views.table(s, d, "events").selectExpr("event_id id", "event_type kind", "props reason")


def chain(s, d):
    """Events of each user as a hash chain, with every 50th event's back link broken."""
    ev = views.table(s, d, "events")
    seq = ev.withColumn("seq", F.expr("row_number() over (partition by user_id order by ts, event_id)")).withColumn("hash", F.md5(F.concat_ws(":", "event_id", "event_type")))
    prev = F.coalesce(F.expr("lag(hash) over (partition by user_id order by seq)"), F.lit(""))
    return e.chain_breaks(seq.select(F.col("user_id").alias("run"), F.col("seq").cast("bigint").alias("seq"), "hash", F.when(F.col("event_id") % 50 == 0, "x").otherwise(prev).alias("prev_hash")))


def ledger(s, d):
    """Old orders, updated by those of one priority at a later time."""
    o = views.table(s, d, "orders").selectExpr("o_custkey k", "o_orderdate at", "o_orderkey v")
    return e.upsert_latest(o.filter("v % 3 > 0").groupBy("k", "at").agg(F.max("v").alias("v")), o.filter("v % 3 = 0").groupBy("k", "at").agg(F.max("v").alias("v")), "k", "at")


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
QUERIES = {
    "h1_tokens": lambda s, d: views.table(s, d, "documents").select("doc_id", F.size(e.tokens(F.col("text"))).cast("long").alias("n"), F.size(F.array_distinct(e.tokens(F.col("text")))).cast("long").alias("n_distinct")),
    "h2_lexical_score": lexical,
    "h15_injection_flags": lambda s, d: views.table(s, d, "pages").select("page_id", F.array_join(e.injection_flags(F.col("html")), ",").alias("flags")),
    "h20_d29_failure_clusters": lambda s, d: e.failure_clusters(traces(s, d)),
    "h24_chain_breaks": chain,
    "a17_upsert_latest": ledger,
    "d5_cohort_denominator": lambda s, d: e.family_counts(views.table(s, d, "events"), "event_type", "user_id"),
}
SQL = {
    "h1_tokens": f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n, CAST(len(list_distinct({_TOK})) AS BIGINT) AS n_distinct FROM documents",
    "h2_lexical_score": f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark), t AS (SELECT doc_id, {_TOK} AS t FROM documents), u AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL), f AS (SELECT term, ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + count(*))) + 1 AS idf FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, sum(idf * tf / sqrt(n)) AS score FROM p JOIN f USING (term) JOIN q USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
    "h15_injection_flags": f"SELECT page_id, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{n}' END" for n, p in e.INJECTIONS)}) AS flags FROM pages",
    "h20_d29_failure_clusters": """WITH n AS (SELECT event_id, event_type, props, trim(regexp_replace(regexp_replace(regexp_replace(lower(props), '"[^"]*"', '<q>', 'g'), '[-+]?[0-9]+(\\.[0-9]+)?', '<num>', 'g'), '\\s+', ' ', 'g')) AS m FROM events),
s AS (SELECT *, substr(sha256(event_type || chr(0) || chr(0) || m), 1, 16) AS signature FROM n) SELECT signature, count(*) AS n, count(DISTINCT event_type) AS n_kinds, arg_min(props, event_id) AS example FROM s GROUP BY signature ORDER BY n DESC, signature LIMIT 20""",
    "h24_chain_breaks": """WITH s AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT run, count(*) AS events, min(seq) FILTER (event_id % 50 = 0) AS broken_seq FROM s GROUP BY run""",
    "a17_upsert_latest": """WITH o AS (SELECT o_custkey AS k, o_orderdate AS "at", o_orderkey % 3 = 0 AS new, max(o_orderkey) AS v FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at" DESC, new DESC) AS n FROM o) SELECT k, "at", v FROM r WHERE n = 1""",
    "d5_cohort_denominator": "SELECT event_type, user_id, count(*) AS denominator, event_type || ':' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS cohort_id FROM events GROUP BY ALL",
}
