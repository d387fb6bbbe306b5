"""Queries of the record, receipt, chain and trace operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import evidence as e
from refspark.operators import receipts as r
from refspark.plans import views


def decisions(s, d):
    return views.table(s, d, "orders").selectExpr(
        "o_orderkey claim_id", "if(o_orderkey % 13 = 0, null, concat('claim ', o_custkey % 40)) claim_statement", "concat('{\"p\":', o_orderkey % 7, '}') spec",
        "case when o_totalprice > 150000 then 'kill' when o_totalprice > 80000 then 'watch' else 'needs_data' end verdict", "if(o_totalprice > 150000, if(o_orderstatus = 'O', 'no_oos_edge', 'fee_curve'), null) kill_reason",
        "o_orderpriority data_footprint", "o_orderdate at", "concat(o_custkey % 50, if(o_orderkey % 2 = 0, o_orderstatus, 'x')) domain_key", "o_orderkey % 4 > 0 replicated", "o_orderkey % 9 > 0 power_sufficient")


def records(s, d):
    """Kill records, some of which have been changed after their receipt was made."""
    k = r.export_kills(decisions(s, d)).withColumn("record_id", F.col("claim_id"))
    changed = F.col("record_id") % 17
    receipt = F.when(changed == 1, F.col("receipt").withField("verdict", F.lit("watch"))).when(changed == 2, F.lit(None)).otherwise(F.col("receipt"))
    return k.withColumns({"receipt": receipt, "kill_reason": F.when(changed == 3, "other").otherwise(F.col("kill_reason")), "spec": F.when(changed == 4, "{}").otherwise(F.col("spec")), "schema_version": F.when(changed == 5, 2).otherwise(F.col("schema_version"))})


def ingest(s, d):
    rows = records(s, d)
    seen = rows.filter("record_id % 5 = 0 and record_id % 17 > 5").selectExpr("receipt.receipt_hash receipt_hash", "'none' claim_spec_key")
    return r.ingest_records(rows, seen).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def chain(s, d):
    events = views.table(s, d, "events").selectExpr("user_id run", "event_id", "row_number() over (partition by user_id order by event_id) - 1 seq", "concat_ws(':', event_type, props) text")
    hashed = events.select("run", "event_id", "seq", "text", F.sha2("text", 256).alias("payload"))
    built = r.build_chain(events.select("run", "seq", F.col("text").alias("payload")))
    j = hashed.join(built, ["run", "seq"])
    changed = j.withColumn("payload", F.when(F.col("event_id") % 211 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("payload")))
    return r.verify_chain(changed).select("run", "events", "broken_seq")


def roots(s, d):
    """The highest price of each day, a seventh of it, which is the same double in every engine."""
    days = views.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("day", "l_shipdate").alias("ts")).agg((F.max("l_extendedprice") / 7).alias("value"))
    return r.merkle_root(days)


def mismatch(s, d):
    a = roots(s, d)
    return r.merkle_mismatch(a.withColumn("root", F.when(F.col("series_id") == "R", F.reverse("root")).otherwise(F.col("root"))), a).select("series_id")


def stages(s, d):
    o = views.table(s, d, "orders").selectExpr(
        "o_orderkey", "case o_orderkey % 8 when 0 then 'needs_data' when 1 then 'pending_module' when 2 then 'needs_review' when 3 then 'cannot_replicate' when 4 then 'engine_error' when 5 then 'kill' when 6 then 'kill' else 'watch' end v",
        "case o_orderkey % 5 when 0 then 'unfaithful_spec' when 1 then 'fee_curve' when 2 then 'dedup' else 'no_oos_edge' end k", "case o_orderkey % 3 when 0 then array('P3', 'P6_data_availability') when 1 then array('P3', 'P6_variable_coverage') else cast(array() as array<string>) end st",
        "case o_orderkey % 7 when 0 then 'P5 sorting' when 1 then 'module run' when 2 then 'loader' end stage")
    return o.select("o_orderkey", r.exit_stage(F.col("v"), F.col("k"), F.col("st"), F.col("stage")).alias("exit_stage"))


def missing(s, d):
    o = views.table(s, d, "orders").selectExpr("o_orderkey", "concat('data_unavailable: ', o_orderpriority, ', the dvol_', o_custkey % 10, '; gdp.x, nothing, DVOL_', o_custkey % 10, ', price') reason")
    return o.select("o_orderkey", F.array_join(r.missing_series(F.when(F.col("o_orderkey") % 6 > 0, F.col("reason")), F.array(F.lit("price"))), "|").alias("missing"))


def normalized(s, d):
    ev = views.table(s, d, "events").selectExpr("event_id", """concat(event_type, ' ''', user_id, ''' at ', cast(ts as string), ' took -', value, '% in /tmp/x', user_id, '/y: "', props, '" `', user_id, '` 0xAF', user_id, ' v2 ') reason""")
    return ev.select("event_id", e.normalize_failure(F.col("reason")).alias("category"), e.failure_signature(F.lit("kill"), F.lit("P8"), F.col("reason")).alias("signature"))


def learned(s, d):
    analysis = views.table(s, d, "orders").selectExpr("o_orderkey - 1 claim_id", "o_orderdate at", "o_orderpriority domain", "o_orderstatus family", "o_orderdate date")
    own = decisions(s, d).selectExpr("claim_id", "verdict", "kill_reason", "if(claim_id % 3 = 0, 'own', null) domain", "cast(null as string) family", "if(claim_id % 2 = 0, at, null) date", "replicated", "power_sufficient")
    return r.decision_records(own, analysis)


def facts(s, d):
    docs = views.table(s, d, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("tag")).agg(F.expr("slice(array_sort(collect_list(struct(cast(ts as string) as end, cast(date_add(to_date(ts), 30) as string) as filed, cast(if(event_id % 10 = 0, null, event_id) as string) as val))), 1, 5)").alias("rows"))
    docs = docs.filter("hash(entity) is not null and (entity % 3 > 0 or tag <> 'view')").groupBy("entity").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tag", "rows")))).alias("json"))
    tags = s.createDataFrame([("look", "view", 1), ("look", "click", 2), ("buy", "purchase", 1)], "concept string, tag string, priority int")
    return r.extract_facts(docs, tags).groupBy("entity", "concept", "tag").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def searches(s, d):
    c = views.table(s, d, "orders").selectExpr("o_custkey run", "o_orderpriority family")
    return r.register_search(c, views.table(s, d, "customer").filter("c_custkey % 3 > 0").selectExpr("c_custkey run", "12L budget"))


QUERIES = {
    "a16_extract_facts": facts,
    "c17_merkle_mismatch": mismatch,
    "c18_decision_records": learned,
    "c19_missing_inputs": lambda s, d: r.missing_inputs(views.table(s, d, "orders").selectExpr("o_orderkey claim", "array(o_custkey, o_custkey * 2) inputs"), views.table(s, d, "customer").filter("c_acctbal > 0").selectExpr("c_custkey name")),
    "d39_merkle_root": roots,
    "h20_normalize_failure": normalized,
    "h21_exit_stage": stages,
    "h22_missing_series": missing,
    "h23_canonical_json": lambda s, d: views.table(s, d, "events").select("event_id", r.json_digest(user_id=F.col("user_id"), event_type=F.col("event_type"), event_id=F.col("event_id"), note=F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.lit("x"))).alias("digest")),
    "h24_verify_chain": chain,
    "h25_receipt": lambda s, d: r.build_receipt(decisions(s, d)).select("claim_id", "spec_hash", "receipt_hash"),
    "h26_export_kills": lambda s, d: r.export_kills(decisions(s, d), "me").select("claim_id", "claim_statement", "verdict", "kill_reason", F.col("receipt.receipt_hash").alias("receipt_hash"), "contributor_id"),
    "h27_ingest_records": ingest,
    "h29_register_search": searches,
    "h30_proposed_principles": lambda s, d: r.proposed_principles(decisions(s, d), "domain_key"),
    "h32_latest_verdicts": lambda s, d: r.latest_verdicts(decisions(s, d).select("claim_id", "verdict", "at"), 5000),
    "h33_list_by_prefix": lambda s, d: r.list_by_prefix(views.table(s, d, "supplier").selectExpr("cast(s_suppkey as string) node_id", "s_name title"), "1", 25),
}

_D = """d AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'claim ' || (o_custkey % 40) END AS st, CASE WHEN o_orderkey % 13 <> 0 THEN 'claim ' || (o_custkey % 40) END AS claim_statement, '{"p":' || (o_orderkey % 7) || '}' AS spec,
  CASE WHEN o_totalprice > 150000 THEN 'kill' WHEN o_totalprice > 80000 THEN 'watch' ELSE 'needs_data' END AS verdict, CASE WHEN o_totalprice > 150000 THEN CASE WHEN o_orderstatus = 'O' THEN 'no_oos_edge' ELSE 'fee_curve' END END AS kill_reason,
  o_orderpriority AS fp, o_orderdate AS "at", concat(o_custkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'x' END) AS domain_key, o_orderkey % 4 > 0 AS replicated, o_orderkey % 9 > 0 AS power FROM orders)"""
_R = """c AS (SELECT *, sha256(spec) AS spec_hash FROM d), rc AS (SELECT *, sha256(CAST(json_object('claim_statement', st, 'data_footprint', fp, 'kill_reason', kill_reason, 'schema_version', 1, 'spec_hash', spec_hash, 'verdict', verdict) AS VARCHAR)) AS receipt_hash FROM c)"""
_LEVELS = 13
_TREE = f"""leaf AS (SELECT series_id, sha256(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || printf('%.10g', value)) AS h, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM price),
l0 AS (SELECT * FROM leaf)""" + "".join(
    f""",
l{i + 1} AS (SELECT series_id, CASE WHEN n = 1 THEN min(h) ELSE sha256(arg_min(h, k) || arg_max(h, k)) END AS h, k // 2 AS k, (n + 1) // 2 AS n FROM l{i} GROUP BY series_id, k // 2, n)"""
    for i in range(_LEVELS)
)
SQL = {
    "a16_extract_facts": """WITH r AS (SELECT user_id AS entity, event_type AS tag, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS VARCHAR), event_id) AS k FROM events WHERE user_id % 3 > 0 OR event_type <> 'view'),
t AS (SELECT * FROM (VALUES ('look', 'view', 1), ('look', 'click', 2), ('buy', 'purchase', 1)) AS v(concept, tag, priority)),
f AS (SELECT entity, concept, tag, priority, event_id FROM r JOIN t USING (tag) WHERE k <= 5 AND event_id % 10 <> 0)
SELECT entity, concept, tag, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total FROM f WHERE (entity, concept, priority) IN (SELECT entity, concept, min(priority) FROM f GROUP BY ALL) GROUP BY ALL""",
    "c17_merkle_mismatch": "SELECT DISTINCT l_returnflag AS series_id FROM lineitem WHERE l_returnflag = 'R'",
    "c18_decision_records": f"""WITH {_D}, a AS (SELECT o_orderkey - 1 AS claim_id, o_orderpriority AS domain, o_orderstatus AS family, o_orderdate AS date FROM orders)
SELECT d.claim_id, verdict, kill_reason, coalesce(CASE WHEN d.claim_id % 3 = 0 THEN 'own' END, a.domain, 'other') AS domain, a.family, coalesce(CASE WHEN d.claim_id % 2 = 0 THEN "at" END, a.date) AS date,
  verdict = 'kill' AND replicated AND power AS structural FROM d LEFT JOIN a USING (claim_id)""",
    "c19_missing_inputs": "SELECT DISTINCT o_orderkey AS claim, input FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey * 2]) AS input FROM orders) WHERE input NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "d39_merkle_root": f"WITH price AS (SELECT l_returnflag AS series_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, max(l_extendedprice) / 7 AS value FROM lineitem GROUP BY ALL), {_TREE} SELECT series_id, h AS root FROM l{_LEVELS}",
    "h21_exit_stage": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'P6_data_availability' ELSE 'P7' END WHEN 1 THEN 'P6'
  WHEN 2 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'P6_variable_coverage' ELSE 'P6' END
  WHEN 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'P6_pre_fidelity' ELSE last END WHEN 4 THEN CASE o_orderkey % 7 WHEN 0 THEN 'P5' WHEN 1 THEN 'P7' WHEN 2 THEN 'loader' ELSE 'engine_error' END
  WHEN 7 THEN last ELSE CASE o_orderkey % 5 WHEN 1 THEN 'P4' WHEN 2 THEN 'P5' ELSE 'P8' END END AS exit_stage
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'P6_data_availability' WHEN 1 THEN 'P6_variable_coverage' ELSE 'unknown' END AS last FROM orders)""",
    "h22_missing_series": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'unspecified' WHEN o_orderpriority LIKE '%NOT SPECIFIED%' THEN 'gdp.x|DVOL_' || (o_custkey % 10) || '|price' ELSE 'gdp.x|DVOL_' || (o_custkey % 10) || '|price' END AS missing FROM orders""",
    "h23_canonical_json": "SELECT event_id, sha256(CAST(json_object('event_id', event_id, 'event_type', event_type, 'note', CASE WHEN event_id % 3 <> 0 THEN 'x' END, 'user_id', user_id) AS VARCHAR)) AS digest FROM events",
    "h24_verify_chain": "SELECT user_id AS run, count(*) AS events, min(seq) FILTER (event_id % 211 = 0) AS broken_seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) GROUP BY ALL",
    "h25_receipt": f"WITH {_D}, {_R.replace('st,', 'st,')} SELECT claim_id, spec_hash, receipt_hash FROM rc",
    "h26_export_kills": f"WITH {_D}, {_R} SELECT claim_id, st AS claim_statement, verdict, kill_reason, receipt_hash, 'me' AS contributor_id FROM rc WHERE verdict = 'kill'",
    "h27_ingest_records": f"""WITH {_D}, {_R}, k AS (SELECT *, claim_id % 17 AS m FROM rc WHERE verdict = 'kill'),
v AS (SELECT *, CASE m WHEN 1 THEN 'receipt_hash_mismatch' WHEN 2 THEN 'receipt_not_object' WHEN 3 THEN 'kill_reason_mismatch' WHEN 4 THEN 'spec_hash_mismatch' WHEN 5 THEN 'unsupported_schema_version' ELSE 'ok' END AS reason FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY receipt_hash, reason = 'ok' ORDER BY claim_id) > 1 OR row_number() OVER (PARTITION BY st, spec_hash, reason = 'ok' ORDER BY claim_id) > 1 OR receipt_hash IN (SELECT receipt_hash FROM k WHERE claim_id % 5 = 0 AND m > 5) AS again FROM v)
SELECT CASE WHEN reason <> 'ok' THEN 'invalid' WHEN again THEN 'duplicate' ELSE 'ingested' END AS outcome, reason, count(*) AS n FROM w GROUP BY ALL""",
    "h29_register_search": """WITH e AS (SELECT o_custkey AS run, count(*) AS emitted FROM orders GROUP BY ALL) SELECT DISTINCT o.o_custkey AS run, o_orderpriority AS family, greatest(emitted, CASE WHEN c_custkey % 3 > 0 THEN 12 END) AS denominator
FROM orders o JOIN e ON e.run = o.o_custkey LEFT JOIN customer ON c_custkey = o.o_custkey""",
    "h30_proposed_principles": f"WITH {_D} SELECT domain_key, count(*) AS kills, min(kill_reason) AS kill_reason FROM d WHERE verdict = 'kill' AND replicated GROUP BY ALL HAVING count(*) >= 3 AND min(kill_reason) = max(kill_reason)",
    "h32_latest_verdicts": f'WITH {_D} SELECT claim_id, verdict, "at" FROM d ORDER BY "at" DESC, claim_id LIMIT 1000',
    "h33_list_by_prefix": "SELECT CAST(s_suppkey AS VARCHAR) AS node_id, s_name AS title FROM supplier WHERE CAST(s_suppkey AS VARCHAR) LIKE '1%' ORDER BY 1 LIMIT 25",
}
