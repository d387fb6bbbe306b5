"""Queries of the readers, the contracts and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf
from refspark.functions.sql import register_sql
from refspark.operators.processed import pending, record, state_table
from refspark.operators.records import register_trials
from refspark.plans import views
from refspark.plans.series_plans import MU, PRICE, PROB
from refspark.shared import folder
from refspark.sources import tables as t
from refspark.sources.versioned import VersionedTable, sink
from refspark.streaming import jobs


def sql_functions(s, d):
    register_sql(s)
    b = views.bracket(s, d).selectExpr("event_id", "line", "part", "size", f"{PRICE} price", f"{PROB} prob", f"{MU} mu")
    return b.selectExpr("event_id", "line", "part", "size", "round(fee_frac(price, 0.07D, 1D), 6) fee", "round(kelly_size(prob, price, 0.25D, 0.1D), 6) kelly", "round(normal_cdf(mu), 6) phi")


def factor_texts(s, d):
    """Monthly means of each priority's orders as a text of factor blocks, written and read again."""
    m = views.table(s, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyyMM").alias("m")).agg(F.round(F.avg("o_totalprice") / 1000, 2).alias("a"), F.round(F.max("o_totalprice") / 1000, 2).alias("b"))
    lines = m.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(", ", "m", F.format_string("%.2f", "a"), F.when(F.col("m").endswith("01"), "-99.99").otherwise(F.format_string("%.2f", "b"))))), "\n").alias("rows"))
    at = jobs.folder(s)
    lines.select(F.concat(F.lit("Some words\n\n,Mean,Most\n"), "rows", F.lit("\n")).alias("value")).write.text(at)
    return t.factor_blocks(s, at).groupBy("ts", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def inferred(s, d):
    """A panel whose date column is found by its content; the years beside it are none."""
    rows = views.table(s, d, "events").selectExpr("year(ts) y", "cast(ts as string) stamp", "event_type ticker", "value", "event_id")
    return t.load_panel(rows, order="event_id")


def market(s, d):
    b = views.bracket(s, d)
    return b.selectExpr("concat_ws('-', event_id, line, part) ticker", "city", "close_time close_date", "entry_price p_close", "outcome", "volume", "2 * volume open_interest", "entry_price <= 0.35D is_tail")


def ohlc(s, d):
    stream = jobs.arriving(s, d, "events").selectExpr("event_type series_id", "ts", "value", "event_id")
    return jobs.run_available(jobs.stream_ohlc(stream, "event_id"))


def triage(s, d):
    stream = jobs.arriving(s, d, "events").selectExpr("ts", "event_type kind", "props reason")
    return jobs.run_available(jobs.stream_triage(stream), "update", ("day", "signature"))


def new_records(s, d):
    stream = jobs.arriving(s, d, "events").selectExpr("ts", "md5(concat_ws(':', event_type, props)) receipt")
    return jobs.run_available(jobs.stream_new_records(stream, "receipt", late="365 days")).select("receipt")


def stream_ledger(s, d):
    """Orders as they arrive, put into a ledger in which every fifth strategy has been scored."""
    table = VersionedTable(s, folder(s, "ledger"), "strategy", "strategy bigint, denominator bigint, scored boolean")
    start = views.table(s, d, "customer").filter("c_custkey % 5 = 0").selectExpr("c_custkey strategy", "7L denominator", "true scored")
    table.upsert(start, lambda old, new: new)
    stream = jobs.arriving(s, d, "orders").selectExpr("o_custkey strategy", "o_orderkey % 90 denominator")
    largest = lambda old, new: register_trials(old, new.groupBy("strategy").agg(F.max("denominator").alias("denominator")))
    jobs.run_sink(stream, sink(table, largest, "orders"))
    return table.read()


def processed_filter(s, d):
    """The second run over documents: half were done, some failed once or thrice, some have changed since, some are forced."""
    docs = views.table(s, d, "documents").selectExpr("doc_id", "cast(doc_id as string) source", "text")
    table = state_table(s, folder(s, "processed"))
    before = docs.filter("doc_id % 2 = 0").withColumn("text", F.expr("if(doc_id % 10 = 0, concat('older ', text), text)"))
    first = pending(before.drop("doc_id"), table.read())
    status = F.expr("case when source % 8 = 0 then 'failed' else 'done' end")
    record(table, first.select("source", "hash", status.alias("status"), F.expr("if(source % 16 = 0, 3, attempt)").alias("attempt"), F.expr("timestamp'2024-01-01'").alias("at")))
    return pending(docs, table.read(), F.col("doc_id") % 50 == 4).select("doc_id", "why", "attempt")


QUERIES = {
    "s3_stream_ledger": stream_ledger,
    "h31_processed_filter": processed_filter,
    "a1_read_table": lambda s, d: t.read_table(s, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")),
    "a3_infer_date": inferred,
    "a15_factor_blocks": factor_texts,
    "a2_load_panel": lambda s, d: t.load_panel(views.table(s, d, "events"), "ts", "event_type", "value", "event_id"),
    "a5_panel_contract": lambda s, d: t.panel_contract(views.panel(s, d), "ret")[1],
    "a6_event_calendar": lambda s, d: t.event_calendar(views.table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day")), "day"),
    "a7_coerce_market": lambda s, d: t.coerce_tail_market(market(s, d)).select("event_id", "close_time", "strike_low", "strike_high", F.round("entry_price", 6).alias("entry_price"), "outcome", "underlying.city", "underlying.is_tail"),
    "a9_lookahead": lambda s, d: t.lookahead(views.bracket(s, d).withColumn("asof_time", F.col("close_time")), "event_id"),
    "a5_panel": lambda s, d: t.checked_kind(t.panel_contract(views.panel(s, d), "ret")[0], "return").select("ts", "entity", "kind", F.round("ret", 6).alias("ret")),
    "a9_reject_lookahead": lambda s, d: t.reject_lookahead(views.bracket(s, d).withColumn("asof_time", F.expr("decision_time + make_interval(0, 0, 0, int(if(city % 3 = 0 and event_id % 7 = 0, 1, -1)))")), "city").groupBy("city").agg(F.count("*").alias("n")),
    "a10_parse_underlying": lambda s, d: views.table(s, d, "events").select("event_id", t.parse_underlying(F.col("props"), "k long")["k"].alias("k")),
    "u4_sql_functions": sql_functions,
    "s1_stream_ohlc": ohlc,
    "s2_stream_triage": triage,
    "s3_stream_records": new_records,
}
_BR = views.BRACKET_SQL

SQL = {
    "s3_stream_ledger": """WITH o AS (SELECT o_custkey AS strategy, max(o_orderkey % 90) AS denominator FROM orders GROUP BY ALL), c AS (SELECT c_custkey AS strategy FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(c.strategy, o.strategy) AS strategy, CASE WHEN c.strategy IS NOT NULL THEN 7 ELSE denominator END AS denominator, c.strategy IS NOT NULL AS scored FROM o FULL JOIN c ON c.strategy = o.strategy""",
    "h31_processed_filter": """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 50 = 4 THEN 'forced' WHEN doc_id % 2 <> 0 THEN 'new' WHEN doc_id % 10 = 0 AND text IS NOT NULL THEN 'changed' WHEN doc_id % 8 = 0 AND doc_id % 16 <> 0 THEN 'retry' END AS why FROM documents)
SELECT doc_id, why, CASE WHEN why = 'new' OR why = 'changed' THEN 1 WHEN why = 'retry' THEN 2 WHEN doc_id % 16 = 0 THEN 4 ELSE 2 END AS attempt FROM w WHERE why IS NOT NULL""",
    "a1_read_table": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL",
    "a3_infer_date": "SELECT ts, event_type AS entity, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "a15_factor_blocks": """WITH m AS (SELECT o_orderpriority, last_day(o_orderdate) AS d, month(o_orderdate) = 1 AS jan, round(avg(o_totalprice) / 1000, 2) AS a, round(max(o_totalprice) / 1000, 2) AS b FROM orders GROUP BY ALL),
u AS (SELECT d, 'Mean' AS name, a / 100 AS v FROM m UNION ALL SELECT d, 'Most', b / 100 FROM m WHERE NOT jan) SELECT CAST(d AS TIMESTAMP) AS ts, name, count(*) AS n, round(sum(v), 6) AS total FROM u GROUP BY ALL""",
    "s2_stream_triage": """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, substr(sha256(event_type || chr(0) || chr(0) || trim(regexp_replace(regexp_replace(regexp_replace(lower(props), '"[^"]*"', '<q>', 'g'), '[-+]?[0-9]+(\\.[0-9]+)?', '<num>', 'g'), '\\s+', ' ', 'g'))), 1, 16) AS signature, count(*) AS n
FROM events GROUP BY ALL""",
    "a2_load_panel": "SELECT ts, event_type AS entity, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "a5_panel_contract": f"WITH {views.PANEL_SQL}, c AS (SELECT entity, ts, count(*) AS n, count(ret) AS v FROM panel GROUP BY ALL), e AS (SELECT entity, count(*) FILTER (n > 1) AS d, sum(v) AS v FROM c GROUP BY ALL) SELECT CAST(sum(d) AS BIGINT) AS duplicates, count(*) FILTER (v = 0) AS empty_entities, count(*) AS entities FROM e",
    "a6_event_calendar": "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS event_ts FROM orders WHERE o_orderpriority = '1-URGENT'",
    "a7_coerce_market": f"WITH {_BR} SELECT concat_ws('-', event_id, line, part) AS event_id, close_time, 0e0 AS strike_low, 1e0 AS strike_high, round(entry_price, 6) AS entry_price, outcome, city, entry_price <= 0.35e0 AS is_tail FROM bracket",
    "a9_lookahead": f"WITH {_BR} SELECT event_id, CASE WHEN bool_or(close_time > decision_time) THEN 'rejected' ELSE 'verified' END AS status FROM bracket GROUP BY event_id",
    "a5_panel": f"WITH {views.PANEL_SQL} SELECT ts, entity, 'return' AS kind, round(ret, 6) AS ret FROM panel WHERE entity IN (SELECT entity FROM panel WHERE ret IS NOT NULL)",
    "a9_reject_lookahead": f"WITH {_BR} SELECT city, count(*) AS n FROM bracket WHERE city NOT IN (SELECT city FROM bracket WHERE city % 3 = 0 AND event_id % 7 = 0) GROUP BY city",
    "a10_parse_underlying": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "u4_sql_functions": f"""WITH {_BR}, q AS (SELECT event_id, line, part, size, {PRICE} AS price, {PROB} AS prob, {MU} AS mu FROM bracket), k AS (SELECT *, price IS NOT NULL AND NOT isnan(price) AS priced, CASE WHEN price < 1e-4 THEN 1e-4 WHEN price > 0.9999e0 THEN 0.9999e0 ELSE price END AS held FROM q)
SELECT event_id, line, part, size, CASE WHEN priced THEN round(0.07e0 * held * (1 - held), 6) END AS fee,
  CASE WHEN NOT priced OR prob IS NULL OR isnan(prob) THEN NULL WHEN price >= 1 OR prob <= price THEN 0 WHEN 0.25e0 * (prob - price) / (1 - price) > 0.1e0 THEN 0.1e0 ELSE round(0.25e0 * (prob - price) / (1 - price), 6) END AS kelly, round({norm_cdf('mu')}, 6) AS phi FROM k""",
    "s1_stream_ohlc": "WITH b AS (SELECT event_type AS series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT * FROM b WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE value IS NOT NULL)",
    "s3_stream_records": "SELECT DISTINCT md5(event_type || ':' || props) AS receipt FROM events",
}
