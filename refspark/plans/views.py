"""Series, panels and brackets over the driver tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NET_SQL = """net AS (SELECT l_suppkey AS series_id, n_name AS family, l_shipdate AS ts,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq,
  (l_discount - 0.048e0) / 10 AS net, CAST(sign(l_tax - 0.04e0) AS DOUBLE) AS position, l_discount - 0.05e0 AS payoff
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
PRICE_SQL = """price AS (SELECT l_returnflag AS series_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"""
PAIR_SQL = """pair AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"""
PAIRS_SQL = """pair AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"""
PANEL_SQL = """month AS (SELECT CAST(last_day(l_shipdate) AS TIMESTAMP) AS ts, l_suppkey AS entity, sum(l_extendedprice) AS dvol, avg(l_discount) AS characteristic FROM lineitem GROUP BY ALL),
panel AS (SELECT *, ln(dvol / lag(dvol) OVER (PARTITION BY entity ORDER BY ts)) AS ret FROM month)"""
BRACKET_SQL = """bracket AS (SELECT l_orderkey AS event_id, l_linenumber AS line, l_partkey AS part, l_extendedprice AS size, l_suppkey AS city, o_orderdate AS decision_time, l_shipdate AS close_time,
  0.05e0 + 9 * l_discount AS entry_price, CAST(l_returnflag = 'R' AS INT) AS outcome, p_size / 50e0 AS mu, l_quantity AS volume FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


#: Rows of lineitem in a task of a join or window, once there are more than SPREAD times as many.
TASK_ROWS, SPREAD = 500_000, 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(key: str, df: DataFrame, *others: tuple[DataFrame, str]) -> list[DataFrame]:
    """df by key and others by theirs, in parts of about TASK_ROWS rows of df, so a task's memory doesn't grow with the table. Small ones stay as they are. Counts df's rows, from the files' footers."""
    n = parts(df)
    return [x.repartition(n, k) if n else x for x, k in ((df, key), *others)]


def parts(df: DataFrame) -> int:
    """So many parts of about TASK_ROWS rows has df; none if there are SPREAD of them or fewer."""
    n = df.count() // TASK_ROWS
    return n if n > SPREAD else 0


def net(spark: SparkSession, d: str) -> DataFrame:
    """V3: a series of net results for each supplier; its nation is the family of the search."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("n_nationkey = s_nationkey")).select("s_suppkey", "n_name")
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines, s = spread("l_suppkey", table(spark, d, "lineitem"), (s, "s_suppkey"))
    rows = lines.join(s, F.expr("s_suppkey = l_suppkey"))
    return rows.select(F.col("l_suppkey").alias("series_id"), F.col("n_name").alias("family"), F.col("l_shipdate").alias("ts"), F.row_number().over(order).alias("seq"), F.expr("(l_discount - 0.048e0) / 10 net"), F.expr("sign(l_tax - 0.04e0) position"), F.expr("l_discount - 0.05e0 payoff"))


def price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(F.avg("l_extendedprice").alias("value"))


def pair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.count("*").cast("double").alias("x"), F.avg("o_totalprice").alias("y"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """pair, for each priority of orders."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").alias("ts"))
    return g.agg(F.count("*").cast("double").alias("x"), F.avg("o_totalprice").alias("y"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.last_day("l_shipdate").cast("timestamp").alias("ts"), F.col("l_suppkey").alias("entity")).agg(F.sum("l_extendedprice").alias("dvol"), F.avg("l_discount").alias("characteristic"))
    return m.withColumn("ret", F.log(F.col("dvol") / F.lag("dvol").over(W.partitionBy("entity").orderBy("ts"))))


def bracket(spark: SparkSession, d: str) -> DataFrame:
    lines, orders, part = spread("l_orderkey", table(spark, d, "lineitem"), (table(spark, d, "orders"), "o_orderkey"), (table(spark, d, "part"), "p_partkey"))
    rows = lines.join(orders, F.expr("o_orderkey = l_orderkey")).join(part, F.expr("p_partkey = l_partkey"))
    return rows.selectExpr("l_orderkey event_id", "l_linenumber line", "l_partkey part", "l_extendedprice size", "l_suppkey city", "o_orderdate decision_time", "l_shipdate close_time", "0.05e0 + 9 * l_discount entry_price", "int(l_returnflag = 'R') outcome", "p_size / 50e0 mu", "l_quantity volume")
