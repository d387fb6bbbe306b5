"""Readers and contracts of the tables that a user brings: by suffix, with roles of columns found by name or by content."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# The column names that are taken for a role, in this order.
DATE_COLUMNS = ("date", "timestamp", "time", "datetime")
ENTITY_COLUMNS = ("entity", "asset", "ticker", "symbol", "permno", "id")
VALUE_COLUMNS = ("value", "return", "returns", "characteristic", "signal")


def role(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """df's column for a role: the first of `names` that it has, in any case."""
    lower = {c.lower(): c for c in df.columns}
    return next((lower[n] for n in names if n in lower), None)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, read by its suffix: parquet, csv, txt, jsonl, ndjson or json (one document)."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".csv", ".txt"):
        return spark.read.option("header", True).csv(path)
    if kind in (".jsonl", ".ndjson", ".json"):
        return spark.read.option("multiLine", kind == ".json").json(path)
    raise ValueError(f"data_unavailable: no reader for {kind or path}")


def infer_date_column(df: DataFrame, least: float = 0.8) -> str | None:
    """The first column at least that share of whose rows parses as a time: one pass over all columns, one row back. Plain years and other short numbers are no times."""
    shares = df.agg(*[F.avg(F.expr(f"int(try_to_timestamp(cast(`{c}` as string)) is not null and not cast(`{c}` as string) rlike '^[0-9]{{1,7}}$')")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return next((c for c, share in zip(df.columns, shares, strict=True) if (share or 0) >= least), None)


def load_panel(df: DataFrame, date: str | None = None, entity: str | None = None, value: str | None = None, order: str | None = None) -> DataFrame:
    """ts, entity, value of a long table (entity and value named, or found by role) or of a wide one (each other column is an entity).

    Rows whose date doesn't parse go; a bad number is null; of a (ts, entity)'s rows the last by `order` stays.
    """
    date = date or role(df, DATE_COLUMNS) or infer_date_column(df)
    if date is None:
        raise ValueError("data_unavailable: no date column")
    entity, value = entity or role(df, ENTITY_COLUMNS), value or role(df, VALUE_COLUMNS)
    if entity is None or value is None:
        wide = [c for c in df.columns if c not in (date, order)]
        keep = [date] + ([order] if order else [])
        df = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in wide]).unpivot(keep, wide, "entity", "value")
        entity, value = "entity", "value"
    long = df.select(F.expr(f"try_to_timestamp(cast(`{date}` as string))").alias("ts"), F.col(entity).cast("string").alias("entity"), F.expr(f"try_cast(`{value}` as double)").alias("value"), (F.col(order) if order else F.col(value)).alias("o"))
    return long.filter("ts is not null").groupBy("ts", "entity").agg(F.max_by(F.struct("value"), "o").alias("v")).select("ts", "entity", "v.value")


def panel_contract(panel: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The panel without entities that never have a value, and one row of counts: duplicates, empty_entities, entities."""
    w = W.partitionBy("entity")
    kept = panel.withColumn("__n", F.count(value).over(w)).filter("__n > 0").drop("__n")
    cells = panel.groupBy("ts", "entity").agg(F.count("*").alias("n"), F.count(value).alias("v"))
    counts = cells.groupBy("entity").agg(F.sum(F.expr("int(n > 1)")).alias("d"), F.sum("v").alias("v"))
    return kept, counts.agg(F.sum("d").alias("duplicates"), F.sum(F.expr("int(v = 0)")).cast("long").alias("empty_entities"), F.count("*").alias("entities"))


def checked_kind(panel: DataFrame, kind: str) -> DataFrame:
    """The panel with its kind: return, price or characteristic; any other is refused."""
    if kind not in ("return", "price", "characteristic"):
        raise ValueError(f"spec_error: a panel can't be of kind {kind!r}")
    return panel.withColumn("kind", F.lit(kind))


def reject_lookahead(df: DataFrame, by: str, decision: str = "decision_time") -> DataFrame:
    """df without the tables (values of `by`) of which any row knows something later than its decision."""
    bad = lookahead(df, by, decision).filter("status = 'rejected'").select(by)
    return df.join(bad, by, "left_anti")


def event_calendar(df: DataFrame, at: str) -> DataFrame:
    """The distinct times of a calendar; unparseable and null ones go."""
    return df.select(F.expr(f"try_to_timestamp(cast(`{at}` as string))").alias("event_ts")).filter("event_ts is not null").distinct()


def coerce_tail_market(df: DataFrame) -> DataFrame:
    """Tail-market rows (ticker, close_date, p_close, outcome, city, volume, open_interest, is_tail) as bracket rows with strikes 0 and 1."""
    inner = F.struct(*[c for c in ("ticker", "city", "volume", "open_interest", "is_tail") if c in df.columns])
    return df.select(F.col("ticker").alias("event_id"), F.col("close_date").alias("close_time"), F.lit(0.0).alias("strike_low"), F.lit(1.0).alias("strike_high"), F.col("p_close").alias("entry_price"), "outcome", inner.alias("underlying"))


def lookahead(df: DataFrame, key: str, decision: str = "decision_time", stamps: tuple[str, ...] = ("underlying_time", "underlying_asof", "asof_time", "model_time")) -> DataFrame:
    """key and status: rejected if any of the stamps that df has is later than the decision, else verified; unverified without stamps."""
    found = [c for c in stamps if c in df.columns]
    if not found:
        return df.select(key).distinct().withColumn("status", F.lit("unverified"))
    late = F.lit(False)
    for c in found:
        late = late | F.coalesce(F.col(c) > F.col(decision), F.lit(False))
    return df.groupBy(key).agg(F.bool_or(late).alias("late")).select(key, F.when(F.col("late"), "rejected").otherwise("verified").alias("status"))


def parse_underlying(text: Column, fields: str) -> Column:
    """JSON text as a struct of `fields` (a DDL string); text that isn't JSON gives null fields."""
    return F.from_json(text, fields)


def factor_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, block, label, ts, name, value of text files with several blocks of dated rows.

    A block is a run of lines that start with a date (YYYYMM or YYYYMMDD) and a comma; its header is the nearest line before it with a
    comma and no date. Percents become fractions; values of -99 or less are missing. Lines are ordered within their own file.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
    w = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    dated = F.col("line").rlike(r"^\s*\d{6}(\d{2})?\s*,")
    lines = files.withColumns({"dated": dated, "header": F.when(~dated & F.col("line").contains(","), F.col("line"))})
    lines = lines.withColumn("start", F.expr("int(dated)") * F.expr("int(not coalesce(lag(dated) over (partition by path order by k), false))"))
    lines = lines.withColumns({"block": F.sum("start").over(w), "header": F.last("header", ignorenulls=True).over(w)}).filter("dated")
    cells = lines.withColumns({"cell": F.split("line", ","), "names": F.split("header", ",")}).select("path", "block", F.trim(F.col("cell")[0]).alias("day"), F.posexplode(F.arrays_zip("names", "cell")).alias("i", "z"))
    day = F.when(F.length("day") == 6, F.last_day(F.to_date("day", "yyyyMM"))).otherwise(F.to_date("day", "yyyyMMdd")).cast("timestamp")
    value = F.expr("try_cast(trim(z.cell) as double)")
    return cells.filter("i > 0").select("path", "block", day.alias("ts"), F.trim("z.names").alias("name"), value.alias("v")).filter("v > -99").withColumn("value", F.col("v") / 100).drop("v")
