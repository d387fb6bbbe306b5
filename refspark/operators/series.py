"""Series and panel operators: windows by series_id or by date, resampling, alignment and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY = ("series_id",)
CADENCE = ((3, "annual"), (24, "monthly"), (90, "weekly"), (400, "daily"), (5000, "hourly"))


def over(by=BY, order=("ts",)):
    return W.partitionBy(*by).orderBy(*order)


def clean_series(df: DataFrame, order: str) -> DataFrame:
    """series_id, ts (UTC day) and value: no nulls or infinities; of a day's values the last by `order`."""
    ok = df.filter("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return ok.groupBy("series_id", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("value", F.struct("ts", order)).alias("value"))


def coverage(df: DataFrame, least: int = 30) -> DataFrame:
    """series_id, first, last, n, and whether there are `least` rows."""
    return df.groupBy("series_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("value").alias("n")).withColumn("available", F.col("n") >= least)


def observations_per_year(df: DataFrame) -> DataFrame:
    days = (F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400.0
    return coverage(df).withColumn("per_year", F.when(days > 0, F.col("n") / (days / 365.25)).otherwise(1.0))


def frequency_label(bpy: Column) -> Column:
    out = F.lit("intraday")
    for top, word in reversed(CADENCE):
        out = F.when(bpy <= top, word).otherwise(out)
    return F.when(bpy.isNull(), "unknown").otherwise(out)


def infer_bpy(df: DataFrame) -> DataFrame:
    """series_id, bpy (a year over the median positive gap; from 3 rows on) and its label."""
    gap = df.withColumn("gap", F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(over()))
    out = gap.groupBy("series_id").agg(F.count("*").alias("n"), F.expr("percentile(gap, 0.5) filter (where gap > 0)").alias("median"))
    return out.select("series_id", F.when(F.col("n") >= 3, 365.25 * 86400 / F.col("median")).alias("bpy")).withColumn("label", frequency_label(F.col("bpy")))


def resample_ohlc(df: DataFrame, tie: str, width: str = "day") -> DataFrame:
    """series_id, ts, open, high, low, close by UTC period; rows of one instant are ordered by `tie`."""
    at = F.struct("ts", tie)
    return df.filter("value is not null").groupBy("series_id", F.date_trunc(width, "ts").alias("day")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))


def full(n: int, agg: Column, value: str = "value", by=BY) -> Column:
    """agg over the last n rows, null until n of them have a value."""
    w = over(by).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, agg.over(w))


def lagged(df: DataFrame, n: int = 1) -> DataFrame:
    """df with lag_n, delta_n, log_return_n and pct_change of value over n rows; null over a value of zero."""
    prev = F.lag("value", n).over(over())
    ratio = F.try_divide("value", prev)
    return df.withColumns({f"lag_{n}": prev, f"delta_{n}": F.col("value") - prev, f"log_return_{n}": F.log(ratio), "pct_change": ratio - 1})


def check_granularity(df: DataFrame, expected: DataFrame) -> DataFrame:
    """series_id, label, expected, ok: the frequency that a series' gaps show against the one declared for it; unknown is no mismatch."""
    j = infer_bpy(df).join(expected, "series_id", "left")
    return j.select("series_id", "label", "expected", ((F.col("label") == "unknown") | F.coalesce(F.col("label") == F.col("expected"), F.lit(True))).alias("ok"))


def panel_coverage(panel: DataFrame, by: str) -> DataFrame:
    """by, first, last, dates, entities, cells of panels (by, ts, entity, value)."""
    return panel.filter("value is not null").groupBy(by).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("dates"), F.count_distinct("entity").alias("entities"), F.count("*").alias("cells"))


def bracket_coverage(brackets: DataFrame, by: str) -> DataFrame:
    """by, first, last (closing times), events, brackets."""
    return brackets.groupBy(by).agg(F.min("close_time").alias("first"), F.max("close_time").alias("last"), F.count_distinct("event_id").alias("events"), F.count("*").alias("brackets"))


def availability(df: DataFrame, start: str, end: str, least: int = 30) -> DataFrame:
    """series_id, n, available, reason of every series of df within [start, end]: one that is too short is unavailable, and says so."""
    inside = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    g = df.groupBy("series_id").agg(F.count_if(inside).alias("n"))
    return g.withColumns({"available": F.col("n") >= least, "reason": F.when(F.col("n") < least, F.concat(F.lit("data_unavailable: "), F.col("n").cast("string"), F.lit(f" of {least} observations")))})


def features(df: DataFrame, n: int = 20) -> DataFrame:
    """lag, delta, log return, rolling sum, mean, deviation and z-score of value. A return over a value of zero is null."""
    prev = F.lag("value").over(over())
    mean, sd = full(n, F.avg("value")), full(n, F.stddev_samp("value"))
    return df.withColumns({"lag_1": prev, "delta_1": F.col("value") - prev, "log_return": F.log(F.try_divide("value", prev)), "sum_n": full(n, F.sum("value")), "mean_n": mean, "std_n": sd, "z_n": F.when(sd > 0, (F.col("value") - mean) / sd)})


def benchmarks(df: DataFrame, ahead: int = 5) -> DataFrame:
    """expanding_mean and random_walk, both of rows before this one, and forward_vol: the population deviation of the next log returns."""
    r = F.log(F.try_divide("value", F.lag("value").over(over())))
    out = df.withColumn("r", r).withColumns({"expanding_mean": F.avg("value").over(over().rowsBetween(W.unboundedPreceding, -1)), "random_walk": F.lag("value").over(over()), "forward_vol": F.stddev_pop("r").over(over().rowsBetween(1, ahead))})
    return out.drop("r")


def regimes(df: DataFrame, n: int = 200) -> DataFrame:
    """trend (above or below the trailing mean; null until n rows), part_of_week, day_name, month_end, and session (asia before 8 h,
    europe before 16 h, us; null unless the series has a stamp off midnight)."""
    mean = full(n, F.avg("value"))
    intraday = F.bool_or((F.hour("ts") != 0) | (F.minute("ts") != 0)).over(W.partitionBy("series_id"))
    session = F.when(intraday, F.when(F.hour("ts") < 8, "asia").when(F.hour("ts") < 16, "europe").otherwise("us"))
    return df.withColumns({"trend": F.when(mean.isNotNull(), F.when(F.col("value") > mean, "above").otherwise("below")), "part_of_week": F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday"), "day_name": F.date_format("ts", "EEEE"), "session": session, "month_end": F.last_day("ts")})


def equity_curve(df: DataFrame) -> DataFrame:
    """equity: the product of 1 + simple returns up to each row; a bar after a value of zero or null earns nothing."""
    r = F.try_divide("value", F.lag("value").over(over()))
    return df.withColumn("step", F.coalesce(r, F.lit(1.0))).withColumn("equity", F.product("step").over(over().rowsBetween(W.unboundedPreceding, 0))).drop("step")


def lagged_pnl(df: DataFrame, cost: float = 0.0005, funding: str | None = None) -> DataFrame:
    """net of holding sign(previous change) over each bar, less the bar's funding, and cost for each change of position.

    Bars without a position or a change (at a series' start, after a value of zero) have no row.
    """
    move = df.withColumn("change", F.try_divide("value", F.lag("value").over(over())) - 1)
    held = move.withColumn("position", F.lag(F.signum("change")).over(over()))
    return held.withColumn("cost", cost * F.abs(F.col("position") - F.coalesce(F.lag("position").over(over()), F.lit(0.0)))).withColumn("net", F.col("position") * (F.col("change") - (F.coalesce(F.col(funding), F.lit(0.0)) if funding else F.lit(0.0))) - F.col("cost")).filter("net is not null")


def ols_single(df: DataFrame, x: str = "x", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """n, beta, r, r2 and t; null for fewer than 3 rows or no spread."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = (ok.groupBy(*by) if by else ok.groupBy()).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    good = F.expr("n >= 3 and vx > 0 and vy > 0")
    r = F.expr("c / sqrt(vx * vy)")
    return a.select(*by, "n", F.when(good, F.expr("c / vx")).alias("beta"), F.when(good, r).alias("r"), F.when(good, r * r).alias("r2"), F.when(good, r * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - r * r))).alias("t"))


def align_lead(x: DataFrame, y: DataFrame, h: int, by: tuple[str, ...] = BY) -> DataFrame:
    """by, ts, x, y_h and target_time: y led by h rows of the union of both indexes; incomplete rows go, and then every h-th stays.

    All is by key, so that many claims are aligned at once, each in its own window.
    """
    j = x.join(y, [*by, "ts"], "full_outer")
    w = W.partitionBy(*by).orderBy("ts")
    led = j.withColumns({"y_h": F.lead("y", h).over(w), "target_time": F.lead("ts", h).over(w)}).filter("x is not null and y_h is not null and target_time is not null")
    return led.withColumn("k", F.row_number().over(w) - 1).filter(F.col("k") % h == 0).select(*by, "ts", "x", "y_h", "target_time")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, lag_days: int = 0, order: str | None = None) -> DataFrame:
    """left with `value` of right's latest row at or before its time, by key: one shuffle of both sides and one window, no range join.

    A row of right counts from lag_days after its time on. Of rows of one time the last by `order` counts (without it the largest value).
    """
    if lag_days:
        right = right.withColumn(at, F.col(at) + F.expr(f"interval {lag_days} days"))
    rows = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, at, F.lit(0).alias("__side"), F.col(value).alias("__v"), *([order] if order else [])).groupBy(key, at, "__side").agg((F.max("__v") if order is None else F.max_by("__v", order)).alias("__v")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__v")


def cross_section(panel: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """By date: rank_pct (ties by entity), z (null for under 2 values or no spread) and bucket 1..buckets."""
    has = F.col(value).isNotNull()
    ranked = W.partitionBy("ts", has).orderBy(value, "entity")
    by = W.partitionBy("ts")
    n, sd = F.count(value).over(by), F.stddev_samp(value).over(by)
    rank = F.row_number().over(ranked)
    return panel.withColumns({"rank_pct": F.when(has, rank / n), "z": F.when(has & (n >= 2) & (sd > 0), (F.col(value) - F.avg(value).over(by)) / sd), "bucket": F.when(has, F.least(F.lit(buckets), F.greatest(F.lit(1), F.ceil(rank * buckets / n))).cast("int"))})


def dollar_neutral_book(panel: DataFrame, factor: str, ret: str) -> DataFrame:
    """ts, port_return and gross: weights are z-scores (population deviation) over the sum of their sizes."""
    by = W.partitionBy("ts")
    ok = panel.filter(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    z = ok.withColumn("z", (F.col(factor) - F.avg(factor).over(by)) / (F.stddev_pop(factor).over(by) + 1e-9))
    w = z.withColumn("w", F.expr("z / nullif(sum(abs(z)) over (partition by ts), 0)"))
    return w.groupBy("ts").agg(F.sum(F.col("w") * F.col(ret)).alias("port_return"), F.sum(F.abs("w")).alias("gross"))


def information_coefficient(panel: DataFrame, factor: str, ret: str) -> DataFrame:
    """dates and ic: the mean over dates of the cross-sectional correlation."""
    c = panel.filter(F.col(factor).isNotNull() & F.col(ret).isNotNull()).groupBy("ts").agg(F.covar_pop(factor, ret).alias("c"), F.var_pop(factor).alias("a"), F.var_pop(ret).alias("b")).filter("a > 0 and b > 0")
    return c.agg(F.count("*").alias("dates"), F.avg(F.expr("c / sqrt(a * b)")).alias("ic"))


def liquidity_screen(panel: DataFrame, top: int, months: int = 3) -> DataFrame:
    """ts, entity and median of the `top` entities by median dvol over the last `months` calendar months; ties by entity."""
    w = W.partitionBy("entity").orderBy(F.year("ts") * 12 + F.month("ts")).rangeBetween(-(months - 1), 0)
    m = panel.withColumn("median", F.expr("percentile(dvol, 0.5)").over(w))
    return m.withColumn("k", F.row_number().over(W.partitionBy("ts").orderBy(F.desc("median"), "entity"))).filter(F.col("k") <= top).select("ts", "entity", "median", "k")


def clip_window(df: DataFrame, start: str, end: str, least: int = 30) -> DataFrame:
    """Rows of [start, end] of the series that have `least` of them."""
    cut = df.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return cut.withColumn("n", F.count("*").over(W.partitionBy("series_id"))).filter(F.col("n") >= least).drop("n")


def resample_agg(df: DataFrame, tie: str, width: str = "day") -> DataFrame:
    """series_id, day and the period's last, first, sum, mean, count, max and min."""
    at = F.struct("ts", tie)
    return df.filter("value is not null").groupBy("series_id", F.date_trunc(width, "ts").alias("day")).agg(F.max_by("value", at).alias("last"), F.min_by("value", at).alias("first"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.count("*").alias("count"), F.max("value").alias("max"), F.min("value").alias("min"))


WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def rebalance_dates(df: DataFrame, rule: str = "M") -> DataFrame:
    """The last days of the periods that have rows: D, W (to Sunday), W-MON to W-SUN (to that weekday), M, kM (k months from January on), Q or Y.

    Months, quarters and years may be written with an E, as in ME.
    """
    day = F.to_date("ts")
    rule = rule.strip().upper()
    rule = rule[:-1] if rule.endswith("E") and len(rule) > 1 else rule
    if rule == "D":
        end = day
    elif rule == "W" or rule.startswith("W-"):
        anchor = rule[2:] or "SUN"
        if anchor not in WEEKDAYS:
            raise ValueError(f"no weekday: {anchor}")
        end = F.next_day(F.date_sub(day, 1), anchor)
    else:
        months = {"Q": 3, "Y": 12}.get(rule) or int(rule[:-1] or 1)
        last = F.ceil((F.year(day) * 12 + F.month(day)) / months) * months - 1  # months since year 0, of the period's last month
        end = F.last_day(F.make_date(F.floor(last / 12).cast("int"), (last % 12 + 1).cast("int"), F.lit(1)))
    return df.select(end.cast("timestamp").alias("ts")).distinct()


def funding_carry(df: DataFrame, cost: float = 0.0005) -> DataFrame:
    """net of holding the sign of the row before, earning this row's value, less cost where that sign changes."""
    sign = F.signum(F.lag("value").over(over()))
    held = df.withColumn("position", sign)
    before = F.lag("position").over(over())
    return held.withColumn("net", F.col("position") * F.col("value") - F.when(F.col("position") != F.coalesce(before, F.lit(0.0)), cost).otherwise(0.0)).filter("net is not null")


def neutral_books(rows: DataFrame) -> DataFrame:
    """factor, ts, port_return, gross of many factors at once: dollar_neutral_book by (factor, ts). rows: factor, ts, entity, value, ret."""
    by = W.partitionBy("factor", "ts")
    ok = rows.filter(F.col("value").isNotNull() & F.col("ret").isNotNull())
    z = ok.withColumn("z", (F.col("value") - F.avg("value").over(by)) / (F.stddev_pop("value").over(by) + 1e-9))
    w = z.withColumn("w", F.try_divide("z", F.sum(F.abs("z")).over(by)))
    return w.groupBy("factor", "ts").agg(F.sum(F.col("w") * F.col("ret")).alias("port_return"), F.sum(F.abs("w")).alias("gross"))


def ranked_coefficients(rows: DataFrame, top: int = 10) -> DataFrame:
    """factor, dates, ic, rank of the `top` factors by the mean over dates of their correlation with ret; ties by name. rows as neutral_books."""
    ok = rows.filter(F.col("value").isNotNull() & F.col("ret").isNotNull())
    c = ok.groupBy("factor", "ts").agg(F.covar_pop("value", "ret").alias("c"), F.var_pop("value").alias("a"), F.var_pop("ret").alias("b")).filter("a > 0 and b > 0")
    g = c.groupBy("factor").agg(F.count("*").alias("dates"), F.avg(F.expr("c / sqrt(a * b)")).alias("ic"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("ic", 12)), "factor"))).filter(F.col("rank") <= top)  # one row a factor
