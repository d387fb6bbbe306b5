"""Claim executors: tables in, net series out; and the regressions and lenses on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.operators.scan import expanding_ranks
from refspark.operators.series import full, over
from refspark.shared import checkpointed


def predictive_regression(aligned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """net = sign x zx x zy and position = sign x zx of rows ts, x, y_h, target_time, by claim.

    Means and deviations come from the first half's rows whose target ends before the second half begins; claims with fewer than 20 rows,
    fewer than 3 such rows, or no spread have no rows.
    """
    rows = aligned.select(*aligned.columns, *([] if by else [F.lit(0).alias("__one")]))
    names = list(by) or ["__one"]
    w = W.partitionBy(*names)
    rows = rows.withColumns({"__k": F.row_number().over(w.orderBy("ts")), "__n": F.count("*").over(w)}).withColumn("__i", F.floor(F.col("__n") * 0.5))
    rows = rows.withColumn("__oos", F.min(F.when(F.col("__k") > F.col("__i"), F.col("ts"))).over(w))
    seen = rows.filter("__k <= __i and target_time < __oos and __n >= 20")
    m = seen.groupBy(*names).agg(F.count("*").alias("m_n"), F.avg("x").alias("mx"), F.avg("y_h").alias("my"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y_h").alias("sy"), F.covar_samp("x", "y_h").alias("c")).filter("m_n >= 3 and sx > 0 and sy > 0")
    out = rows.join(m, names).withColumn("position", F.signum("c") * (F.col("x") - F.col("mx")) / F.col("sx"))
    return out.select(*by, "ts", "position", (F.col("position") * (F.col("y_h") - F.col("my")) / F.col("sy")).alias("net"))


def signal_pnl(df: DataFrame, signal: Column, cost: float = 0.0005) -> DataFrame:
    """position = sign(signal), net = position x the next row's simple return, less cost where the position changes."""
    ret = F.try_divide("value", F.lag("value").over(over())) - 1
    held = df.withColumn("__r", ret).withColumn("position", F.signum(signal))
    flip = F.col("position") != F.coalesce(F.lag("position").over(over()), F.lit(0.0))
    return held.withColumn("net", F.col("position") * F.lead("__r").over(over()) - F.when(flip, cost).otherwise(0.0)).filter("net is not null").drop("__r")


def vol_regime(df: DataFrame, window: int = 60, least: int = 120) -> DataFrame:
    """series_id, ts, label: trailing volatility against the terciles of all volatility seen so far; none before `least` of it.

    A volatility reaches the upper tercile of the n seen if 2 (n - 1) / 3 of the others at least are no higher, and the lower one if (n - 1) / 3
    at most are lower: ranks among earlier rows, which are counted in ranges of time and of value.
    """
    r = df.withColumn("r", F.log(F.try_divide("value", F.lag("value").over(over()))))
    v = r.withColumn("vol", full(window, F.stddev_samp("r"), "r")).filter("vol is not null and not isnan(vol)").select("series_id", "ts", "vol")
    ranks = expanding_ranks(v, ["series_id"], ["ts"], "vol").filter(F.col("k") >= least - 1)
    label = F.when(F.col("upto") * 3 >= F.col("k") * 2, "high_vol").when(F.col("below") * 3 <= F.col("k"), "low_vol").otherwise("mid_vol")
    return ranks.select("series_id", "ts", label.alias("label"))


def momentum(returns: DataFrame, lookback: int = 12, skip: int = 1) -> DataFrame:
    """entity, ts (month end) and momentum: the compounded return of `lookback` months that ended `skip` months ago.

    ret is a log return. Months without rows count as missing, so the frame is by month number, not by row.
    """
    month = F.year("ts") * 12 + F.month("ts")
    m = returns.groupBy("entity", month.alias("m"), F.last_day("ts").cast("timestamp").alias("ts")).agg(F.sum("ret").alias("r"))
    w = W.partitionBy("entity").orderBy("m").rangeBetween(-(skip + lookback - 1), -skip)
    return m.withColumn("momentum", F.when(F.count("r").over(w) == lookback, F.exp(F.sum("r").over(w)) - 1)).select("entity", "ts", "momentum")


def form_factor(panel: DataFrame, signal: str, ret: str, buckets: int = 10, hold: int = 1, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """ts, net of the top bucket less the bottom one, with the memberships (rb, entity, bucket).

    At each month's last date entities are sorted by `signal`; the legs hold the returns of the next `hold` months, each name alike.
    Cohorts that cover one date are averaged. Returns meet their cohorts by month number, an equi-join.
    """
    month = F.year("ts") * 12 + F.month("ts")
    rows = panel.withColumn("m", month)
    last = rows.withColumn("__last", F.max("ts").over(W.partitionBy("m"))).filter(F.col("ts") == F.col("__last")).filter(F.col(signal).isNotNull())
    by = W.partitionBy("m")
    ranked = last.withColumns({"n": F.count("*").over(by), "rank": F.row_number().over(by.orderBy(signal, "entity"))}).filter(F.col("n") >= least)
    bucket = F.least(F.lit(buckets), F.greatest(F.lit(1), F.ceil(F.col("rank") * buckets / F.col("n")))).cast("int")
    members = ranked.select(F.last_day("ts").cast("timestamp").alias("rb"), F.col("m").alias("cohort"), "entity", bucket.alias("bucket")).filter(F.col("bucket").isin(1, buckets))
    held = rows.filter(F.col(ret).isNotNull()).select("ts", "entity", F.col(ret).alias("r"), F.explode(F.sequence(F.col("m") - hold, F.col("m") - 1)).alias("cohort"))
    legs = held.join(members, ["cohort", "entity"]).groupBy("cohort", "ts").agg(F.avg(F.when(F.col("bucket") == buckets, F.col("r"))).alias("high"), F.avg(F.when(F.col("bucket") == 1, F.col("r"))).alias("low"))
    return legs.groupBy("ts").agg(F.avg(F.col("high") - F.col("low")).alias("net")), members.drop("cohort")


def forecast_skill(df: DataFrame, forecast: Column, h: int = 1, benchmark: str = "expanding_mean", least: int = 1) -> DataFrame:
    """series_id, ts, net: (benchmark - value)^2 - (forecast - value)^2; each h-th row, of series that have `least` such rows.

    The benchmark is the mean of all rows before (expanding_mean) or the row before (random_walk).
    """
    b = F.avg("value").over(over().rowsBetween(W.unboundedPreceding, -1)) if benchmark == "expanding_mean" else F.lag("value").over(over())
    out = df.withColumns({"f": forecast, "b": b}).filter("f is not null and b is not null and value is not null")
    out = out.withColumn("k", F.row_number().over(over()) - 1).filter(F.col("k") % h == 0)
    out = out.withColumn("n", F.count("*").over(W.partitionBy("series_id"))).filter(F.col("n") >= least)
    return out.select("series_id", "ts", F.expr("(b - value) * (b - value) - (f - value) * (f - value)").alias("net"))


def two_factor(df: DataFrame, y: str, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    """intercept, beta_a, beta_b, mean, n of the least-squares fit of y on two factors, by series: one aggregate, then the normal equations."""
    ok = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    m = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("vaa"), F.var_pop(b).alias("vbb"), F.covar_pop(a, b).alias("vab"), F.covar_pop(y, a).alias("vya"), F.covar_pop(y, b).alias("vyb"))
    m = m.withColumn("det", F.expr("vaa * vbb - vab * vab")).filter("n >= 10 and det > 1e-12 * vaa * vbb")
    m = m.withColumns({"beta_a": F.expr("(vya * vbb - vyb * vab) / det"), "beta_b": F.expr("(vyb * vaa - vya * vab) / det")})
    return m.select(*by, "n", F.expr("my - beta_a * ma - beta_b * mb").alias("intercept"), "beta_a", "beta_b", F.col("my").alias("mean"))


def exposure_decomposition(fit: DataFrame) -> DataFrame:
    """A two_factor fit with share (intercept over mean) and survives (intercept > 0 and share >= 0.5)."""
    share = F.when(F.col("mean") > 1e-12, F.col("intercept") / F.col("mean")).otherwise(0.0)
    return fit.withColumn("share", share).withColumn("survives", F.expr("intercept > 0 and share >= 0.5"))


def crisis_leave_one_out(net: DataFrame, windows: list[tuple[str, str]]) -> DataFrame:
    """series_id, base_mean and dominated: a positive mean that some window's removal makes zero or less. One pass, a column for each window."""
    inside = [F.col("ts").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")) for a, b in windows]
    out = net.groupBy("series_id").agg(F.avg("net").alias("base_mean"), *[F.avg(F.when(~x, F.col("net"))).alias(f"without_{i}") for i, x in enumerate(inside)])
    bad = F.lit(False)
    for i in range(len(windows)):
        bad = bad | F.coalesce(F.col(f"without_{i}") <= 0, F.lit(False))
    return out.withColumn("dominated", (F.col("base_mean") > 0) & bad)


def best_of_k(net: DataFrame, per_year: float = 252) -> DataFrame:
    """family, series_id, sharpe, k: the series with the highest Sharpe ratio of each family's k, ties by series_id."""
    s = net.groupBy("family", "series_id").agg(F.count("net").alias("n"), F.avg("net").alias("m"), F.stddev_samp("net").alias("sd"))
    s = s.withColumn("sharpe", F.when(F.expr("n >= 20 and sd > 0"), F.col("m") / F.col("sd") * per_year**0.5))
    return s.groupBy("family").agg(F.max_by("series_id", F.struct("sharpe", -F.col("series_id"))).alias("series_id"), F.max("sharpe").alias("sharpe"), F.count("*").alias("k"))


def tail_fade(trades: DataFrame, capacity_frac: float = 0.1, notional: float = 1000.0, least_interest: float = 0.0, pair: tuple[str, ...] = (), pair_gross: float | None = None, fee: float = 0.07, equal: bool = False) -> DataFrame:
    """day, net, trades of holding NO in each traded tail bracket from its price to settlement.

    A trade's size is capacity_frac x the smaller of volume and open interest; on a day when the pair's cities exceed pair_gross x
    notional, theirs are scaled down to it. net is the day's gain over notional, or with `equal` the mean gain of a unit.
    """
    ok = trades.filter(F.expr("is_tail and volume > 0")).filter(F.col("open_interest") >= least_interest)
    ok = ok.withColumns({"day": F.date_trunc("day", "close_time"), "size": capacity_frac * F.least("volume", "open_interest")}).filter("size > 0")
    p = F.col("entry_price")
    ok = ok.withColumn("unit", F.when(F.col("outcome") == 0, p).otherwise(p - 1) - fee * p * (1 - p))
    if pair and pair_gross is not None:
        in_pair, cap = F.col("city").cast("string").isin(*pair), pair_gross * notional
        gross = ok.filter(in_pair).groupBy("day").agg(F.sum("size").alias("gross"))
        ok = ok.join(gross, "day", "left").withColumn("size", F.when(in_pair & (F.col("gross") > cap) & F.lit(cap > 0), F.col("size") * cap / F.col("gross")).otherwise(F.col("size")))
    net = F.avg("unit") if equal else F.sum(F.col("size") * F.col("unit")) / notional
    return ok.groupBy("day").agg(net.alias("net"), F.count("*").alias("trades"))


def capacity(net: DataFrame, scores: DataFrame, per_year: float = 252, bps_per_million: float = 25.0) -> DataFrame:
    """series_id, capacity_usd: the size at which linear impact takes the whole yearly return, to the nearest 1000; null without a gain or turnover.

    The first bar counts as no change of position. scores has series_id and ann_ret.
    """
    step = F.abs(F.col("position") - F.lag("position").over(W.partitionBy("series_id").orderBy("seq")))
    turn = net.select("series_id", F.coalesce(step, F.lit(0.0)).alias("step")).groupBy("series_id").agg(F.avg("step").alias("turn"))
    usd = F.col("ann_ret") / (F.col("turn") * per_year * (bps_per_million / 1e4 / 1e6))
    return scores.join(turn, "series_id").select("series_id", F.when(F.expr("ann_ret > 0 and turn > 0"), F.round(usd / 1000) * 1000).alias("capacity_usd"))


def market_model(df: DataFrame, y: str, x: str, by: tuple[str, ...], least: int = 5) -> DataFrame:
    """alpha and beta of y on x by key; null for fewer than `least` rows or no spread."""
    m = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.covar_samp(y, x).alias("c"), F.var_samp(x).alias("v"))
    good = (F.col("n") >= least) & (F.col("v") > 0)
    return m.select(*by, "n", F.when(good, F.expr("my - c / v * mx")).alias("alpha"), F.when(good, F.expr("c / v")).alias("beta"))


#: Times whose places are broadcast; more are joined by a shuffle.
TIMES = 100_000


def pool_series(net: DataFrame, by: str, parts: int = 0) -> DataFrame:
    """The net series of each value of `by` as one sample, in order of time; family and seq are the pool's, and n is its number of rows.

    No task holds a pool: rows are sorted within their time, and the times' counts, one row each, are summed up to the place of each time in
    its pool (in the shared folder; broadcast if there are at most TIMES). With `parts` the rows are dealt over so many.
    """
    pool = W.partitionBy("__by")
    times = net.groupBy(F.col(by).alias("__by"), F.col("ts").alias("__ts")).agg(F.count("*").alias("__c"))
    times = checkpointed(times.select("__by", "__ts", (F.sum("__c").over(pool.orderBy("__ts")) - F.col("__c")).alias("__before"), F.sum("__c").over(pool).alias("n")))
    small = times.count() <= TIMES
    rows = (net.repartition(parts, by, "ts") if parts else net).drop("n")
    rows = rows.withColumn("__k", F.row_number().over(W.partitionBy(by, "ts").orderBy("series_id", "seq")))
    rows = rows.join(F.broadcast(times) if small else times, F.col(by).eqNullSafe(F.col("__by")) & F.col("ts").eqNullSafe(F.col("__ts")))
    return rows.withColumns({"series_id": F.col(by), "seq": F.col("__before") + F.col("__k")}).drop("__by", "__ts", "__before", "__k")


def walk_forward(frame: DataFrame, hold: int = 5, windows: int = 4, first: float = 0.3, cost: float = 0.0008, rolling: bool = False) -> DataFrame:
    """series_id, window, trades, mean, sharpe: each `hold`-th row of signal, fut_rv, iv traded, standardised on all rows before its window
    (rolling: on the last `first` share of the series before it).

    Series with fewer than 3 trades a window have no rows.
    """
    w = W.partitionBy("series_id")
    rows = frame.filter("signal is not null and fut_rv is not null and iv is not null").withColumns({"k": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count("*").over(w)})
    past = w.orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"mu": F.avg("signal").over(past), "sd": F.stddev_samp("signal").over(past)})
    if rolling:  # by sums up to each row of the signal less its mean, so that little is lost in their differences
        x = F.col("signal") - F.avg("signal").over(w)
        rows = rows.withColumn("x", x).withColumns({"s1": F.coalesce(F.sum("x").over(past), F.lit(0.0)), "s2": F.coalesce(F.sum(F.col("x") * F.col("x")).over(past), F.lit(0.0)), "from": F.greatest(F.lit(0).cast("long"), F.col("k") - F.floor(F.col("n") * first))})
        base = rows.select("series_id", F.col("k").alias("from"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
        rows = rows.join(base, ["series_id", "from"]).withColumns({"m": F.col("k") - F.col("from"), "d1": F.col("s1") - F.col("b1"), "d2": F.col("s2") - F.col("b2")})
        mean = F.expr("try_divide(d1, m)")
        rows = rows.withColumns({"mu": F.col("signal") - F.col("x") + mean, "sd": F.expr("case when m > 1 then sqrt(greatest(0e0, (d2 - d1 * d1 / m) / (m - 1))) end")})
    entries = rows.filter((F.col("k") % hold == 0) & (F.col("k") < F.col("n") - hold) & (F.col("k") >= F.floor(F.col("n") * first)))
    entries = entries.withColumns({"entries": F.count("*").over(w), "window": F.ntile(windows).over(w.orderBy("ts"))}).filter(F.col("entries") >= 3 * windows)
    start = entries.groupBy("series_id", "window").agg(F.min_by(F.struct("k", "mu", "sd"), "k").alias("s"))
    far = (F.col("signal") - F.col("s.mu")) / F.col("s.sd")
    z = F.when(far.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), far)))
    traded = entries.join(start, ["series_id", "window"]).filter("s.k >= 5 and s.sd > 0").withColumn("z", z)
    net = traded.withColumn("net", F.col("z") * (F.col("fut_rv") - F.col("iv")) - F.abs("z") * cost)
    sharpe = F.when((F.count("*") >= 20) & (F.stddev_samp("net") > 0), F.try_divide(F.avg("net"), F.stddev_samp("net")) * (365 / hold) ** 0.5)
    return net.groupBy("series_id", "window").agg(F.count("*").alias("trades"), F.avg("net").alias("mean"), sharpe.alias("sharpe"))


def walk_forward_consistent(windows: DataFrame) -> DataFrame:
    """series_id, windows, consistent: whether every window of walk_forward that has a Sharpe ratio has it above zero; null if none has."""
    ok = windows.filter("sharpe is not null")
    return windows.groupBy("series_id").agg(F.count("*").alias("windows")).join(ok.groupBy("series_id").agg(F.bool_and(F.col("sharpe") > 0).alias("consistent")), "series_id", "left")


def tail_positions(trades: DataFrame, capacity_frac: float = 0.1, notional: float = 1000.0, least_interest: float = 0.0) -> DataFrame:
    """day, city, position: the part of the notional that tail_fade holds in each city's brackets, without caps on pairs."""
    ok = trades.filter(F.expr("is_tail and volume > 0")).filter(F.col("open_interest") >= least_interest)
    size = capacity_frac * F.least("volume", "open_interest")
    return ok.groupBy(F.date_trunc("day", "close_time").alias("day"), "city").agg((F.sum(size) / notional).alias("position"))
