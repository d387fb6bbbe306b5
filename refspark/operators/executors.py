"""Claim executors over many claims at once: alignment, as-of rebalances, holding windows, spanning, event studies, and the search as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.operators import scores
from refspark.operators.scan import folded, running

#: Columns that every executor returns, by claim.
NET_TRIPLE = ("series_id", "ts", "net", "position")

# The benchmark sets that a claim may name.
BENCHMARKS = {"capm": ("mkt",), "ff3": ("mkt", "smb", "hml"), "carhart": ("mkt", "smb", "hml", "mom"), "ff5": ("mkt", "smb", "hml", "rmw", "cma")}


def execute(executor: Callable[[DataFrame], DataFrame], inputs: DataFrame) -> DataFrame:
    """The executor's result, held to the columns of NET_TRIPLE; an executor is a function of a DataFrame, and nothing runs here."""
    out = executor(inputs)
    missing = [c for c in NET_TRIPLE if c not in out.columns]
    if missing:
        raise ValueError(f"engine_error: the executor's result lacks {', '.join(missing)}")
    return out.filter("net is not null and not isnan(net)")


def priced(rows: DataFrame, model: Callable[[Column], Column], of: str, name: str = "prob") -> DataFrame:
    """rows with a pricing model's value: a model is a function from a Column to a Column."""
    return rows.withColumn(name, model(F.col(of)))


def align_inner(rows: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ("claim",)) -> DataFrame:
    """by, ts and a column for each name: the times at which all of them have a finite value. rows: by, name, ts, value; of equal ones the largest."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    wide = rows.filter(F.col("name").isin(*names) & finite).groupBy(*by, "ts").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return wide.dropna(subset=list(names))


def known_at(panel: DataFrame, dates: DataFrame, value: str) -> DataFrame:
    """rb, entity, value: the panel's last date at or before each rb, and what it has there. An entity without a value on that date is out.

    Only the calendars meet, one row a date, in ranges of time; the panel is then joined by equal dates.
    """
    own, rb = panel.select("ts").distinct().withColumn("own", F.col("ts")), dates.select(F.col("rb").alias("ts"), F.lit(None).cast("timestamp").alias("own")).distinct()
    both = own.unionByName(rb.withColumn("own", F.lit(None).cast(panel.schema["ts"].dataType))).withColumn("late", F.col("own").isNull())
    at = running(both, [], ["ts", "late"], {"at": ("last", F.col("own"))})
    last = at.filter("own is null and at is not null").select(F.col("ts").alias("rb"), F.col("at").alias("ts"))
    return panel.filter(F.col(value).isNotNull()).join(last, "ts").select("rb", "entity", value)


def holding_window(returns: DataFrame, dates: DataFrame, months: int = 1) -> DataFrame:
    """rb, ts, entity, ret of the returns with rb < ts <= rb + months. Both sides meet by the calendar months that the window touches."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    end = F.add_months("rb", months)
    windows = dates.select("rb", end.cast("timestamp").alias("__end"), F.explode(F.sequence(month("rb"), month(end))).alias("__m"))
    rows = returns.withColumn("__m", month("ts"))
    return rows.join(windows, "__m").filter((F.col("ts") > F.col("rb")) & (F.col("ts") <= F.col("__end"))).select("rb", "ts", "entity", "ret")


def sort_positions(members: DataFrame, returns: DataFrame, months: int = 1) -> DataFrame:
    """ts, entity, position: half of the book in each leg, spread evenly over its names; names of several cohorts at a time have their mean.

    members: rb, entity, leg (high or low).
    """
    size = F.count("*").over(W.partitionBy("rb", "leg"))
    weight = F.when(F.col("leg") == "high", 0.5).otherwise(-0.5) / size
    legs = members.select("rb", "entity", weight.alias("w")).groupBy("rb", "entity").agg(F.sum("w").alias("w"))
    days = holding_window(returns, members.select("rb").distinct(), months).select("rb", "ts").distinct()
    return days.join(legs, "rb").groupBy("ts", "entity").agg(F.avg("w").alias("position"))


def sorted_book(signal: DataFrame, returns: DataFrame, buckets: int = 10, months: int = 1, least: int = 20, weights: DataFrame | None = None, eligible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ts, net of the top leg less the bottom one) and (rb, entity, leg, weight), by month ends.

    signal: ts, entity, signal; known at each rebalance as known_at says. returns: ts, entity, ret. weights: ts, entity, weight, known
    likewise; only positive ones count, and without any at a date it is skipped. eligible: rb, entity that may be held. Cohorts that cover
    one date are averaged.
    """
    dates = returns.select(F.last_day("ts").cast("timestamp").alias("rb")).distinct()
    known = known_at(signal, dates, "signal")
    if eligible is not None:
        known = known.join(eligible.select("rb", "entity").distinct(), ["rb", "entity"], "left_semi")
    by = W.partitionBy("rb")
    ranked = known.withColumns({"n": F.count("*").over(by), "rank": F.row_number().over(by.orderBy("signal", "entity"))}).filter(F.col("n") >= least)
    bucket = F.least(F.lit(buckets), F.greatest(F.lit(1), F.ceil(F.col("rank") * buckets / F.col("n"))))
    members = ranked.withColumn("leg", F.when(bucket == buckets, "high").when(bucket == 1, "low")).filter("leg is not null").select("rb", "entity", "leg")
    if weights is None:
        members = members.withColumn("weight", F.lit(1.0))
    else:
        of = known_at(weights, dates, "weight")
        members = members.join(of.select("rb").distinct(), "rb", "left_semi").join(of.filter("weight > 0"), ["rb", "entity"], "left")
    held = holding_window(returns, dates, months).filter("ret is not null").join(members.filter("weight is not null"), ["rb", "entity"])
    leg = lambda name: F.sum(F.when(F.col("leg") == name, F.col("ret") * F.col("weight"))) / F.sum(F.when(F.col("leg") == name, F.col("weight")))
    net = held.groupBy("rb", "ts").agg((leg("high") - leg("low")).alias("net")).groupBy("ts").agg(F.avg("net").alias("net"))
    return net.filter("net is not null"), members


def ols_multi(df: DataFrame, y: str, xs: tuple[str, ...], by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """by, n, alpha, betas (an array in the order of xs), r2, alpha_t, mean of the least-squares fit of y on xs, by key.

    One aggregation gives each key its means and covariances; the normal equations of all keys of a batch are then solved together. Null
    for n <= k + 1; of factors that depend on one another the solution of least length.
    """
    k = len(xs)
    ok = df.dropna(subset=[y, *xs])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = [F.covar_pop(xs[i], xs[j]).alias(f"__c{i}_{j}") for i, j in pairs] + [F.covar_pop(y, x).alias(f"__y{i}") for i, x in enumerate(xs)]
    m = ok.groupBy(*by).agg(F.count("*").alias("__n"), F.avg(y).alias("__my"), F.var_pop(y).alias("__vy"), *[F.avg(x).alias(f"__m{i}") for i, x in enumerate(xs)], *cov)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            n, my, vy, mx = at("__n"), at("__my"), at("__vy"), np.stack([at(f"__m{i}") for i in range(k)], 1)
            c, cy = np.zeros((len(n), k, k)), np.stack([at(f"__y{i}") for i in range(k)], 1)
            for i, j in pairs:
                c[:, i, j] = c[:, j, i] = at(f"__c{i}_{j}")
            inv = np.linalg.pinv(c, hermitian=True)
            beta = np.einsum("nij,nj->ni", inv, cy)
            left = np.maximum(vy - (beta * cy).sum(1), 0)
            with np.errstate(all="ignore"):
                r2 = np.where(vy > 0, 1 - left / vy, np.nan)
                se = np.sqrt(n * left / (n - k - 1) * (1 / n + np.einsum("ni,nij,nj->n", mx, inv, mx) / n))
                t = np.where((vy > 0) & (se > 0), (my - (beta * mx).sum(1)) / se, np.nan)
            good = n > k + 1
            null = lambda x, good=good: pa.array(x, pa.float64(), mask=~good | ~np.isfinite(x))
            betas = pa.array([row.tolist() if g else None for row, g in zip(beta, good, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in by], b.column("__n"), null(my - (beta * mx).sum(1)), betas, null(r2), null(t), b.column("__my")], names=[*by, "n", "alpha", "betas", "r2", "alpha_t", "mean"])

    return m.mapInArrow(solve, f"{keys}, n bigint, alpha double, betas array<double>, r2 double, alpha_t double, mean double")


def factor_spanning(frame: DataFrame, candidate: str, factors: tuple[str, ...], by: str = "series_id") -> DataFrame:
    """by, ts, net: what the factors leave of the candidate, its alpha included. The betas come from the first half of each series' rows."""
    w = W.partitionBy(by)
    rows = frame.dropna(subset=[candidate, *factors]).withColumns({"__k": F.row_number().over(w.orderBy("ts")), "__n": F.count("*").over(w)})
    fit = ols_multi(rows.filter(F.col("__k") <= F.floor(F.col("__n") * 0.5)), candidate, factors, (by,)).filter("betas is not null").select(by, "betas")
    fitted = F.lit(0.0)
    for i, x in enumerate(factors):
        fitted = fitted + F.col("betas")[i] * F.col(x)
    return rows.join(fit, by).select(by, "ts", (F.col(candidate) - fitted).alias("net"))


def simpler_variant(net: DataFrame, simpler: DataFrame, by: str = "series_id") -> DataFrame:
    """by, mean, simpler_mean, survives: whether a simpler variant does as well, which speaks against the claim."""
    j = net.groupBy(by).agg(F.avg("net").alias("mean")).join(simpler.groupBy(by).agg(F.avg("net").alias("simpler_mean")), by)
    return j.withColumn("survives", F.col("simpler_mean") >= F.col("mean"))


def vol_timing(frame: DataFrame, hold: int = 5, cost: float = 0.0008, least: int = 60) -> DataFrame:
    """series_id, ts, net, position of every hold-th row: the signal, standardised on the first half and clipped, times realised less implied volatility.

    frame: series_id, ts, signal, rv (realised over the hold rows before), iv. Series with fewer than `least` complete rows have none.
    """
    w = W.partitionBy("series_id")
    rows = frame.dropna(subset=["signal", "rv", "iv"]).withColumns({"__k": F.row_number().over(w.orderBy("ts")) - 1, "__n": F.count("*").over(w)}).filter(F.col("__n") >= least)
    first = F.when(F.col("__k") < F.floor(F.col("__n") * 0.5), F.col("signal"))
    rows = rows.withColumns({"__mu": F.avg(first).over(w), "__sd": F.stddev_samp(first).over(w), "__rv": F.lead("rv", hold).over(w.orderBy("ts"))})
    sd = F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("signal") - F.col("__mu")) / sd))
    traded = rows.filter((F.col("__k") % hold == 0) & (F.col("__k") < F.col("__n") - hold)).withColumn("position", z)
    return traded.select("series_id", "ts", (F.col("position") * (F.col("__rv") - F.col("iv")) - F.abs("position") * cost).alias("net"), "position")


def event_candidates(returns: DataFrame, events: DataFrame, window: tuple[int, int], estimation: int, market: str | None = None) -> DataFrame:
    """series_id, event_ts, start, end (row numbers of the event window), first (of the estimation window), flaw and car, before overlaps are looked at.

    returns: series_id, ts, ret and the market's column if there is one. The event's row is the first at or after it. All sums are windows
    over the returns, so an event is joined with one row.
    """
    a, b = window
    w = W.partitionBy("series_id").orderBy("ts")
    before, inside = w.rowsBetween(-estimation, -1), w.rowsBetween(0, b - a)
    both = F.col("ret").isNotNull() & F.col(market).isNotNull() if market else F.lit(False)
    x, y = F.when(both, F.col(market)) if market else F.lit(None).cast("double"), F.when(both, F.col("ret"))
    k = F.row_number().over(w) - 1
    rows = returns.withColumns({
        "k": k, "n": F.count("*").over(W.partitionBy("series_id")), "e_n": F.count("ret").over(before), "e_mean": F.avg("ret").over(before), "v_n": F.count("ret").over(inside), "v_sum": F.sum("ret").over(inside),
        "m_n": F.count(x).over(before), "m_x": F.avg(x).over(before), "m_y": F.avg(y).over(before), "m_v": F.var_samp(x).over(before), "m_c": F.covar_samp(x, y).over(before),
        "w_n": F.count(F.col(market) if market else F.lit(None)).over(inside), "w_sum": F.sum(F.col(market) if market else F.lit(None).cast("double")).over(inside),
    }).withColumnRenamed("k", "start")
    stamps = returns.select("series_id", "ts", F.lit(1).alias("row")).unionByName(events.select("series_id", F.col("event_ts").alias("ts"), F.lit(0).alias("row")))
    order = W.partitionBy("series_id").orderBy("ts", "row").rowsBetween(W.unboundedPreceding, 0)
    at = stamps.withColumn("pos", F.sum("row").over(order)).filter("row = 0").select("series_id", F.col("ts").alias("event_ts"), (F.col("pos") + a).alias("start"))
    j = at.join(rows.drop("ts"), ["series_id", "start"], "left")
    length = b - a + 1
    beta = F.when(F.col("m_v") > 0, F.col("m_c") / F.col("m_v"))
    model = F.col("v_sum") - (length * (F.col("m_y") - beta * F.col("m_x")) + beta * F.col("w_sum"))
    flaws = [(F.col("n").isNull() | (F.col("start") + b - a >= F.col("n")), "event_window_out_of_range"), (F.col("start") < estimation, "insufficient_pre_event_estimation_window"), (F.col("e_n") < estimation, "incomplete_pre_event_estimation_window"), (F.col("v_n") < length, "incomplete_event_window")]
    if market:
        flaws += [((F.col("m_n") < 5) | beta.isNull(), "degenerate_market_model"), (F.col("w_n") < length, "incomplete_market_event_window")]
    flaw = F.lit(None).cast("string")
    for wrong, name in reversed(flaws):
        flaw = F.when(wrong, name).otherwise(flaw)
    car = model if market else F.col("v_sum") - length * F.col("e_mean")
    return j.select("series_id", "event_ts", "start", (F.col("start") + b - a).alias("end"), (F.col("start") - estimation).alias("first"), flaw.alias("flaw"), car.alias("car"))


def event_study(returns: DataFrame, events: DataFrame, window: tuple[int, int] = (-1, 3), estimation: int = 20, market: str | None = None) -> DataFrame:
    """series_id, event_ts, car, skipped: abnormal returns summed over each event's window, or why an event is left out.

    In order of time an event counts only if its window and its estimation window lie after the window of the last one that counted: events are
    streamed in their order, a series' last window being all that is kept. A flaw of range comes before overlaps, the others after, as they are met.
    """
    c = event_candidates(returns, events, window, estimation, market).select("series_id", "event_ts", "start", "end", "first", "flaw", "car")

    def step(last: int, row: tuple) -> tuple[int, tuple[float | None, str | None]]:
        _, _, start, end, first, flaw, car = row
        some = last >= 0
        if flaw == "event_window_out_of_range":
            why = flaw
        elif some and start is not None and start <= last:
            why = "overlaps_prior_event_window"
        elif flaw != "insufficient_pre_event_estimation_window" and some and first is not None and first <= last:
            why = "estimation_window_overlaps_prior_event_window"
        else:
            why = flaw
        return (end if why is None else last), (car if why is None else None, why)

    found = folded(c.withColumnRenamed("car", "__car"), ["series_id"], ["event_ts", "start", "end"], "car double, skipped string", -1, step)
    return found.select("series_id", "event_ts", "car", "skipped")


def search_scopes(net: DataFrame) -> DataFrame:
    """scope, series_id, n_trials, dsr, verdict of every series, judged as if it had been tried alone and as one of its family's search."""
    alone = scores.referee(net.withColumn("family", F.col("series_id").cast("string"))).withColumn("scope", F.lit("alone"))
    pooled = scores.referee(net).withColumn("scope", F.lit("pooled"))
    pick = ("scope", "series_id", "n_trials", "dsr", "verdict")
    return alone.select(*pick).unionByName(pooled.select(*pick))


def verdict_shares(decisions: DataFrame, by: str) -> DataFrame:
    """by, verdict, n, share, survivors (the share of watch and research-supported among all of `by`)."""
    g = decisions.groupBy(by, "verdict").agg(F.count("*").alias("n"))
    w = W.partitionBy(by)
    alive = F.sum(F.when(F.col("verdict").isin("watch", "research-supported"), F.col("n")).otherwise(0)).over(w)
    return g.withColumns({"share": F.col("n") / F.sum("n").over(w), "survivors": alive / F.sum("n").over(w)})


def competing_explanations(net: DataFrame, factors: tuple[str, ...], windows: list[tuple[str, str]], simpler: DataFrame, fragile: DataFrame) -> DataFrame:
    """series_id, lens, verdict (survives, rejected or untested) of four lenses on the first 80 % of each series.

    net: series_id, seq, ts, net and the factors. simpler: series_id, seq, net. fragile: series_id, fragile (a series is concentrated in one regime).
    """
    n = F.count("*").over(W.partitionBy("series_id"))
    seen = net.withColumn("__n", n).withColumn("__k", F.row_number().over(W.partitionBy("series_id").orderBy("seq"))).filter(F.col("__k") <= F.floor(F.col("__n") * 0.8))
    said = lambda lens, tested, survives: F.struct(F.lit(lens).alias("lens"), F.when(tested, F.when(survives, "survives").otherwise("rejected")).otherwise("untested").alias("verdict"))
    fit = ols_multi(seen, "net", factors).filter("n >= 10 and alpha is not null").select("series_id", "alpha", "mean")
    inside = [F.col("ts").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")) for a, b in windows]
    crisis = seen.groupBy("series_id").agg(F.avg("net").alias("base"), F.min_by("series_id", "seq").alias("__s"), *[F.avg(F.when(~x, F.col("net"))).alias(f"without_{i}") for i, x in enumerate(inside)]).drop("__s")
    plain = simpler.join(seen.select("series_id", "seq"), ["series_id", "seq"], "left_semi").groupBy("series_id").agg(F.avg("net").alias("simple"))
    j = crisis.join(fit, "series_id", "left").join(plain, "series_id", "left").join(fragile, "series_id", "left")
    share = F.when(F.col("mean") > 1e-12, F.col("alpha") / F.col("mean")).otherwise(0.0)
    dominated = F.lit(False)
    for i in range(len(windows)):
        dominated = dominated | F.coalesce(F.col(f"without_{i}") <= 0, F.lit(False))
    lenses = F.array(
        said("exposure", F.col("alpha").isNotNull(), ~((F.col("alpha") > 0) & (share >= 0.5))), said("single_regime", F.lit(True), F.coalesce("fragile", F.lit(False))),
        said("crisis", F.lit(bool(windows)), (F.col("base") > 0) & dominated), said("simpler_variant", F.col("simple").isNotNull(), F.col("simple") >= F.col("base")),
    )
    return j.select("series_id", F.inline(lenses))
