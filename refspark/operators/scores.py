"""Scores of net series: (series_id, seq, net) tables in, a row for each series out. One shuffle by series_id carries all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf, norm_ppf

EULER = 0.5772156649
#: Decision bands of the verdict.
KILL, WATCH, LEAST_OOS, LEAST_T, IC_FLOOR, Z = 0.90, 0.95, 30, 1.0, 0.05, 1.645


def part(net: DataFrame, numbered: bool = False) -> DataFrame:
    """net with n and part: the first half of each series 'is', up to 80 % 'oos', then 'holdout', by rows; seq becomes the row's number from 1 on.

    Rows are counted in the order of seq, whatever its numbers are (from 0 on, with gaps, repeated); rows of one number in that of net. If
    they are `numbered`, seq and n are so already, and no task sorts a whole series.
    """
    w = W.partitionBy("series_id")
    first, last = F.floor(F.col("n") * 0.5), F.floor(F.col("n") * (0.5 + 0.3))
    rows = net if numbered else net.withColumns({"n": F.count("*").over(w), "seq": F.row_number().over(w.orderBy("seq", "net"))})
    return rows.withColumn("part", F.when(F.col("seq") <= first, "is").when(F.col("seq") <= last, "oos").otherwise("holdout"))


def moments(x: Column, prefix: str = "") -> list[Column]:
    """Aggregates that sharpe and psr are made of."""
    return [F.count(x).alias(f"{prefix}k"), F.avg(x).alias(f"{prefix}mean"), F.stddev_samp(x).alias(f"{prefix}sd"), F.skewness(x).alias(f"{prefix}g1"), F.kurtosis(x).alias(f"{prefix}g2")]


def sharpe(k: str, mean: str, sd: str, bpy: str) -> Column:
    """Annualised; null for fewer than 20 rows or no spread."""
    return F.expr(f"CASE WHEN {k} >= 20 AND {sd} > 0 THEN {mean} / {sd} * sqrt({bpy}) END")


def once(x: str, function) -> str:
    """SQL text of function(x) that evaluates x one time, however often the function's text names it."""
    return f"transform(array({x}), v -> {function('v')})[0]"


def psr(prefix: str = "", bench: str = "0e0") -> Column:
    """P(true Sharpe > bench), with skewness and kurtosis made unbiased from the population moments."""
    k, m, s, a, b = (f"{prefix}{c}" for c in ("k", "mean", "sd", "g1", "g2"))
    g3 = f"({a} * sqrt({k} * ({k} - 1e0)) / ({k} - 2))"
    g4 = f"((({k} - 1e0) / (({k} - 2e0) * ({k} - 3e0))) * (({k} + 1) * {b} + 6) + 3)"
    root = f"sqrt(greatest(1e-12, 1 - {g3} * ({m} / {s}) + ({g4} - 1) / 4 * power({m} / {s}, 2)))"
    z = f"(({m} / {s} - ({bench})) * sqrt({k} - 1e0) / {root})"
    return F.expr(f"CASE WHEN {k} >= 20 AND {s} > 0 THEN {once(z, norm_cdf)} END")


def deflation_benchmark(trials: str, variance: str) -> str:
    """The Sharpe that the best of so many trials shows by luck; 0 for one trial or no variance."""
    e1, e2 = once(f"1 - 1e0 / {trials}", norm_ppf), once(f"1 - 1e0 / ({trials} * 2.718281828459045e0)", norm_ppf)
    return f"(CASE WHEN {trials} >= 2 AND {variance} > 0 THEN sqrt({variance}) * ({1 - EULER} * {e1} + {EULER} * {e2}) ELSE 0e0 END)"


def fold(seq: Column, seen: Column) -> Column:
    """1 to 3: the third of the first `seen` rows that a row is in; the first thirds take what is over."""
    base, over = F.floor(seen / 3), seen % 3
    head = over * (base + 1)
    return F.when(seq <= head, F.ceil(F.try_divide(seq, base + 1))).otherwise(over + F.ceil(F.try_divide(seq - head, base))).cast("int")


def _fold_moments() -> list[Column]:
    """Aggregates of part's rows that the folds' t are made of."""
    seen = F.floor(F.col("n") * (0.5 + 0.3))
    of = lambda k: F.when((F.col("part") != "holdout") & (fold(F.col("seq"), seen) == k), F.col("net"))
    out = [F.count(F.when(F.col("part") != "holdout", F.col("net"))).alias("seen")]
    for k in (1, 2, 3):
        out += [F.count(of(k)).alias(f"__k{k}"), F.avg(of(k)).alias(f"__m{k}"), F.stddev_samp(of(k)).alias(f"__s{k}")]
    return out


def _fold_columns(df: DataFrame) -> DataFrame:
    """df, aggregated by _fold_moments, with fold_1..3, min_fold_t and consistent."""
    df = df.withColumns({f"fold_{k}": F.expr(f"CASE WHEN seen >= 30 AND __k{k} >= 5 AND __s{k} > 0 THEN round(__m{k} / (__s{k} / sqrt(__k{k})), 3) END") for k in (1, 2, 3)})
    up = F.expr("coalesce(fold_1 > 0 AND fold_2 > 0 AND fold_3 > 0, false)")
    return df.withColumns({"min_fold_t": F.least("fold_1", "fold_2", "fold_3"), "consistent": up}).drop(*[f"__{c}{k}" for c in "kms" for k in (1, 2, 3)])


def three_fold(net: DataFrame) -> DataFrame:
    """series_id, fold_1..3 (t of each third of the rows before the holdout), min_fold_t and consistent (three folds, all above 0)."""
    out = _fold_columns(part(net).filter("part <> 'holdout'").groupBy("series_id").agg(*_fold_moments()))
    return out.select("series_id", "fold_1", "fold_2", "fold_3", "min_fold_t", "consistent")


def score_split(net: DataFrame, bpy: float = 252.0, numbered: bool = False) -> DataFrame:
    """series_id, family, n, n_oos, the parts' scores, and three_fold's columns, in one aggregation; dsr waits for the ledger. numbered: as in part."""
    of = lambda p: F.when(F.col("part") == p, F.col("net"))
    s = part(net, numbered).groupBy("series_id", "family").agg(F.max("n").alias("n"), *moments(of("oos"), "o_"), *moments(of("is"), "i_"), *moments(F.col("net"), "f_"), *moments(of("holdout"), "h_"), F.sum("net").alias("total"), F.avg(F.when(F.col("part") != "holdout", F.col("net"))).alias("seen_mean"), *_fold_moments())
    s, b = _fold_columns(s), str(bpy)
    return s.withColumns({
        "n_oos": F.col("o_k"), "oos_sharpe": sharpe("o_k", "o_mean", "o_sd", b), "is_sharpe": sharpe("i_k", "i_mean", "i_sd", b), "full_sharpe": sharpe("f_k", "f_mean", "f_sd", b),
        "per_trade_sharpe": F.expr("CASE WHEN o_sd > 0 THEN o_mean / o_sd END"), "edge_t": F.expr("CASE WHEN o_sd > 0 THEN o_mean / (o_sd / sqrt(o_k)) END"),
        "psr": psr("o_"), "ann_ret": F.col("seen_mean") * bpy, "holdout_sharpe": sharpe("h_k", "h_mean", "h_sd", b), "holdout_psr": psr("h_"),
        "status": F.when(F.col("n") < LEAST_OOS, "insufficient_trades").otherwise("scored"),
    })


def trial_stats(scores: DataFrame, least: int = 10) -> DataFrame:
    """scores with n_trials and sr_variance of each series' family: all its series, `least` at least, and the spread of the others' per-trade Sharpe.

    The own series is left out of the variance by subtracting it from the family's sums, so there is no join of pairs.
    """
    x = "per_trade_sharpe"
    sums = scores.groupBy("family").agg(F.count("*").alias("trials"), F.count(x).alias("c"), F.sum(x).alias("s1"), F.sum(F.col(x) * F.col(x)).alias("s2"))
    own = scores.join(sums, "family").withColumns({"c": F.expr(f"c - if({x} is null, 0, 1)"), "s1": F.expr(f"s1 - coalesce({x}, 0)"), "s2": F.expr(f"s2 - coalesce({x} * {x}, 0)")})
    return own.withColumn("n_trials", F.greatest("trials", F.lit(least))).withColumn("sr_variance", F.expr("CASE WHEN c >= 3 THEN greatest(0e0, (s2 - s1 * s1 / c) / (c - 1)) ELSE 0.01e0 END")).drop("trials", "c", "s1", "s2")


# The least trials of an outside claim, the prior variance of Sharpe ratios and its weight, and the caps of a cohort and of a grid.
LEAST_TRIALS, PRIOR_VARIANCE, PRIOR_WEIGHT, MOST_COHORT, MOST_GRID = 10, 0.01, 3, 1_000_000, 10_000


def ledger_stats(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """strategy, n_trials, sr_variance of each claim, by the ledger of its family.

    ledger: strategy, family, cohort, denominator, per_trade_sharpe, at; of a strategy's rows in a family the last counts. claims: strategy, family,
    cohort (null for none), generated, single (one preregistered test of a provided series), registered, grid. The number of trials is the largest
    of the family's strategies with this one, the sum of its cohorts' largest denominators, what the claim registered, its grid, and 10 for outside
    claims. The variance leaves out the claim's own cohort, by subtracting its sums from the family's, and is blended with the prior's.
    """
    last = ledger.groupBy("family", "strategy").agg(F.max_by(F.struct("cohort", "denominator", "per_trade_sharpe"), "at").alias("r")).select("family", "strategy", "r.*")
    x = F.col("per_trade_sharpe")
    sums = lambda p: [F.count(x).alias(f"{p}c"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{p}s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"{p}q")]
    family = last.groupBy("family").agg(F.count("*").alias("trials"), *sums("f_"))
    cohort = last.filter("cohort is not null").groupBy("family", "cohort").agg(F.max(F.least(F.coalesce("denominator", F.lit(0)), F.lit(MOST_COHORT))).alias("declared"), *sums("c_"))
    declared = cohort.groupBy("family").agg(F.sum("declared").alias("declared"))
    known = last.select("family", "strategy", F.lit(0).alias("new"))
    j = claims.join(family, "family", "left").join(declared, "family", "left").join(cohort.drop("declared"), ["family", "cohort"], "left").join(known, ["family", "strategy"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    single = F.coalesce("single", F.lit(False))
    floor = F.when(single | F.coalesce("generated", F.lit(False)), 1).otherwise(LEAST_TRIALS)
    grid = F.when(single, 1).otherwise(F.least(F.lit(MOST_GRID), F.greatest(F.lit(1), zero("grid"))))
    n = F.greatest(F.lit(1), zero("trials") + F.coalesce("new", F.lit(1)), zero("declared"), zero("registered"), floor, grid)
    j = j.withColumns({"n_trials": n.cast("long"), "c": zero("f_c") - zero("c_c"), "s": zero("f_s") - zero("c_s"), "q": zero("f_q") - zero("c_q")})
    raw = F.expr("case when c > 1 then greatest(0e0, (q - s * s / c) / (c - 1)) else 0e0 end")
    blend = F.when(F.col("c") < PRIOR_WEIGHT, F.greatest(raw, F.lit(PRIOR_VARIANCE))).otherwise((F.col("c") * raw + PRIOR_WEIGHT * PRIOR_VARIANCE) / (F.col("c") + PRIOR_WEIGHT))
    return j.select("strategy", "n_trials", blend.alias("sr_variance"))


def power(n_oos: str, bpy: str = "252") -> dict[str, Column]:
    """Smallest detectable effect per bar and a year, and whether it is within the floor."""
    mde = f"({Z} / nullif(sqrt({n_oos}), 0))"
    return {"mde": F.expr(mde), "mde_annual": F.expr(f"{mde} * sqrt({bpy})"), "sufficient": F.expr(f"coalesce({mde} <= {IC_FLOOR}, false)"), "needed_bars": F.lit(int((Z / IC_FLOOR) ** 2) + 1).cast("long")}


def verdict(scored: DataFrame) -> DataFrame:
    """scored with verdict and kill_reason: the ordered table up to the decision bands, then the relabelling of kills that lack power."""
    chain = [
        (F.col("n_oos") < LEAST_OOS, "insufficient_data", "data_unavailable"), (~F.col("consistent"), "kill", "in_sample_only"), (F.coalesce("dsr", F.lit(0.0)) < KILL, "kill", "no_oos_edge"),
        (F.coalesce("edge_t", F.lit(0.0)) < LEAST_T, "kill", "low_edge_t"), (F.col("dsr") < WATCH, "watch", None), ((F.col("holdout_sharpe") > 0) & (F.col("holdout_psr") >= KILL), "research-supported", None),
    ]
    v, r = F.lit("watch"), F.lit(None).cast("string")
    for when, word, reason in reversed(chain):
        v, r = F.when(when, word).otherwise(v), F.when(when, F.lit(reason)).otherwise(r)
    weak = (v == "kill") & r.isin("no_oos_edge", "low_edge_t") & ~F.col("sufficient")
    return scored.withColumns({"verdict": F.when(weak, "underpowered").otherwise(v), "kill_reason": F.when(weak, "below_detection_floor").otherwise(r)})


def referee(net: DataFrame) -> DataFrame:
    """One verdict row for each series of net."""
    scored = trial_stats(score_split(net)).withColumn("bench", F.expr(deflation_benchmark("n_trials", "sr_variance")))
    return verdict(scored.withColumn("dsr", psr("o_", "bench")).withColumns(power("n_oos")))


def max_drawdown(net: DataFrame) -> DataFrame:
    run = W.partitionBy("series_id").orderBy("seq")
    eq = net.withColumn("eq", F.sum("net").over(run.rowsBetween(W.unboundedPreceding, 0)))
    return eq.withColumn("down", F.max("eq").over(run.rowsBetween(W.unboundedPreceding, 0)) - F.col("eq")).groupBy("series_id").agg(F.max("down").alias("max_drawdown"))


def tail_metrics(net: DataFrame) -> DataFrame:
    """series_id, n, skew (population; null for under 20 rows or a nearly constant series), cvar_5 and cvar_95 (means of the ceil(5 %) worst and
    best), tail_ratio, the extremes, worst_vs_typical (the largest loss over the 95th percentile of gains) and asymmetric (small gains against
    large losses: skew <= -0.5 with a tail ratio of 3, or skew <= -3 from 40 rows on). Rows that aren't finite are left out; one sort of a series."""
    w = W.partitionBy("series_id")
    ok = net.filter("net is not null and not isnan(net) and abs(net) < double('infinity')")
    r = ok.withColumns({"up": F.row_number().over(w.orderBy("net", "seq")), "n": F.count("*").over(w)}).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * 0.05)))
    worst, best = F.col("up") <= F.col("k"), F.col("up") > F.col("n") - F.col("k")
    out = r.groupBy("series_id").agg(
        F.max("n").alias("n"), F.skewness("net").alias("g"), F.stddev_pop("net").alias("sd"), F.avg("net").alias("mu"), F.avg(F.when(worst, F.col("net"))).alias("cvar_5"), F.avg(F.when(best, F.col("net"))).alias("cvar_95"),
        F.min("net").alias("max_loss"), F.max("net").alias("max_gain"), F.expr("percentile(net, 0.95) filter (where net > 0)").alias("gain"),
    )
    scale = F.greatest(F.abs("mu"), F.abs("max_loss"), F.abs("max_gain"), F.lit(1e-12))
    out = out.withColumn("skew", F.when((F.col("n") >= 20) & (F.col("sd") > 0) & (F.col("sd") >= 1e-9 * scale), F.col("g")))
    out = out.withColumns({"tail_ratio": F.expr("CASE WHEN cvar_95 > 0 THEN abs(cvar_5) / cvar_95 END"), "worst_vs_typical": F.expr("CASE WHEN gain > 0 THEN abs(max_loss) / gain END")})
    asymmetric = F.expr("coalesce(skew <= -3.0 and n >= 40, false) or coalesce(skew <= -0.5 and tail_ratio >= 3.0, false)")
    return out.withColumn("asymmetric", asymmetric).drop("g", "sd", "mu", "gain")


def turnover(net: DataFrame) -> DataFrame:
    """series_id, turnover (mean absolute change of position; the first bar pays its own size, a null position is none) and traded (the sum)."""
    before = F.lag("position").over(W.partitionBy("series_id").orderBy("seq"))
    change = net.withColumn("position", F.coalesce("position", F.lit(0.0))).withColumn("step", F.abs(F.col("position") - F.coalesce(before, F.lit(0.0))))
    return change.groupBy("series_id").agg(F.avg("step").alias("turnover"), F.sum("step").alias("traded"))
