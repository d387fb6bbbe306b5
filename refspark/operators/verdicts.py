"""The verdict in full: the decision bands of the scores, then the gates, caps, power and plausibility, in the order in which they may overrule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refspark.functions.normal import norm_cdf
from refspark.operators import scores
from refspark.shared import checkpointed

# Claim types whose results are no trades, those capped at watch, and those exempt from the plausibility gate.
NOT_TRADES = ("predictive_regression", "factor_spanning", "cross_sectional_sort", "event_study", "forecast_skill")
CAPPED_TYPES = ("provided_series_statistic", "cross_sectional_sort", "event_study", "forecast_skill")
NO_PLAUSIBILITY = ("provided_series_statistic", "descriptive_statistical", "structural_proposition")
AMBIGUOUS = ("no_oos_edge", "edge_ci_zero", "overfit_cpcv", "low_edge_t")
#: p of a permutation above which a signal is no signal; years after a claim's sample; power of three folds; a fold's t that is a kill by itself.
MOST_P, LEAST_YEARS, FOLD_POWER, FOLD_T, LEAST_MARGIN = 0.10, 1.0, 0.60, -1.0, 1.5
#: Columns that the gates give, with their types; a table without one is judged as if that gate hadn't run.
GATES = {
    "adheres": "boolean", "regime_fragile": "boolean", "includes_zero": "boolean", "permutation_p": "double", "walk_forward_consistent": "boolean", "cpcv_overfit": "boolean", "parameter_fragile": "boolean",
    "tail_asymmetric": "boolean", "claim_type": "string", "unanchored": "boolean", "costs_measured": "boolean", "post_years": "double", "external": "boolean", "cost_margin": "double", "implausible": "string",
    "strategy_framed": "boolean", "fold_power": "double",
}


def fold_power(sizes: list[str]) -> Column:
    """The chance that all folds of these sizes are above zero under the smallest edge that matters; null unless each has 5 rows."""
    power = " * ".join(norm_cdf(f"({scores.IC_FLOOR} * sqrt({n}))") for n in sizes)
    return F.expr(f"CASE WHEN {' AND '.join(f'{n} >= 5' for n in sizes)} THEN {power} END")


def in_bands() -> Column:
    """Whether the score bands leave a series alive, as decide's do: only then a gate or a cap can touch it."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dead = (F.col("n_oos") < scores.LEAST_OOS) | ~F.coalesce("consistent", F.lit(False)) | (zero("dsr") < scores.KILL) | (zero("edge_t") < scores.LEAST_T)
    return ~F.coalesce(dead, F.lit(False))


def decide(scored: DataFrame, cost_gate: bool = False) -> DataFrame:
    """scored with verdict, kill_reason and reasons (an array, in the order in which they were found).

    scored: a row of scores.referee's columns for each series, before its verdict, with those of GATES that there are. Gates and caps touch
    survivors alone; a kill that isn't structural, on data that couldn't have shown an edge that matters, is underpowered; and an implausible
    result goes to review, whatever its verdict.
    """
    t = scored.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in GATES.items() if c not in scored.columns])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kind = F.coalesce("claim_type", F.lit("trading_strategy"))
    trades = ~kind.isin(*NOT_TRADES)
    notes: list[Column] = []

    def step(chain: list[tuple[Column, str, str | None]], verdict: Column | None, reason: Column | None) -> tuple[Column, Column]:
        v, r = verdict if verdict is not None else F.lit("watch"), reason if reason is not None else F.lit(None).cast("string")
        for when, word, why in reversed(chain):
            v, r = F.when(when, word).otherwise(v), F.when(when, F.lit(why)).otherwise(r)
        return v, r

    def fix(frame: DataFrame, verdict: Column, reason: Column) -> DataFrame:
        return frame.withColumns({"__v": verdict, "__r": reason})

    bands = [
        (F.col("n_oos") < scores.LEAST_OOS, "insufficient_data", "data_unavailable"), (~yes("consistent"), "kill", "in_sample_only"), (zero("dsr") < scores.KILL, "kill", "no_oos_edge"), (zero("edge_t") < scores.LEAST_T, "kill", "low_edge_t"),
        (F.col("dsr") < scores.WATCH, "watch", None), ((zero("holdout_sharpe") > 0) & (zero("holdout_psr") >= scores.KILL), "research-supported", None),
    ]
    t = fix(t, *step(bands, None, None))
    alive = F.col("__v").isin("watch", "research-supported")
    gates = [
        (alive & (F.col("adheres") == F.lit(False)), "kill", "regime_mismatch"), (alive & yes("regime_fragile"), "kill", "regime_fragile"), (alive & yes("includes_zero"), "kill", "edge_ci_zero"),
        (alive & (F.coalesce("permutation_p", F.lit(0.0)) > MOST_P), "kill", "no_signal_alignment"), (alive & (F.col("walk_forward_consistent") == F.lit(False)), "kill", "walk_forward_drift"),
        (alive & yes("cpcv_overfit"), "kill", "overfit_cpcv"), (alive & yes("parameter_fragile"), "kill", "parameter_fragile"),
    ]
    gates = [(F.coalesce(w, F.lit(False)), a, b) for w, a, b in gates]
    t = fix(t, *step(gates, F.col("__v"), F.col("__r")))
    t = t.withColumns({"__top": F.col("__v") == "research-supported", "__alive": alive})
    framed = (kind == "factor_spanning") & yes("strategy_framed")
    caps = {
        "tail_asymmetric": yes("tail_asymmetric") & trades, "costs_modelled": F.col("__top") & trades & ~yes("costs_measured"), "no_external_anchor": F.col("__top") & yes("unanchored"),
        "capped_claim_type": F.col("__alive") & (kind.isin(*CAPPED_TYPES) | framed), "no_post_sample_data": F.col("__alive") & yes("external") & (F.coalesce("post_years", F.lit(-1.0)) < LEAST_YEARS),
    }
    capped = F.lit(False)
    for name, when in caps.items():
        capped = capped | when
        notes.append(F.when(when, F.lit(name)))
    t = t.withColumn("__v", F.when(F.col("__top") & capped, "watch").otherwise(F.col("__v"))).withColumn("__notes", F.array_compact(F.array(*notes)))
    if cost_gate:
        thin = alive & trades & (F.col("cost_margin") < LEAST_MARGIN)
        thin = F.coalesce(thin, F.lit(False))
        t = t.withColumn("__thin", thin)
        t = t.withColumns({"__r": F.when(F.col("__thin") & (F.col("__v") == "watch"), "cost_sensitive").otherwise(F.col("__r")), "__v": F.when(F.col("__thin"), F.when(F.col("__v") == "watch", "kill").otherwise("watch")).otherwise(F.col("__v"))}).drop("__thin")
    open_folds = (F.col("__r") == "in_sample_only") & ~F.coalesce(F.col("min_fold_t") <= FOLD_T, F.lit(False)) & (F.coalesce("fold_power", F.lit(0.0)) < FOLD_POWER)
    weak = (F.col("__v") == "kill") & ((F.col("__r").isin(*AMBIGUOUS) & ~yes("sufficient")) | open_folds)
    weak = F.coalesce(weak, F.lit(False))
    t = t.withColumn("__weak", weak)
    t = t.withColumns({"__was": F.col("__r"), "__v": F.when(F.col("__weak"), "underpowered").otherwise(F.col("__v")), "__r": F.when(F.col("__weak"), "below_detection_floor").otherwise(F.col("__r"))})
    odd = F.col("implausible").isNotNull() & ~kind.isin(*NO_PLAUSIBILITY)
    reasons = F.array_compact(F.concat(F.array(F.col("__was")), F.col("__notes"), F.array(F.when(F.col("__weak"), F.lit("below_detection_floor")), F.when(odd, F.col("implausible")))))
    out = t.withColumns({"verdict": F.when(odd, "needs_review").otherwise(F.col("__v")), "kill_reason": F.when(~odd, F.col("__r")), "reasons": reasons})
    return out.drop("__v", "__r", "__top", "__alive", "__notes", "__weak", "__was")


def power_resolution(scored: DataFrame) -> DataFrame:
    """series_id, n_oos, mde, needed_bars, more_bars, needed_breadth, fold_power: what it would take to see an edge that matters."""
    sizes = [f"(floor(seen / 3) + if(seen % 3 > {k}, 1, 0))" for k in range(3)]
    need = (scores.Z / scores.IC_FLOOR) ** 2
    out = scored.withColumn("needed_bars", F.lit(int(need) + 1).cast("long")).withColumn("fold_power", fold_power(sizes))
    return out.select("series_id", "n_oos", F.expr(f"round({scores.Z} / sqrt(greatest(2, n_oos)), 4)").alias("mde"), "needed_bars", F.greatest(F.lit(0).cast("long"), F.col("needed_bars") - F.col("n_oos")).alias("more_bars"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(need) / F.greatest(F.lit(1), F.col("n_oos")))).alias("needed_breadth"), "fold_power")


def claim_report(decided: DataFrame) -> DataFrame:
    """series_id, verdict, kill_reason, the reasons (and their rationale, if it has been made) and each metric beside what deflates it: psr and dsr with the number of trials, edge_t, the smallest edge
    that could have been seen, and the holdout."""
    return decided.select("series_id", "verdict", "kill_reason", F.array_join("reasons", "; ").alias("reasons"), *(["rationale"] if "rationale" in decided.columns else []), "psr", "dsr", "n_trials", "edge_t", "n_oos", "mde", "sufficient", "oos_sharpe", "is_sharpe", "holdout_sharpe", "holdout_psr", (F.coalesce("is_sharpe", F.lit(0.0)) > 0).alias("replicated_in_sample"))


# Wordings by which a claim calls itself a strategy that is traded.
TRADED = (
    r"\bstrateg(?:y|ies)\b",
    r"\brebalanc",
    r"\blong[- ]short\b",
    r"\bgoes?\s+long\b",
    r"\bshort\s+(?:losers?|the\s+bottom)\b",
    r"\bportfolio\b.{0,40}\brebalanc",
    r"\btrading\s+strateg",
)


def strategy_framed(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike("|".join(f"(?:{p})" for p in TRADED))


def join_gates(
    net: DataFrame, scored: DataFrame, claims: DataFrame, configs: DataFrame | None = None, forward: DataFrame | None = None, regimes: DataFrame | None = None, declared: DataFrame | None = None,
    cost: float = 0.0005, reps: int = 2000, per_year: float = 252, report_only: bool = False,
) -> DataFrame:
    """scored, a row of scores.referee for each series, with what every gate says of it: all columns of GATES, and the figures of RATIONALE.

    net: series_id, family, ts, seq, net, position, payoff. claims: series_id, text, source_text, source_type, sample_end, costs (measured or
    not). configs: claim, config, seq, net of a claim's other parameters. forward: series_id, ts, signal, fut_rv, iv. regimes: series_id,
    scheme, label, net, and declared: series_id, scheme, label. A gate whose table is missing, or that a series is too short for, has not run:
    its columns are null. Each gate is one table with a row a series, and all are joined by series_id.

    With report_only the resampled gates, and those on the edge's robustness, run on the series alone that decide and rationale ask about them:
    those that the score bands leave alive, and for capacity implausible ones as well. Verdicts, reasons and rationales are those of all
    gates on all series. The scores and these series' rows are written first, so jobs run while the plan is built.
    """
    from refspark.operators import claims as c
    from refspark.operators import gates as g
    from refspark.operators import reserve
    from refspark.operators.claimtext import classify

    base = scored.drop("verdict", "kill_reason")
    sizes = [f"(floor(seen / 3) + if(seen % 3 > {k}, 1, 0))" for k in range(3)]
    base = base.withColumn("fold_power", fold_power(sizes))
    said = classify(claims, ["text"], "source_text").select("series_id", "claim_type", strategy_framed(F.col("text")).alias("strategy_framed"), F.coalesce(~reserve.anchored(F.col("source_type")), F.lit(False)).alias("unanchored"), (F.lower("source_type") == "external_source").alias("external"), (F.lower(F.trim("costs")) == "measured").alias("costs_measured"), "sample_end")
    whole = net.groupBy("series_id").agg(F.avg("net").alias("__mean"), F.stddev_samp("net").alias("__sd"), F.max("ts").alias("data_end"))
    base = base.join(whole, "series_id", "left").withColumn("implausible", reserve.implausible(F.col("oos_sharpe"), F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")
    tails, sized = scores.tail_metrics(net), net
    if report_only:
        base = checkpointed(base)
        asked = base.filter(in_bands())
        sized = net.join(base.filter(in_bands() | F.col("implausible").isNotNull()).select("series_id"), "series_id", "left_semi")
        only = lambda df, key="series_id": df.join(asked.select(F.col("series_id").alias(key)), key, "left_semi")
        net = checkpointed(only(net))
        configs, forward = configs and only(configs, "claim"), forward and only(forward)
    tables = [
        said,
        g.block_bootstrap(net, reps, per_year=per_year).select("series_id", "includes_zero", "edge_lo", "edge_hi"),
        g.permutation_test(net, reps).select("series_id", F.col("p").alias("permutation_p")),
        g.regime_gate(net).groupBy("series_id").agg(F.bool_or("fragile").alias("regime_fragile"), F.min(F.when(F.col("fragile"), F.concat_ws("=", "scheme", "best"))).alias("fragile_regime")),
        g.cpcv(net, per_year=per_year).select("series_id", F.col("overfit").alias("cpcv_overfit"), F.col("p_loss").alias("cpcv_loss"), F.col("median_sharpe").alias("cpcv_sharpe"), F.col("paths").alias("cpcv_paths")),
        tails.select("series_id", F.col("asymmetric").alias("tail_asymmetric"), "skew", "tail_ratio", "max_loss"),
        g.cost_sensitivity(net, base.select("series_id", "bench"), cost, per_year).select("series_id", F.col("margin").alias("cost_margin")),
        g.capacity_ci(sized, per_year=per_year).select("series_id", "capacity_median", F.col("conditional").alias("capacity_conditional"), F.col("p_positive").alias("capacity_p")),
    ]
    if configs is not None:
        tables.append(g.parameter_fragility(configs).select(F.col("claim").alias("series_id"), F.col("fragile").alias("parameter_fragile"), "positive_share", "configs"))
    if forward is not None:
        windows = c.walk_forward(forward)
        shown = windows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("window", F.round("sharpe", 3).alias("sharpe")))).alias("w")).select("series_id", F.transform("w", lambda x: x["sharpe"]).alias("window_sharpes"))
        tables += [c.walk_forward_consistent(windows).select("series_id", F.col("consistent").alias("walk_forward_consistent")), shown]
    if declared is not None and regimes is not None:
        adherence = g.regime_adherence(regimes, declared).select("series_id", "adheres", "trade_share", "top_label")
        tables += [adherence, declared.select("series_id", F.concat_ws("=", "scheme", "label").alias("declared_regime"))]
    out = base
    for t in tables:
        out = out.join(t, "series_id", "left")
    return out.withColumn("post_years", reserve.post_sample_years(F.col("data_end"), F.col("sample_end")))


def _shown(c: str | Column, places: int = 3) -> Column:
    """A number as text, or a dash."""
    c = F.col(c) if isinstance(c, str) else c
    value = F.round(c.cast("double"), places) if places else F.round(c.cast("double")).cast("bigint")
    return F.coalesce(value.cast("string"), F.lit("-"))


def rationale(decided: DataFrame) -> DataFrame:
    """decided, of join_gates, with rationale: a sentence for each of its reasons with the figures behind it, in the order of the reasons.

    What the bands say of a survivor (a score in the watch band, a holdout that doesn't confirm), and what is left open (a capacity that can't be
    told or holds under a condition, the data that would settle an open question) comes as well. A verdict without a reason passed all gates.
    """
    t = decided.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in RATIONALE.items() if c not in decided.columns])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    n, survivor = _shown("n_oos", 0), F.col("verdict").isin("watch", "research-supported")
    alive = survivor | (F.col("verdict") == "needs_review") & F.col("kill_reason").isNull()
    trades = ~F.coalesce("claim_type", F.lit("trading_strategy")).isin(*NOT_TRADES)
    more = F.greatest(F.lit(0).cast("long"), F.col("needed_bars") - F.col("n_oos"))
    framed = F.coalesce("strategy_framed", F.lit(False))
    said = {
        "data_unavailable": text("Only ", _shown("n_oos", 0), f" rows are out of sample, and {scores.LEAST_OOS} are needed."),
        "in_sample_only": text("The signs of the three folds differ: t of ", _shown("fold_1"), ", ", _shown("fold_2"), ", ", _shown("fold_3"), "; power ", _shown("fold_power"), "."),
        "no_oos_edge": text("The deflated score out of sample is ", _shown("dsr"), f", under {scores.KILL}, with ", _shown("n_trials", 0), " trials."),
        "low_edge_t": text("The edge out of sample has a t of ", _shown("edge_t"), f", under {scores.LEAST_T}."),
        "regime_mismatch": text("The claim is for ", F.coalesce("declared_regime", F.lit("-")), ", where a share of ", _shown("trade_share"), " of the trades lies; most of the edge is in ", F.coalesce("top_label", F.lit("-")), "."),
        "regime_fragile": text("Without its best regime, ", F.coalesce("fragile_regime", F.lit("-")), ", little of the edge is left, less than by chance."),
        "edge_ci_zero": text("The bootstrap interval of the edge holds zero: ", _shown("edge_lo", 6), " to ", _shown("edge_hi", 6), "."),
        "no_signal_alignment": text("Shuffled outcomes do as well: p ", _shown("permutation_p", 4), f", over {MOST_P}."),
        "walk_forward_drift": text("Not every walk-forward window gains: ", F.array_join(F.transform("window_sharpes", lambda x: x.cast("string")), ", ", "-"), "."),
        "overfit_cpcv": text("Of ", _shown("cpcv_paths", 0), " purged test paths a share of ", _shown("cpcv_loss"), " loses, and their median Sharpe ratio is ", _shown("cpcv_sharpe"), "."),
        "parameter_fragile": text("Of ", _shown("configs", 0), " configurations a share of ", _shown("positive_share"), " gains."),
        "cost_sensitive": text("The edge bears ", _shown("cost_margin"), f" times its costs, under {LEAST_MARGIN}."),
        "tail_asymmetric": text("Small gains stand against large losses: skew ", _shown("skew"), ", tail ratio ", _shown("tail_ratio"), ", largest loss ", _shown("max_loss", 6), "."),
        "costs_modelled": text("Costs are modelled, not measured: at most watch."),
        "no_external_anchor": text("The source has no outside anchor: at most watch."),
        "capped_claim_type": F.when(F.col("claim_type") == "provided_series_statistic", "The series was given, not built here: at most watch.").when(framed, "The claim is of a strategy that is traded, and was tested before costs: at most watch.").otherwise("What is shown is no trade, and has no costs or capacity: at most watch."),
        "no_post_sample_data": text("No data come after the claim's own sample: ", _shown("post_years"), " years."),
        "below_detection_floor": text("Not shown to be dead: with ", n, " rows the least edge to be seen is ", _shown("mde", 4), "; ", _shown(more, 0), " rows more would tell."),
        "implausible_sharpe": text("A Sharpe ratio of ", _shown("oos_sharpe"), " is that of a broken test, not of an edge."),
        "degenerate_series": text("The series hardly varies: its result is that of a broken test, not of an edge."),
    }
    table = F.map_from_arrays(F.array(*map(F.lit, said)), F.array(*[F.coalesce(v, F.lit("-")) for v in said.values()]))
    band = F.when(survivor & (F.col("dsr") < scores.WATCH), text("The deflated score of ", _shown("dsr"), " lies in the watch band."))
    holdout = F.when(survivor & (F.col("dsr") >= scores.WATCH) & ~F.coalesce((F.col("holdout_sharpe") > 0) & (F.col("holdout_psr") >= scores.KILL), F.lit(False)), text("The holdout doesn't confirm it: Sharpe ratio ", _shown("holdout_sharpe"), ", score ", _shown("holdout_psr"), "."))
    thin = F.when(survivor & trades & (F.col("cost_margin") < LEAST_MARGIN), said["cost_sensitive"])
    size = F.when(alive & trades & F.col("capacity_median").isNull(), "Its capacity can't be told.").when(alive & trades & F.col("capacity_conditional"), text("Its capacity holds where the edge is positive, with p ", _shown("capacity_p"), "."))
    open_ = F.when(F.col("verdict") == "insufficient_data", text(_shown(more, 0), " rows more would show an edge that matters."))
    within = F.when((F.col("verdict") != "kill") & F.col("adheres") & F.col("declared_regime").isNotNull(), text("It holds within ", F.col("declared_regime"), ", not elsewhere."))
    every = F.array_compact(F.concat(F.array(band, holdout), F.transform("reasons", lambda r: F.coalesce(F.try_element_at(table, r), r)), F.array(thin, size, open_, within)))
    return t.withColumn("rationale", F.when(F.size(every) > 0, F.array_join(every, " ")).otherwise("It passed all gates.")).drop(*[c for c in RATIONALE if c not in decided.columns])


#: Figures of the rationale, with their types; those that a table hasn't are shown as a dash.
RATIONALE = {
    "edge_lo": "double", "edge_hi": "double", "fragile_regime": "string", "cpcv_loss": "double", "cpcv_sharpe": "double", "cpcv_paths": "bigint", "skew": "double", "tail_ratio": "double", "max_loss": "double", "capacity_median": "double",
    "capacity_conditional": "boolean", "capacity_p": "double", "positive_share": "double", "configs": "bigint", "window_sharpes": "array<double>", "trade_share": "double", "top_label": "string", "declared_regime": "string",
} | GATES
