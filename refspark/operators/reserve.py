"""Confirmation reserves, provenance and plausibility: what may be used as evidence, and what must be held back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sources without an outside anchor, and the bars a year of a rebalance rule.
UNANCHORED = ("generated", "synthesized", "chat")
CADENCE = {"D": 365.25, "B": 252.0, "W": 52.0, "Q": 4.0, "QE": 4.0, "Y": 1.0, "YE": 1.0, "A": 1.0, "AE": 1.0}
#: A yearly Sharpe ratio above it, or a deviation under so small a share of the mean, is taken for a broken test.
MOST_SHARPE, LEAST_SPREAD = 6.0, 0.02


def implausible(sharpe: Column, mean: Column, sd: Column) -> Column:
    """implausible_sharpe, degenerate_series or null. A sharpe that isn't finite falls through to the second test."""
    finite = sharpe.isNotNull() & ~F.isnan(sharpe) & (F.abs(sharpe) < float("inf"))
    degenerate = (mean != 0) & (F.abs(sd) < LEAST_SPREAD * F.abs(mean))
    return F.when(finite & (F.abs(sharpe) > MOST_SHARPE), "implausible_sharpe").when(degenerate, "degenerate_series")


def post_sample_years(data_end: Column, sample_end: Column) -> Column:
    """Years of data after the claim's own sample; null if the sample's end isn't declared."""
    return F.datediff(data_end, sample_end) / 365.25


def anchored(source_type: Column) -> Column:
    """Whether a source has an outside anchor; null for an unknown one."""
    return ~F.lower(source_type).isin(*UNANCHORED)


def cadence(rule: Column, observed: Column) -> Column:
    """Bars a year of a rebalance rule; of one that isn't known, those observed, 1 at least."""
    text = F.upper(F.trim(F.coalesce(rule, F.lit(""))))
    bare = F.regexp_replace(text, r"^1(?=[A-Z])", "")
    out = F.greatest(F.lit(1.0), observed)
    out = F.when(bare.rlike(r"^\d+ME?$"), F.greatest(F.lit(1.0), 12.0 / F.try_to_number(F.regexp_extract(bare, r"^(\d+)", 1), F.lit("999999")).cast("double"))).otherwise(out)
    out = F.when(bare.isin("M", "ME"), 12.0).when(bare.startswith("W-"), 52.0).otherwise(out)
    return reduce(lambda acc, kv: F.when(bare == kv[0], kv[1]).otherwise(acc), CADENCE.items(), out)


def overlaps(left_start: str, left_end: str, right_start: str, right_end: str) -> Column:
    """Whether two closed periods share a day."""
    return (F.col(left_start) <= F.col(right_end)) & (F.col(right_start) <= F.col(left_end))


def valid_epochs(epochs: DataFrame, by: str = "reserve") -> DataFrame:
    """Epochs (by, epoch_id, start, end) of the reserves all of whose complete epochs have ids of their own and don't overlap.

    Epochs without an id or with an end before their start are left out; one clash empties its reserve.
    """
    ok = epochs.filter(F.expr("trim(epoch_id) <> '' and start <= end"))
    w = W.partitionBy(by)
    clash = F.col("start") <= F.lag("end").over(w.orderBy("start", "end", "epoch_id"))
    twice = F.count("*").over(W.partitionBy(by, "epoch_id")) > 1
    return ok.withColumn("__bad", F.coalesce(clash, F.lit(False)) | twice).withColumn("__any", F.bool_or("__bad").over(w)).filter("not __any").drop("__bad", "__any")


def provenance_checkable(has_period: Column, datasets: Column, domains: Column, names_datasets: Column, names_domains: Column) -> Column:
    """Whether a lineage says enough to be held against epochs: a period, and what the epochs name (arrays; null is empty)."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return F.coalesce(has_period, F.lit(False)) & (~names_datasets | some(datasets)) & (~names_domains | some(domains))


def reserve_overlap(lineage: DataFrame, epochs: DataFrame, key: str) -> DataFrame:
    """key, shares_name, shares_day, n_day_epochs, overlap: whether a lineage has a domain or a dataset of some epoch, or a day, and with how many
    epochs it shares one; one row for each of lineage's.

    lineage: key (unique), domains, datasets (arrays), start, end. epochs: epoch_id, domains, datasets, start, end. Epochs are first put together
    to their distinct names and, month by month, to a mask of the days that any of them covers, so no pair of a lineage and an epoch is
    made, however many share a name or a day. The epochs of a lineage's days are those begun by its end less those ended before its start, two
    sums by day. Null or empty arrays share nothing, a period without both ends has no day.
    """

    def names(side: DataFrame, *keep: str) -> DataFrame:
        each = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(kind), x))
        return side.select(*keep, F.explode(F.concat(each("domain:", F.col("domains")), each("dataset:", F.col("datasets")))).alias("name"))

    def days(side: DataFrame, *keep: str) -> DataFrame:
        months = side.filter("start <= end").select(*keep, "start", "end", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("month"))
        first = F.when(F.trunc("start", "month") == F.col("month"), F.dayofmonth("start")).otherwise(1)
        last = F.when(F.trunc("end", "month") == F.col("month"), F.dayofmonth("end")).otherwise(31)
        below = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
        return months.select(*keep, "month", (below(last) - below(first - 1)).alias("days"))

    named = names(lineage, key).join(names(epochs).distinct(), "name", "left_semi").select(key).distinct().withColumn("shares_name", F.lit(True))
    covered = days(epochs).groupBy("month").agg(F.bit_or("days").alias("covered"))
    timed = days(lineage, key).join(covered, "month").filter(F.col("days").bitwiseAND(F.col("covered")) != 0).select(key).distinct().withColumn("shares_day", F.lit(True))
    whole = epochs.filter("start <= end")
    marks = whole.groupBy(F.col("start").alias("day")).agg(F.count("*").alias("begun")).join(whole.groupBy(F.date_add("end", 1).alias("day")).agg(F.count("*").alias("ended")), "day", "full")
    calendar = marks.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # one row for each day of the calendar
    runs = calendar.join(marks, "day", "left").select("day", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("begun", "ended")])
    first, last = (F.broadcast(runs.agg(f("day").alias(n))) for f, n in ((F.min, "__first"), (F.max, "__last")))
    spans = lineage.filter("start <= end").select(key, "start", "end").join(first).join(last)
    at = lambda c, n: spans.filter(F.col(c) >= F.col("__first")).select(key, F.least(c, "__last").alias("day")).join(runs.select("day", n), "day").select(key, n)
    counted = at("end", "begun").join(at("start", "ended"), key, "left").select(key, (F.col("begun") - F.coalesce("ended", F.lit(0))).alias("n_day_epochs"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = lineage.select(key).join(named, key, "left").join(timed, key, "left").join(counted, key, "left").select(key, no("shares_name"), no("shares_day"), F.coalesce("n_day_epochs", F.lit(0)).alias("n_day_epochs"))
    return out.withColumn("overlap", F.col("shares_name") | F.col("shares_day"))


def assign_epochs(candidates: DataFrame, epochs: DataFrame, by: str, order: str) -> DataFrame:
    """by, candidate, epoch_id, status: the i-th candidate of a reserve gets its i-th epoch; with fewer epochs than candidates, refused.

    candidates: by, candidate and `order`; epochs: by, epoch_id, start. A reserve is small by nature, and is one window.
    """
    c = candidates.withColumns({"k": F.row_number().over(W.partitionBy(by).orderBy(order, "candidate")), "n": F.count("*").over(W.partitionBy(by))})
    e = epochs.withColumns({"k": F.row_number().over(W.partitionBy(by).orderBy("start", "epoch_id"))}).select(by, "k", "epoch_id")
    have = epochs.groupBy(by).agg(F.count("*").alias("epochs"))
    out = c.join(have, by, "left").join(e, [by, "k"], "left").withColumn("ok", F.coalesce(F.col("epochs") >= F.col("n"), F.lit(False)))
    return out.select(by, "candidate", F.when(F.col("ok"), F.col("epoch_id")).alias("epoch_id"), F.when(F.col("ok"), "assigned").otherwise("refused").alias("status"))


def restrict_datasets(series: DataFrame, allowed: DataFrame, name: str = "dataset") -> DataFrame:
    """Rows of the datasets that an epoch allows; all rows where it names none."""
    return series.join(allowed.select(name).distinct(), name, "left_semi") if not allowed.isEmpty() else series


def require_survivorship(meta: DataFrame) -> DataFrame:
    """meta with available and reason: panels of returns must say survivorship = corrected."""
    bad = (F.col("kind") == "return") & (F.coalesce(F.lower(F.trim("survivorship")), F.lit("")) != "corrected")
    return meta.withColumns({"available": ~bad, "reason": F.when(bad, "data_unavailable: returns are not corrected for survivorship")})


def provenance_summary(inputs: DataFrame, coverage: DataFrame, by: str) -> DataFrame:
    """by, name, available, reason, first, last, n, source, any_synthetic: each declared input with what there is of it.

    inputs: by, name. coverage: name, first, last, n, source, synthetic.
    """
    j = inputs.join(coverage, "name", "left")
    there = F.col("n").isNotNull() & (F.col("n") > 0)
    any_synthetic = F.coalesce(F.bool_or("synthetic").over(W.partitionBy(by)), F.lit(False))
    return j.select(by, "name", there.alias("available"), F.when(~there, "data_unavailable").alias("reason"), "first", "last", "n", "source", any_synthetic.alias("any_synthetic"))


def cleanup_unscored(ledger: DataFrame, cohorts: DataFrame, cohort: str = "cohort", source: str = "paper") -> DataFrame:
    """The ledger without the unscored rows of that source in these cohorts."""
    marked = ledger.join(cohorts.select(cohort).distinct().withColumn("__in", F.lit(True)), cohort, "left")
    gone = F.coalesce(F.col("__in"), F.lit(False)) & (F.col("source") == source) & ~F.coalesce(F.col("scored"), F.lit(False))
    return marked.filter(~F.coalesce(gone, F.lit(False))).drop("__in")


def lookahead_diff(full: DataFrame, head: DataFrame, by: str = "series_id", rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """by, common, differ, status: a run on all rows against one on the first of them, at the times that both have.

    Under three common rows, or with a value that isn't finite, nothing can be said (skip); any difference is a look-ahead.
    """
    j = full.select(by, "ts", F.col("value").alias("a")).join(head.select(by, "ts", F.col("value").alias("b")), [by, "ts"])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    off = F.abs(F.col("a") - F.col("b")) > atol + rtol * F.abs("b")
    g = j.groupBy(by).agg(F.count("*").alias("common"), F.count_if(~(finite("a") & finite("b"))).alias("odd"), F.count_if(off).alias("differ"))
    return g.select(by, "common", "differ", F.when(F.expr("common < 3 or odd > 0"), "skip").when(F.col("differ") > 0, "lookahead").otherwise("ok").alias("status"))


def tolerance_check(pairs: DataFrame, decades: float = 1.0) -> DataFrame:
    """key, direction, edge, sharpe, capacity (each null if it can't be judged), conclusive and passed.

    pairs: key, ref_edge, cand_edge, edge_lo, edge_hi (the reference's interval), ref_sharpe, cand_sharpe, sharpe_lo, sharpe_hi, ref_capacity, cand_capacity.
    """
    half = lambda x: F.abs(F.col(f"{x}_hi") - F.col(f"{x}_lo")) / 2
    near = lambda x: F.abs(F.col(f"cand_{x}") - F.col(f"ref_{x}")) <= half(x)
    both = (F.col("ref_capacity") > 0) & (F.col("cand_capacity") > 0)
    out = pairs.select("key", ((F.col("ref_edge") >= 0) == (F.col("cand_edge") >= 0)).alias("direction"), near("edge").alias("edge"), near("sharpe").alias("sharpe"),
        F.when(both, F.abs(F.log10("cand_capacity") - F.log10("ref_capacity")) <= decades).alias("capacity"))
    conclusive = F.col("direction").isNotNull() & F.col("edge").isNotNull()
    every = reduce(lambda a, c: a & F.coalesce(F.col(c), F.lit(True)), ("direction", "edge", "sharpe", "capacity"), F.lit(True))
    return out.withColumns({"conclusive": conclusive, "passed": conclusive & every})


def decay_by_period(returns: DataFrame, papers: DataFrame, least: int = 24) -> DataFrame:
    """signal, in_sample, post_sample, post_publication (means), n_in, n_post and decay (1 - post-publication over in-sample).

    returns: signal, year, ret. papers: signal, sample_end, published (years), small and broadcast by Spark if it fits. Signals with fewer
    than `least` rows in the first or last period have no row.
    """
    j = returns.join(papers, "signal")
    when = lambda c: F.avg(F.when(c, F.col("ret")))
    early, late = F.col("year") <= F.col("sample_end"), F.col("year") > F.col("published")
    g = j.groupBy("signal").agg(when(early).alias("in_sample"), when(~early & ~late).alias("post_sample"), when(late).alias("post_publication"), F.count_if(early).alias("n_in"), F.count_if(late).alias("n_post"))
    return g.filter((F.col("n_in") >= least) & (F.col("n_post") >= least)).withColumn("decay", F.when(F.col("in_sample") != 0, 1 - F.col("post_publication") / F.col("in_sample")))
