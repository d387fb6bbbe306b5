"""Resampling and robustness gates over many net series at once (series_id, seq, ts, net).

A mean within 1e-12 of zero (a Sharpe ratio within 1e-9) counts as zero. The resampling gates are one shuffle by series: a series' rows
come to one task once, 8 bytes a value, and its replicates are made there as arrays, some at a time. Their draws come from a generator
seeded by the series and the gate, so a task that is lost draws the same again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Drawn values held at a time.
CELLS = 1 << 21
#: And as many while only the places of blocks are kept of them.
PIECE = 1 << 16
#: A regime whose absence leaves so small a share of the edge is suspect; a permutation as concentrated as it, so often, excuses it.
SURVIVAL, REGIME_P, REGIME_REPS = 0.25, 0.05, 500
#: Groups of cross-validation need so many rows, and a combination of test groups so many of its kind.
LEAST_GROUP, LEAST_PATHS = 5, 6


def _numbered(net: DataFrame) -> DataFrame:
    w = W.partitionBy("series_id")
    return net.withColumns({"k": F.row_number().over(w.orderBy("seq")) - 1, "n": F.count("*").over(w)})


def generator(series: object, gate: str) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(series).encode()), zlib.crc32(gate.encode())])


def stationary(rng: np.random.Generator, n: int, block: int, reps: int) -> np.ndarray:
    """reps rows of n places: runs of mean length `block` that start anywhere and wrap around."""
    fresh = rng.random((reps, n)) < 1.0 / max(1, block)
    fresh[:, 0] = True
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    start = rng.integers(0, n, (reps, n))
    return (np.take_along_axis(start, at, 1) + np.arange(n) - at) % n


def _blocks(rng: np.random.Generator, n: int, block: int, reps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same draws as stationary's, as blocks in order: row, first place, length."""
    step = max(1, PIECE // n)
    at = []
    for a in range(0, reps, step):  # pieces of one stream are the same draws
        fresh = rng.random((min(step, reps - a), n)) < 1.0 / max(1, block)
        fresh[:, 0] = True
        at.append(np.flatnonzero(fresh) + a * n)
    start = [rng.integers(0, n, min(step * n, reps * n - k * step * n))[own - k * step * n] for k, own in enumerate(at)]
    at = np.concatenate(at)
    return at // n, np.concatenate(start), np.diff(at, append=reps * n)


class _Circle:
    """Sums, extremes and drawdowns of stretches of a series that is walked in a circle, each in a few look-ups.

    Tables over 2^k places at each place, for stretches of up to one turn; an inner drawdown is that of two halves that overlap, or from the
    first's part before the second to the second.
    """

    def __init__(self, x: np.ndarray, down: bool = True):
        self.n, self.x = len(x), x - x[0]
        self.shift = x[0]
        turn = np.concatenate((self.x, self.x))
        self.s1, self.s2 = (np.concatenate(([0.0], np.cumsum(v))) for v in (turn, turn * turn))
        self.levels = max(1, self.n.bit_length())
        if down:
            c = np.cumsum(np.concatenate((x, x)))
            hi, lo, dd = [c], [c], [np.zeros(len(c))]
            for k in range(self.levels - 1):
                far = np.minimum(np.arange(len(c)) + (1 << k), len(c) - 1)
                dd.append(np.maximum(np.maximum(dd[k], dd[k][far]), hi[k] - lo[k][far]))
                hi.append(np.maximum(hi[k], hi[k][far]))
                lo.append(np.minimum(lo[k], lo[k][far]))
            self.c, self.hi, self.lo, self.dd = c, np.stack(hi), np.stack(lo), np.stack(dd)
            self.log = np.concatenate(([0], np.floor(np.log2(np.arange(1, self.n + 1) + 0.5)))).astype(np.int64)

    def sums(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and sum of squares of the values less the first of the series."""
        return self.s1[start + size] - self.s1[start], self.s2[start + size] - self.s2[start]

    def drawdowns(self, row: np.ndarray, start: np.ndarray, size: np.ndarray, reps: int) -> np.ndarray:
        """The largest drawdown of the summed results of each row of blocks."""
        k = self.log[size]
        last = start + size - (1 << k)
        rest = size - (1 << k)
        j = self.log[rest]
        front = np.where(rest > 0, np.maximum(self.hi[j, start], self.hi[j, np.maximum(start, start + rest - (1 << j))]), -np.inf)
        low, high = np.minimum(self.lo[k, start], self.lo[k, last]), np.maximum(self.hi[k, start], self.hi[k, last])
        inner = np.maximum(np.maximum(self.dd[k, start], self.dd[k, last]), front - self.lo[k, last])
        before = np.where(start > 0, self.c[start - 1], 0.0)
        total = self.c[start + size - 1] - before
        edges = np.searchsorted(row, np.arange(reps + 1))
        count = np.diff(edges)
        sofar, peak, out = np.zeros(reps), np.full(reps, -np.inf), np.zeros(reps)
        for b in range(int(count.max(initial=0))):
            r = np.flatnonzero(count > b)
            i = edges[r] + b
            base = sofar[r] - before[i]
            out[r] = np.maximum(np.maximum(out[r], inner[i]), peak[r] - (base + low[i]))
            peak[r] = np.maximum(peak[r], base + high[i])
            sofar[r] += total[i]
        return out


def _chunks(reps: int, n: int) -> Iterator[int]:
    step = max(1, CELLS // max(1, n))
    yield from (min(step, reps - k) for k in range(0, reps, step))


def _sharpes(x: np.ndarray, per_year: float) -> np.ndarray:
    """Of each row; null under 20 values, 0 without spread."""
    sd = x.std(1, ddof=1) if x.shape[1] > 1 else np.zeros(len(x))
    return np.where(sd > 0, x.mean(1) / np.where(sd > 0, sd, 1) * per_year**0.5, 0.0)


def _values(pdf: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    pdf = pdf.sort_values("seq", kind="stable")
    x = [pdf[c].to_numpy(float) for c in columns]
    good = np.all([np.isfinite(v) for v in x], axis=0)
    return [v[good] for v in x]


def _type(df: DataFrame) -> str:
    return df.schema["series_id"].dataType.simpleString()


def _by_series(df: DataFrame, columns: tuple[str, ...], fields: str, make) -> DataFrame:
    """One row or none for each series: make(series_id, arrays of the finite rows in order) -> tuple of `fields`."""
    names = ["series_id", *[f.split()[0] for f in fields.split(", ")]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = make(key[0], *_values(pdf, *columns))
        return pd.DataFrame([(key[0], *got)] if got is not None else [], columns=names)

    return df.select("series_id", "seq", *[F.col(c).cast("double").alias(c) for c in columns]).groupBy("series_id").applyInPandas(run, f"series_id {_type(df)}, {fields}")


BOOTSTRAP = "n bigint, edge_lo double, edge_hi double, p_positive double, sharpe_lo double, sharpe_hi double, p_sharpe double, drawdown_median double, drawdown_p95 double, includes_zero boolean"


def block_bootstrap(net: DataFrame, reps: int = 2000, ci: float = 0.9, per_year: float = 252) -> DataFrame:
    """series_id and BOOTSTRAP by a stationary bootstrap with blocks of mean length round(sqrt(n)): intervals of the mean and the Sharpe ratio, the
    shares above zero, and drawdowns of the summed results. Series of fewer than 10 finite rows have no row."""

    def make(series, x: np.ndarray):
        n = len(x)
        if n < 10:
            return None
        rng, parts, circle = generator(series, "bootstrap"), [], _Circle(x)
        for k in _chunks(reps, n):
            row, start, size = _blocks(rng, n, max(1, round(n**0.5)), k)
            s1, s2 = (np.bincount(row, v, minlength=k) for v in circle.sums(start, size))
            var = np.maximum(s2 - s1 * s1 / n, 0) / (n - 1)
            mean = circle.shift + s1 / n
            sd = np.sqrt(var)
            ratio = np.where(sd > 0, mean / np.where(sd > 0, sd, 1) * per_year**0.5, 0.0)
            close = var <= 1e-7 * circle.s2[n] / n  # too near to none for differences of sums: drawn out
            if close.any():
                own = close[row]
                places = np.repeat(start[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
                ratio[close] = _sharpes(x[places % n].reshape(-1, n), per_year)
            parts.append((mean, ratio, circle.drawdowns(row, start, size, k)))
        edge, sharpe, down = (np.concatenate(p) for p in zip(*parts, strict=True))
        q = [(1 - ci) / 2 * 100, (1 + ci) / 2 * 100]
        lo, hi = np.percentile(edge, q)
        return (n, lo, hi, (edge > 1e-12).mean(), *np.percentile(sharpe, q), (sharpe > 1e-9).mean(), np.median(down), np.percentile(down, 95), bool(lo <= 0 <= hi))

    return _by_series(net, ("net",), BOOTSTRAP, make)


def permutation_test(net: DataFrame, reps: int = 2000) -> DataFrame:
    """series_id, observed, p: the mean of position x payoff against payoffs in shuffled order; p = (as large + 1) / (reps + 1). Costs don't change
    with the order and are left out. Series of fewer than 10 complete rows have no row."""

    def make(series, position: np.ndarray, payoff: np.ndarray):
        n = len(position)
        if n < 10:
            return None
        rng, seen, as_large = generator(series, "permutation"), float((position * payoff).mean()), 0
        step = max(1, PIECE // n)
        for a in range(0, reps, step):
            shuffled = rng.permuted(np.broadcast_to(payoff, (min(step, reps - a), n)), axis=1)
            as_large += int((shuffled @ position / n >= seen - 1e-12).sum())
        return seen, (as_large + 1) / (reps + 1)

    return _by_series(net, ("position", "payoff"), "observed double, p double", make)


def capacity_ci(net: DataFrame, reps: int = 500, ci: float = 0.9, per_year: float = 252, bps_per_million: float = 25.0) -> DataFrame:
    """series_id, p_positive, capacity_lo, capacity_median, capacity_hi (to the nearest 1000), conditional: the size at which linear impact takes the
    yearly edge, over the resamples that have one. Conditional if under 90 % have; null where none has. No turnover, no row."""

    def make(series, x: np.ndarray, position: np.ndarray):
        n = len(x)
        turn = float(np.abs(np.diff(position, prepend=position[:1])).mean()) if n else 0.0
        if n < 10 or turn <= 0:
            return None
        rng, means, circle = generator(series, "capacity"), [], _Circle(x, down=False)
        for k in _chunks(reps, n):
            row, start, size = _blocks(rng, n, max(1, round(n**0.5)), k)
            means.append(circle.shift + np.bincount(row, circle.sums(start, size)[0], minlength=k) / n)
        year = np.concatenate(means) * per_year
        caps = year[year > 0] / (turn * per_year * bps_per_million / 1e4 / 1e6)
        share = round(float((year > 0).mean()), 3)
        if not len(caps):
            return share, None, None, None, True
        lo, mid, hi = (float(round(v, -3)) for v in np.percentile(caps, [(1 - ci) / 2 * 100, 50, (1 + ci) / 2 * 100]))
        return share, lo, mid, hi, share < 0.9

    return _by_series(net.withColumn("position", F.coalesce("position", F.lit(0.0))), ("net", "position"), "p_positive double, capacity_lo double, capacity_median double, capacity_hi double, conditional boolean", make)


def sign_flip_null(returns: DataFrame, blocks: tuple[int, ...] = (1, 6, 12, 24), reps: int = 2000) -> DataFrame:
    """series_id, block, mean, sd, p95: of the mean result over replicates in which each block of returns has a random sign, traded by the sign of the return before."""
    fields = "block int, mean double, sd double, p95 double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (x,) = _values(pdf, "ret")
        out = []
        for block in blocks if len(x) > 1 else ():
            rng, means = generator(key[0], f"flip{block}"), []
            for k in _chunks(reps, len(x)):
                sign = np.repeat(rng.integers(0, 2, (k, -(-len(x) // block))) * 2.0 - 1, block, axis=1)[:, : len(x)]
                flipped = x * sign
                means.append((np.sign(flipped[:, :-1]) * flipped[:, 1:]).mean(1))
            m = np.concatenate(means)
            out.append((key[0], block, m.mean(), m.std(ddof=1), np.percentile(m, 95)))
        return pd.DataFrame(out, columns=["series_id", "block", "mean", "sd", "p95"])

    return returns.select("series_id", "seq", F.col("ret").cast("double").alias("ret")).groupBy("series_id").applyInPandas(run, f"series_id {_type(returns)}, {fields}")


def fold_groups(net: DataFrame, groups: int) -> DataFrame:
    """series_id, g (0 to groups - 1), n, m, q (the sum of squared deviations), first, last: contiguous groups of the rows of each series."""
    g = _numbered(net.filter("net is not null")).withColumn("g", F.ntile(groups).over(W.partitionBy("series_id").orderBy("seq")) - 1)
    return g.groupBy("series_id", "g").agg(F.count("*").alias("n"), F.avg("net").alias("m"), (F.var_pop("net") * F.count("*")).alias("q"), F.min("k").alias("first"), F.max("k").alias("last"), F.max("n").alias("all"))


def cpcv(net: DataFrame, groups: int = 8, per_year: float = 252, embargo: float = 0.01) -> DataFrame:
    """series_id, paths, median_sharpe, iqr_sharpe, p_loss, haircut, purged, embargoed, overfit over all pairs of `groups` contiguous groups as test sets.

    Only the groups' counts, means and squares are paired (28 rows a series for 8 groups), never the rows. A pair purges the row on each side
    of its groups, and embargoes the next ceil(embargo x n) rows after each, as far as they are training rows; purged and embargoed are their
    sums over the pairs. Series need 5 rows a group, some spread, and 6 pairs. haircut is the median over the whole series' Sharpe ratio.
    """
    m = fold_groups(net, groups).filter((F.col("all") >= groups * LEAST_GROUP) & F.lit(groups * (groups - 1) // 2 >= LEAST_PATHS))
    whole = m.groupBy("series_id").agg(F.max("all").alias("n"), F.sum("n").alias("n_"), F.sum(F.col("n") * F.col("m")).alias("t"), F.collect_list(F.struct("n", "m", "q")).alias("parts"))
    mean = F.col("t") / F.col("n")
    q = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["q"] + x["n"] * F.pow(x["m"] - mean, 2))
    whole = whole.withColumn("full", mean / F.nullif(F.sqrt(q / (F.col("n") - 1)), F.lit(0.0)) * per_year**0.5).filter("full is not null").select("series_id", "full")
    pair = m.alias("a").join(m.alias("b"), F.expr("a.series_id = b.series_id and a.g < b.g"))
    e = F.greatest(F.lit(1), F.ceil(embargo * F.col("a.all")))
    adjacent = F.expr("a.g + 1 = b.g")
    side = lambda c: F.when(c, 1).otherwise(0)
    after_a = F.when(adjacent, 0).otherwise(1)  # a row after a is training unless b begins there
    purged = side(F.col("a.first") > 0) + after_a + F.when(adjacent, 0).when(F.expr("b.first - a.last = 2"), 0).otherwise(1) + side(F.col("b.last") < F.col("a.all") - 1)
    embargoed = F.when(adjacent, 0).otherwise(F.least(e, F.expr("b.first - a.last - 1"))) + F.least(e, F.expr("a.all - 1 - b.last"))
    pair = pair.select("a.series_id", F.expr("a.n + b.n").alias("n"), F.expr("(a.n * a.m + b.n * b.m) / (a.n + b.n)").alias("m"), F.expr("a.q + b.q + power(a.m - b.m, 2) * a.n * b.n / (a.n + b.n)").alias("q"), purged.alias("purged"), embargoed.alias("embargoed"))
    s = pair.withColumn("sharpe", F.coalesce(F.expr("m / nullif(sqrt(q / (n - 1)), 0)") * per_year**0.5, F.lit(0.0)))
    quantile = lambda p: F.expr(f"percentile(sharpe, {p})")
    out = s.groupBy("series_id").agg(F.count("sharpe").alias("paths"), quantile(0.5).alias("median_sharpe"), (quantile(0.75) - quantile(0.25)).alias("iqr_sharpe"), F.avg(F.expr("int(sharpe <= 1e-9)")).alias("p_loss"), F.sum("purged").alias("purged"), F.sum("embargoed").alias("embargoed"))
    out = out.join(whole, "series_id").withColumn("haircut", F.when(F.col("full") > 1e-9, F.col("median_sharpe") / F.col("full"))).drop("full")
    return out.withColumn("overfit", F.col("p_loss") >= 0.5)


def common_length(nets: DataFrame, by: str = "family") -> DataFrame:
    """nets without what a series has beyond the length of its family's shortest: pbo compares candidates over equally many rows.

    nets: series_id, seq (numbered from 1 in each series) and the family. The lengths are one row a series.
    """
    lengths = nets.groupBy(by, "series_id").agg(F.count("*").alias("n")).groupBy(by).agg(F.min("n").alias("__common"))
    return nets.join(lengths, by).filter("seq <= __common").select(*nets.columns)


def pbo(nets: DataFrame, groups: int = 8, by: str = "family") -> DataFrame:
    """by, splits, pbo: how often the candidate that is best in training ranks in the lower half out of sample, over all pairs of test groups.

    Candidates of a family must have equally many rows, 10 at least, and there must be two. Means of groups are paired, never the rows.
    """
    names = nets.select("series_id", by).distinct()
    m = fold_groups(nets, groups).join(names, "series_id").withColumn("t", F.col("n") * F.col("m"))
    ok = m.groupBy(by).agg(F.min("all").alias("lo"), F.max("all").alias("hi"), F.count_distinct("series_id").alias("c")).filter("lo = hi and lo >= 10 and c >= 2").select(by)
    m = m.join(ok, by)
    total = m.groupBy(by, "series_id").agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n"))
    pair = m.alias("a").join(m.alias("b"), F.expr("a.series_id = b.series_id and a.g < b.g")).select(F.col(f"a.{by}").alias(by), "a.series_id", F.col("a.g").alias("x"), F.col("b.g").alias("y"), F.expr("a.t + b.t").alias("t"), F.expr("a.n + b.n").alias("n"))
    j = pair.join(total, [by, "series_id"]).withColumns({"oos": F.round(F.expr("t / n"), 12), "train": F.round(F.expr("(all_t - t) / (all_n - n)"), 12)})
    w = W.partitionBy(by, "x", "y")
    k = j.withColumn("k", F.row_number().over(w.orderBy(F.desc("train"), "series_id")))
    chosen = F.max(F.when(F.col("k") == 1, F.col("oos"))).over(w)
    g = k.withColumn("best", chosen).groupBy(by, "x", "y").agg(F.count_if(F.col("oos") < F.col("best")).alias("below"), F.count("*").alias("c"))
    share = (F.col("below") + 1) / (F.col("c") + 1)
    return g.withColumn("low", F.log(share / (1 - share)) < -1e-12).groupBy(by).agg(F.count("*").alias("splits"), F.avg(F.col("low").cast("int")).alias("pbo"))


def regime_buckets(net: DataFrame, least: int = 8) -> DataFrame:
    """series_id, scheme, label, n, mean of the calendar regimes part_of_week and day_of_week; buckets of `least` rows and series of 24 at least."""
    ok = net.filter("net is not null").withColumn("__n", F.count("*").over(W.partitionBy("series_id"))).filter("__n >= 24")
    both = F.array(F.struct(F.lit("part_of_week").alias("scheme"), F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday").alias("label")), F.struct(F.lit("day_of_week").alias("scheme"), F.dayofweek("ts").cast("string").alias("label")))
    return ok.select("series_id", "net", F.inline(both)).groupBy("series_id", "scheme", "label").agg(F.count("*").alias("n"), F.avg("net").alias("mean")).filter(F.col("n") >= least)


def drop_best_regime(net: DataFrame, share: float = 0.25) -> DataFrame:
    """series_id, scheme, best, rest_mean, concentrated: whether the mean without the best bucket is at most `share` of a positive mean."""
    b = regime_buckets(net)
    s = b.groupBy("series_id", "scheme").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("t"), F.max(F.struct(F.round(F.col("n") * F.col("mean"), 9).alias("t"), "label", "n")).alias("top"), F.count("*").alias("buckets"))
    rest = F.expr("(t - top.t) / (n - top.n)")
    return s.filter("buckets >= 2").select("series_id", "scheme", F.col("top.label").alias("best"), rest.alias("rest_mean"), F.expr(f"t > 0 and (t - top.t) / (n - top.n) <= {share} * t / n").alias("concentrated"))


def regime_gate(net: DataFrame, scheme: Column | None = None, label: str = "label", least: int = 8, reps: int = REGIME_REPS, declared: str | None = None) -> DataFrame:
    """series_id, scheme, best, rest_mean, p, fragile: whether a positive edge hangs on the best regime of a scheme, and more than chance would have it.

    net: with columns scheme and label if they aren't the calendar's (see regime_rows). p is the share of `reps` shuffles of the labels whose
    best bucket leaves as little; fragile if it is under REGIME_P. A scheme needs two buckets of `least` rows and a series 24 rows. With a
    declared "scheme=label" its own concentration is exempt.
    """
    rows = net if {"scheme", label} <= set(net.columns) else regime_rows(net)
    fields = "best string, rest_mean double, p double, fragile boolean"

    def rest(x: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label and mean without it of each row of label numbers."""
        sums = np.stack([np.where(of == j, x, 0.0).sum(1) for j in range(len(n))], 1)
        best = np.where(n >= least, sums, -np.inf).argmax(1)
        left = len(x) - n[best]
        mean = np.where(left >= least, (x.sum() - sums[np.arange(len(of)), best]) / np.maximum(left, 1), 0.0)
        return best, mean

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["series_id", "scheme", "best", "rest_mean", "p", "fragile"]
        pdf = pdf[np.isfinite(pdf["net"].to_numpy(float))].sort_values("seq", kind="stable")
        x, (of, names) = pdf["net"].to_numpy(float), pd.factorize(pdf[label].fillna("unknown"), sort=True)
        n = np.bincount(of, minlength=len(names))
        if len(x) < max(20, 3 * least) or (n >= least).sum() < 2:
            return pd.DataFrame([], columns=columns)
        best, mean = (v[0] for v in rest(x, of[None], n))
        said = str(names[best])
        if x.mean() <= 1e-12 or mean > SURVIVAL * x.mean() or declared == f"{key[1]}={said}":
            return pd.DataFrame([(*key, said, mean, None, False)], columns=columns)
        rng, hits = generator(key[0], f"regime{key[1]}"), 0
        for k in _chunks(reps, len(x)):
            hits += int((rest(x, rng.permuted(np.broadcast_to(of, (k, len(x))), axis=1), n)[1] <= mean).sum())
        return pd.DataFrame([(*key, said, mean, hits / reps, hits / reps < REGIME_P)], columns=columns)

    picked = rows.select("series_id", "scheme", "seq", F.col("net").cast("double").alias("net"), label)
    return picked.groupBy("series_id", "scheme").applyInPandas(run, f"series_id {_type(net)}, scheme string, {fields}")


def regime_rows(net: DataFrame) -> DataFrame:
    """net with a row for each calendar scheme: part_of_week, day_of_week, and session where the series has stamps within a day."""
    intraday = F.bool_or(F.hour("ts") != 0).over(W.partitionBy("series_id"))
    session = F.when(F.hour("ts") < 8, "asia").when(F.hour("ts") < 16, "europe").otherwise("us")
    both = F.array(F.struct(F.lit("part_of_week").alias("scheme"), F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday").alias("label")), F.struct(F.lit("day_of_week").alias("scheme"), F.date_format("ts", "EEE").alias("label")))
    return net.withColumn("__i", intraday).select("*", F.inline(F.when(F.col("__i"), F.concat(both, F.array(F.struct(F.lit("session").alias("scheme"), session.alias("label"))))).otherwise(both))).drop("__i")


def regime_adherence(net: DataFrame, declared: DataFrame, least: int = 8, share: float = 0.6) -> DataFrame:
    """series_id, trade_share, declared_edge, top_label, adheres: whether a claim's declared regime has `least` trades, `share` of them, and most of the result.

    net: series_id, scheme, label, net. declared: series_id, scheme, label; a scheme that the series hasn't doesn't adhere.
    """
    low = lambda c: F.lower(F.trim(c))
    want = declared.select("series_id", low("scheme").alias("scheme"), low("label").alias("want"))
    rows = net.filter("net is not null").withColumns({"scheme": low("scheme"), "label": low("label")}).join(want, ["series_id", "scheme"])
    g = rows.groupBy("series_id", "want", "label").agg(F.count("*").alias("n"), F.sum("net").alias("t"))
    is_it = F.col("label") == F.col("want")
    out = g.groupBy("series_id", "want").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(is_it, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(is_it, F.col("t"))), F.lit(0.0)).alias("declared_edge"), F.max_by("label", F.struct(F.round("t", 12), "label")).alias("top_label"))
    out = want.select("series_id", "want").join(out, ["series_id", "want"], "left")
    adheres = (F.col("n") >= least) & (F.col("n") / F.col("all") >= share) & (F.col("top_label") == F.col("want"))
    return out.select("series_id", F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)).alias("trade_share"), F.coalesce("declared_edge", F.lit(0.0)).alias("declared_edge"), "top_label", F.coalesce(adheres, F.lit(False)).alias("adheres"))


def cost_sensitivity(net: DataFrame, deflation: DataFrame, cost: float, per_year: float = 252, reps: int = 200, least: int = 30, steps: int = 10) -> DataFrame:
    """series_id, breakeven, margin: the first cost of a grid of `steps` steps from the configured one on at which the deflated score of the middle part
    is under 0.9 or its bootstrap interval holds zero; null if none is. deflation: series_id, bench (the score's benchmark)."""
    from math import erf

    step = cost if cost > 0 else 0.0005
    grid = [round(step * i, 10) for i in range(steps + 1) if step * i >= cost - 1e-12]
    j = net.join(deflation.select("series_id", "bench"), "series_id").withColumn("position", F.coalesce("position", F.lit(0.0)))

    def score(x: np.ndarray, bench: float) -> float:
        n, sd = len(x), x.std(ddof=1)
        if sd <= 0:
            return 0.0
        z, sr = (x - x.mean()) / x.std(), x.mean() / sd
        g3 = (z**3).mean() * (n * (n - 1)) ** 0.5 / (n - 2)
        g4 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((z**4).mean() - 3) + 6) + 3
        return 0.5 * (1 + erf((sr - bench) * (n - 1) ** 0.5 / max(1e-12, 1 - g3 * sr + (g4 - 1) / 4 * sr**2) ** 0.5 / 2**0.5))

    def make(series, x: np.ndarray, position: np.ndarray, bench: np.ndarray):
        if len(x) < least:
            return None
        turn = np.abs(np.diff(position, prepend=0.0))
        a, b = int(len(x) * 0.5), int(len(x) * 0.8)
        for c in grid:
            oos = (x - turn * max(0.0, c - cost))[a:b]
            if len(oos) < 20:
                continue
            drawn = oos[stationary(generator(series, "cost"), len(oos), max(1, round(len(oos) ** 0.5)), reps)].mean(1)
            lo, hi = np.percentile(drawn, [5, 95])
            if score(oos, float(bench[0])) < 0.9 or lo <= 0 <= hi:
                return c, (round(c / cost, 4) if cost > 0 else None)
        return None, None

    return _by_series(j, ("net", "position", "bench"), "breakeven double, margin double", make)


def param_grid(specs: DataFrame, most: int = 24, ceiling: int = 10_000) -> DataFrame:
    """claim, config (JSON, keys in order), total: the combinations of each claim's parameters, or the `most` of them with the least SHA-256.

    specs: claim, params (a map of name to an array of texts). A claim's grid is built name by name inside its row; grids of over `ceiling`
    combinations are refused.
    """
    start = F.array(F.lit(""))
    keys = F.array_sort(F.map_keys("params"))
    one = lambda acc, k: F.flatten(F.transform(acc, lambda left: F.transform(F.element_at("params", k), lambda v: F.concat(left, F.when(left == "", "").otherwise(","), F.lit('"'), k, F.lit('":"'), v, F.lit('"')))))
    total = F.aggregate(F.map_values("params"), F.lit(1).cast("long"), lambda acc, v: acc * F.size(v))
    ok = specs.filter(F.size("params") > 0).withColumn("total", total).filter((F.col("total") > 0) & (F.col("total") <= ceiling))
    each = ok.select("claim", "total", F.explode(F.transform(F.aggregate(keys, start, one), lambda c: F.concat(F.lit("{"), c, F.lit("}")))).alias("config"))
    k = F.row_number().over(W.partitionBy("claim").orderBy(F.sha2(F.concat(F.lit("0:"), "config"), 256), "config"))
    return each.withColumn("k", k).filter(F.col("k") <= most).select("claim", "config", "total")


def parameter_fragility(nets: DataFrame, least: float = 0.5, least_configs: int = 4) -> DataFrame:
    """claim, configs, positive_share, fragile: over a claim's configurations, how many have a positive mean in the rows from 50 to 80 %.

    nets: claim, config, seq, net. Under four configurations, or all with one outcome, the gate doesn't run.
    """
    w = W.partitionBy("claim", "config")
    rows = nets.filter("net is not null").withColumns({"k": F.row_number().over(w.orderBy("seq")), "n": F.count("*").over(w)})
    mid = rows.filter((F.col("k") > F.floor(F.col("n") * 0.5)) & (F.col("k") <= F.floor(F.col("n") * 0.8)))
    edge = mid.groupBy("claim", "config").agg(F.avg("net").alias("edge"))
    g = edge.groupBy("claim").agg(F.count("*").alias("configs"), F.avg(F.expr("int(edge > 0)")).alias("positive_share"), F.count_distinct(F.round("edge", 12)).alias("kinds"))
    ran = (F.col("configs") >= least_configs) & (F.col("kinds") > 1)
    return g.select("claim", "configs", "positive_share", F.when(ran, F.col("positive_share") < least).alias("fragile"))


def holdout_once(requests: DataFrame, burned: DataFrame, scores: DataFrame) -> DataFrame:
    """claim, status, holdout_sharpe, holdout_psr: the holdout's scores for claims that haven't seen theirs, and a refusal for the others.

    A claim that asks twice is answered once. Append the answered claims to `burned` before the answers are used.
    """
    one = requests.select("claim").distinct().join(burned.select("claim").distinct().withColumn("used", F.lit(True)), "claim", "left")
    j = one.join(scores.select(F.col("series_id").alias("claim"), "holdout_sharpe", "holdout_psr"), "claim", "left")
    free = F.col("used").isNull()
    status = F.when(~free, "refused").when(F.col("holdout_psr").isNull(), "too_small").otherwise("evaluated")
    return j.select("claim", status.alias("status"), F.when(free, F.col("holdout_sharpe")).alias("holdout_sharpe"), F.when(free, F.col("holdout_psr")).alias("holdout_psr"))
