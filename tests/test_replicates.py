"""The resampling gates against brute force with their own draws, replicate by replicate."""

import numpy as np
import pytest

from refspark.operators import gates as g

rng = np.random.default_rng(3)
NET = {1: rng.normal(0.4, 1, 120), 2: rng.normal(0, 1, 90), "thin": rng.normal(0, 1, 9)}
NET[2] -= NET[2].mean() - 0.01
SIDE = {k: np.sign(rng.normal(0, 1, len(x))) for k, x in NET.items()}


@pytest.fixture(scope="module")
def rows(spark):
    out = [(str(s), k, float(x), float(SIDE[s][k]), float(x * SIDE[s][k])) for s, xs in NET.items() for k, x in enumerate(xs)]
    out += [("1", 900, None, None, None), ("1", 901, float("nan"), 0.0, None), ("lone", 0, 1.0, 1.0, 1.0), ("flat", 0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(out, "series_id string, seq long, net double, position double, payoff double").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(seq)) ts", "net as ret").repartition(3)


def test_stationary_blocks_follow_their_rule():
    at = g.stationary(np.random.default_rng(1), 50, 7, 400)
    follows = at[:, 1:] == (at[:, :-1] + 1) % 50
    assert at.min() == 0 and at.max() == 49 and abs(follows.mean() - (1 - 1 / 7 + 1 / 350)) < 0.01
    assert abs(np.bincount(at.ravel(), minlength=50).std() / 400) < 0.2


def test_block_bootstrap(rows):
    got = {r.series_id: r for r in g.block_bootstrap(rows, 300).collect()}
    assert got.keys() == {"1", "2"}
    for s in (1, 2):
        x, means, downs, sharpes = NET[s], [], [], []
        for places in g.stationary(g.generator(str(s), "bootstrap"), len(x), round(len(x) ** 0.5), 300).tolist():
            drawn = [x[i] for i in places]
            means.append(sum(drawn) / len(drawn))
            sharpes.append(means[-1] / np.std(drawn, ddof=1) * 252**0.5)
            total, peak, down = 0.0, -np.inf, 0.0
            for v in drawn:
                total += v
                peak = max(peak, total)
                down = max(down, peak - total)
            downs.append(down)
        r = got[str(s)]
        assert [r.edge_lo, r.edge_hi] == pytest.approx(np.percentile(means, [5, 95]))
        assert [r.sharpe_lo, r.sharpe_hi] == pytest.approx(np.percentile(sharpes, [5, 95]))
        assert (r.drawdown_median, r.drawdown_p95) == pytest.approx((np.median(downs), np.percentile(downs, 95)))
        assert r.p_positive == pytest.approx(np.mean(np.array(means) > 0)) and r.includes_zero == (r.edge_lo <= 0 <= r.edge_hi)
    assert not got["1"].includes_zero and got["2"].includes_zero


def test_permutation_test(rows):
    got = {r.series_id: r for r in g.permutation_test(rows, 300).collect()}
    for s in (1, 2):
        side, pay = SIDE[s], NET[s] * SIDE[s]
        seen = float((side * pay).mean())
        null = [float((p * side).mean()) for p in g.generator(str(s), "permutation").permuted(np.broadcast_to(pay, (300, len(pay))), axis=1)]
        assert got[str(s)].observed == pytest.approx(seen)
        assert got[str(s)].p == pytest.approx((1 + sum(m >= seen - 1e-12 for m in null)) / 301)
    assert g.permutation_test(rows.limit(0), 10).count() == 0


def test_capacity_and_costs(rows, spark):
    got = {r.series_id: r for r in g.capacity_ci(rows, 200).collect()}
    x, side = NET[1], SIDE[1]
    turn = np.abs(np.diff(side)).sum() / len(x)
    means = [x[p].mean() for p in g.stationary(g.generator("1", "capacity"), len(x), round(len(x) ** 0.5), 200)]
    caps = [m * 252 / (turn * 252 * 25 / 1e4 / 1e6) for m in means if m > 0]
    assert (got["1"].capacity_lo, got["1"].capacity_hi) == pytest.approx([round(v, -3) for v in np.percentile(caps, [5, 95])])
    assert got["1"].p_positive == pytest.approx(len(caps) / 200, abs=1e-3) and got["2"].conditional
    bench = spark.createDataFrame([("1", 0.0), ("2", 0.0)], "series_id string, bench double")
    strong = rows.withColumn("net", rows.net + 3)
    assert {r.series_id: r.breakeven for r in g.cost_sensitivity(strong, bench, 0.001).collect()} == {"1": None, "2": None}
    assert {r.breakeven for r in g.cost_sensitivity(rows.withColumn("net", rows.net - 3), bench, 0.001).collect()} == {0.001}
    thin = g.cost_sensitivity(rows.withColumn("net", rows.net + 3), bench, 2.0).filter("breakeven is not null").collect()
    assert thin and all(r.margin == pytest.approx(r.breakeven / 2.0) for r in thin)


def test_sign_flips(rows):
    got = {(r.series_id, r.block): r for r in g.sign_flip_null(rows, (1, 6), 200).collect()}
    x = NET[2]
    for block in (1, 6):
        signs = g.generator("2", f"flip{block}").integers(0, 2, (200, -(-len(x) // block))) * 2.0 - 1
        means = []
        for row in signs.tolist():
            flipped = [v * row[k // block] for k, v in enumerate(x.tolist())]
            means.append(np.mean([np.sign(a) * b for a, b in zip(flipped, flipped[1:], strict=False)]))
        assert got["2", block].mean == pytest.approx(np.mean(means)) and got["2", block].p95 == pytest.approx(np.percentile(means, 95))


def test_regime_gate_finds_the_planted_regime(spark):
    r = np.random.default_rng(9)
    out = []
    for k in range(210):
        weekend = k % 7 in (5, 6)
        out.append(("week", k, float(r.normal(3 if weekend else 0, 0.5))))
        out.append(("even", k, float(r.normal(1, 0.5))))
    df = spark.createDataFrame(out, "series_id string, seq long, net double").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(seq)) ts")
    got = {(x.series_id, x.scheme): x for x in g.regime_gate(df).collect()}
    assert got["week", "part_of_week"].fragile and got["week", "part_of_week"].best == "weekend" and got["week", "part_of_week"].p < 0.05
    assert not got["even", "part_of_week"].fragile
    exempt = {(x.series_id, x.scheme): x.fragile for x in g.regime_gate(df, declared="part_of_week=weekend").collect()}
    assert not exempt["week", "part_of_week"]


def test_blocks_are_the_stationary_draws():
    """the bootstraps work on blocks; their draws, sums and drawdowns are those of the places drawn one by one."""
    for n, reps, block in ((1, 3, 1), (10, 40, 3), (700, 300, 26), (70_000, 3, 264)):
        x = np.random.default_rng(n).normal(0.1, 1, n)
        places = g.stationary(g.generator(n, "t"), n, block, reps)
        row, start, size = g._blocks(g.generator(n, "t"), n, block, reps)
        assert np.array_equal(np.repeat(start - np.cumsum(size) + size, size) % n, (places.ravel() - np.arange(n * reps)) % n)
        drawn, circle = x[places], g._Circle(x)
        total = np.cumsum(drawn, axis=1)
        assert np.allclose(circle.drawdowns(row, start, size, reps), (np.maximum.accumulate(total, axis=1) - total).max(1), atol=1e-8)
        assert np.allclose(np.bincount(row, circle.sums(start, size)[0]) / n + circle.shift, drawn.mean(1))
        assert len(row) < max(n * reps, 2) or block == 1
