"""No operator ends a job over one row: zeros, nulls, NaN, infinities, a series of one row, repeated rows, an empty table, a clashing column."""

import pytest
from pyspark.sql import functions as F

from refspark.operators import claims, corpus, evidence, executors, gates, markets, receipts, records, reserve, scores, series, verdicts

ROWS = [("zero", k, float(k % 3), 0.0, 0.0) for k in range(50)] + [("one", 0, 1.0, 1.0, 1.0)] + [("null", k, None, None, None) for k in range(3)]
ROWS += [("odd", 0, float("nan"), 1.0, 1.0), ("odd", 1, float("inf"), 1.0, 1.0), ("odd", 2, 1.0, -1.0, 1.0)] + [("flat", k, 2.0, 1.0, 1.0) for k in range(50)] + [("zero", 7, 1.0, 0.0, 0.0)] * 2


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, "series_id string, seq long, value double, position double, payoff double")
    return df.selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(seq)) ts", "value / 100 as net", "'f' as family", "value as ret", "1 as n", "2 as k", "'x' as part", "value as signal", "value as rv", "value as iv", "value as fut_rv", "value as m").cache()


SERIES = {
    "clean": lambda t: series.clean_series(t, "seq"), "coverage": series.coverage, "per_year": series.observations_per_year, "bpy": series.infer_bpy, "ohlc": lambda t: series.resample_ohlc(t, "seq"),
    "features": series.features, "lagged": series.lagged, "benchmarks": series.benchmarks, "regimes": series.regimes, "equity": series.equity_curve, "pnl": series.lagged_pnl, "carry": series.funding_carry,
    "availability": lambda t: series.availability(t, "2024-01-01", "2024-02-01"), "rebalance": series.rebalance_dates, "ols": lambda t: series.ols_single(t, "value", "net", ("series_id",)),
    "align": lambda t: series.align_lead(t.selectExpr("series_id", "ts", "value x"), t.selectExpr("series_id", "ts", "net y"), 2),
    "regression": lambda t: claims.predictive_regression(series.align_lead(t.selectExpr("series_id", "ts", "value x"), t.selectExpr("series_id", "ts", "net y"), 2), ("series_id",)),
    "signal": lambda t: claims.signal_pnl(t, F.col("value")), "vol_regime": claims.vol_regime, "skill": lambda t: claims.forecast_skill(t, F.col("value")), "forward": claims.walk_forward, "rolling": lambda t: claims.walk_forward(t, rolling=True),
    "best": lambda t: claims.best_of_k(t.withColumn("series_id", F.crc32("series_id"))), "timing": executors.vol_timing, "many": lambda t: executors.ols_multi(t, "net", ("value", "position")),
    "spanning": lambda t: executors.factor_spanning(t, "net", ("position",)), "events": lambda t: executors.event_study(t.select("series_id", "ts", "ret"), t.select("series_id", F.col("ts").alias("event_ts"))),
    "shares": lambda t: executors.verdict_shares(t.withColumn("verdict", F.lit("watch")), "series_id"),
    "split": scores.score_split, "folds": scores.three_fold, "drawdown": scores.max_drawdown, "tail": scores.tail_metrics, "turnover": scores.turnover, "referee": scores.referee, "decide": lambda t: verdicts.decide(scores.referee(t).drop("verdict", "kill_reason")),
    "bootstrap": lambda t: gates.block_bootstrap(t, 20), "permutation": lambda t: gates.permutation_test(t, 20), "capacity": lambda t: gates.capacity_ci(t, 20), "flips": lambda t: gates.sign_flip_null(t, (1, 6), 20), "cpcv": gates.cpcv,
    "pbo": gates.pbo, "regime_gate": lambda t: gates.regime_gate(t.drop("label"), reps=20), "costs": lambda t: gates.cost_sensitivity(t, t.select("series_id").distinct().withColumn("bench", F.lit(0.0)), 0.001, reps=20),
    "fragility": lambda t: gates.parameter_fragility(t.selectExpr("series_id claim", "position config", "seq", "net")), "merkle": receipts.merkle_root, "fingerprint": records.fingerprint,
    "lookahead": lambda t: reserve.lookahead_diff(t, t), "probability": lambda t: t.select(markets.bracket_probability("value", "position", "0e0", "1e0")), "implausible": lambda t: t.select(reserve.implausible(F.col("value"), F.col("net"), F.col("position"))),
}


@pytest.mark.parametrize("name", sorted(SERIES))
def test_odd_rows(table, name):
    rows = SERIES[name](table).collect()
    assert SERIES[name](table.limit(0)).collect() is not None
    assert isinstance(rows, list)


def test_zero_and_null_have_a_defined_result(table, spark):
    got = {(r.series_id, r.seq): r for r in series.lagged(table.filter("series_id = 'zero' and seq < 6")).collect()}
    assert got["zero", 1].pct_change is None and got["zero", 2].pct_change == 1.0
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8]), (4, None)], "vec_id long, embedding array<double>")
    near = {r.vec_id: (r.best_id, r.cosine, r.status) for r in records.nearest_vectors(v, v).collect()}
    assert near[0] == (2, 1.0, "duplicate") and near[3] == (0, 0.6, "novel") and near[1][1:] == (0.0, "novel") and near[4][1] == 0.0
    assert records.nearest_vectors(v.limit(0), v).count() == 0
    p = spark.range(1).select(markets.bracket_probability("0e0", "0e0", "-1e0", "1e0").alias("a"), markets.bracket_probability("0e0", "1e0", "-1e0", "1e0").alias("b")).first()
    assert p.a is None and abs(p.b - 0.682689) < 1e-6


def test_event_study_against_a_loop(spark):
    import random

    rng = random.Random(4)
    rets = [None if k in (40, 90) else rng.gauss(0, 1) for k in range(200)]
    days = sorted(rng.sample(range(-5, 205), 45))
    stamp = "timestamp'2024-01-01' + make_interval(0, 0, 0, int(k))"
    r = spark.createDataFrame([("a", k, x) for k, x in enumerate(rets)], "series_id string, k int, ret double").selectExpr("series_id", f"{stamp} ts", "ret", "k")
    e = spark.createDataFrame([("a", k) for k in days], "series_id string, k int").selectExpr("series_id", f"{stamp} event_ts", "k")
    got = {row.k: row for row in executors.event_study(r.drop("k"), e.drop("k"), (-2, 2), 15).join(e, ["series_id", "event_ts"]).collect()}
    last = None
    for d in days:
        start, end = max(d, 0) - 2, max(d, 0) + 2
        est = range(start - 15, start)
        why = None
        if d >= 200 or start < 0 or end >= 200:
            why = "event_window_out_of_range"
        elif last is not None and start <= last:
            why = "overlaps_prior_event_window"
        elif start - 15 < 0:
            why = "insufficient_pre_event_estimation_window"
        elif last is not None and est[0] <= last:
            why = "estimation_window_overlaps_prior_event_window"
        elif any(rets[k] is None for k in est):
            why = "incomplete_pre_event_estimation_window"
        elif any(rets[k] is None for k in range(start, end + 1)):
            why = "incomplete_event_window"
        assert got[d].skipped == why, d
        if why is None:
            mean = sum(rets[k] for k in est) / 15
            assert abs(got[d].car - (sum(rets[start : end + 1]) - 5 * mean)) < 1e-9
            last = end


def test_every_kill_reason_is_reached(spark):
    good = dict(n_oos=2000, consistent=True, min_fold_t=1.0, dsr=0.99, edge_t=4.0, holdout_sharpe=1.0, holdout_psr=0.99, sufficient=True, costs_measured=True)
    cases = {
        "research-supported:None": {}, "insufficient_data:data_unavailable": {"n_oos": 10}, "kill:in_sample_only": {"consistent": False, "min_fold_t": -2.0}, "kill:no_oos_edge": {"dsr": 0.5}, "kill:low_edge_t": {"edge_t": 0.5},
        "watch:None": {"holdout_psr": 0.5}, "kill:regime_mismatch": {"adheres": False}, "kill:regime_fragile": {"regime_fragile": True}, "kill:edge_ci_zero": {"includes_zero": True}, "kill:no_signal_alignment": {"permutation_p": 0.3},
        "kill:walk_forward_drift": {"walk_forward_consistent": False}, "kill:overfit_cpcv": {"cpcv_overfit": True}, "kill:parameter_fragile": {"parameter_fragile": True}, "underpowered:below_detection_floor": {"dsr": 0.5, "sufficient": False},
        "needs_review:None": {"implausible": "degenerate_series"},
    }
    kinds = {"n_oos": "long", "consistent": "boolean", "min_fold_t": "double", "dsr": "double", "edge_t": "double", "holdout_sharpe": "double", "holdout_psr": "double", "sufficient": "boolean"} | verdicts.GATES
    rows = [(name, *[({**good, **case}).get(c) for c in kinds]) for name, case in cases.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in {"series_id": "string", **kinds}.items()))
    for r in verdicts.decide(df).collect():
        assert f"{r.verdict}:{r.kill_reason}" == r.series_id
    capped = {"tail_asymmetric": {"tail_asymmetric": True}, "costs_modelled": {"costs_measured": None}, "no_external_anchor": {"unanchored": True}, "capped_claim_type": {"claim_type": "event_study"}, "no_post_sample_data": {"external": True}}
    rows = [(name, *[({**good, **case}).get(c) for c in kinds]) for name, case in capped.items()]
    for r in verdicts.decide(spark.createDataFrame(rows, df.schema)).collect():
        assert r.verdict == "watch" and r.reasons == [r.series_id]
    soft = spark.createDataFrame([("x", *[({**good, "consistent": False}).get(c) for c in kinds])], df.schema)
    assert verdicts.decide(soft).first().verdict == "underpowered"


def test_principles_support_each_kill_once(spark):
    rows = [(k, k, "r", "d", ["a", "b"], "single", 2024) for k in range(5)] + [(10 + k, k, "r", "d", ["a", f"x{k}"], f"m{k}", 2022) for k in range(4)] + [(20 + k, k, "r", "d", ["c", f"y{k}"], "overlay", None) for k in range(3)]
    rows += [(30 + k, k, "r", "macro", None, None, 2026) for k in range(3)] + [(0, 99, "r", "d", ["a", "b"], "single", 2024)]
    df = spark.createDataFrame(rows, "claim_id long, at long, kill_reason string, domain string, components array<string>, method string, year int")
    got = {(r.level, r.label): (r.n, r.newest, r.confidence) for r in corpus.principles(df, year=2026).collect()}
    assert got == {("exact", "a+b::single"): (5, 2024, 0.354), ("method", "overlay"): (3, 2026, 0.5), ("component", "a"): (4, 2022, 0.25), ("domain", "macro"): (3, 2026, 0.5)}


def test_failures_that_differ_in_detail_have_one_signature(spark):
    said = ["Job 3f2504e0-4f89-11d3-9a0c-0305e82c3301 at 2024-01-02T03:04:05: in '/tmp/a' took 12.5% of 0xAF", "job 00000000-4f89-11d3-9a0c-0305e82c3301 at 2025-11-12: in 'x' took -3 of 0x1", "", None]
    df = spark.createDataFrame([(s,) for s in said], "reason string")
    got = [r[0] for r in df.select(evidence.normalize_failure(F.col("reason"))).collect()]
    assert got == ["job <uuid> at <time>: in <q> took <num> of <hex>"] * 2 + ["unspecified failure"] * 2


def test_a_changed_payload_breaks_the_chain(spark):
    rows = spark.createDataFrame([("a", k, f"p{k}") for k in range(6)] + [("b", 0, "q")], "run string, seq long, payload string")
    built = rows.selectExpr("run", "seq", "sha2(payload, 256) payload").join(receipts.build_chain(rows), ["run", "seq"])
    whole = {r.run: r.broken_seq for r in receipts.verify_chain(built).collect()}
    assert whole == {"a": None, "b": None}
    changed = built.withColumn("payload", F.when(F.col("seq") == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("payload")))
    assert {r.run: r.broken_seq for r in receipts.verify_chain(changed).collect()} == {"a": 3, "b": None}
    assert {r.run: r.broken_seq for r in receipts.verify_chain(built.filter("seq <> 2")).collect()}["a"] == 2
