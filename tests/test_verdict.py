"""The decision over joined rows against the same rules one after another, and over the gates themselves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from refspark.operators import scores
from refspark.operators import verdicts as v
from refspark.plans import registry

NOT_TRADES = {"predictive_regression", "factor_spanning", "cross_sectional_sort", "event_study", "forecast_skill"}
BASE = {"n_oos": 100, "consistent": True, "dsr": 0.99, "edge_t": 3.0, "holdout_sharpe": 1.0, "holdout_psr": 0.95, "min_fold_t": 0.5, "sufficient": True, "costs_measured": True, "claim_type": "trading_strategy"}


def plain(r, cost_gate):
    """verdict, kill reason and reasons of one row."""
    kind, reasons = r["claim_type"] or "trading_strategy", []
    trades = kind not in NOT_TRADES
    dsr, t = r["dsr"] or 0.0, r["edge_t"] or 0.0
    if r["n_oos"] < 30:
        verdict, why = "insufficient_data", "data_unavailable"
    elif not r["consistent"]:
        verdict, why = "kill", "in_sample_only"
    elif dsr < 0.90:
        verdict, why = "kill", "no_oos_edge"
    elif t < 1.0:
        verdict, why = "kill", "low_edge_t"
    elif dsr < 0.95:
        verdict, why = "watch", None
    elif (r["holdout_sharpe"] or 0) > 0 and (r["holdout_psr"] or 0) >= 0.90:
        verdict, why = "research-supported", None
    else:
        verdict, why = "watch", None
    alive = lambda: verdict in ("watch", "research-supported")
    if alive():
        gates = [
            (r["adheres"] is False, "regime_mismatch"), (r["regime_fragile"], "regime_fragile"), (r["includes_zero"], "edge_ci_zero"), (r["permutation_p"] is not None and r["permutation_p"] > 0.10, "no_signal_alignment"),
            (r["walk_forward_consistent"] is False, "walk_forward_drift"), (r["cpcv_overfit"], "overfit_cpcv"), (r["parameter_fragile"], "parameter_fragile"),
        ]
        for hit, name in gates:
            if hit:
                verdict, why = "kill", name
                break
    if why:
        reasons.append(why)
    top, lives = verdict == "research-supported", alive()
    if r["tail_asymmetric"] and trades:
        reasons.append("tail_asymmetric")
    if top and trades and not r["costs_measured"]:
        reasons.append("costs_modelled")
    if top and r["unanchored"]:
        reasons.append("no_external_anchor")
    if lives and (kind in ("provided_series_statistic", "cross_sectional_sort", "event_study", "forecast_skill") or kind == "factor_spanning" and r["strategy_framed"]):
        reasons.append("capped_claim_type")
    if lives and r["external"] and (r["post_years"] is None or r["post_years"] < 1.0):
        reasons.append("no_post_sample_data")
    if top and reasons:
        verdict = "watch"
    if cost_gate and alive() and trades and r["cost_margin"] is not None and r["cost_margin"] < 1.5:
        if verdict == "research-supported":
            verdict = "watch"
        else:
            verdict, why = "kill", "cost_sensitive"
            reasons.insert(0, why)
    power = r["fold_power"]
    open_folds = why == "in_sample_only" and not (r["min_fold_t"] is not None and r["min_fold_t"] <= -1.0) and (power is None or power < 0.60)
    if verdict == "kill" and (why in ("no_oos_edge", "edge_ci_zero", "overfit_cpcv", "low_edge_t") and not r["sufficient"] or open_folds):
        verdict, why = "underpowered", "below_detection_floor"
        reasons.append(why)
    if r["implausible"] and kind not in ("provided_series_statistic", "descriptive_statistical", "structural_proposition"):
        verdict, why = "needs_review", None
        reasons.append(r["implausible"])
    return verdict, why, reasons


FIELDS = {"n_oos": "long", "consistent": "boolean", "dsr": "double", "edge_t": "double", "holdout_sharpe": "double", "holdout_psr": "double", "min_fold_t": "double", "sufficient": "boolean"} | v.GATES


def frame(spark, rows):
    names = ["series_id", *FIELDS]
    return spark.createDataFrame([tuple([k, *[r.get(c) for c in FIELDS]]) for k, r in enumerate(rows)], ", ".join(f"{c} {FIELDS.get(c, 'long')}" for c in names))


@pytest.mark.parametrize("cost_gate", [False, True])
def test_decision_against_the_rules_one_by_one(spark, cost_gate):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    rows = []
    for _ in range(4000):
        r = {c: None for c in FIELDS} | {k: x for k, x in BASE.items()}
        for c, kind in FIELDS.items():
            if rng.random() < 0.3 and kind == "boolean":
                r[c] = some(True, False) if c in ("consistent", "sufficient") else some(True, False, None)
        for c, xs in {"n_oos": (5, 29, 30, 400), "dsr": (None, 0.89, 0.9, 0.94, 0.95, 1.0), "edge_t": (None, 0.99, 1.0, 5.0), "holdout_sharpe": (None, -1.0, 0.0, 2.0), "holdout_psr": (None, 0.5, 0.9, 1.0), "min_fold_t": (None, -2.0, -1.0, -0.9, 3.0)}.items():
            if rng.random() < 0.25:
                r[c] = some(*xs)
        for c, xs in {"permutation_p": (0.01, 0.1, 0.11), "post_years": (None, 0.5, 1.0, 4.0), "cost_margin": (None, 1.0, 1.5, 3.0), "fold_power": (None, 0.2, 0.6, 0.9), "implausible": (None, None, "implausible_sharpe", "degenerate_series"), "claim_type": (None, *NOT_TRADES, "provided_series_statistic", "structural_proposition", "formulaic_signal")}.items():
            if rng.random() < 0.3:
                r[c] = some(*xs)
        rows.append(r)
    got = {x.series_id: (x.verdict, x.kill_reason, x.reasons) for x in v.decide(frame(spark, rows), cost_gate).collect()}
    want = {k: plain(r, cost_gate) for k, r in enumerate(rows)}
    assert got == want
    assert len({(a, b) for a, b, _ in want.values()}) >= (16 if cost_gate else 15)


PLANTED = {
    "none": ({}, "research-supported", None), "regime": ({"adheres": False}, "kill", "regime_mismatch"), "fragile": ({"regime_fragile": True}, "kill", "regime_fragile"), "zero": ({"includes_zero": True}, "kill", "edge_ci_zero"),
    "shuffled": ({"permutation_p": 0.5}, "kill", "no_signal_alignment"), "drift": ({"walk_forward_consistent": False}, "kill", "walk_forward_drift"), "overfit": ({"cpcv_overfit": True}, "kill", "overfit_cpcv"),
    "parameters": ({"parameter_fragile": True}, "kill", "parameter_fragile"), "tail": ({"tail_asymmetric": True}, "watch", None), "modelled": ({"costs_measured": False}, "watch", None), "generated": ({"unanchored": True}, "watch", None),
    "kind": ({"claim_type": "event_study"}, "watch", None), "framed": ({"claim_type": "factor_spanning", "strategy_framed": True}, "watch", None), "sample": ({"external": True, "post_years": 0.2}, "watch", None), "margin": ({"cost_margin": 1.2}, "watch", None),
    "thin": ({"cost_margin": 1.2, "dsr": 0.92}, "kill", "cost_sensitive"), "odd": ({"implausible": "implausible_sharpe"}, "needs_review", None), "few": ({"n_oos": 10}, "insufficient_data", "data_unavailable"), "weak": ({"dsr": 0.5, "sufficient": False}, "underpowered", "below_detection_floor"),
    "folds": ({"consistent": False, "fold_power": 0.59}, "underpowered", "below_detection_floor"), "power": ({"consistent": False, "fold_power": 0.6}, "kill", "in_sample_only"), "deep": ({"consistent": False, "min_fold_t": -1.0}, "kill", "in_sample_only"),
}


def test_each_gate_flips_its_series_and_says_why(spark):
    rows = [BASE | change for change, _, _ in PLANTED.values()]
    decided = v.decide(frame(spark, rows).withColumns({c: F.lit(None).cast("double") for c in ("fold_1", "fold_2", "fold_3", "n_trials", "mde", "oos_sharpe")}).withColumn("needed_bars", F.lit(1083).cast("long")), cost_gate=True)
    got = {r.series_id: r for r in v.rationale(decided).collect()}
    for k, (name, (_, verdict, why)) in enumerate(PLANTED.items()):
        assert (got[k].verdict, got[k].kill_reason) == (verdict, why), name
        sentences = [s for s in got[k].rationale.split(". ") if s]
        assert len(sentences) >= len(got[k].reasons) and "None" not in got[k].rationale and not any(r in got[k].rationale for r in got[k].reasons), name
    assert got[0].rationale == "Its capacity can't be told."


def test_fold_power_of_declared_sizes(spark):
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    r = spark.sql("select 100L a, 400L b, 4L c").select(v.fold_power(["a", "b", "a"]).alias("p"), v.fold_power(["a", "b", "c"]).alias("few")).first()
    assert r.p == pytest.approx(phi(scores.IC_FLOOR * 10) ** 2 * phi(scores.IC_FLOOR * 20), rel=1e-7) and r.few is None


def test_all_gates_over_the_table(spark):
    """Every gate has run on the series, and the verdicts are those of the rules over what they found."""
    sf = "/root/testdata/sf0.01"
    from refspark.plans import verdict_plans as plans

    joined = plans.all_gates(spark, sf).cache()
    rows = [r.asDict() for r in joined.collect()]
    filled = {c for c in v.GATES if any(r[c] is not None for r in rows)}
    assert filled == set(v.GATES)
    for c in ("adheres", "includes_zero", "walk_forward_consistent", "parameter_fragile", "unanchored", "external", "costs_measured", "strategy_framed"):
        assert {r[c] for r in rows} >= {True, False}, c
    decided = {r.series_id: (r.verdict, r.kill_reason, r.reasons) for r in v.decide(joined, cost_gate=True).collect()}
    assert decided == {r["series_id"]: plain(r, True) for r in rows} and len(rows) == len(decided)
    report = {r.series_id: r for r in registry.queries()["g14_g15_claim_report"](spark, sf).collect()}
    assert {k: (r.verdict, r.kill_reason, r.reasons.split("; ") if r.reasons else []) for k, r in report.items()} == decided
    assert all(r.rationale for r in report.values())
    joined.unpersist()


def test_report_asks_the_gates_only_about_whom_they_can_touch(spark, monkeypatch):
    """The same report as from all gates on all series, and the bootstrap is given only the series that it can touch."""
    sf = "/root/testdata/sf0.01"
    from refspark.operators import gates
    from refspark.plans import verdict_plans as plans

    given, bootstrap = [], gates.block_bootstrap
    monkeypatch.setattr(gates, "block_bootstrap", lambda net, *a, **k: given.append({r.series_id for r in net.select("series_id").distinct().collect()}) or bootstrap(net, *a, **k))
    every = v.decide(plans.all_gates(spark, sf), cost_gate=True)
    want = {r.series_id: r for r in v.claim_report(v.rationale(every)).collect()}
    got = {r.series_id: r for r in plans.full_gates(spark, sf).collect()}
    assert got == want and len(given) == 2
    touched = {r.series_id for r in every.filter(v.in_bands()).collect()}
    assert given[0] == set(want) and given[1] == touched and 0 < len(touched) < len(want)
