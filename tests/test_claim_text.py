"""Claim types, parameters and specifications: against plain regular expressions, and over odd inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from refspark.operators import claimtext as t
from refspark.operators import specs as p
from refspark.plans import text_plans as plans


def has(cue, text):
    return sum(bool(re.search(w, text)) for w in t.CUES[cue])


def plain(claim, source):
    """The decision, one after another."""
    c = claim.lower()
    both = c + " " + source.lower()
    if not c.strip():
        return "trading_strategy"
    if has("venue", both) and has("bracket", both) and has("pricing", c):
        return "event_market_strategy"
    framed = has("strategy", c)
    if not framed and has("timing", c) and has("abnormal", c) and has("window", c):
        return "event_study"
    if has("alpha", c) and has("control", c) and has("factors", c):
        return "factor_spanning"
    if has("sort", c) and has("spread", c) and has("characteristic", c):
        return "cross_sectional_sort"
    if not framed and has("model", c) and has("accuracy", c) and has("rival", c) and has("unseen", c):
        return "forecast_skill"
    if not framed and has("direction", c) and has("regression", c) and has("horizon", c):
        return "predictive_regression"
    if has("formula", c) and has("trade_series", c):
        return "formulaic_signal"
    if has("one_cohort", c):
        return "provided_series_statistic"
    if has("named_series", c):
        return "trading_strategy" if has("construction", c) >= 2 and not has("encoded", c) else "provided_series_statistic"
    if has("pooled", both) and (has("encoded", both) or has("declared", both)):
        return "trading_strategy" if has("construction", c) >= 2 and not has("encoded", both) else "provided_series_statistic"
    if has("descriptive", c) and has("descriptive", c) >= has("trading", c):
        return "descriptive_statistical"
    if has("trading", c):
        return "trading_strategy"
    return "structural_proposition" if has("structural", c) else "trading_strategy"


@pytest.fixture(scope="module")
def mixed():
    """Claims and sources strung together from parts of the planted ones, so that cues meet in many ways."""
    rng = random.Random(3)
    parts = [w for c, _ in plans.CLAIMS for w in re.split(r"(?<=[a-z]) (?=[a-z])", c) if w.strip()] + [c for c, _ in plans.CLAIMS]
    rows = [(c, s) for c, _ in plans.CLAIMS for s, _ in plans.CLAIMS[:9]]
    rows += [(" ".join(rng.choices(parts, k=rng.randint(1, 25))), rng.choice(["", " ".join(rng.choices(parts, k=12))])) for _ in range(1500)]
    return rows


def test_types_against_plain_expressions(spark, mixed):
    df = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(mixed)], "id long, claim string, source string")
    got = {r.id: r.claim_type for r in t.classify(df, ["claim"], "source").select("id", "claim_type").collect()}
    want = {i: plain(c, s) for i, (c, s) in enumerate(mixed)}
    assert got == want and set(want.values()) == set(t.CLAIM_TYPES)


def test_no_match_without_a_needed_word():
    """Every match of every pattern in many texts has a word of which the pattern says that it needs one."""
    rng = random.Random(1)
    patterns = [w for ws in t.CUES.values() for w in ws] + [w for _, w, _ in t.PARAMETERS]
    words = sorted({w for x in patterns for w in re.findall(r"[a-z0-9&\[\],=:%_-]+", re.sub(r"\\[a-z]", " ", x))})
    found = 0
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=30))
        for x in patterns:
            if m := re.search(x, text):
                found += 1
                assert not t.needed(x) or any(w in m.group() for w in t.needed(x)), (x, m.group())
    assert found > 1000


def test_cues_have_places_and_odd_rows_have_a_type(spark):
    df = spark.createDataFrame([(1, "A Signal, and a signal", None), (2, None, "Kalshi bracket"), (3, "", ""), (4, "x " * 100_000 + "momentum", None)], "id long, claim string, cues string")
    got = {r.id: r for r in t.classify(df, ["claim"], "cues").collect()}
    assert ("trading", False, 2) in [tuple(c) for c in got[1].cues]
    assert [got[k].claim_type for k in (2, 3)] == ["trading_strategy"] * 2
    assert ("trading", False, 200_000) in [tuple(c) for c in got[4].cues]
    assert t.classify(df.limit(0), ["claim"]).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_stated_parameters(spark, strict):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(plans.STATED)] + [(90, None), (91, "over 3 days after, five-factor, ff 5")], "id long, spans string")
    got = {r.id: r.parameters for r in t.extract(df, ["spans"], strict).collect()}
    assert got[90].event_window is None and got[90].contradicts == []
    assert tuple(got[91].event_window) == (0, 2) and got[91].benchmark_set == "ff5"
    for i, (_, said) in enumerate(plans.STATED):
        window, estimation, buckets, rebalance, horizon, *rest, contradicts = said.split("|")
        wrong = set(contradicts.split(",")) if strict else set()
        number = lambda x: int(x) if x else None
        r = got[i]
        assert (tuple(r.event_window) if r.event_window else None) == (tuple(map(int, window.split(":"))) if window and "event_window" not in wrong else None)
        assert (r.estimation_window, r.buckets, r.rebalance, r.horizon) == (number(estimation), None if "buckets" in wrong else number(buckets), rebalance or None, None if "horizon" in wrong else number(horizon))
        assert [r.baseline, r.benchmark_set, r.benchmark_method] == [None if k in wrong else x or None for k, x in zip(("baseline", "benchmark_set", "benchmark_method"), rest, strict=True)]
        assert ",".join(r.contradicts) == contradicts


def test_spans_stand_where_they_say(spark):
    text = "In a [-1, +3] day window and DECILES, then deciles"
    r = t.find_spans(spark.createDataFrame([(text,)], "text string"), ["text"]).first()
    assert [(x.kind, x.value, x.until, text[x.start : x.stop].lower()) for x in r.spans] == [("event_window", "-1", "+3", "[-1, +3] day window"), ("buckets", "10", None, "deciles"), ("buckets", "10", None, "deciles")]


def test_planted_reasons_and_odd_specs(spark):
    rows = [(i, *r[:3]) for i, r in enumerate(plans.DECLARED)]
    odd = [None, "", "{", "null", "{}", '{"inputs": null}', '{"inputs": "x", "window": {"a": 1}, "binding_provenance": []}', '{"a": {"b": [{"Alpha level": 1}]}}']
    rows += [(1000 + 10 * k + j, kind, said, spec) for k, spec in enumerate(odd) for j, (kind, said) in enumerate([(k, x) for k in p.CHECKED for x in (None, "x")])]
    df = spark.createDataFrame(rows, "id long, claim_type string, said string, spec string").withColumn("parameters", F.lit(1)).withColumn("matches", F.lit("x"))
    got = {r.id: r for r in p.spec_matches_text(df, ["said"]).collect()}
    for i, r in enumerate(plans.DECLARED):
        assert (";".join(got[i].reasons) if got[i].reasons is not None else None) == r[3], r
    assert all(not got[i].matches and got[i].reasons for i in got if i >= 1000)
    assert all("added_gate" in got[i].reasons for i in got if i >= 1070)
    reasons = {x for r in plans.DECLARED for x in (r[3] or "").split(";") if x}
    assert {"no_spec", "order_of_mention", "horizon", "buckets", "cadence", "event_window", "baseline", "benchmark_set", "benchmark_size", "benchmark_method", "added_gate"} <= reasons


def test_horizons(spark):
    df = spark.createDataFrame([("5 days", 5), ('{"periods": 3}', 3), ('{"days": 0, "h": "7"}', 7), ("-2", 1), ("2.9", 2), ("three months", 3), ("h5", None), (None, None), ("999999999999", None), ("12d", 12)], "h string, want int")
    assert all(r.got == r.want for r in df.select("want", p.horizon_of(F.col("h")).alias("got")).collect())
    text = spark.createDataFrame([("a 5-day ahead and two weeks; next day, ten months",)], "x string").select(p.horizons(F.col("x")).alias("h")).first()
    assert sorted(text.h) == [1, 5, 10]


def test_repeated_claims_are_judged_once(spark, monkeypatch):
    """the same rows whether equal claims are judged once or row by row, with nulls in every column."""
    rows = [(i, k, said, spec) for i, (k, said, spec) in enumerate([("event_study", "Returns rise", "{}"), ("event_study", None, None), (None, "x", "{}"), ("event_study", "Returns rise", "{}"), ("other", "x", None)] * 3)]
    df = spark.createDataFrame(rows, "id int, claim_type string, said string, spec string")
    take = lambda: sorted((r.id, r.matches, r.reasons) for r in p.spec_matches_text(df, ["said"]).collect())
    once = take()
    seen = []
    whole = p.spec_reasons
    monkeypatch.setattr(p, "spec_reasons", lambda d, *a: (seen.append(d.count()), whole(d, *a))[1])
    assert take() == once and seen == [4] and len(once) == 15
    monkeypatch.setattr(p, "REPEATED", 3)
    assert take() == once and seen == [4, 15]
