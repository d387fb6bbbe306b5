"""Competing explanations, and the widening of search results, against loops."""

import random

import numpy as np

from refspark.operators import corpus, executors


def test_lenses_against_least_squares(spark):
    rng = random.Random(7)
    rows, simple, fragile = [], [], []
    for s in range(14):
        n = rng.choice([6, 40, 80])
        for k in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((s, k, 0.3 * (s % 3) + (s % 4) * 0.5 * a - 0.2 * b + rng.gauss(0, 0.3) - (s == 5), a, b))
            if s % 5:
                simple.append((s, k, rows[-1][2] * rng.choice([0.5, 1.4])))
        if s % 2:
            fragile.append((s, s % 4 == 1))
    net = spark.createDataFrame(rows, "series_id long, seq long, net double, a double, b double").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(seq)) ts")
    windows = [("2024-01-05", "2024-01-20"), ("2030-01-01", "2031-01-01")]
    got = {(r.series_id, r.lens): r.verdict for r in executors.competing_explanations(net, ("a", "b"), windows, spark.createDataFrame(simple, "series_id long, seq long, net double"), spark.createDataFrame(fragile, "series_id long, fragile boolean")).collect()}
    want = {}
    for s in range(14):
        own = [r for r in rows if r[0] == s]
        seen = own[: int(len(own) * 0.8)]
        y = np.array([r[2] for r in seen])
        if len(seen) >= 10:
            x = np.array([[1, r[3], r[4]] for r in seen])
            alpha, mean = np.linalg.lstsq(x, y, rcond=None)[0][0], y.mean()
            want[s, "exposure"] = "rejected" if alpha > 0 and (alpha / mean if mean > 1e-12 else 0) >= 0.5 else "survives"
        else:
            want[s, "exposure"] = "untested"
        want[s, "single_regime"] = "survives" if dict(fragile).get(s) else "rejected"
        outside = [r[2] for r in seen if not 4 <= r[1] <= 19]
        want[s, "crisis"] = "survives" if y.mean() > 0 and outside and np.mean(outside) <= 0 else "rejected"
        plain = [v for t, k, v in simple if t == s and k < len(seen)]
        want[s, "simpler_variant"] = "untested" if not plain else "survives" if np.mean(plain) >= y.mean() else "rejected"
    assert got == want and {"survives", "rejected", "untested"} == set(want.values())


def test_expansion_stays_among_eligible_nodes(spark):
    rng = random.Random(3)
    seeds = [(q, rng.randrange(40), round(rng.random(), 3)) for q in range(6) for _ in range(4)]
    seeds = list({(q, n): (q, n, s) for q, n, s in seeds}.values())
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(0, k) for k in range(40)]
    eligible = [k for k in range(40) if k % 7]
    frames = spark.createDataFrame(seeds, "query_id long, node_id long, score double"), spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(k,) for k in eligible], "node_id long")
    both = {(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a in eligible and b in eligible}
    for hops, k in ((1, 6), (2, 1000), (0, 2)):
        got = {}
        for r in corpus.expand_eligible(*frames, hops, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.node_id, round(r.score, 9)))
        for q in range(6):
            best = {n: s for x, n, s in seeds if x == q and n in eligible}
            for _ in range(hops):
                step = dict(best)
                for a, b in both:
                    if a in best:
                        step[b] = max(step.get(b, 0), best[a] / 2)
                best = step
            assert got.get(q, []) == sorted(((n, round(s, 9)) for n, s in best.items()), key=lambda r: (-r[1], r[0]))[:k]
