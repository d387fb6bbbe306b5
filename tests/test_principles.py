"""What kills have in common, against a cover that counts all groups anew for each choice."""

import random

from refspark.operators import corpus


def plain(rows, least, year):
    first = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        first.setdefault(r["claim_id"], r)
    kills, out = list(first.values()), set()

    def graded(level, label, reason, group):
        newest = max((k["year"] for k in group if k["year"] is not None), default=year)
        return level, label, reason, len(group), newest, round(0.5 * 0.5 ** (max(0, year - newest) / 4), 3)

    def take(pool, level, label):
        groups = {}
        for k in pool:
            groups.setdefault((label(k), k["kill_reason"]), []).append(k)
        chosen = {g for g, ks in groups.items() if len(ks) >= least}
        out.update(graded(level, a, b, groups[a, b]) for a, b in chosen)
        return [k for k in pool if (label(k), k["kill_reason"]) not in chosen]

    known = [k for k in kills if k["components"] is not None and k["method"] is not None]
    take([k for k in kills if k not in known], "domain", lambda k: k["domain"])
    left = take(known, "exact", lambda k: "+".join(sorted(k["components"])) + "::" + k["method"])
    left = take(left, "method", lambda k: k["method"])
    while True:
        groups = {}
        for k in left:
            for c in set(k["components"]):
                groups.setdefault((k["kill_reason"], c), []).append(k)
        if not groups:
            return out
        (reason, label), group = min(groups.items(), key=lambda g: (-len(g[1]), g[0]))
        if len(group) < least:
            return out
        out.add(graded("component", label, reason, group))
        left = [k for k in left if k not in group]


def test_principles_against_counting_anew(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        rows.append({"claim_id": rng.randrange(700), "at": i, "kill_reason": rng.choice("pqr"), "domain": rng.choice("xyz"), "components": rng.choice([None, *[sorted(rng.sample("abcdefghijklm", rng.randint(1, 4))) for _ in range(9)]]), "method": rng.choice([None, *[f"m{k}" for k in range(60)]]), "year": rng.choice([None, 2019, 2022, 2030])})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "claim_id long, at long, kill_reason string, domain string, components array<string>, method string, year int").repartition(5)
    got = {tuple(r) for r in corpus.principles(df, 4, year=2026).collect()}
    want = plain(rows, 4, 2026)
    assert got == want and {r[0] for r in want} >= {"method", "component", "domain"}
    assert corpus.principles(df.limit(0), year=2026).count() == 0


def test_cover_takes_ties_by_name():
    assert corpus.cover([(["b", "a"], 3, 2000), (["b"], 1, None), (["a"], 1, 2001), (["c"], 2, None)], 2) == [("a", 4, 2001), ("c", 2, None)]
    assert corpus.cover([], 1) == []
