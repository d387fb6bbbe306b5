import random
import re
from collections import Counter

import numpy as np

from refspark.llm import quality as q


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    hit = {i + j for i, x in enumerate(windows) if x in twice for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        some = rng.sample(["a", "É", "x|y", "ß#", "b", "c", "dd", " ", "日本"], rng.randint(1, 9))
        text = "".join(rng.choice(some) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 120)))
        assert q.statistics(text.encode())[:5] == brute(text)


def test_trees_learn_and_keep_the_constraint():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(6 * x[:, 0] + 3 * np.sin(9 * x[:, 1]) - 3)))).astype(float)
    model = q.fit_trees(x[:3000], y[:3000], np.array([1, 0, -1]))
    p = model.score(x[3000:])
    order = p.argsort()
    ranks = np.empty(1000)
    ranks[order] = np.arange(1000)
    t = y[3000:] == 1
    assert (ranks[t].sum() - t.sum() * (t.sum() - 1) / 2) / (t.sum() * (~t).sum()) > 0.85
    for j, sign in ((0, 1), (2, -1)):
        for base in x[:50]:
            grid = np.repeat(base[None], 60, 0)
            grid[:, j] = np.linspace(-0.2, 1.2, 60)
            assert (sign * np.diff(model.score(grid)) >= -1e-12).all()
    one = q.fit_trees(x[:10], np.zeros(10), np.zeros(3))
    assert one.score(x[:2]).max() < 0 and len(q.fit_trees(x[:0], y[:0], np.zeros(3)).roots) == 0


def test_digest_and_edge_cases(spark):
    good = ["w%d " % i * 1 + " ".join(f"x{i}y{j}" for j in range(60)) for i in range(60)]
    bad = [" | ".join(f"q{i}z{j}" for j in range(60)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(good + bad)] + [(900, None, True), (901, "", True), (902, "a b " * 50, True)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in q.quality_digest(docs, labels).collect()}
    assert all(rows[i].kept == (i < 60) for i in range(120))
    assert [rows[i].base_failed for i in (900, 901, 902)] == [True] * 3
    assert tuple(rows[902])[1:6] == brute("a b " * 50)
    assert all(r.kept for r in q.quality_digest(docs, labels.limit(0)).collect() if r.doc_id < 120)
    assert q.quality_digest(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    old, new = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = q.assess(docs.join(new, "doc_id"), q.train(docs, old), ["doc_id", "quality"]).filter("not base_failed or quality = 0").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    print(n)
    assert n.get((1, True), 0) > 0.985 * sum(v for k, v in n.items() if k[0] == 1)
    assert n.get((0, False), 0) > 0.9 * sum(v for k, v in n.items() if k[0] == 0)
