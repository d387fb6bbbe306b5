import numpy as np

from refspark.llm import toxicity as t


def test_chain_feeds_earlier_links():
    rng = np.random.default_rng(0)
    rows, a, b = [], [], []
    for _ in range(1500):
        x = set(rng.integers(0, 400, 30).tolist())
        one = len(x & set(range(12))) > 0
        rows.append(np.array(sorted(x), np.int32))
        a.append(float(one))
        b.append(float(one and not x & set(range(100, 110))))
    chain = t.fit_chain(rows[:1000], {"a": np.array(a[:1000]), "b": np.array(b[:1000])})
    p = t.predict_chain(chain, rows[1000:])
    assert chain[1].earlier.shape == (1,) and chain[1].earlier[0] > 0
    assert ((p[:, 0] > 0.5) == np.array(a[1000:])).mean() > 0.9
    assert ((p[:, 1] > 0.5) == np.array(b[1000:])).mean() > 0.85


def test_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in t.toxicity_digest(docs, labels).collect()] == [False] * 3
    assert t.toxicity_digest(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    old, new = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth")
    got = t.score(docs.join(new, "doc_id"), t.train(docs, old), ["doc_id", "truth"]).groupBy("truth", "toxic").count().collect()
    n = {(r.truth, r.toxic): r["count"] for r in got}
    print(n)
    assert n.get((1, True), 0) > 0.8 * sum(v for k, v in n.items() if k[0] == 1)
    assert n.get((0, False), 0) > 0.99 * sum(v for k, v in n.items() if k[0] == 0)


def test_predictions_against_brute_force():
    import math

    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 1 << t.BITS, rng.integers(0, 40))).astype(np.int32) for _ in range(200)]
    chain = [t.Link(f"c{k}", rng.normal(0, 1, 1 << t.BITS), rng.normal(0, 1, k), float(rng.normal())) for k in range(3)]
    got = t.predict_chain(chain, rows)
    for row, p in zip(rows, got, strict=True):
        before = []
        for link, have in zip(chain, p, strict=True):
            z = link.start + sum(link.weights[f] for f in row.tolist())
            for w, q in zip(link.earlier.tolist(), before, strict=True):
                q = min(max(q, 1e-3), 1 - 1e-3)
                z += w * math.log(q / (1 - q))
            before.append(1 / (1 + math.exp(-z)))
            assert abs(before[-1] - have) < 1e-9


def test_kinds_part_toxic_documents_by_their_words():
    rng = np.random.default_rng(5)
    rows, toxic, group = [], [], []
    for k in range(400):
        kind = k % 4  # 0 and 1: two ways to be toxic
        own = set(rng.integers(100, 900, 20).tolist()) | (set(rng.integers(0, 8, 4).tolist()) if kind == 0 else set(rng.integers(20, 28, 4).tolist()) if kind == 1 else set())
        rows.append(np.array(sorted(own), np.int32))
        toxic.append(float(kind < 2))
        group.append(kind)
    kinds, group = t.toxic_kinds(rows, np.array(toxic)), np.array(group)
    assert set(kinds[group > 1]) == {-1}
    assert {len(set(kinds[group == k])) for k in (0, 1)} == {1} and kinds[group == 0][0] != kinds[group == 1][0]
    assert t.toxic_kinds(rows, np.zeros(400)).max() == -1


def test_repeated_rows_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "w " * 400_000), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, t.toxicity_digest(docs, labels).collect()))
    assert len(got) == 4 and got[0] == got[1]
