"""What the search for similar statements shuffles, and the order in which it compares candidates (F11)."""

import random

from refspark.operators import corpus


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    empty = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def pairs(rows, least=0.6):
    sets = [(i, set(t.split())) for i, t, _ in rows]
    found = ((a, b, round(len(x & y) / len(x | y), 9)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= least * len(x | y) and x != y)
    return sorted(found, key=lambda r: (-r[2], r[0], r[1]))


def test_texts_and_words_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(corpus, "COMPARED", 2, raising=False)
    rng = random.Random(3)
    rows = []
    for g in range(120):
        base = [f"{rng.getrandbits(64):x}" for _ in range(1500)]
        for _ in range(2):
            rows.append((len(rows), " ".join([*base, *(f"{rng.getrandbits(64):x}" for _ in range(1 + g))]), "kill"))
    df = spark.createDataFrame(rows, "id long, statement string, verdict string")
    before = shuffled(spark)
    got = [(r.a, r.b, round(r.similarity, 9)) for r in corpus.similar_statements(df, top=2).collect()]
    took = shuffled(spark) - before
    assert got == pairs(rows)[:2]
    assert took < 0.3 * sum(len(t) for _, t, _ in rows)


def test_candidates_are_compared_until_none_can_be_better(spark, monkeypatch):
    monkeypatch.setattr(corpus, "COMPARED", 1)
    monkeypatch.setattr(corpus, "HASHED", 50)
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        base = [f"a{rng.getrandbits(30):x}" for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 4)):
            cut = rng.choice((0.0, 0.02, 0.05, 0.2))
            rows.append((len(rows), " ".join([*(w if rng.random() >= cut else f"b{rng.getrandbits(30):x}" for w in base), f"c{len(rows)}"]), "watch"))
    df = spark.createDataFrame(rows, "id long, statement string, verdict string")
    for top in (3, 40):
        assert [(r.a, r.b, round(r.similarity, 9)) for r in corpus.similar_statements(df, top=top).collect()] == pairs(rows)[:top]
    met = {(r.a, r.b): r.bound for r in corpus._banded_pairs(df.selectExpr("id", "split(statement, ' ') w"), 2, 32).collect()}
    alike = {(a, b): s for a, b, s in pairs(rows, 0)}
    assert met and all(bound >= alike[pair] - 1e-9 for pair, bound in met.items())
