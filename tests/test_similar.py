"""Similar statements against all pairs."""

import random
import re

from refspark.operators import corpus


def test_similar_statements_against_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 25))]
        for _ in range(rng.randint(1, 5)):
            words = [w if rng.random() > 0.12 else f"x{rng.randrange(50)}" for w in base]
            rows.append((len(rows), " ".join(words).capitalize(), rng.choice(["kill", "watch"])))
    rows += [(900, rows[3][1].upper(), "kill"), (901, None, "kill"), (902, "", "watch"), (903, "...", None)]
    got = [(r.a, r.b, round(r.similarity, 9), r.a_verdict, r.b_verdict) for r in corpus.similar_statements(spark.createDataFrame(rows, "id long, statement string, verdict string")).collect()]
    one = {}
    for i, t, v in rows:
        if t is not None:
            one[t.lower()] = min(one.get(t.lower(), (i, v)), (i, v))
    sets = sorted((i, set(re.findall("[a-z0-9]+", t)), v) for t, (i, v) in one.items())
    want = []
    for k, (a, x, v) in enumerate(sets):
        for b, y, u in sets[k + 1 :]:
            if x and y and len(x & y) >= 0.6 * len(x | y):
                want.append((a, b, round(len(x & y) / len(x | y), 9), v, u))
    want.sort(key=lambda r: (-r[2], r[0], r[1]))
    assert len(want) > 50 and got == want[:50]
    assert corpus.similar_statements(spark.createDataFrame(rows[:0], "id long, statement string, verdict string")).count() == 0


def test_where_many_are_nearly_equal_the_less_alike_do_not_meet(spark):
    """A crowd of statements about 0.4 alike would pair up; with enough pairs of 0.9 the result is the same and its pairs are few (F1)."""
    rng = random.Random(5)
    base = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join([w for w in base if rng.random() < 0.6] + [f"u{i}"]), "kill") for i in range(300)]
    near = [f"n{k}" for k in range(40)]
    rows += [(1000 + i, " ".join([*near, f"v{i}"]), "watch") for i in range(12)]
    rows += [(2000 + i, " ".join(rng.sample(near, 40)), "watch") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, statement string, verdict string")
    got = [(r.a, r.b, round(r.similarity, 9)) for r in corpus.similar_statements(df).collect()]
    sets = [(i, set(t.split())) for i, t, _ in rows]
    want = sorted(((a, b, round(len(x & y) / len(x | y), 9)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= 0.6 * len(x | y)), key=lambda r: (-r[2], r[0], r[1]))
    assert got == want[:50]
    got = [(r.a, r.b, round(r.similarity, 9)) for r in corpus.similar_statements(df.filter("id < 2003")).collect()]
    want = [r for r in want if r[1] < 2003]
    assert got == want[:50] and want[49][2] > 0.9
    words = df.filter("id < 1000").selectExpr("id", "split(statement, ' ') w")
    assert corpus._banded_pairs(words, 6, 18).count() * 3 < corpus._banded_pairs(words, 2, 32).count()
