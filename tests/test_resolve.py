"""Series named in prose, against every pair of a text and a name."""

import random

from pyspark.sql import functions as F

from refspark.operators import corpus


def brute(texts, names):
    covers = lambda a, b: len(a) >= 3 and len(b) >= 3 and (a.startswith(b) or b.startswith(a))
    out = {}
    for i, d in texts:
        best = None
        for name, n in names:
            used = []
            for word in n:
                free = [k for k in range(len(d)) if k not in used and covers(word, d[k])]
                used += free[:1]
            if n and used:
                got = (len(used) / len(n), len({d[k] for k in used}), name, len(n), n[0])
                best = max(best, got) if best else got
        ok = best and best[0] >= 0.5 and (best[1] >= 2 or (best[3] == 1 and best[0] == 1 and best[4] not in corpus.GENERIC))
        out[i] = (best[2], round(best[0], 6)) if ok else (None, None)
    return out


def test_resolve_series_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = ["acme", "acme1", "acme12", "vola", "volatility", "account", "accounts", "btc", "price", "rate", "ra", "rates", "spread", "spreads", "gold"]
    names = spark.createDataFrame([(i, "_".join(rng.choices(vocab, k=rng.randint(1, 4)))) for i in range(60)], "i int, name string")
    texts = spark.createDataFrame([(i, " ".join(rng.choices([*vocab, "zzz", "the"], k=rng.randint(0, 5)))) for i in range(150)] + [(900, None), (901, "gold gold")], "id long, text string")
    got = {r.id: (r.series, r.score and round(r.score, 6)) for r in corpus.resolve_series(texts, names).collect()}
    split = lambda df, k, c: [(r[0], r[1]) for r in df.select(k, corpus.prose_tokens(F.col(c))).distinct().collect()]
    assert got == brute(split(texts, "id", "text"), split(names, "name", "name")) and len({v for v in got.values()}) > 10


def test_common_words_do_not_bring_every_text_to_every_name(spark):
    """Each text covers two words of three of every name, and one name whole: the pairs were 4,000 times 4,000 (F2)."""
    names = spark.range(4000).selectExpr("concat('acme', 10000 + id, '_volatility_account') name")
    texts = spark.range(4000).selectExpr("id", "concat('vola and accounts of acme', 10000 + id) text")
    df = corpus.resolve_series(texts, names)
    rows = df.selectExpr("count(*)", "count_if(series = concat('acme', 10000 + id, '_volatility_account') and full)").first()
    assert tuple(rows) == (4000, 4000)
    joined = [int(n.metrics().apply("numOutputRows").value()) for n in _nodes(df) if "Join" in n.nodeName() and n.metrics().contains("numOutputRows")]
    assert joined and max(joined) <= 40_000


def _nodes(df):
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
            continue
        out.append(p)
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out
