"""The index's search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import pytest

from refspark.operators import lexical


def plain(queries, docs, k):
    words = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs]
    df = Counter(w for _, ws in words for w in set(ws))
    out = {}
    for q, text in queries:
        terms = set(re.findall("[a-z0-9]+", (text or "").lower()))
        found = []
        for i, ws in words:
            tf = Counter(w for w in ws if w in terms)
            if tf and i is not None:
                found.append((-round(sum(n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in tf.items()) / math.sqrt(len(ws)), 9), i))
        out[q] = [(i, pytest.approx(-s, abs=2e-9)) for s, i in sorted(found)[:k]]
    return out


@pytest.mark.parametrize(("block", "skip", "part", "batch"), [(1024, 64, 1024, 20_000), (16, 1, 7, 20_000), (5, 2, 1000, 3)])
def test_search_against_every_document(spark, tmp_path, monkeypatch, block, skip, part, batch):
    monkeypatch.setattr(lexical, "SKIP", skip)
    monkeypatch.setattr(lexical, "PART", part)
    rng = random.Random(block)
    word = lambda: rng.choice(["the"] * 6 + [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(3)])
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(230)]
    docs += [(900, None), (901, ""), (902, "THE w1, w2-w3"), (3, docs[3][1]), (3, docs[3][1]), (None, "w1 w2"), (903, "x " * 5000)]
    queries = [(q, " ".join(word() for _ in range(rng.randint(1, 9)))) for q in range(17)] + [(50, None), (51, "unknown zzz"), (52, "The w1 W1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "'q' as term").repartition(4)
    index = lexical.build_index(d, str(tmp_path / "i"), block)
    got = {}
    for r in lexical.search(lexical.LexicalIndex.open(spark, str(tmp_path / "i")), spark.createDataFrame(queries, "query_id long, text string"), 5, batch).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: rows for q, rows in plain(queries, docs, 5).items() if rows}
    assert got == want
    assert index.postings.count() > index.terms.count() or block == 1024


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert lexical.search(lexical.build_index(docs, str(tmp_path / "a")), q).count() == 0
    one = spark.createDataFrame([(1, "a b")], docs.schema)
    assert [tuple(r)[:2] for r in lexical.search(lexical.build_index(one, str(tmp_path / "b")), q).collect()] == [(1, 1)]
    assert lexical.search(lexical.build_index(one, str(tmp_path / "c")), q.limit(0)).count() == 0
