import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from refspark.llm import decontam as d


def test_index_agrees_with_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(25):
        docs = [rng.integers(1, 5, rng.integers(0, 60)) for _ in range(rng.integers(1, 8))]
        docs += docs[:2]
        text = np.concatenate([np.append(x, 0) for x in docs])
        index = d.FMIndex(text, np.flatnonzero(text == 0), 5)
        phrases = [tuple(rng.integers(1, 5, rng.integers(1, 7)).tolist()) for _ in range(40)]
        padded = np.array([[0] * (6 - len(p)) + list(p) for p in phrases])
        low, high = index.search(padded, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high, strict=True):
            there = [i for i in range(len(text)) if tuple(text[i : i + len(p)].tolist()) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == there


def brute(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for i, t in docs:
        w = word.findall(low(t))
        hit, found = set(), set()
        for k, x in items:
            v = word.findall(low(x))
            for s in range(max(1, len(v) - window + 1) if v else 0):
                p = v[s : s + window]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit.update(range(a, a + len(p)))
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_digest_and_blocks(spark, block_bytes):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["Red", "blue", "GREEN", "É1", "é2", "x"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([14, 12, 3, 0, 25, 10, 11, 2])] + [(2, None), (9, "blue, x!")]
    docs = [(i, say(rng.randint(0, 80))) for i in range(40)] + [(100, None), (101, ""), (102, "A " * 30000), (3, items[4][1]), (3, "zz " + items[4][1] + " qq " + items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_contamination(frame, bench, block_bytes=block_bytes, shard_words=700)
    rows = found.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), F.col("n_hit") > 0).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items)
    left = found.filter("doc_id = 3 and n_hit > 0 and text like 'zz%'").select(d.remove_spans(F.col("text"), F.col("spans"))).first()[0]
    assert left.split() == ["zz", "qq"]


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(docs, none).select("doc_id", "n_words", "n_hit").collect() == [(1, 2, 0)]
    assert d.find_contamination(docs.limit(0), none).count() == 0
    assert d.contamination_digest(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).first()[2] == 2
