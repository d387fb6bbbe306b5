import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from refspark.llm import jaccard as j


def plain(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(rows, over=0.8, within=64):
    """By comparing every pair; with `within`, only those whose fingerprints are so near."""
    texts = dict(rows)
    low = {i: i for i, _ in rows}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    sets = {i: plain(t) for i, t in rows}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= over * len(x | y) - 1e-12 and apart(texts[a], texts[b]) <= within:
            u, v = sorted((root(a), root(b)))
            low[v] = u
    return {i: root(i) for i, _ in rows}


def by_least(rows):
    low = {}
    for r in rows:
        low[r.part] = min(low.get(r.part, r.doc_id), r.doc_id)
    return {r.doc_id: low[r.part] for r in rows}


def apart(a, b):
    def fp(text):
        return j.majority(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in set(j.words_of((text or "").encode()))), np.uint64))

    return bin(fp(a) ^ fp(b)).count("1")


@pytest.mark.parametrize("salt", [100_000, 10])
def test_groups_against_brute_force(spark, monkeypatch, salt):
    monkeypatch.setattr(j, "SALT", salt)
    monkeypatch.setattr(j, "ROUNDS", ((1, 1), (2, 2)))
    rng = random.Random(4)
    line = " ".join(f"line{k}" for k in range(12))
    texts = [None, "", " \n", "one", "ONE", "a b c d e", "a b c d f"]
    for g in range(12):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(8):  # near 0.8 on both sides, in chains
            for _ in range(rng.randint(1, max(1, len(base) // 45))):
                base[rng.randrange(len(base))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(base) + (" " + line if g % 3 == 0 else ""))
    head = [f"h{k}" for k in range(100)]
    texts += [" ".join(head[:50] + [f"n{k}"] + head[50:]) for k in range(60)]  # one large group
    texts += [line + f" only{k} of{k}" for k in range(20)]
    rng.shuffle(texts)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = by_least(j.near_duplicates(docs, ["doc_id"]).collect())
    near = groups(rows, within=7)
    assert found == near
    assert 20 < len(set(near.values())) < len(near)
    want = groups(rows)
    assert all(want[i] == want[found[i]] for i in found)  # nothing is joined that isn't similar
    assert len(found) - len(set(found.values())) >= 0.9 * (len(want) - len(set(want.values())))  # nine in ten of all copies are found


@pytest.mark.parametrize("rounds", [((1, 1),), ((1, 1), (2, 8), (9, 64))])
def test_one_chain_of_many_groups(spark, monkeypatch, rounds):
    """Texts with a long common part: each group has a text that its copies are near to, though many of them aren't near each other."""
    monkeypatch.setattr(j, "ROUNDS", rounds)
    rng = random.Random(9)
    common = [f"c{k}" for k in range(90)]
    texts = [" ".join(common)]
    for g in range(14):
        base = common + [f"g{g}x{k}" for k in range(35)]
        texts.append(" ".join(base))
        for _ in range(9):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(1, 4)):
                words[at] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = spark.createDataFrame([(i, sorted(j.shingles(t.encode().split()).tolist())) for i, t in rows], "node long, hs array<long>")
    members = sets.selectExpr("node", "0L fp", "node % 2 chain")  # two chains, each of which must be whole in itself
    label = {r.node: r.label for r in j.groups_in_chains(members, sets, 4, 5, 64).collect()}
    for chain in (0, 1):
        own = [(i, t) for i, t in rows if i % 2 == chain]
        low = {}
        for i, _ in own:
            low.setdefault(label.get(i, i), i)
        assert {i: low[label.get(i, i)] for i, _ in own} == groups(own)
        assert 8 < len(set(groups(own).values())) < len(own)


def test_pipeline_stage_drops_copies_at_eight_tenths(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = groups([(r.doc_id, r.text) for r in docs.collect()], within=7)
    assert want[177] == 1 and want[145] == 6  # similar by 0.83
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(set(want.values()))


def test_stage_decides_by_row(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " more", "x"), (None, b, "x"), (None, None, "x"), (None, "", "y"), (5, None, "x"), (7, "c d", "x"), (7, "c d", "x"), (None, "e f", "x"), (None, "e f", "x"), (9, "x y", "x"), (9, "X  y", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "1 as part", "2 as fp", "'q' as __hash")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [k for k in kept if k[0] != 9] == sorted([(1, a), (1, b), (5, None), (7, "c d"), (None, "e f")], key=str)  # a text's copy goes, another text of its doc_id stays
    assert len([k for k in kept if k[0] == 9]) == 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_recall_of_the_distance():
    """Of texts with a near copy at 0.8 or more, the share that has one within the distance."""
    rng = random.Random(8)
    found = n = 0
    for _ in range(300):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        other = list(words)
        for _ in range(max(1, len(words) // 50)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        x, y = plain(a), plain(b)
        if len(x & y) >= 0.8 * len(x | y):
            n += 1
            found += apart(a, b) <= 7
    assert n > 200 and found >= 0.9 * n
