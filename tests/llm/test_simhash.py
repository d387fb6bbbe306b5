import random
import re

import pytest
import xxhash

from refspark.llm import simhash as s


def plain(text, n=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(ids, fps, d=2):
    low = list(range(len(ids)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                low[root(i)] = root(j)
    best = {}
    for i in range(len(ids)):
        best[root(i)] = min(best.get(root(i), ids[i]), ids[i])
    return [best[root(i)] for i in range(len(ids))]


def test_digest_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ÉF gh ij KL mñ 12 zz".split())
    base = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(30)]
    docs = base + base[:5] + [b + " tail" for b in base[5:15]] + [b.replace("ab", "ba", 1) for b in base[15:25]] + [None, "", " \n\t", "one", "ONE", "x y z"]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(docs)]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_duplicate_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [plain(t) for _, t in rows]
    want = groups([i for i, _ in rows], fps)
    assert found == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)}


@pytest.mark.parametrize(("distance", "segments", "hot"), [(2, 2, 4096), (2, 2, 3), (2, 3, 2), (3, 2, 4)])
def test_links_are_whole(spark, tmp_path, distance, segments, hot):
    rng = random.Random(distance * 7 + hot)
    fps = {0}
    for _ in range(6):
        seed = rng.getrandbits(64)
        for _ in range(12):
            seed ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 2)))
            fps.add(seed & (2**64 - 1))
    signed = lambda x: x - 2**64 if x >> 63 else x
    spark.createDataFrame([(signed(x),) for x in fps], "fp long").write.parquet(str(tmp_path / "n"))
    got = {tuple(sorted((r.a, r.b))) for r in s.links(spark.read.parquet(str(tmp_path / "n")), distance, segments, hot).collect()}
    fps = sorted(fps)
    assert got == {tuple(sorted((signed(x), signed(y)))) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= distance}


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    found = {r.v: r.label for r in s.components(edges).collect()}
    assert found == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_empty(spark):
    assert s.near_duplicate_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
