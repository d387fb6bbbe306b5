import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from refspark.llm import periodic as p


def plain(w, shortest=12):
    """All runs, by every period: start, length, period."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def fibonacci(n):
    x, y = [0], [0, 1]
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_every_period(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 8)):
        n, k = rng.choice([0, 1, 2, 12, 13, 40, 90, 250]), rng.choice([1, 2, 2, 3, 5, 60])
        w = rng.choice([fibonacci, thue_morse, lambda n: [rng.randrange(k) for _ in range(n)]])(n)  # noqa: B023
        if rng.random() < 0.5 and n > 4:
            a = rng.randrange(n)
            period = 1 + rng.randrange(max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % period] for i in range(n)]
        texts.append(w)
    texts += texts[: rng.randrange(3)]  # copies share their rules
    words, begins = np.array([x for w in texts for x in w], np.int64), np.cumsum([0, *map(len, texts)])
    got = p.runs_of(words, np.unique([begins[i] for i, w in enumerate(texts) if w]).astype(np.int64)) if len(words) else ([], [], [])
    assert list(zip(*(list(map(int, x)) for x in got), strict=True)) == [(int(begins[i]) + s, n, q) for i, w in enumerate(texts) for s, n, q in plain(w)]


def test_rules_derive_equal_words_and_the_whole_text():
    words = np.array([1, 2, 3, 4] * 40 + [9] * 33 + [1, 2, 3, 4] * 7)
    rule, start, middle, end = p.derive(words, np.array([0]), 1)
    for r in set(rule.tolist()):
        assert len({tuple(words[a:b]) for a, b in zip(start[rule == r], end[rule == r], strict=True)}) == 1
    assert (end - start).max() == len(words) and len(set(rule.tolist())) < 40
    assert all((start < middle) & (middle < end))


def test_collisions_are_found_out(monkeypatch):
    """With hashes that say that all is equal, another base is taken."""
    first = p.Matches._equal
    calls = []

    def equal(self, i, j, size):
        calls.append(1)
        return np.ones(len(i), bool) if len(calls) < 20 else first(self, i, j, size)

    monkeypatch.setattr(p.Matches, "_equal", equal)
    w = [0, 1, 2] * 3 + [5] + [0, 1, 2] * 8
    assert [tuple(map(int, x)) for x in zip(*p.runs_of(np.array(w), np.array([0])), strict=True)] == plain(w)


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
    runs = plain(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_digest_against_contract(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "É", "x\x1cy", "\xa0"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(120)]
    texts += ["one two three\t" * 9, "x\n" * 40, None, "", " \n\x0b", "a b " * 6, "a b " * 5 + "a", *(["q r s " * 30] * 3), " ".join(f"w{k % 3000}" for k in range(9000))]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)] + [(None, "a b " * 20), (None, None), (-50, "z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "'q' as collapsed", "2 as start").repartition(3)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in p.run_digest(docs).collect()), key=str)
    assert got == sorted(((i, *contract(i, t)) for i, t in rows), key=str)
    assert sum(r[1] for r in got) > 10
    assert p.run_digest(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in p.run_digest(docs).collect()}
    for r in docs.filter("length(text) < 6000").collect():
        want = contract(r.doc_id, r.text)
        assert got[r.doc_id] == (want[0], *want[-2:])


def test_operator_keeps_text_and_runs(spark):
    docs = spark.createDataFrame([("k", "head " + "a b c " * 5 + "tail")], "name string, body string")
    r = p.periodic_runs(docs, ["name"], "body").first()
    assert (r.name, r.n_words, r.collapsed) == ("k", 17, "head a b c tail")
    assert [tuple(x) for x in r.runs] == [(1, 15, 3)]
    with pytest.raises(ValueError, match="three words"):
        p.periodic_runs(docs, [], "body", 5)
