import hashlib
import random
import re

from pyspark.sql import functions as F

from refspark.llm import secrets as s


def brute(text):
    text, found = text or "", []
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for k, r in enumerate(s.BASE + s.MORE):
        regex = re.compile(r.regex, re.A | re.I if r.ignore_case else 0)
        found += [(m.start(), k, m.end(), r.kind) for m in regex.finditer(text) if len(m[r.group]) >= r.least]
    assert lower("ÉA") == "Éa"
    return sorted(found)


def test_queries_are_derived():
    q = {r.kind: s.trigram_query(r.regex) for r in s.BASE + s.MORE}
    assert q["hex"] is None
    assert q["access"] == ("and", frozenset({b"aki", b"kia"}))
    assert q["assign"][0] == "or" and len(q["assign"][1]) > 5
    assert q["pem"] is not None and q["github"] is not None and q["jwt"] == ("and", frozenset({b"eyj"}))
    assert s.trigram_query("(abc|de)x*fgh") == ("and", frozenset({b"fgh"}))


def test_digest(spark):
    rng = random.Random(8)
    some = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", "  ", ":", "=", "abcDEF12", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "é", "K", "\n", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abcdefghij", "eyJabc.def_.ghi-" * 3, "sk_live_"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "a" * 100_000 + "f" * 31, "f" * 50_000]
    rows = {i: t for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in s.secret_digest(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows.items():
        found = brute(t)
        say = lambda f: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in f)
        base = [x for x in found if x[1] < 3]
        assert got[i].spans == say(found)
        assert got[i].base_sha256 == hashlib.sha256(say(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))


def test_redact_and_clash(spark):
    docs = spark.createDataFrame([(1, "x token = abcdefgh12 é password: 0123456789abcdef0123456789abcdef0 end", 3), (2, None, 4), (3, "clean", 5)], "doc_id long, text string, secrets int")
    out = s.find_secrets(docs).select("doc_id", s.redact(F.col("text"), F.col("secrets")).alias("t"))
    assert {r[0]: r[1] for r in out.collect()} == {1: "x [secret] é [secret] end", 2: None, 3: "clean"}
    assert s.find_secrets(docs.limit(0)).count() == 0
