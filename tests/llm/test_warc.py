import hashlib

import pytest

from refspark.llm import warc as w


def brute(rows):
    out = []
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, p in data:
        same = [j for j, q in data if q == p and j is not None]
        again = len(p) >= 100 and same and min(same) != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


ROWS = [(5, "http://a/\r\nX: y", "é" * 60), (3, None, "é" * 60), (9, "u", "é" * 60), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "é" * 60), (11, "u", "\r\n\r\n"), (12, "u", "\r\n\r\n" * 60_000), (13, "u", "x" * 200_000), (14, "u", "x" * 200_000), (20, "u", "y" * 100), (20, "u", "y" * 100)]


def test_round_trip_against_brute_force(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert sorted(map(tuple, w.warc_digest(pages).collect()), key=str) == brute(ROWS)
    assert w.warc_digest(pages.limit(0)).count() == 0


def test_many_repeated_payloads_and_clashing_columns(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as first", "2 as n", "3 as chunk_no", "'y' as digest")
    plain = w.plan_records(pages).drop("payload").collect()
    for few, hot in ((0, 1), (0, 2), (0, 100)):
        assert sorted(w.plan_records(pages, few, hot).drop("payload").collect(), key=str) == sorted(plain, key=str)


def test_archive_is_a_warc_file_and_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "a")
    w.write_archives(pages, path)
    rows = spark.read.parquet(path)
    assert max(len(r.data) for r in rows.select("data").collect()) <= w.CHUNK + 1000
    first = rows.first().archive
    raw = b"".join(r.data for r in rows.filter(f"archive = {first}").orderBy("record_no", "chunk_no").collect())
    n = 0
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and rest[size : size + 4] == b"\r\n\r\n"
        raw, n = rest[size + 4 :], n + 1
    assert n == rows.filter(f"archive = {first} and chunk_no = 0").count()
    from pyspark.sql import functions as F

    bad = str(tmp_path / "b")
    rows.withColumn("data", F.when(F.length("data") == 65536, F.expr("cast(repeat('z', 65536) as binary)")).otherwise(F.col("data"))).write.parquet(bad)
    with pytest.raises(Exception, match="differs"):
        w.read_archives(spark, bad).collect()
