import duckdb
import pytest
from pyspark.sql import functions as F

from refspark.llm import shards as s


@pytest.mark.parametrize("slice_", [100_000, 7, 1])
def test_digest_against_sql(spark, monkeypatch, slice_):
    monkeypatch.setattr(s, "SLICE", slice_)
    rows = [(i, "é" * (i * 37 % 400) if i % 11 else None, 1) for i in range(3000)] + [(None, "x", 1), (5, "again", 2), (5, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(6)
    got = sorted(map(tuple, s.sharding_digest(docs, 20, 100_000, 2000).collect()), key=str)
    documents = docs.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(s.digest_sql(20, 100_000, 2000)).fetchall(), key=str)
    assert got == want
    assert len({r[1] for r in got}) < 60
    assert s.sharding_digest(docs.limit(0)).count() == 0


def test_versions_are_atomic_and_immutable(spark, tmp_path):
    root = str(tmp_path / "r")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('a', cast(id % 50 as int))").alias("text"))
    assert s.append(docs.filter("doc_id < 300"), root, F.floor(F.col("doc_id") / 10)) == 1
    assert s.append(docs.filter("doc_id >= 300"), root, F.floor(F.col("doc_id") / 10)) == 2
    with pytest.raises(ValueError, match="taken"):
        s.append(docs.limit(5), root, F.lit(3))
    assert s.compact(spark, root, 3000, 100) == 3
    for version, n in ((1, 300), (2, 400), (3, 400)):
        assert sorted(r[0] for r in s.read(spark, root, version).select("doc_id").collect()) == list(range(n))
    live = s.manifest(spark, root, 3)
    assert live.count() < s.manifest(spark, root, 2).count() and live.agg(F.sum("rows")).first()[0] == 400
    with pytest.raises(RuntimeError, match="another writer"):
        s.commit(live, root, 3)
    assert s.versions(spark, root) == [1, 2, 3]
    assert sorted(r[0] for r in s.read(spark, root).select("doc_id").collect()) == list(range(400))
    files = {r[0] for r in s.read(spark, root).select(F.input_file_name()).distinct().collect()}
    assert files == {f for f in files if any(f"__attempt={r.attempt}/__gen={r.gen}/__shard={r.shard}/" in f for r in live.collect())}
    assert s.vacuum(spark, root) == s.manifest(spark, root, 2).join(live, ["attempt", "gen", "shard"], "left_anti").count() + 1  # and the refused arrival
    assert s.read(spark, root).count() == 400


def test_a_writer_that_dies_before_its_commit_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(7).alias("gen"), F.lit(8).alias("__gen"))
    real = s.commit

    def dies(*a):
        raise OSError("gone")

    arrival = F.floor(F.col("doc_id") / 5)
    for work in (lambda: s.append(docs, root, arrival), lambda: s.compact(spark, root, 3000, 100)):
        monkeypatch.setattr(s, "commit", dies)
        with pytest.raises(OSError, match="gone"):
            work()
        monkeypatch.setattr(s, "commit", real)
        work()
        rows = s.read(spark, root)
        assert rows.count() == 40 and rows.select("gen").distinct().collect() == [(7,)]
        assert s.manifest(spark, root, s.versions(spark, root)[-1]).agg(F.sum("rows")).first()[0] == 40


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    root = str(tmp_path / "r")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    s.append(docs, root, F.floor(F.col("doc_id") / 5))
    live = s.manifest(spark, root, 1)
    first, second = live.filter("shard < 2"), live.filter("shard >= 2")
    s.commit(first, root, 2)
    with pytest.raises(RuntimeError, match="another writer"):  # it had looked before the first one's commit
        s.commit(second, root, 2)
    assert s.versions(spark, root) == [1, 2]
    assert sorted(r.shard for r in s.manifest(spark, root, 2).collect()) == [0, 1]
    left = [f.name for f in (tmp_path / "r/manifest").iterdir() if not f.name.startswith(".")]
    assert sorted(f[:5] for f in left) == ["table", "table", "v0000", "v0000"]


def test_very_long_texts_and_one_task_for_each_merge(spark, tmp_path):
    root = str(tmp_path / "r")
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.expr("repeat('a', cast(if(id = 9, 3000000, 1000) as int))").alias("text"))
    s.append(docs.repartition(1), root, F.col("doc_id"))
    s.compact(spark, root, 16_000, 100)
    merged = s.read(spark, root).filter("__gen > 0").select("__shard", F.input_file_name().alias("file"), F.length("text").alias("n")).collect()
    of, size = {}, {}
    for r in merged:
        of.setdefault(r[0], set()).add(r.file)
        size[r[0]] = size.get(r[0], 0) + r.n
    assert {len(files) for files in of.values()} == {1} and max(size.values()) <= 18_000
    assert s.read(spark, root).filter("doc_id = 9").select("__gen").collect() == [(0,)]
