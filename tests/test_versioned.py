"""The versioned table under crashes, repeated batches and a second writer; the state of what has been processed."""

import threading

import pytest
from pyspark.sql import functions as F

from refspark.operators import processed, records
from refspark.sources import versioned
from refspark.sources.versioned import Conflict, VersionedTable, sink

LEDGER = "strategy long, denominator long, scored boolean"


def plain(table):
    return {r.strategy: (r.denominator, r.scored) for r in table.read().collect()}


def ledger(spark, root):
    return VersionedTable(spark, str(root), "strategy", LEDGER, 8)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "strategy long, denominator long")


def test_versions_and_merges(spark, tmp_path):
    t = ledger(spark, tmp_path / "t")
    assert t.version() == 0 and t.read().count() == 0
    assert t.upsert(batch(spark, (1, 5), (2, 7), (None, 3)), records.register_trials) == 1
    assert t.upsert(batch(spark, (1, 4), (3, 9)), records.register_trials) == 2
    assert plain(t) == {1: (5, False), 2: (7, False), 3: (9, False), None: (3, False)}
    assert {r.strategy for r in t.read(1).collect()} == {1, 2, None}  # an earlier version stays as it was
    before = t.manifest(2)["folders"]
    t.upsert(batch(spark, (1, 50)), records.register_trials)
    assert sum(before[b] != at for b, at in t.manifest(3)["folders"].items()) == 1  # only the touched bucket is written
    assert t.upsert(batch(spark).limit(0) if False else batch(spark, (1, 1)).limit(0), records.register_trials) == 4 and plain(t)[1] == (50, False)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    t = ledger(spark, tmp_path / "t")
    add = lambda old, new: old.unionByName(new.withColumn("scored", F.lit(False))).groupBy("strategy").agg(F.sum("denominator").alias("denominator"), F.bool_or("scored").alias("scored"))
    for number in (0, 1, 1, 0, 2):
        t.upsert(batch(spark, (1, 1)), add, "s", number)
    t.upsert(batch(spark, (1, 10)), add, "other", 0)
    assert plain(t) == {1: (13, False)} and t.version() == 4


def test_stream_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    for k in range(6):
        batch(spark, *[(i % 40, 100 * k + i) for i in range(60)]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    t = ledger(spark, tmp_path / "t")
    add = lambda old, new: old.unionByName(new.withColumn("scored", F.lit(False)).select("strategy", "denominator", "scored")).groupBy("strategy").agg(F.sum("denominator").alias("denominator"), F.bool_or("scored").alias("scored"))
    real, calls = versioned.VersionedTable.publish, []

    def dies(self, said, version):
        calls.append(version)
        if len(calls) == 3:
            raise OSError("killed before the commit")
        real(self, said, version)
        if len(calls) == 5:
            raise OSError("killed after the commit")

    monkeypatch.setattr(versioned.VersionedTable, "publish", dies)

    def run():
        source = spark.readStream.schema("strategy long, denominator long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = source.writeStream.foreachBatch(sink(t, add, "s")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    want = {}
    for k in range(6):
        for i in range(60):
            want[i % 40] = want.get(i % 40, 0) + 100 * k + i
    assert plain(t) == {s: (n, False) for s, n in want.items()}
    assert t.version() == 6


def test_a_second_writer_is_not_overwritten(spark, tmp_path, monkeypatch):
    t = ledger(spark, tmp_path / "t")
    t.upsert(batch(spark, (1, 1)), records.register_trials)
    real, raced = versioned.VersionedTable.publish, []

    def slow(self, said, version):
        if not raced:
            raced.append(1)
            other = threading.Thread(target=lambda: ledger(spark, tmp_path / "t").upsert(batch(spark, (2, 2)), records.register_trials))
            other.start()
            other.join()
        real(self, said, version)

    monkeypatch.setattr(versioned.VersionedTable, "publish", slow)
    assert t.upsert(batch(spark, (1, 9), (3, 3)), records.register_trials) == 3
    assert plain(t) == {1: (9, False), 2: (2, False), 3: (3, False)}
    raced.clear()
    with pytest.raises(Conflict):
        t.upsert(batch(spark, (1, 10)), records.register_trials, attempts=1)
    assert plain(t)[1] == (9, False)


def test_second_run_takes_what_changed_failed_or_is_forced(spark, tmp_path):
    t = processed.state_table(spark, str(tmp_path / "s"), 4)
    make = lambda *rows: spark.createDataFrame(list(rows), "source string, text string")
    first = make(("a", "x"), ("b", "y"), ("c", None), ("d", "z"), ("d", "z"), (None, "n"))
    todo = {r.source: (r.why, r.attempt) for r in processed.pending(first, t.read()).collect()}
    assert todo == {k: ("new", 1) for k in "abcd"}
    done = processed.pending(first, t.read()).selectExpr("source", "hash", "case source when 'b' then 'failed' when 'd' then 'started' else 'done' end status", "attempt", "timestamp'2024-01-01' at")
    assert processed.record(t, done) == 1
    second = make(("a", "x"), ("b", "y"), ("c", "new text"), ("d", "z"), ("e", "w"))
    got = {r.source: (r.why, r.attempt) for r in processed.pending(second, t.read()).collect()}
    assert got == {"b": ("retry", 2), "c": ("changed", 1), "d": ("retry", 2), "e": ("new", 1)}
    forced = {r.source: r.why for r in processed.pending(second, t.read(), F.col("source") == "a").collect()}
    assert forced["a"] == "forced" and len(forced) == 5
    again = spark.createDataFrame([("b", 3)], "source string, attempt int").selectExpr("source", f"'{'0' * 64}' hash", "'failed' status", "attempt", "timestamp'2024-01-02' at")
    hashes = {r.source: r.hash for r in t.read().collect()}
    processed.record(t, again.withColumn("hash", F.lit(hashes["b"])))
    assert "b" not in {r.source for r in processed.pending(second, t.read()).collect()}  # given up after three attempts
    late = again.withColumns({"hash": F.lit(hashes["b"]), "status": F.lit("done"), "attempt": F.lit(1), "at": F.expr("timestamp'2023-01-01'")})
    processed.record(t, late)
    assert {r.source: r.status for r in t.read().collect()}["b"] == "failed"
    assert processed.pending(second.limit(0), t.read()).count() == 0
