"""Readers by suffix, panels of both shapes, blocks of factor files, and a stream against its batch twin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from refspark.plans import registry
from refspark.sources import tables as t

SF = "/root/testdata/sf0.01"


def test_readers_and_panels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,x,y\n2020-01-31,1,2\nnot a day,3,4\n2020-02-29,bad,5\n2020-02-29,7,\n")
    wide = t.read_table(spark, str(tmp_path / "a.csv"))
    assert t.infer_date_column(wide, 0.7) == "date"
    got = {(r.ts.date(), r.entity): r.value for r in t.load_panel(wide).collect()}
    assert got.keys() == {(dt.date(2020, m, d), e) for m, d in ((1, 31), (2, 29)) for e in "xy"}
    assert got[dt.date(2020, 1, 31), "y"] == 2.0
    (tmp_path / "b.jsonl").write_text('{"date": "2020-01-01", "ticker": "q", "value": 2}\n{"date": null, "ticker": "q", "value": 3}\n')
    assert [(r.entity, r.value) for r in t.load_panel(t.read_table(spark, str(tmp_path / "b.jsonl"))).collect()] == [("q", 2.0)]
    with pytest.raises(ValueError):
        t.read_table(spark, str(tmp_path / "c.xls"))


def test_factor_blocks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("words\n\n,Mkt,SMB\n202001, 1.50, -99.99\n202002,-2.00,0.50\n\nAnnual, a note\n,Mkt,SMB\n20200131,0.10,0.20\n")
    got = sorted((r.block, r.ts.date().isoformat(), r.name, round(r.value, 6)) for r in t.factor_blocks(spark, str(tmp_path)).collect())
    assert got == [(1, "2020-01-31", "Mkt", 0.015), (1, "2020-02-29", "Mkt", -0.02), (1, "2020-02-29", "SMB", 0.005), (2, "2020-01-31", "Mkt", 0.001), (2, "2020-01-31", "SMB", 0.002)]


def test_factor_blocks_count_within_each_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(",X\n" + "".join(f"2020{m:02d},{m}\n" for m in range(1, 13)) + "\n,Y\n202001,5\n")
    got = t.factor_blocks(spark, str(tmp_path)).groupBy("path", "block", "name").agg(F.count("*").alias("n")).collect()
    assert sorted((r.path[-5:], r.block, r.name, r.n) for r in got) == [(f"{f}.txt", b, x, n) for f in "ab" for b, x, n in ((1, "X", 12), (2, "Y", 1))]


def test_lookahead_without_stamps(spark):
    df = spark.createDataFrame([(1, 2)], "event_id int, decision_time int")
    assert [tuple(r) for r in t.lookahead(df, "event_id").collect()] == [(1, "unverified")]


def test_triage_stream_counts_every_event(spark):
    got = registry.queries()["s2_stream_triage"](spark, SF)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert got.groupBy("day", "signature").count().filter("count > 1").count() == 0
