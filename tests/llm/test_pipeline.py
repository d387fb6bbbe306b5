import zlib

import numpy as np

import corpus_pipeline as c
from refspark.llm import pieces, quality
from test_decontam import brute as contamination
from test_secrets import brute as secret_spans
from test_jaccard import groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in c.run(spark, SF).collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {}
    for i, t in rows.items():
        n, _, _, _, repeated, features = quality.statistics(t.encode())
        if not quality.base_failed(n, repeated) and model.score(np.array([features]))[0] <= 0:
            kept[i] = t
    ids = sorted(kept)
    kept = {i: kept[i] for i, g in groups([(i, kept[i]) for i in ids]).items() if i == g}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, *_, hit in contamination(list(kept.items()), items) if not hit} <= got.keys() <= kept.keys()
    left = [(i, r.text) for i, r in got.items()]
    assert not any(hit for *_, hit in contamination(left, items))
    assert not any(x[1] < 3 for _, t in left for x in secret_spans(t))
    v = pieces.Vocabulary(c.SENTENCEPIECE_FILE)
    clean = {i for i, *_, hit in contamination(list(kept.items()), items) if not hit}
    for i, r in got.items():
        assert r.n_chars == len(r.text) and r.round_trip
        if i in clean and not secret_spans(kept[i]):
            assert r.text == kept[i]
        ids = v.encode(r.text)
        assert r.ids_crc32 == zlib.crc32(ids) and r.piece_ids == np.frombuffer(ids, "<i4").tolist()


def test_stages_keep_columns_and_stand_nulls(spark):
    wide = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as kept", "'x' as secrets", "2 as n_hit", "3 as fp", "4 as features", "5 as spans").limit(60)
    odd = wide.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars", "kept", "secrets", "n_hit", "fp", "features", "spans")
    docs = wide.unionByName(odd).unionByName(odd).unionByName(wide.limit(5))
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == wide.columns
        assert docs.select("secrets", "kept").distinct().collect() == [("x", 1)]
    assert set(wide.columns) <= set(c.STAGES[-1][1](spark, docs, SF).columns)
    empty = wide.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0
