import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from refspark.llm import packing as p

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, found, length, end_id=0):
    """Every document's pieces make it up, and every sequence but the last is full and gapless."""
    encode = Tokenizer.from_file(FILE).encode
    want = sorted(((i, [*encode(t or "", add_special_tokens=False).ids, end_id]) for i, t in rows), key=str)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append(r)
    total = sum(len(ids) for _, ids in want)
    assert sorted(by) == list(range(-(-total // length)))
    for s, pieces in by.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) == (length if s < max(by) else total - length * s)
    stream = sorted(found, key=lambda r: (r.sequence_id, r.offset))
    docs, k = [], 0
    while k < len(stream):  # in the stream a document's pieces lie one after another
        r, n, crc = stream[k], 0, []
        while n < r.doc_tokens:
            assert (stream[k].doc_id, stream[k].start, stream[k].doc_tokens) == (r.doc_id, n, r.doc_tokens)
            crc.append((n, stream[k].length, stream[k].ids_crc32))
            n += stream[k].length
            k += 1
        assert n == r.doc_tokens
        docs.append((r.doc_id, n, crc))
    rest = list(want)
    for i, n, crc in docs:
        at = next(k for k, (j, ids) in enumerate(rest) if j == i and len(ids) == n and all(zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes()) == c for a, size, c in crc))
        rest.pop(at)
    assert not rest


TEXTS = [None, "", "one", "word " * 700, "naïve café\n\n" * 300, "x", "<|endoftext|> y", "日本語 " * 100, *["copy of it " * 40] * 5]


@pytest.mark.parametrize(("length", "row_ids"), [(1024, 1 << 18), (64, 50), (1, 10), (7, 1)])
def test_pieces_against_the_library(spark, tmp_path, length, row_ids):
    rows = [(3 * i - 4, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (-4, "again"), (-4, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'q' as ids", "2 as before").repartition(3)
    p.write_stream(docs, str(tmp_path / "s"), FILE, row_ids=row_ids)
    stream = p.placed(spark, str(tmp_path / "s"))
    found = p.boundaries(stream, length).collect()
    check(rows, found, length)
    own = {r.sequence_id: r for r in p.sequences(stream, length, pad_id=9).collect()}
    for r in found:
        ids = np.frombuffer(own[r.sequence_id].ids, "<u4")[r.offset : r.offset + r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
    for r in own.values():
        power = r.n_ids & (r.n_ids - 1) == 0
        assert len(r.ids) == 4 * (r.n_ids if power else length) and set(np.frombuffer(r.ids, "<u4")[r.n_ids :]) <= {9}


def test_whole_table_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], p.packing_digest(docs, FILE).collect(), 1024)
    assert p.packing_digest(docs.limit(0), FILE).count() == 0
    whole, edges = p.pack(docs.filter("doc_id < 20"), FILE, end_id=2, length=128)
    assert whole.agg({"n_ids": "sum"}).first()[0] == edges.agg({"length": "sum"}).first()[0]


def test_wide_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([("a", "some words"), ("b", "more")], "doc_id string, text string")
    p.write_stream(docs, str(tmp_path / "s"), FILE, end_id=70_000)
    r = p.sequences(p.placed(spark, str(tmp_path / "s")), 16).first()
    assert list(np.frombuffer(r.ids, "<u4")).count(70_000) == 2 and {x.doc_id for x in p.boundaries(p.placed(spark, str(tmp_path / "s"))).collect()} == {"a", "b"}
