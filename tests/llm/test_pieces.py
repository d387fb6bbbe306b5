import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from refspark.llm import pieces as p

FILE = public_tokenizers.path("piece_bpe_32k.model")


def library():
    """The library's own best-path encoder over the same pieces and scores."""
    v, m = p.Vocabulary(FILE), pb.ModelProto()
    m.ParseFromString(open(FILE, "rb").read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for x in m.pieces:
        if x.piece in v.score:
            x.score = v.score[x.piece] / p.UNIT
    return v, sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts(seed, n):
    rng = random.Random(seed)
    some = ["the", "ation", "é", "日本", " ", " ", "  ", "\n", "\t", "Zz", "😀", "123", "▁", "á", "qu", "ing", "\0", "aaaa"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_best_score_is_the_librarys():
    v, sp = library()
    for t in texts(1, 400):
        ids = np.frombuffer(v.encode(t), "<u4")
        assert v.decode(ids).decode() == t.replace("▁", " ")
        total = lambda some: sum(sp.get_score(i) for i in some if i not in v.byte.values())
        theirs = sp.encode(t)
        assert abs(total(ids.tolist()) - total(theirs)) < 1e-2, t
        assert sum(i in v.byte.values() for i in ids.tolist()) == sum(i in v.byte.values() for i in theirs)


def sequential(v, text):
    """word() over each word of the marked text, one after another."""
    return b"".join(v.word(w)[0] for w in p._WORD.findall(p.MARK + text.replace(" ", p.MARK))) if text else b""


def test_words_together_as_one_by_one():
    v = p.Vocabulary(FILE)
    some = [*texts(5, 500), "a" * 63, "a" * 64, "b" * 65, "日本語" * 30, "", " ", "   ", "😀😀", "x  y", "\n \n"]
    got, counts, scores = v.encode_all(pa.array([t.replace(p.MARK, " ").encode() for t in some], pa.large_binary()))
    stop = np.cumsum(counts)
    for t, a, b, score in zip(some, stop - counts, stop, scores, strict=True):
        marked = p.MARK + t.replace(" ", p.MARK)
        assert got[a:b].astype("<u4").tobytes() == sequential(v, t), t
        assert score == (sum(v.word(w)[1] for w in p._WORD.findall(marked)) if t else 0)
    assert v.decode_all(got, counts) == [t.replace(p.MARK, " ").encode() for t in some]


def test_a_batch_takes_bounded_memory():
    """An executor of 3,000 MB holds two workers beside its heap."""
    v, rng = p.vocabulary(FILE), random.Random(6)
    words = ["".join(rng.choice(["the", "ation", "é", "qu", "ing", "z"]) for _ in range(rng.randint(1, 8))) for _ in range(200_000)]
    text, size = [], 0
    while size < p.TEXT_BYTES:
        text.append(" ".join(rng.choices(words, k=500)))
        size += len(text[-1].encode())
    batch = pa.array([t.encode() for t in text], pa.large_binary())
    tracemalloc.start()
    got, counts, _ = v.encode_all(batch)
    found = p._results(v, batch, got, counts, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(found[2]) and peak < 100e6, peak


def test_scan_is_exact_and_associative():
    v = p.Vocabulary(FILE)
    for t in filter(None, texts(2, 60) + ["a" * 300, "日本語" * 60, "x y " * 40, "in" * 90]):
        marked = p.MARK + t.replace(" ", p.MARK)
        whole = sum(v.word(w)[1] for w in p._WORD.findall(marked))
        for size in (1, 5, 16, 17, 50):
            parts = [(marked[k : k + size], marked[k + size : k + size + v.states - 1]) for k in range(0, len(marked), size)]
            ms = [v.matrix(*x) for x in parts]
            left = ms[0]
            for m in ms[1:]:
                left = p.combine(left, m)
            assert left[0, 0] == whole
            right = ms[-1]
            for m in ms[-2::-1]:
                right = p.combine(m, right)
            assert right[0, 0] == whole
            before = [np.array(v._unit(0), np.int64)]
            for m in ms:
                before.append(p.through(before[-1], m))
            leave, out = 0, b""
            for x, b, after in zip(parts[::-1], before[-2::-1], before[:0:-1], strict=True):
                out = v.trace(*x, b.tolist(), leave) + out
                leave = v.entries(*x, b.tolist(), after)[leave]
            assert leave == 0 and out == sequential(v, t)


def test_digest_and_decode(spark):
    rows = list(enumerate([*texts(3, 40), None, "", "a" * 500, "the cat " * 100, " ".join(texts(4, 30)), "in" * 3000, "日本" * 900, "same", "same"]))
    docs = spark.createDataFrame([(i, t, 1, 2, "n", 3) for i, t in rows], "doc_id long, text string, piece_ids int, n_pieces int, __text string, __row int")
    v = p.Vocabulary(FILE)
    whole = {r.doc_id: r for r in p.piece_digest(docs.union(docs), FILE).collect()}
    for i, t in rows:
        ids = sequential(v, t or "")
        assert tuple(whole[i]) == (i, len(ids) // 4, zlib.crc32(ids), True)
    for chunk in (1, 64, 1000):
        coded = p.encode(docs if chunk > 1 else docs.filter("doc_id < 20"), FILE, chunk=chunk, ids=True)
        assert coded.columns == ["doc_id", "text", "__text", "__row", "n_pieces", "ids_crc32", "round_trip", "piece_ids"]
        back = {r.doc_id: r.text for r in p.decode(coded, FILE, keep=["doc_id"]).collect()}
        found = coded.collect()
        assert len(found) == (len(rows) if chunk > 1 else 20) and all(r.round_trip for r in found)
        for r in found:  # however a text is cut, its ids are the same
            assert np.array(r.piece_ids, "<u4").tobytes() == sequential(v, rows[r.doc_id][1] or "") and r.n_pieces == len(r.piece_ids)
            assert back[r.doc_id] == (rows[r.doc_id][1] or "").replace(p.MARK, " ")
    assert p.piece_digest(docs.limit(0), FILE).count() == 0
