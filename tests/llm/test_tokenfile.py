import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from refspark.llm import tokenfile as t

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("top", [1, 2, 9, 300, 50_000, 2**20, 2**40, 2**63])
def test_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 59, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64)
        ids[rng.random(n) < 0.5] //= np.uint64(7)
        p = t.encode_ids(ids)
        assert (t.decode_ids(p["words"], p["block_words"], n, p["escape_at"], p["escape_id"]) == ids).all()


def test_mixed_widths_round_trip():
    rng = random.Random(2)
    ids = np.array([rng.getrandbits(rng.randint(1, 64)) for _ in range(4000)], np.uint64)
    p = t.encode_ids(ids)
    assert (t.decode_ids(p["words"], p["block_words"], len(ids), p["escape_at"], p["escape_id"]) == ids).all()
    small = t.encode_ids(np.ones(6000, np.uint64))
    assert len(small["words"]) == 5 * 18 + 15  # 1024 ids in words of 60; at last 880


def test_stretches_encode_as_the_whole_text():
    rng = random.Random(4)
    plain = Tokenizer.from_file(FILE)
    some = ["a", "É", " ", "  ", "\n", "\t", "don't", "12", "...", "!!", "\u00a0", "\u3000", "\u2009", "\u1680", "\u0085", "\x1c", "x y", "<|endoftext|>", "日本", "かな", "'s", "\r\n", " ", "_", "e\u0301"]
    said = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encoder = t.Encoder(FILE)
    for batch in (said[:300], said[300:], said[:1], ["", ""], []):
        ids, counts = encoder.encode(pa.array([x.encode() for x in batch], pa.large_binary()))
        assert len(counts) == len(batch)
        stop = np.cumsum(counts)
        for text, a, b in zip(batch, stop - counts, stop, strict=True):
            assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    ids, counts = encoder.encode(pa.array([b"a \xff b", b"c"], pa.large_binary()))
    assert ids.tolist() == [*plain.encode("a \ufffd b").ids, *plain.encode("c").ids] and counts.sum() == len(ids)


def test_known_stretches_are_not_encoded_again():
    rng = random.Random(5)
    plain = Tokenizer.from_file(FILE)
    words = [bytes(rng.choice(b"abcdefg") for _ in range(rng.randint(1, 9))).decode() for _ in range(400)] + ["w" * 90, "É", "don't"]
    encoder, sent = t.Encoder(FILE), []
    encoder.KNOWN = 300
    library = encoder._library
    encoder._library = lambda texts: sent.append(sum(map(len, texts))) or library(texts)
    for k in range(4):
        said = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
        before = sum(sent)
        ids, counts = encoder.encode(pa.array([x.encode() for x in said], pa.large_binary()))
        stop = np.cumsum(counts)
        assert all(ids[b - n : b].tolist() == plain.encode(x, add_special_tokens=False).ids for x, n, b in zip(said, counts, stop, strict=True))
        if k:
            assert sum(sent) - before < 0.6 * sent_first
        else:
            sent_first = sum(sent)
    assert len(encoder.known) == len(encoder.known_ids) == 300


PEAK = """
import random, resource, sys
import pyarrow as pa
from refspark.llm import tokenfile as t
rng = random.Random(8)
words = ["".join(rng.choice(["the", "ation", "é", "qu", "ing", "z"]) for _ in range(rng.randint(1, 8))) for _ in range(500_000)]
text = [" ".join(rng.choices(words, k=500)).encode() for _ in range(8000)]
encoder, used, batch, size = t.Encoder(sys.argv[1]), lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, [], 0
before = used()
for x in text:
    batch.append(x)
    size += len(x)
    if size >= t.TEXT_BYTES:
        encoder.encode(pa.array(batch, pa.large_binary()))
        batch, size = [], 0
print(used() - before)
"""


def test_a_worker_takes_bounded_memory():
    """An executor of 3,000 MB holds two workers beside its heap."""
    said = subprocess.run([sys.executable, "-c", PEAK, FILE], cwd=Path(t.__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(said.stdout) < 200, said.stdout


def test_digest(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of\n", "É", "  x", "7"]) for _ in range(rng.randint(0, 50)))) for i in range(120)] + [(500, None), (501, ""), (499, "w " * 40_000), (7, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as words", "3 as part").repartition(5)
    got = sorted(map(tuple, t.token_digest(frame, FILE).collect()))
    plain, at, want = Tokenizer.from_file(FILE), 0, []
    kept = {r[1]: r for r in got if r[0] == 7}
    for i, x in sorted(rows, key=lambda r: (r[0], kept and r[0] == 7 and kept.get(0, (0, 0, 0))[2] or 0)):
        ids = [*plain.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    once = lambda found: [r for r in found if r[0] != 7]  # noqa: E731  the two rows of one id may stand either way
    assert once(got) == sorted(once(want))
    assert sorted(r[2:] for r in got if r[0] == 7) == sorted(r[2:] for r in want if r[0] == 7)
    assert t.token_digest(frame.limit(0), FILE).count() == 0
