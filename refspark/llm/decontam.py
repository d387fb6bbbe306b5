"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a run of documents of about `shard_words` words. Its words are mapped to the
phrases' vocabulary (a run of words that no phrase has is one separator), its suffixes are
sorted, and the Burrows-Wheeler transform is kept in a wavelet matrix. All test phrases are
searched backward together through the matrix's ranks; an occurrence is located by walking
to the next sampled suffix position; the removal spans are the union of the occurrences.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, cut, text_bytes

#: A-Z to a-z; what is no word byte to a space. Bytes from 0x80 are parts of word characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
#: A word in a text whose case has not been folded.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OTHER = 1


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (8 + -len(packed) % 8), np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.n = len(bits)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """A sequence of symbols below 2**depth, with the rank of any symbol at any position."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.levels, self.zeros = depth, [], []
        for k in range(depth - 1, -1, -1):
            bit = ((symbols >> k) & 1).astype(bool)
            level = Bits(bit)
            self.levels.append(level)
            self.zeros.append(level.n - level.ones)
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        every = np.arange(1 << depth)
        self.start = self._down(every, np.zeros(len(every), np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = level.rank(i)
            i = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, i) - self.start[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, one = level.get(i), level.rank(i)
            i = np.where(bit, zeros + one, i - one)
            symbol = symbol * 2 + bit
        return symbol, i - self.start[symbol]


def suffix_array(symbols: np.ndarray, ends: np.ndarray, alphabet: int) -> np.ndarray:
    """Order of all suffixes. ends: positions of the documents' end marks, the last symbol among them; each mark is unlike any other symbol.

    A first sort by as many symbols as a 63-bit key holds, then prefix doubling over the suffixes that are still tied.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width = int(len(ends) + alphabet).bit_length()
    h = max(1, 62 // width)
    padded = np.concatenate((rank, np.zeros(h, np.int64)))
    key = padded[:n].copy()
    for j in range(1, h):
        key <<= width
        key |= padded[j : j + n]
    order = np.argsort(key)
    tied = np.arange(n)
    key, part = key[order], order
    while True:
        first = np.empty(len(tied), bool)
        first[:1] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        group = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        rank[part] = group
        alone = first & np.append(first[1:], True)
        tied, part, group = tied[~alone], part[~alone], group[~alone]
        if not len(tied):
            return order
        key = (group << 31) | rank[part + h]
        move = np.argsort(key)
        key, part = key[move], part[move]
        order[tied] = part
        h *= 2


class FMIndex:
    """An index of one shard. symbols: all documents' symbols (OTHER or more), each document closed by a 0."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, alphabet: int, sample: int = 8):
        self.n = n = len(symbols)
        order = suffix_array(symbols, ends, alphabet)
        self.matrix = WaveletMatrix(symbols[order - 1].astype(np.int64), max(1, int(alphabet).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << self.matrix.depth))))
        first = np.zeros(n, bool)
        first[0] = True
        first[ends[:-1] + 1] = True
        sampled = (order % sample == 0) | first[order]
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases: symbols, right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1]):
            live = live[(low[live] < high[live]) & (lengths[live] > j)]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - j]
            low[live] = self.before[c] + self.matrix.rank(c, low[live])
            high[live] = self.before[c] + self.matrix.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        found, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.sampled.get(rows)
            found[left[done]] = self.positions[self.sampled.rank(rows[done])] + steps
            left, rows = left[~done], rows[~done]
            c, k = self.matrix.symbol_and_rank(rows)
            rows = self.before[c] + k
            steps += 1
        return found


class Phrases:
    """Test items cut to windows of `window` words (a shorter item is one window), as symbols of their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        index: dict[tuple[int, ...], int] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + OTHER + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                at = index.setdefault(tuple(ids[k : k + window]), len(self.items))
                if at == len(self.items):
                    self.items.append(set())
                if item is not None:
                    self.items[at].add(item)
        self.lengths = np.array([len(x) for x in index], np.int64)
        self.symbols = np.zeros((len(index), window), np.int64)
        for k, x in enumerate(index):
            self.symbols[k, window - len(x) :] = x

    def occurrences(self, shard: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Start, as a word's number over all documents of the shard, and phrase of each occurrence. shard: each document's word symbols."""
        every = np.concatenate([*shard, np.empty(0, np.int32)])
        if not len(self.items) or not len(every):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stops = np.cumsum([len(x) for x in shard])
        text = np.insert(every, stops, 0)
        marks = stops + np.arange(len(shard))
        word = np.arange(len(text)) - np.searchsorted(marks, np.arange(len(text)), "left")
        kept = np.ones(len(text), bool)
        kept[1:] = (text[1:] != OTHER) | (text[:-1] != OTHER)
        text, word = text[kept], word[kept]
        index = FMIndex(text, np.flatnonzero(text == 0), len(self.vocabulary) + OTHER + 1)
        low, high = index.search(self.symbols, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return word[index.locate(rows)], phrase


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words, in code points, end exclusive."""
    found, at, open_ = [], 0, False
    for k, m in enumerate(_WORD.finditer(text.decode("utf-8", "replace"))):
        if hit[k]:
            if open_:
                found[-1]["end"] = m.end()
            else:
                found.append({"start": m.start(), "end": m.end()})
        open_ = bool(hit[k])
    return found


RESULT = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"
#: Word runs hit so far, as first and past-last word of each in turn; carried between blocks of phrases.
_RUNS = "__runs array<bigint>"


def _search_block(docs: DataFrame, text: str, phrases, shard_words: int, spans: bool, drop_text: bool) -> DataFrame:
    """docs with RESULT and _RUNS; those that docs already has, from earlier blocks, are added to."""
    new = T._parse_datatype_string(f"{RESULT}, {_RUNS}")
    again = "__runs" in docs.columns
    names = [c for c in docs.columns if c not in new.names and not (drop_text and c == text)]
    schema = T.StructType([docs.schema[c] for c in names] + list(new.fields))
    kinds = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = phrases.value
        get = p.vocabulary.get

        def flush(held: list, shard: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            start, phrase = p.occurrences(shard)
            sizes = np.array([len(x) for x in shard], np.int64)
            stops = np.cumsum(sizes)
            edge = np.zeros(int(sizes.sum()) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + p.lengths[phrase], -1)
            items: dict[int, set[str]] = defaultdict(set)
            where = np.searchsorted(stops, start, "right")
            for d, k in np.unique(np.stack((where, phrase), 1), axis=0).tolist() if len(start) else []:
                items[d] |= p.items[k]
            at = 0
            for _, _, earlier in held:
                for ids, runs in earlier:
                    items[at].update(ids) if ids else None
                    for k, r in enumerate(runs):
                        edge[stops[at] - sizes[at] + r] += 1 - 2 * (k & 1)
                    at += 1
            hit = np.cumsum(edge[:-1]) > 0
            at = 0
            for batch, raw, _ in held:
                out = [[], [], [], [], []]
                for t in raw:
                    own = hit[stops[at] - sizes[at] : stops[at]]
                    n = int(own.sum())
                    row = (int(sizes[at]), n, sorted(items.get(at, ())), _spans(t, own) if spans and n else [], np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist() if n else [])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names + new.names)

        held, shard, size = [], [], 0
        for batch in batches:
            raw = text_bytes(batch.column(text))
            for t in raw:
                found = words(t)
                shard.append(np.fromiter(map(get, found, repeat(OTHER)), np.int32, len(found)))
                size += len(found)
            earlier = list(zip(batch.column("item_ids").to_pylist(), batch.column("__runs").to_pylist(), strict=True)) if again else []
            held.append((batch.select(names), raw if spans else [b""] * len(raw), earlier))
            if size >= shard_words:
                yield from flush(held, shard)
                held, shard, size = [], [], 0
        if held:
            yield from flush(held, shard)

    return docs.mapInArrow(run, schema)


def blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The test items in lists of about block_bytes of text, streamed: the driver holds one list at a time, however many items there are."""
    held, size = [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        held.append((row[0], (row[1] or "").encode("utf-8", "replace")))
        size += len(held[-1][1]) + 100
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = 1 << 20, block_bytes: int = 4 << 20, spans: bool = True, keep_text: bool = True) -> DataFrame:
    """docs, without a shuffle, and n_words, n_hit (words inside an occurrence), item_ids (sorted as strings) and spans (to remove; code points, end exclusive; empty unless `spans`).

    Null and empty texts have no words. Repeated documents are each searched. Without items, or with items without words,
    nothing is hit. An item whose id is null counts for hits and spans and is not listed; repeated items are one. A document
    longer than shard_words is a shard of its own. Columns of docs that have a result's name are replaced. The phrases are
    broadcast in blocks of about block_bytes, one for each pass over docs; what a pass has found is written before the next, so a task
    has one worker and one block at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.drop(*T._parse_datatype_string(RESULT).names, "__runs")
    parts = blocks(items, item_id, item_text, block_bytes)
    block = next(parts)
    while block is not None:
        then = next(parts, None)
        out = _search_block(out, text, spark.sparkContext.broadcast(Phrases(block, window)), shard_words, spans and then is None, then is None and not keep_text)
        if then is not None:
            out = cut(out, "pass")
        block = then
    return out.drop("__runs")


def remove_spans(text: Column, spans: Column) -> Column:
    """text without the spans, which are sorted and disjoint; null stays null."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring(text, (F.when(k == 0, F.lit(0)).otherwise(spans[k - 1]["end"]) + 1).cast("int"), (F.when(k == F.size(spans), F.length(text)).otherwise(spans[k]["start"]) - F.when(k == 0, F.lit(0)).otherwise(spans[k - 1]["end"])).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(gaps, ""))


def contamination_digest(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The row of each document that op1's contract asks for."""
    found = find_contamination(docs.select(doc_id, "text"), items, spans=False, keep_text=False)
    return found.select(
        doc_id, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
