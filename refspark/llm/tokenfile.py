"""Token-id files: Simple-8b words with escapes and per-block offsets, decoded by whole arrays.

Layout, as Parquet rows. A row is a run of whole documents, about `row_ids` ids: `part` and `seq` order the rows,
`before` counts the ids of its part in earlier rows. Its ids stand one after another, cut into blocks of BLOCK ids.
A 64-bit word has a selector in its top 4 bits: selector k holds COUNTS[k] ids of WIDTHS[k] bits each, the first lowest.
Words do not cross blocks (`block_words`: each block's first word); a block's last word is filled up with zeros. An id of
over ESCAPE_BITS bits stands as 0 and is listed in `escape_at`, `escape_id`.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, cut, new_folder

#: The format's selectors: ids in a word, and bits of an id.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE_BITS = 30
BLOCK = 1024


def encode_ids(ids: np.ndarray) -> dict[str, np.ndarray]:
    """ids (unsigned 64 bits) as words, block_words, escape_at and escape_id."""
    ids = np.asarray(ids, np.uint64)
    at = np.flatnonzero(ids >> np.uint64(ESCAPE_BITS))
    out = {"escape_at": at, "escape_id": ids[at]}
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)
    plain = ids.copy()
    plain[at] = 0
    full = n // BLOCK
    grid[:full, :BLOCK] = plain[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : n - full * BLOCK] = plain[full * BLOCK :]
    bits = np.zeros(grid.shape, np.uint8)  # no plain id has over ESCAPE_BITS bits
    for k in range(ESCAPE_BITS):
        more = grid >= np.uint64(1 << k)
        if not more.any():
            break
        bits += more
    widest = {1: bits}  # the most bits among the next 1, 2, 4 ... ids
    for k in (1, 2, 4, 8, 16):
        widest[2 * k] = np.maximum(widest[k][:, :-k], widest[k][:, k:])
    choice = np.full((blocks, BLOCK), len(COUNTS) - 1, np.int8)
    for k in range(len(COUNTS) - 2, -1, -1):  # the fullest word that holds the next ids wins
        half = 1 << (int(COUNTS[k]).bit_length() - 1)
        rest = int(COUNTS[k]) - half
        most = np.maximum(widest[half][:, :BLOCK], widest[half][:, rest : rest + BLOCK])
        choice[most <= WIDTHS[k]] = k
    size = np.full(blocks, BLOCK)
    if n % BLOCK:
        size[-1] = n % BLOCK
    where, row, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(row):  # the same step in all blocks at once
        starts.append((row, where))
        where = where + COUNTS[choice[row, where]]
        on = where < size[row]
        row, where = row[on], where[on]
    row = np.concatenate([r for r, _ in starts]) if starts else np.empty(0, np.int64)
    where = np.concatenate([w for _, w in starts]) if starts else np.empty(0, np.int64)
    order = np.lexsort((where, row))
    row, where = row[order], where[order]
    chosen = choice[row, where].astype(np.int64) if len(row) else np.empty(0, np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        on = np.flatnonzero(chosen == k)
        shift = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        words[on] |= np.bitwise_or.reduce(grid[row[on, None], where[on, None] + np.arange(COUNTS[k])] << shift, axis=1)
    return out | {"words": words, "block_words": np.searchsorted(row, np.arange(blocks))}


def decode_ids(words: np.ndarray, block_words: np.ndarray, n: int, escape_at: np.ndarray, escape_id: np.ndarray) -> np.ndarray:
    """The n ids, without a loop over words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    blocks = len(block_words)
    of = np.repeat(np.arange(blocks), np.diff(np.append(block_words, len(words))))
    to = of * BLOCK + before - before[block_words][of] if blocks else before
    ids = np.zeros(blocks * BLOCK + 60, np.uint64)
    for k in np.unique(selector)[::-1]:  # what fills up a block's last word lies beyond it and is overwritten below
        on = np.flatnonzero(selector == k)
        place = to[on, None] + np.arange(COUNTS[k])
        value = (words[on, None] >> (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[k])) - 1)
        inside = place < (of[on, None] + 1) * BLOCK
        ids[place[inside]] = value[inside]
    ids = ids[:n]
    ids[escape_at] = escape_id
    return ids


class Encoder:
    """A tokenizer of the tokenizers library over whole texts, with each distinct stretch of a batch encoded once.

    Byte-level pre-tokenization always parts before a space that has a character other than white space on either side, so texts
    are cut there as arrays of bytes, Arrow finds the distinct stretches, and only those are encoded: strung together in long
    strings, for the library parts them again at the same places, and told apart by the bytes that each id stands for. A neighbour
    that could end or begin a white space character outside ASCII gives no cut, which only makes a stretch longer. Texts with the
    string of an added token, and all texts of a file with another pre-tokenizer or a normalizer, are encoded whole. The first KNOWN
    short stretches that a worker meets stay with their ids, for all its later batches and tasks; what isn't among them is encoded.
    """

    #: Bytes of stretches in one string, and strings in one call: the library holds some hundred bytes for each id of a call.
    STRING, STRINGS = 1000, 320
    #: Stretches that stay, some 50 bytes each with their ids and as many while a batch looks them up, and the most bytes of one.
    KNOWN, SHORT = 400_000, 64

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core: threads of the library's own would only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        said = json.loads(self.tokenizer.to_str())
        how = said.get("pre_tokenizer") or {}
        self.parts = how.get("type") == "ByteLevel" and not how.get("add_prefix_space") and how.get("use_regex", True) and not said.get("normalizer")
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        self.bytes = np.fromiter((len(self.tokenizer.id_to_token(i) or "") for i in range(size)), np.int64, size)  # a letter of a byte-level token is a byte
        self.known = pa.array([], pa.large_binary())
        self.known_ids = pa.array([], pa.large_list(pa.uint32()))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for k in range(0, len(texts), self.STRINGS) for e in self.tokenizer.encode_batch_fast(texts[k : k + self.STRINGS], add_special_tokens=False)]

    def encode(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. texts: no nulls; what isn't UTF-8 is read as replacement characters."""
        pa.default_memory_pool().release_unused()  # what the batch before has left
        try:
            texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.large_binary())
        whole = np.full(len(texts), not self.parts)
        for content in self.added:
            whole |= pc.match_substring(texts, content.encode()).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        plain, odd = np.flatnonzero(~whole), np.flatnonzero(whole)
        ids, counts[plain] = self._stretches(texts if not len(odd) else texts.take(pa.array(plain)))
        if not len(odd):
            return ids, counts
        own = self._library([t.decode("utf-8", "replace") for t in texts.take(pa.array(odd)).to_pylist()])
        counts[odd] = list(map(len, own))
        out, kind = np.empty(counts.sum(), np.uint32), np.repeat(whole, counts)
        out[~kind], out[kind] = ids, np.concatenate(own)
        return out, counts

    def _stretches(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        edge = np.zeros(len(b) + 1, bool)
        edge[at] = True
        safe = (b > 0x20) & (b != 0x7F)
        before = safe.copy()  # by the last byte: not if two or three bytes back stands a byte that leads to white space
        before[1:] &= (b[:-1] != 0xC2) | (b[1:] < 0x80)
        before[2:] &= ((b[:-2] != 0xE1) & (b[:-2] != 0xE2) & (b[:-2] != 0xE3)) | (b[2:] < 0x80)
        after = safe & (b != 0xC2) & (b != 0xE1) & (b != 0xE2) & (b != 0xE3)
        if len(b) > 2:
            edge[1 : len(b) - 1] |= (b[1:-1] == 0x20) & before[:-2] & after[2:]
        cuts = np.flatnonzero(edge)
        stretches = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(b)]).dictionary_encode()
        ids, edges = self._distinct(stretches.dictionary)
        which = stretches.indices.to_numpy()
        got = pa.LargeListArray.from_arrays(pa.array(edges), pa.array(ids)).take(stretches.indices)
        total = np.append(0, np.cumsum((edges[1:] - edges[:-1])[which]))
        return got.flatten().to_numpy(), np.diff(total[np.searchsorted(cuts, at)])

    def _distinct(self, stretches: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these stretches and where each one's begin: those that have stayed from earlier batches aren't encoded again."""
        at = pc.index_in(stretches, value_set=self.known)
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        new = stretches.filter(pa.array(fresh))
        ids, edges = self._encoded(new)
        own = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(ids, pa.uint32()))
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[fresh] = len(self.known) + np.arange(len(new))
        got = pa.concat_arrays([self.known_ids, own]).take(pa.array(place))
        if len(self.known) < self.KNOWN:
            stay = pa.array(np.flatnonzero(pc.binary_length(new).to_numpy() <= self.SHORT)[: self.KNOWN - len(self.known)])
            self.known, self.known_ids = pa.concat_arrays([self.known, new.take(stay)]), pa.concat_arrays([self.known_ids, own.take(stay)])
        return got.flatten().to_numpy(), got.offsets.to_numpy() - got.offsets[0].as_py()

    def _encoded(self, stretches: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these stretches and where each one's begin. Those that start and end like a cut are encoded together."""
        n = len(stretches)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        at = np.frombuffer(stretches.buffers()[1], np.int64)[: n + 1]
        raw = np.frombuffer(stretches.buffers()[2] or b"", np.uint8)[: at[-1]]
        head, second, last = raw[at[:-1]], raw[np.minimum(at[:-1] + 1, len(raw) - 1)], raw[at[1:] - 1]
        ok = (np.diff(at) > 1) & (head == 0x20) & (second > 0x20) & (second < 0x7F) & (last > 0x20) & (last < 0x7F)  # others are encoded alone
        tied, lone = np.flatnonzero(ok), np.flatnonzero(~ok)
        counts = np.zeros(n, np.int64)
        own: list[np.ndarray] = []
        if len(tied):
            joined = stretches.take(pa.array(tied))
            to = np.frombuffer(joined.buffers()[1], np.int64)[: len(tied) + 1]
            text = np.frombuffer(joined.buffers()[2], np.uint8)[: to[-1]].tobytes()
            stops = np.unique(np.append(np.searchsorted(to, np.arange(0, to[-1], self.STRING)), len(tied)))
            got = np.concatenate(self._library([text[to[i] : to[j]].decode("utf-8", "replace") for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]))
            ends = np.searchsorted(np.append(0, np.cumsum(self.bytes[got])), to)
            counts[tied] = np.diff(ends)
            own.append(got)
        if len(lone):
            alone = self._library([t.decode("utf-8", "replace") for t in stretches.take(pa.array(lone)).to_pylist()])
            counts[lone] = list(map(len, alone))
            own += alone
        edges = np.append(0, np.cumsum(counts))
        out, kind = np.empty(edges[-1], np.uint32), np.repeat(ok, counts)
        if len(tied):
            out[kind] = own.pop(0)
        if own:
            out[~kind] = np.concatenate(own)
        return out, edges


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(file)


ROWS = (
    "part int, seq bigint, before bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, "
    "words binary, block_words array<int>, escape_at array<bigint>, escape_id array<bigint>"
)


#: Bytes of text that a writing task encodes at a time: a worker's arrays take some forty times as much.
TEXT_BYTES = 4 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", row_ids: int = 1 << 18) -> None:
    """Write docs' ids, each document closed by end_id, in ascending doc_id order (null first; repeated ids by their text's hash).

    One range shuffle of the texts; a part is encoded as a stream, so a task holds about TEXT_BYTES of texts and their ids. Null texts
    are empty, repeated rows are each written, an empty table gives no rows. A document longer than row_ids makes a row of its own.
    Only doc_id and text are read, so other columns' names can't clash.
    """
    kinds = to_arrow_schema(T._parse_datatype_string(ROWS))
    ordered = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part, seq, before = TaskContext.get().partitionId(), 0, 0

        def row(names: pa.Array, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal seq, before
            packed = encode_ids(ids)
            values = [part, seq, before, len(ids), names.to_pylist(), counts, packed["words"].tobytes(), packed["block_words"], packed["escape_at"], packed["escape_id"].astype(np.int64)]
            seq, before = seq + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds, strict=True)], schema=kinds)

        def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.concat_arrays([b.column(0) for b in held])
            ids, counts = encode(pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in held]))
            whole = np.full(len(ids) + len(counts), end_id, np.uint64)
            stop = np.cumsum(counts + 1)
            whole[np.delete(np.arange(len(whole)), stop - 1)] = ids
            first = 0
            while first < len(counts):
                start = stop[first] - counts[first] - 1
                end = min(int(np.searchsorted(stop, start + row_ids)) + 1, len(counts))
                yield row(names[first:end], counts[first:end] + 1, whole[start : stop[end - 1]])
                first = end

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TEXT_BYTES:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    ordered.mapInArrow(run, ROWS).write.parquet(path)


#: Parts of a file whose starts are broadcast; those of more are joined by a shuffle.
PARTS = 100_000


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (over all its ids as little-endian 32-bit integers), from the files.

    The starts of the parts, one small row for each, are summed in Spark; they are broadcast if there are at most PARTS.
    """
    from pyspark.sql import Window as W

    rows = spark.read.schema(ROWS).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = cut(parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first")), "starts")
    small = first.count() <= PARTS
    placed = rows.join(F.broadcast(first) if small else first, "part").withColumn("before", F.col("before") + F.col("first")).drop("first", "part", "seq")
    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    kinds = to_arrow_schema(T._parse_datatype_string(out))
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(i)[k] for i, c in enumerate(names)}
                array = lambda c: r[c].values.to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                counts = array("counts")
                ids = decode_ids(np.frombuffer(r["words"].as_py(), np.uint64), array("block_words"), r["n_ids"].as_py(), array("escape_at"), array("escape_id").view(np.uint64))
                raw = memoryview(ids.astype("<u4").tobytes())
                stop = np.cumsum(counts)
                start = stop - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([r["doc_ids"].values.cast(kinds[0].type), *[pa.array(x, f.type) for x, f in zip((start + r["before"].as_py(), counts, crc), list(kinds)[1:], strict=True)]], schema=kinds)

    return placed.mapInArrow(run, out)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The row of each document that op4's contract asks for: written in this format, and read back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
