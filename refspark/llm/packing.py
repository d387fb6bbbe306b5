"""Packing by concatenating and cutting: all documents' ids make one stream, which is cut into windows of a fixed length.

First pass: each task encodes its documents and writes their ids, in rows of whole documents that know how many ids of their part come
before. The parts' totals, one small row each, are summed up to the parts' places in the stream. Second pass: each row, read back, is
cut at the multiples of the window length. A window within a row is whole; of a window that reaches over rows each row writes a fragment,
and only fragments are shuffled. Every piece of a document in a window has a boundary record. No text is shuffled, and only the last window of
all is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, cut, new_folder
from .tokenfile import PARTS, TEXT_BYTES, encoder

#: Ids are held in two bytes each if all of the vocabulary fit, else in four.
ROWS = "part int, before bigint, n_ids bigint, doc_ids array<{}>, counts array<bigint>, width int, ids binary"


def write_stream(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", row_ids: int = 1 << 18) -> None:
    """The ids of all rows of docs, each closed by end_id, as Parquet rows of whole documents: about row_ids ids, or one longer document.

    The stream has the order of docs' partitions and rows. Null texts are empty, repeated rows each have their ids, null doc_ids are kept, an
    empty table gives no rows; other columns of docs aren't read. A task holds about TEXT_BYTES of texts, or one longer text, and their ids.
    """
    fields = ROWS.format(docs.schema[doc_id].dataType.simpleString())
    kinds = to_arrow_schema(T._parse_datatype_string(fields))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer)
        kind = np.dtype("<u2" if max(work.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        part, before = TaskContext.get().partitionId(), 0

        def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal before
            names = pa.concat_arrays([b.column(0) for b in held])
            ids, counts = work.encode(pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in held]))
            whole, stop = np.full(len(ids) + len(counts), end_id, kind), np.cumsum(counts + 1)
            whole[np.delete(np.arange(len(whole)), stop - 1)] = ids
            first = 0
            while first < len(counts):
                start = int(stop[first] - counts[first] - 1)
                end = min(int(np.searchsorted(stop, start + row_ids)) + 1, len(counts))
                n = int(stop[end - 1]) - start
                values = [part, before, n, names[first:end].to_pylist(), counts[first:end] + 1, kind.itemsize, whole[start : start + n].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds, strict=True)], schema=kinds)
                first, before = end, before + n

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TEXT_BYTES:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own.mapInArrow(run, fields).write.parquet(path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stream, `before` counting the ids of the whole stream. The parts' starts are broadcast if there are at most PARTS."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = cut(parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first")), "starts")
    small = first.count() <= PARTS
    return rows.join(F.broadcast(first) if small else first, "part").withColumn("before", F.col("before") + F.col("first")).drop("first", "part")


def pieces_of(before: int, counts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """A row's documents cut at the windows of the stream: doc (number in the row), at (place in the row), start (in the document), length, sequence_id, offset."""
    stop = np.cumsum(counts)
    total = int(stop[-1]) if len(stop) else 0
    edges = np.unique(np.concatenate([stop - counts, np.arange(-before % length, total, length)]))
    doc = np.searchsorted(stop, edges, "right")
    sequence, offset = np.divmod(before + edges, length)
    return {"doc": doc, "at": edges, "start": edges - (stop - counts)[doc], "length": np.diff(np.append(edges, total)), "sequence_id": sequence, "offset": offset}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array, memoryview]]:
    """before, counts, doc_ids and the ids as little-endian 32-bit integers, of each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = {c: batch.column(c)[k] for c in ("before", "counts", "doc_ids", "width", "ids")}
            ids = np.frombuffer(r["ids"].as_py(), f"<u{r['width'].as_py()}").astype("<u4")
            yield r["before"].as_py(), r["counts"].values.to_numpy().astype(np.int64), r["doc_ids"].values, memoryview(ids.tobytes())


def boundaries(stream: DataFrame, length: int = 1024) -> DataFrame:
    """A record of each piece: doc_id, start, length, ids_crc32 (of its ids as little-endian 32-bit integers), doc_tokens, sequence_id, offset."""
    out = f"doc_id {stream.schema['doc_ids'].dataType.elementType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    kinds = to_arrow_schema(T._parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, counts, names, raw in _rows(batches):
            p = pieces_of(before, counts, length)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(p["at"].tolist(), (p["at"] + p["length"]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(p["doc"])).cast(kinds[0].type), *map(pa.array, (p["start"], p["length"], crc, counts[p["doc"]], p["sequence_id"], p["offset"]))], schema=kinds)

    return stream.mapInArrow(run, out)


def sequences(stream: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids (without padding) and ids (little-endian 32-bit) of every window, padded to `length` unless n_ids is a power of two.

    Of a window over several rows of the stream the fragments, at most `length`, meet by a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, _, _, raw in _rows(batches):
            n = len(raw) // 4
            at = np.unique(np.append(0, np.arange(-before % length, n, length))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([(before + a) // length for a in at], pa.int64()), pa.array([(before + a) % length for a in at], pa.int32()), pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(at, [*at[1:], n], strict=True)], pa.binary())], names=["sequence_id", "offset", "ids"])

    windows = cut(stream.mapInArrow(run, "sequence_id bigint, offset int, ids binary"), "windows")
    whole = F.length("ids") == 4 * length
    torn = windows.filter(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    torn = torn.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    every = windows.filter(whole).select("sequence_id", "ids").union(torn).withColumn("n_ids", (F.length("ids") / 4).cast("int"))
    padding = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), length - F.col("n_ids")))
    return every.select("sequence_id", "n_ids", F.when(F.bit_count("n_ids") != 1, F.concat("ids", padding)).otherwise(F.col("ids")).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, pad_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The packed sequences of docs, and their boundary records. Both are read from the one written stream."""
    path = new_folder(docs.sparkSession, "stream")
    write_stream(docs, path, tokenizer, end_id, doc_id, text)
    stream = placed(docs.sparkSession, path)
    return sequences(stream, length, pad_id), boundaries(stream, length)


def packing_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, doc_id: str = "doc_id") -> DataFrame:
    """The rows that op13's contract asks for: the ids are written as a stream, and the boundary records are read off it."""
    path = new_folder(docs.sparkSession, "stream")
    write_stream(docs, path, tokenizer, end_id, doc_id)
    return boundaries(placed(docs.sparkSession, path), length).withColumnRenamed("doc_id", doc_id)
