"""What the operators of this subpackage share: the shared folder, lineage cuts, Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes in an Arrow batch: whichever is reached first ends it, and a row that is longer alone is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a new one; a cluster has an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: later steps neither recompute it nor need the executors that made it."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of path, and path as it knows it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of BATCH_ROWS rows and BATCH_BYTES, so a worker's memory follows the batch and not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8, without decoding; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.string())
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text as a Python string; null as empty."""
    return [b.decode("utf-8", "replace") for b in text_bytes(column)]


def map_columns(df: DataFrame, read: list[str], keep: list[str], fields: str, make: Callable[[], Callable[[pa.RecordBatch], list]], gather: int = 0) -> DataFrame:
    """df's columns `keep`, and after them `fields` (a DDL string), which make()(batch of the columns `read`) returns as one list or array each.

    make runs once in each task, so what it loads serves all batches. A kept column with a name of `fields` is left out. With `gather`,
    batches are put together until they have so many bytes.
    """
    new = T._parse_datatype_string(fields)
    keep = [c for c in keep if c not in new.names]
    take = list(dict.fromkeys(keep + read))
    bounded_batches(df.sparkSession)
    df = df.select(*[f"`{c}`" for c in take])
    schema = T.StructType([df.schema[c] for c in keep] + list(new.fields))
    arrow = to_arrow_schema(new)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= gather:
                yield pa.concat_batches(held) if len(held) > 1 else batch
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in gathered(batches):
            if not batch.num_rows:
                continue
            got = work(batch.select(read))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, arrow, strict=True)],
                names=keep + new.names,
            )

    return df.mapInArrow(run, schema)
