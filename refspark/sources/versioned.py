"""A table of rows by key that is changed batch by batch, and never half: versions over files that are never changed.

Rows lie in buckets by the hash of their key. A change reads and writes the buckets that it touches, in a folder of its own, and then
publishes a version, a small file that names the folder of every bucket, by a rename that replaces nothing. A writer that dies before
leaves the last version as it was; of two writers one gets the version, and the other begins again from it. Each version says how far
each stream's batches are in it, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published the version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = 64):
        """root must be on a file system whose rename fails where the name is taken (HDFS, local)."""
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The latest version's number; 0 where nothing has been published."""
        fs, p = self._fs(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int) -> dict:
        """folders: of each bucket that has rows, its path under root; streams: of each stream the number of its last batch."""
        if not version:
            return {"folders": {}, "streams": {}}
        fs, p = self._fs(f"{self.root}/versions/v{version:012d}")
        said = fs.open(p)
        try:
            return json.loads(bytes(said.readAllBytes()).decode())
        finally:
            said.close()

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; of some buckets if `only` is given. Without rows an empty table."""
        folders = self.manifest(self.version() if version is None else version)["folders"]
        paths = [f"{self.root}/{at}" for b, at in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def publish(self, said: dict, version: int) -> None:
        """Make `said` this version's manifest, or raise Conflict."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, draft = self._fs(f"{self.root}/versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never = gateway.new_array(kind, 1)
        never[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(self._fs(f"{self.root}/versions/v{version:012d}")[1]), never)
        except Exception as error:
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.root} is another writer's") from error

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, number: int = -1, attempts: int = 5) -> int:
        """Put merge(the rows there are of the touched buckets, rows) in their place; the version that has it.

        merge must give one row for each key of either side, in the table's columns. With `stream`, a batch whose number isn't beyond the
        last one of that stream in the table is left out, so batches may be run again. Conflicts with other writers are tried again.
        """
        for attempt in range(attempts):
            base = self.version()
            said = self.manifest(base)
            if stream is not None and number <= said["streams"].get(stream, -1):
                return base
            touched = {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # at most one for each bucket
            folders = dict(said["folders"])
            if touched:
                merged = merge(self.read(base, touched), rows).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
                at = f"data/{uuid.uuid4().hex}"
                merged.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{at}")
                fs, p = self._fs(f"{self.root}/{at}")
                written = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if s.isDirectory()}
                folders = {b: f for b, f in folders.items() if int(b) not in touched} | {b: f"{at}/{BUCKET}={b}" for b in written}
            try:
                self.publish({"folders": folders, "streams": said["streams"] | ({stream: number} if stream is not None else {})}, base + 1)
                return base + 1
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError


def sink(table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch is put into the table once, however often it is run."""

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, merge, stream, number)

    return write
