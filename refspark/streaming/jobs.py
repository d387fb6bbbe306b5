"""Structured Streaming forms of three batch operators, each bounded in state by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.operators.evidence import failure_signature
from refspark.shared import folder


def stream_ohlc(ticks: DataFrame, tie: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """series_id, day, open, high, low, close of each period, once it is `late` past: append mode."""
    at = F.struct("ts", tie)
    bars = ticks.filter("value is not null").withWatermark("ts", late).groupBy("series_id", F.window("ts", width).alias("w"))
    out = bars.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))
    return out.select("series_id", F.col("w.start").alias("day"), "open", "high", "low", "close")


def stream_triage(traces: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """day, signature and the count of failures so far: update mode. traces has ts, kind and reason."""
    signature = failure_signature(F.col("kind"), F.lit(""), F.col("reason"))
    return traces.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), signature.alias("signature")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "signature", "n")


def stream_new_records(records: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark: append mode."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream over what has arrived, and return its rows; in update mode the latest row of each of `keys`.

    Every batch goes to a folder of its own number, overwritten where a batch is run again, so a restart neither loses nor doubles rows.
    """
    spark, at = stream.sparkSession, folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{at}/rows").parquet(f"{at}/rows")
    if not keys:
        return rows.drop("batch")
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))).filter("__k = 1").drop("__k", "batch")


def run_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str | None = None, mode: str = "append") -> None:
    """Run the stream over what has arrived into write(batch, number), which must bear batches that come again. state: where the stream's progress is
    kept, so that the next run goes on from there; a new folder by default."""
    at = state or f"{folder(stream.sparkSession)}/state"
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def arriving(spark: SparkSession, d: str, name: str, files: int = 1) -> DataFrame:
    """A driver table as a stream of files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{d}/{name}.parquet*")
    return rows.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])
