"""Which sources are still to be processed: by content, what became of them before, and what is forced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refspark.sources.versioned import VersionedTable

STATE = "source string, hash string, status string, attempt int, at timestamp"
#: Attempts at one content before a source is given up.
ATTEMPTS = 3


def state_table(spark, root: str, buckets: int = 64) -> VersionedTable:
    return VersionedTable(spark, root, "source", STATE, buckets)


def pending(sources: DataFrame, state: DataFrame, force: Column | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """sources (source, text) with hash, why and attempt, those alone that are to be processed.

    why: new (not in state), changed (its content isn't what was processed), retry (failed, or begun and not ended, fewer than `attempts` times with
    this content), or forced, where `force` is true. A source that is done with this content is left out. Repeated rows of a source with
    one content are one; of several contents the one with the largest hash counts. A null text is an empty one; null sources are left out.
    """
    held = sources.withColumn("__force", F.coalesce(force, F.lit(False)) if force is not None else F.lit(False)).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    one = held.filter("source is not null").groupBy("source").agg(F.max_by(F.struct(*[F.col(c) for c in held.columns if c != "source"]), "hash").alias("r")).select("source", "r.*")
    known = state.select("source", F.col("hash").alias("__hash"), "status", F.col("attempt").alias("__attempt"))
    j = one.join(known, "source", "left")
    same = F.col("__hash") == F.col("hash")
    why = (
        F.when(F.col("__force"), "forced").when(F.col("__hash").isNull(), "new").when(~same, "changed")
        .when((F.col("status") != "done") & (F.col("__attempt") < attempts), "retry")
    )
    out = j.withColumns({"why": why, "attempt": F.when(F.coalesce(same, F.lit(False)), F.col("__attempt") + 1).otherwise(1)}).filter("why is not null")
    return out.select(*sources.columns, "hash", "why", "attempt")


def record(table: VersionedTable, results: DataFrame, stream: str | None = None, number: int = -1) -> int:
    """Put results (source, hash, status, attempt, at) into the state; the version. Of a source's rows the latest counts, with the later attempt
    where two are of one time, so results of an earlier run that come late change nothing."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = F.struct("at", "attempt", "hash", "status")
        return old.unionByName(new.select(*old.columns)).groupBy("source").agg(F.max(rest).alias("r")).select("source", "r.hash", "r.status", "r.attempt", "r.at")

    return table.upsert(results, merge, stream, number)
