"""Sharding by size-tiered compaction, in DataFrame functions only.

Layout under a root: data/__attempt=A/__gen=G/__shard=S/*.parquet, immutable; a write puts its shards in an attempt folder of its own, so
what a writer that died left behind is never read, nor mixed with what its repetition writes. A version is a Parquet table with a row
for each live shard, in manifest/table-*, and a small file manifest/vNNNNNNNN that names it. Arrivals are appended as small shards. A
compaction plans, on the manifest alone, which runs of similarly sized shards become one shard of about the target size, and rewrites
only those. Either commits the next version by moving a finished file to the version's name, which fails if another writer was first.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, file_system, new_folder

MANIFEST = "attempt string, gen int, shard bigint, rows bigint, bytes bigint"
#: The folders' columns, and the manifest's for them.
FOLDERS = {"__attempt": "attempt", "__gen": "gen", "__shard": "shard"}
#: Shards are summed up and rewritten in slices of so many shard numbers, so a task has few of them. Where slices end changes no plan.
SLICE = 100_000


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = file_system(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    fs, p = file_system(spark, f"{root}/manifest/v{version:08d}")
    said = fs.open(p)
    try:
        name = said.readUTF()
    finally:
        said.close()
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{name}")


def commit(live: DataFrame, root: str, version: int) -> None:
    """Publish live as this version. Readers see all of it or nothing; of several writers of a version one wins, and the others get an error."""
    spark, name = live.sparkSession, f"table-{uuid.uuid4().hex}"
    columns = [F.col(c).cast(kind).alias(c) for c, kind in map(str.split, MANIFEST.split(", "))]
    live.select(*columns).coalesce(1).write.option("compression", "zstd").parquet(f"{root}/manifest/{name}")
    fs, draft = file_system(spark, f"{root}/manifest/draft-{name}")
    said = fs.create(draft, False)
    said.writeUTF(name)
    said.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    kind = getattr(hadoop, "Options$Rename")
    never = gateway.new_array(kind, 1)
    never[0] = kind.NONE  # a file of the target's name is not replaced
    context = hadoop.FileContext.getFileContext(fs.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(hadoop.Path(f"{root}/manifest/v{version:08d}")), never)
    except Exception as error:
        fs.delete(draft, False)
        fs.delete(hadoop.Path(f"{root}/manifest/{name}"), True)
        raise RuntimeError(f"version {version} of {root} has been committed by another writer") from error


def _write(rows: DataFrame, root: str) -> str:
    """Rows with __gen and __shard, written as an attempt of their own; its name."""
    attempt = f"a-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").partitionBy("__gen", "__shard").parquet(f"{root}/data/__attempt={attempt}")
    return attempt


def _load(spark: SparkSession, root: str, shards: DataFrame) -> DataFrame:
    """The rows of these shards (attempt, gen, shard), and of no other: the driver lists their folders, one for each shard."""
    found = shards.select("attempt", "gen", "shard").collect()
    paths = [f"{root}/data/__attempt={a}/__gen={g}/__shard={s}" for a, g, s in found]
    rows = spark.read.option("basePath", f"{root}/data").parquet(*paths)
    kinds = {"__attempt": T.StringType(), "__gen": T.IntegerType(), "__shard": T.LongType()}
    return rows.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def text_size(text: str) -> Column:
    """A row's size: the text's UTF-8 bytes and 8 more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def append(docs: DataFrame, root: str, arrival: Column, text: str = "text") -> int:
    """Add docs as generation-0 shards, one for each value of arrival (a long; null is -1), and commit; the new version.

    No shuffle of texts: each task writes its own rows into their shards' folders. Shards are immutable: a number that is live already
    is refused. Columns of docs named as FOLDERS are left out. An empty table commits a version without new shards.
    """
    spark = docs.sparkSession
    have = versions(spark, root)
    own = docs.drop(*FOLDERS).withColumns({"__gen": F.lit(0), "__shard": F.coalesce(arrival.cast("long"), F.lit(-1))})
    at = f"{root}/data/__attempt={(attempt := _write(own, root))}"
    written = spark.read.schema(own.schema).parquet(at)
    new = written.groupBy(F.lit(attempt).alias("attempt"), F.col("__gen").alias("gen"), F.col("__shard").alias("shard")).agg(F.count("*").alias("rows"), F.sum(text_size(text)).alias("bytes"))
    if have:
        new, live = cut(new, "arrivals"), manifest(spark, root, have[-1])
        if not new.join(live.select("shard"), "shard", "left_semi").isEmpty():
            raise ValueError("an arrival's number is taken")
        new = new.unionByName(live)
    commit(new, root, (have or [0])[-1] + 1)
    return (have or [0])[-1] + 1


def tier(size: Column, base: int, fan_in: int) -> Column:
    """0 below base; each tier spans a factor of fan_in."""
    return reduce(lambda acc, k: F.when(size >= base * fan_in**k, F.lit(k + 1)).otherwise(acc), range(12), F.lit(0))


def plan_merges(live: DataFrame, target: int, base: int, fan_in: int = 4, rounds: int = 3) -> DataFrame:
    """gen, shard and into (the merged shard's number, the smallest of its sources') of each live shard; a shard that stays has into = shard.

    Each round looks at shards below half the target. Within a tier of sizes, in order of number, runs whose earlier members' sizes sum
    to less than a multiple of the target go together, if the run has fan_in members or more. The next round sees the merged sizes. Sizes
    are summed up within slices, and the slices' sums, a row for each, before them.
    """
    now = live.select("gen", "shard", F.col("shard").alias("into"), "bytes")
    for _ in range(rounds):
        groups = now.groupBy("into").agg(F.sum("bytes").alias("size")).filter(F.col("size") < target / 2)
        groups = cut(groups.select("into", "size", F.floor(F.col("into") / SLICE).alias("s"), tier(F.col("size"), base, fan_in).alias("t")), "tiers")
        total = groups.groupBy("t", "s").agg(F.sum("size").alias("total"))
        before = total.select("t", "s", (F.sum("total").over(W.partitionBy("t").orderBy("s")) - F.col("total")).alias("before"))
        run = F.sum("size").over(W.partitionBy("s", "t").orderBy("into")) - F.col("size")
        placed = groups.withColumn("run", run).join(before, ["t", "s"]).select("into", "t", F.floor((F.col("before") + F.col("run")) / target).alias("g"))
        same = W.partitionBy("t", "g")
        moved = placed.select("into", F.min("into").over(same).alias("to"), F.count("*").over(same).alias("n")).filter(F.col("n") >= fan_in)
        now = cut(now.join(moved, "into", "left").select("gen", "shard", F.coalesce("to", "into").alias("into"), "bytes"), "plan")
    return now


def compact(spark: SparkSession, root: str, target: int, base: int, fan_in: int = 4, rounds: int = 3) -> int:
    """Plan, rewrite what is merged, and commit the next version; the version that is current then.

    Merges are numbered densely, and a merge's rows go to the task of its number, so each task writes one shard of at most about target
    bytes. Shards that no run takes are not read.
    """
    have = versions(spark, root)[-1]
    live = manifest(spark, root, have)
    plan = plan_merges(live, target, base, fan_in, rounds)
    merged = cut(plan.withColumn("n", F.count("*").over(W.partitionBy("into"))).filter("n > 1").drop("n").join(live.select("shard", "attempt"), "shard"), "merges")
    slices = [r[0] for r in merged.select(F.floor(F.col("into") / SLICE).alias("s")).distinct().orderBy("s").collect()]
    if not slices:
        return have
    gen = live.agg(F.max("gen")).first()[0] + 1
    new = []
    for s in slices:
        mine = merged.filter(F.floor(F.col("into") / SLICE) == s)
        into = mine.groupBy("into").agg(F.count("*").alias("sources")).select("into", (F.row_number().over(W.orderBy("into")) - 1).alias("task"))  # at most SLICE numbers
        n = into.count()
        to = mine.join(into, "into").select(F.col("shard").alias("__shard"), F.col("gen").alias("__gen"), "into", "task")
        small = to.count() <= 2 * SLICE  # a merge's sources may go on in the next slice
        rows = _load(spark, root, mine).join(F.broadcast(to) if small else to, ["__gen", "__shard"])
        rows = rows.repartitionById(n, F.col("task")).drop("__attempt", "__gen", "__shard", "task").withColumns({"__gen": F.lit(gen), "__shard": F.col("into")}).drop("into")
        attempt = _write(rows, root)
        sizes = live.join(mine.select("shard", "into"), "shard")
        new.append(sizes.groupBy(F.lit(attempt).alias("attempt"), F.lit(gen).alias("gen"), F.col("into").alias("shard")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")))
    commit(reduce(DataFrame.unionByName, new, live.join(merged, "shard", "left_anti")), root, have + 1)
    return have + 1


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the data of shards that none of the last `keep` versions has, those of dead attempts too; how many shard folders went.

    Not to be run while a writer is at work, whose shards no version has yet. It handles folder names, one for each shard.
    """
    known = {tuple(r) for v in versions(spark, root)[-keep:] for r in manifest(spark, root, v).select("attempt", "gen", "shard").collect()}
    fs, data = file_system(spark, f"{root}/data")
    gone = 0
    for shard in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/*/*/*")) or []:
        path = shard.getPath()
        name = [p.split("=", 1)[-1] for p in path.toString().split("/")[-3:]]
        if shard.isDirectory() and path.getName().startswith("__shard=") and (name[0], int(name[1]), int(name[2])) not in known:
            fs.delete(path, True)
            gone += 1
    return gone


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version's live shards, with __attempt, __gen and __shard; no other shard is read. A version without shards can't be read."""
    return _load(spark, root, manifest(spark, root, versions(spark, root)[-1] if version is None else version))


def sharding_digest(docs: DataFrame, rows_per_arrival: int = 1000, target: int = 64 << 20, base: int = 1 << 20) -> DataFrame:
    """doc_id, shard, merged and n_bytes (the text's) of every document, as the compacted version holds them.

    Documents arrive by doc_id, rows_per_arrival ids at a time (a null id: arrival -1). Repeated rows stay repeated, null texts have no
    bytes; an empty table gives no rows.
    """
    spark, root = docs.sparkSession, new_folder(docs.sparkSession, "shards")
    if docs.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("shard"), F.lit(False).alias("merged"), F.lit(0).cast("long").alias("n_bytes"))
    append(docs, root, F.floor(F.col("doc_id") / rows_per_arrival))
    rows = read(spark, root, compact(spark, root, target, base))
    return rows.select("doc_id", F.col("__shard").alias("shard"), (F.col("__gen") > 0).alias("merged"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def digest_sql(rows_per_arrival: int = 1000, target: int = 64 << 20, base: int = 1 << 20, fan_in: int = 4, rounds: int = 3) -> str:
    """sharding_digest as DuckDB SQL."""
    t = "CASE " + " ".join(f"WHEN size >= {base * fan_in**k} THEN {k + 1}" for k in range(11, -1, -1)) + " ELSE 0 END"
    steps = [f"d AS (SELECT doc_id, coalesce(CAST(floor(doc_id / {rows_per_arrival}) AS BIGINT), -1) AS arrival, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents)", "m0 AS (SELECT arrival AS shard, arrival AS into_, sum(n_bytes + 8) AS bytes FROM d GROUP BY ALL)"]
    for k in range(rounds):
        steps += [
            f"g{k} AS (SELECT into_, sum(bytes) AS size FROM m{k} GROUP BY into_ HAVING sum(bytes) < {target} / 2)",
            f"t{k} AS (SELECT into_, size, {t} AS t FROM g{k})",
            f"p{k} AS (SELECT into_, t, floor((sum(size) OVER (PARTITION BY t ORDER BY into_) - size) / {target}) AS g FROM t{k})",
            f"q{k} AS (SELECT into_, min(into_) OVER (PARTITION BY t, g) AS to_, count(*) OVER (PARTITION BY t, g) AS n FROM p{k})",
            f"m{k + 1} AS (SELECT m.shard, coalesce(q.to_, m.into_) AS into_, m.bytes FROM m{k} m LEFT JOIN q{k} q ON q.into_ = m.into_ AND q.n >= {fan_in})",
        ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT d.doc_id, m.into_ AS shard, count(*) OVER (PARTITION BY m.into_) > c.n AS merged, d.n_bytes FROM d JOIN m{rounds} m ON m.shard = d.arrival JOIN (SELECT into_, max(k) AS n FROM (SELECT m.into_, count(*) AS k FROM d JOIN m{rounds} m ON m.shard = d.arrival GROUP BY m.into_, m.shard) GROUP BY into_) c ON c.into_ = m.into_"
