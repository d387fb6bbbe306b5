"""The training-corpus pipeline: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last adds
the encoding. Null texts are empty texts to every stage, and null doc_ids are kept like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refspark.llm import decontam, jaccard, pieces, quality, secrets
from refspark.llm.common import bounded_batches, cut

SENTENCEPIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def _with_text(docs: DataFrame, changed: DataFrame, text) -> DataFrame:
    """changed's rows with docs' columns, the new text, and n_chars as its length."""
    changed = changed.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), "text")
    return quality.assess(plain, model, ["__row"]).filter("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 at least) one row stays.

    It is that of the smallest doc_id, a null one last; of rows of one doc_id that of the least hash of its columns. Rows that are
    equal in all columns are one. Rows of one doc_id with different texts are rows like any others.
    """
    bounded_batches(spark)
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("__doc"), F.col("text").alias("__text"), F.col("doc_id").alias("__id"), F.xxhash64(*columns).alias("__hash"))
    found = jaccard.near_duplicates(keyed, ["__id", "__hash"], "__text")
    stays = found.groupBy("part").agg(F.min(F.struct(F.isnull("__id").alias("none"), "__id", "__hash")).alias("s")).select("s.*")
    rows = keyed.join(stays.select(F.col("__id").alias("i"), F.col("__hash").alias("h")), F.expr("__hash = h and __id <=> i"), "left_semi")
    return rows.dropDuplicates(["__hash", "__id"]).select("__doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that was nothing else goes."""
    bounded_batches(spark)
    plain = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), "text")
    found = decontam.find_contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    changed = found.select("__row.*", F.col("spans").alias("__spans"), (F.col("n_hit") == F.col("n_words")).alias("__all"), (F.col("n_hit") > 0).alias("__hit"))
    return _with_text(docs, changed.filter("not (__hit and __all)"), decontam.remove_spans(F.col("text"), F.col("__spans")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    bounded_batches(spark)
    plain = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), "text")
    changed = secrets.find_secrets(plain, keep=["__row"]).select("__row.*", F.col("secrets").alias("__secrets"))
    return _with_text(docs, changed, secrets.redact(F.col("text"), F.col("__secrets")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, whose decoding is compared with the text."""
    bounded_batches(spark)
    return pieces.encode(docs, SENTENCEPIECE_FILE, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither the trees nor the encoding; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
