"""Text, search and log operators of the evidence corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.operators.lexical import build_index, search, tokens


def lexical_scores(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank over an index made for this search; keep one of `lexical.build_index` to search the same documents again."""
    return search(build_index(docs), queries, k)


# What varies between repetitions of a failure, in this order, and the marks that stand for it.
FAILURE_MASKS = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b0x[0-9a-f]+\b", "<hex>"),
    (r"\b\d{4}-\d{2}-\d{2}(?:[t ][0-9:.+-z]+)?\b", "<time>"),
    (r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[+-]\d{2}:?\d{2}|z)?\b", "<time>"),
    (r"(?<![a-z])'[^'\n]*'", "<q>"),
    (r'"[^"\n]*"', "<q>"),
    (r"`[^`\n]*`", "<q>"),
    (r"(?<![a-z])[-+]?(?:\d+\.\d+|\d+|\.\d+)(?:e[-+]?\d+)?%?", "<num>"),
    (r"(/[^\s:;,]+)+", "<path>"),
    (r"\s+", " "),
)


def normalize_failure(reason: Column) -> Column:
    """The lower-cased reason with what varies masked; an empty or null one is an unspecified failure."""
    out = F.lower(F.coalesce(reason, F.lit("")))
    for pattern, mark in FAILURE_MASKS:
        out = F.regexp_replace(out, pattern, mark)
    out = F.trim(out)
    return F.when(out == "", "unspecified failure").otherwise(out)


def failure_signature(verdict: Column, stage: Column, reason: Column) -> Column:
    """16 hex digits over verdict, stage and the normalised reason."""
    text = F.concat_ws("\x00", F.coalesce(verdict, F.lit("")), F.coalesce(stage, F.lit("")), normalize_failure(reason))
    return F.substring(F.sha2(text, 256), 1, 16)


def failure_clusters(traces: DataFrame, top: int = 20) -> DataFrame:
    """signature, n, n_kinds and example (the one of the smallest id), most frequent first. traces: id, kind (the verdict), stage if there is one, reason."""
    stage = F.col("stage") if "stage" in traces.columns else F.lit("")
    s = traces.withColumn("signature", failure_signature(F.col("kind"), stage, F.col("reason")))
    g = s.groupBy("signature").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("n_kinds"), F.min_by("reason", "id").alias("example"))
    return g.orderBy(F.desc("n"), "signature").limit(top)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The union's last row of each key by `order`; a new row wins a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("__new")))).filter("__k = 1").drop("__k", "__new")


def chain_breaks(events: DataFrame) -> DataFrame:
    """run, events and broken_seq: the first event whose prev_hash isn't the hash before it, or whose number doesn't follow."""
    w = W.partitionBy("run").orderBy("seq")
    bad = events.withColumn("bad", (F.coalesce(F.lag("hash").over(w), F.lit("")) != F.col("prev_hash")) | (F.col("seq") != F.row_number().over(w)))
    return bad.groupBy("run").agg(F.count("*").alias("events"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_seq"))


# Instructions that a text should not give, by name.
INJECTIONS = (
    ("override", r"(?i)\bignore (?:all )?(?:previous|prior|above) instructions\b"),
    ("role", r"(?i)\b(?:you are|act as|pretend to be) (?:a|an) (?:helpful )?(?:assistant|agent|trader)\b"),
    ("prompt", r"(?i)\b(?:system|developer|user) (?:message|prompt|instruction)\b"),
    ("decision", r"(?i)\b(?:promote|approve|commit) (?:this|the) (?:claim|verdict|decision)\b"),
)


def injection_flags(text: Column) -> Column:
    """Names of suspicious instructions in a text; the text is left as it is."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in INJECTIONS]))


def cohort_denominators(claims: DataFrame) -> DataFrame:
    """source, family, cohort_id, denominator: the claims of a source in a family that are ready to be run; 1 for a single preregistered one.

    claims: source, family, ready, single.
    """
    g = claims.filter("ready").groupBy("source", "family").agg(F.count("*").alias("n"), F.bool_and("single").alias("single"))
    return g.select("source", "family", F.concat_ws(":", F.col("source"), F.substring(F.sha2(F.col("family").cast("string"), 256), 1, 16)).alias("cohort_id"), F.when(F.col("single") & (F.col("n") == 1), 1).otherwise(F.col("n")).alias("denominator"))


def family_counts(df: DataFrame, source: str, family: str) -> DataFrame:
    """source, family, cohort_id and denominator: how many trials a source has registered in a family."""
    return df.groupBy(source, family).agg(F.count("*").alias("denominator")).withColumn("cohort_id", F.concat_ws(":", F.col(source), F.substring(F.sha2(F.col(family).cast("string"), 256), 1, 16)))
