"""Ledgers, decisions, kills, vectors and the graph of the evidence corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.functions.numbers import exact
from refspark.operators.scan import numbered

# Domains and the words that name them, tried in this order.
DOMAINS = (
    ("crypto-volatility", ("volatility", "realized vol", "implied vol", "vrp", "dvol", "garch")),
    ("funding-carry", ("funding", "perpetual", "perp", "basis", "carry")),
    ("pm-microstructure", ("order book", "liquidation", "resolution", "halt", "margin", "depth", "perpetual futures on")),
    ("prediction-market", ("kalshi", "polymarket", "prediction market", "binary", "election")),
    ("crypto-equity", ("equity", "equities", "correlation", "asset class", "inflation", "breakeven")),
    ("trend-following", ("trend-following", "trend following", "ewmac", "moving-average crossover", "moving average crossover")),
    ("cross-sectional-factor", ("momentum", "reversal", "value", "accruals", "size", "factor", "anomaly", "long-short")),
    ("macro-signal", ("fed", "cpi", "recession", "macro", "rate")),
)
# Fixed value: lines that are no title.
NO_TITLE = r"(?i)^(arxiv|doi|http|\d+\.\d+|vol\.|page|\d+$)"


def infer_domain(text: Column) -> Column:
    """The first domain of whose words the lower-cased text contains one; else other."""
    low, out = F.coalesce(F.lower(text), F.lit("")), F.lit("other")
    for name, words in reversed(DOMAINS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def guess_title(text: Column) -> Column:
    """The first of the first 30 lines that is neither empty, over 200 characters, nor a number, address or page mark."""
    lines = F.transform(F.slice(F.split(text, "\r\n|\n|\r"), 1, 30), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.get(F.filter(lines, lambda x: (x != "") & (F.length(x) <= 200) & ~x.rlike(NO_TITLE)), 0)


def winsorize(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def position_map(signal: Column, kind: str = "sign") -> Column:
    return F.signum(signal) if kind == "sign" else winsorize(signal, -1.0, 1.0)


def fee_gate(edge: Column, least: float = 0.0008) -> Column:
    return F.when(edge.isNull(), "not_evaluated").when(edge < least, "kill").otherwise("pass")


def register_trials(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """strategy, denominator, scored: a scored strategy stays as it is, an unscored one takes the larger denominator, a new one is added."""
    j = ledger.alias("o").join(rows.alias("n"), "strategy", "full_outer")
    den = F.when(F.expr("o.scored"), F.col("o.denominator")).otherwise(F.greatest("o.denominator", "n.denominator"))
    return j.select("strategy", den.alias("denominator"), F.coalesce("o.scored", F.lit(False)).alias("scored"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("__k = 1").drop("__k")


def supersede(decisions: DataFrame, source: str, run: str) -> DataFrame:
    """The marker rows to append: for each claim of the source whose latest decision is another run's and not superseded yet."""
    last = latest(decisions.filter(F.col("source") == source), "claim_id", "at", "seq").filter((F.col("run_id") != run) & (F.col("verdict") != "superseded"))
    return last.select("claim_id", F.lit(source).alias("source"), F.lit(run).alias("run_id"), F.lit("superseded").alias("verdict"), F.col("verdict").alias("prior_verdict"), F.col("run_id").alias("prior_run_id"))


def open_requests(requests: DataFrame) -> DataFrame:
    return latest(requests, "request_id", "at", "seq").filter("status = 'open'")


def failure_clusters(records: DataFrame, least: int = 2) -> DataFrame:
    """reason, domain, n of structural kills; `least` at least. records holds those alone: no verdict for want of power or of data."""
    return records.filter("reason is not null").groupBy("reason", "domain").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def cross_domain_links(records: DataFrame) -> DataFrame:
    """reason, domains, total, first (the smallest ids of three domains) of the reasons seen in two domains or more."""
    by = records.filter("reason is not null").groupBy("reason", "domain").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    ranked = by.withColumn("k", F.row_number().over(W.partitionBy("reason").orderBy("domain")))
    out = ranked.groupBy("reason").agg(F.count("*").alias("domains"), F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("id").cast("string")))), ",").alias("first"))
    return out.filter("domains >= 2")


def anti_known(new: DataFrame, seen: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """new without rows that share any of the keys with seen, and one row of each key within the batch."""
    for k in keys:
        new = new.join(seen.select(k).distinct(), k, "left_anti")
    for k in keys:
        new = new.withColumn("__k", F.row_number().over(W.partitionBy(k).orderBy(order))).filter("__k = 1").drop("__k")
    return new


def fingerprint(series: DataFrame) -> DataFrame:
    """series_id, fingerprint: a hash of months' hashes of (second, exact value; a null value leaves its second); a group is a month of a series."""
    line = F.concat_ws(":", F.unix_timestamp("ts"), exact(F.col("value")))
    month = series.groupBy("series_id", F.date_format("ts", "yyyy-MM").alias("m")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("h"))
    return month.groupBy("series_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "m", "h"))), ","), 256).alias("fingerprint"))


#: Queries held in memory by a pass over the corpus, and compared with a batch at a time.
QUERY_BLOCK, QUERY_PART = 16_384, 512
#: Vectors of the corpus that a block is compared with at a time: a product of QUERY_PART x CORPUS_PART numbers is all that is held.
CORPUS_PART = 1024


def nearest_vectors(queries: DataFrame, corpus: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """vec_id, best_id, cosine, status of each query's nearest other vector: >= 0.92 duplicate, >= 0.75 review, else novel.

    Exact: queries come in blocks of about `block`, broadcast as one matrix; each task multiplies it with its own vectors, batch by batch,
    keeps the best of each query and hands on one row for it. A vector of zeros or null is like none: its cosine is 0. Equal cosines go to
    the smallest id. Vectors have the queries' length; one of another length is like a null.
    """
    return _nearest(queries, corpus, block, 1).withColumn("status", F.when(F.col("cosine") >= 0.92, "duplicate").when(F.col("cosine") >= 0.75, "review").otherwise("novel")).select("vec_id", F.col("other").alias("best_id"), "cosine", "status")


def vector_scores(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """vec_id, other, cosine, rank of each query's k nearest other vectors with a cosine above 0; exact, as nearest_vectors."""
    best = _nearest(queries, corpus, block, k).filter("cosine > 0")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")))


def _units(column: pa.ListArray, wide: int) -> np.ndarray:
    """Each vector by its length, in float64; null, empty and zero ones, and those of another length, are zeros."""
    x = np.zeros((len(column), wide))
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), -1)
    fit = np.flatnonzero(size == wide) if wide else []
    if len(fit):
        places = column.offsets.to_numpy()[fit, None] + np.arange(wide)
        x[fit] = column.values.to_numpy(zero_copy_only=False)[places]
    size = np.sqrt((x * x).sum(1))
    return np.divide(x, size[:, None], out=x, where=size[:, None] > 0)


def _nearest(queries: DataFrame, corpus: DataFrame, block: int, k: int) -> DataFrame:
    spark, fields = corpus.sparkSession, "vec_id bigint, other bigint, cosine double"
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        held = mine.column("v").combine_chunks()
        wide = int(pc.max(pc.list_value_length(held)).as_py() or 0)
        shared = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy().astype(np.int64), _units(held, wide)))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = np.full((len(names), k), -np.inf)
            whose = np.full((len(names), k), np.iinfo(np.int64).max)
            parts = (batch.slice(at, CORPUS_PART) for batch in batches for at in range(0, batch.num_rows, CORPUS_PART))
            for batch in parts:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                u = _units(batch.column(1), q.shape[1])
                for a in range(0, len(names), QUERY_PART):
                    own = slice(a, a + QUERY_PART)
                    c = q[own] @ u.T
                    met = np.flatnonzero(np.isin(ids, names[own]))
                    c[:, met] = np.where(names[own, None] == ids[None, met], -np.inf, c[:, met])
                    if k == 1:  # only queries whose best here may reach their best so far are looked at
                        rows = np.flatnonzero(c.max(1, initial=-np.inf) >= best[own, 0] - 2e-9)
                        near = np.round(c[rows], 9)
                        most = near.max(1, initial=-np.inf)
                        who = np.where((near == most[:, None]) & (near > -np.inf), ids, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                        rows += a
                        up = (most > best[rows, 0]) | ((most == best[rows, 0]) & (who < whose[rows, 0]))
                        best[rows[up], 0], whose[rows[up], 0] = most[up], who[up]
                        continue
                    c = np.round(c, 9)
                    if len(ids) > k:  # what is under a query's k best here, or under its k-th so far, needn't be put in order
                        edge = np.maximum(np.partition(c, -k, axis=1)[:, -k], best[own, -1])
                        open_ = np.flatnonzero((c >= edge[:, None]).any(0))
                        c, here = c[:, open_], ids[open_]
                    else:
                        here = ids
                    both, of = np.hstack((best[own], c)), np.hstack((whose[own], np.broadcast_to(here, c.shape)))
                    top = np.lexsort((of, -both), axis=1)[:, :k]
                    best[own], whose[own] = np.take_along_axis(both, top, 1), np.take_along_axis(of, top, 1)
            on = best > -np.inf
            row = np.nonzero(on)[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(whose[on]), pa.array(best[on])], names=["vec_id", "other", "cosine"])

        part = corpus.filter("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(score, fields)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], fields)
    ranked = out.withColumn("__k", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")))
    return ranked.filter(F.col("__k") <= k).drop("__k")


def reciprocal_ranks(scores: DataFrame, k: int = 60) -> DataFrame:
    """id, score: the sum over score maps of 1 / (k + rank), ties by id. Ranks are numbers over ranges of (map, score), so a map is many tasks."""
    ranked = numbered(scores.withColumn("__down", -F.col("score")), ["map"], ["__down", "id"], "r").withColumn("r", F.col("r") + 1)
    return ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("r"))).alias("score"))


def graph_expand(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """id, score: nodes within `hops` undirected edges of a seed, 0.5 for each step, the best path's."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct()
    reached = seeds.select("id", F.lit(1.0).alias("score"))
    for _ in range(hops):
        step = reached.join(both, "id").select(F.col("to").alias("id"), (F.col("score") * 0.5).alias("score"))
        reached = reached.unionByName(step).groupBy("id").agg(F.max("score").alias("score"))
    return reached


def unprocessed(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources whose content hash isn't among those seen."""
    return sources.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(seen.select("hash").distinct(), "hash", "left_anti")


def fused_ranks(vector: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, score: the sum over both searches of 1 / (k + rank); a document's words count only if its vector wasn't found.

    vector, lexical: query_id, id, score, the best of each query.
    """
    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).select("query_id", "id", (1.0 / (k + F.col("r"))).alias("score"))

    words = ranked(lexical).join(vector.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return ranked(vector).unionByName(words).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
