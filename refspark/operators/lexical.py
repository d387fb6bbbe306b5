"""Search by words: an inverted index with the best weight of every block of postings, and the k best documents of each query.

A document belongs to one block, by the hash of its id, and a block has about BLOCK documents. The index has a row for each term and block: the
term's documents there with their weights (term frequency over the root of the document's length), and the largest of them. So the postings of
a common term are as many rows as there are blocks. What a query can score in a block is at most the sum of its terms' largest weights there
times their rarity: a block whose bound is under the query's k-th best score so far is skipped, and its postings aren't unfolded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refspark.shared import checkpointed, folder

#: Documents in a block, about; queries taken at a time; queries and terms in one product; and blocks from which it pays to look for a bound first.
BLOCK, QUERIES, PART, SKIP = 1024, 20_000, 1024, 64
#: So many pairs of a query and a term at most are handed to every task, so that postings are shuffled to their blocks only, and only those asked for.
ASKED = 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


@dataclass
class LexicalIndex:
    """postings: block, term, docs (an array of doc_id, row in the block and weight), best. terms: term, idf. Both are files under root, and can be opened again."""

    postings: DataFrame
    terms: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LexicalIndex:
        return cls(spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/terms"))


def _postings(table: pa.Table, kinds: pa.Schema) -> pa.Table:
    """A row for each term of one block. The table has a row for each document, with its words."""
    t = table.column("t").combine_chunks()
    size = np.diff(t.offsets.to_numpy())
    words = t.flatten().dictionary_encode()
    pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(t) + np.repeat(np.arange(len(t)), size), return_counts=True)
    term, row = np.divmod(pair, max(1, len(t)))
    w = tf / np.sqrt(size[row])
    edges = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    docs = pa.StructArray.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(row), pa.array(w)], fields=list(kinds.field("docs").type.value_type))
    best = np.maximum.reduceat(w, edges[:-1]) if len(w) else np.zeros(0)
    block = pa.array(np.full(len(words.dictionary), table.column("block")[0].as_py() if len(table) else 0), pa.int32())
    return pa.Table.from_arrays([block, words.dictionary.cast(pa.string()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), docs).cast(kinds.field("docs").type), pa.array(best)], schema=kinds)


def build_index(docs: DataFrame, root: str | None = None, block: int = BLOCK) -> LexicalIndex:
    """The index of docs (doc_id, text), written under root, by default a new shared folder.

    Words are found by built-in functions and shuffled once, to their blocks; a task holds one block's. Null texts are empty documents, repeated rows are documents of their own, and rows without an id count as documents but are never found.
    """
    root = root or folder(docs.sparkSession, "lexical")
    n = docs.count()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // block)))).cast("int")
    fields = f"block int, term string, docs array<struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},row:bigint,w:double>>, best double"
    kinds = to_arrow_schema(T._parse_datatype_string(fields))
    words = docs.select(at.alias("block"), "doc_id", tokens(F.col("text")).alias("t"))
    words.groupBy("block").applyInArrow(lambda table: _postings(table, kinds), fields).write.parquet(f"{root}/postings")
    spark = docs.sparkSession
    held = spark.read.parquet(f"{root}/postings")
    rare = F.log((1.0 + n) / (1.0 + F.sum(F.size("docs")))) + 1.0
    held.groupBy("term").agg(rare.alias("idf")).write.parquet(f"{root}/terms")
    return LexicalIndex.open(spark, root)


def _block_scores(table: pa.Table, k: int, least: dict, kinds: pa.Schema) -> pa.Table:
    """The k best documents of each query in one block. A row of the table is a term: its docs, and the queries that have it (asked) with its idf.

    Terms' weights make a matrix of terms and documents, the queries' idf one of queries and terms, and their product the scores. A query
    whose bound here is under what its k-th best document has anyway is left out before.
    """
    docs, asked = table.column("docs").combine_chunks(), table.column("asked").combine_chunks()
    d, q = docs.flatten(), asked.flatten()
    rows, place = np.unique(d.field("row").to_numpy(), return_inverse=True)
    ids = d.field("doc_id").take(pa.array(_first(place, len(rows))))
    names = q.field("query_id").dictionary_encode()
    who, idf = names.indices.to_numpy(), q.field("idf").to_numpy()
    d_term = np.repeat(np.arange(len(docs)), np.diff(docs.offsets.to_numpy()))
    q_term = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
    most = np.bincount(who, idf * table.column("best").to_numpy()[q_term], minlength=len(names.dictionary))
    queries = names.dictionary.to_pylist()
    floor = np.array([least.get(x, 0.0) for x in queries])
    open_ = np.flatnonzero(most >= floor - 1e-9)
    out: list[tuple] = []
    weights = d.field("w").to_numpy()
    for start in range(0, len(open_), PART):
        own = open_[start : start + PART]
        slot = np.full(len(queries), -1)
        slot[own] = np.arange(len(own))
        scores = np.zeros((len(own), len(rows)))
        mine = slot[who] >= 0
        for t in range(0, len(docs), PART):  # some terms at a time
            x, y = (d_term >= t) & (d_term < t + PART), mine & (q_term >= t) & (q_term < t + PART)
            if not x.any() or not y.any():
                continue
            left, right = np.zeros((len(own), min(PART, len(docs) - t))), np.zeros((min(PART, len(docs) - t), len(rows)))
            left[slot[who[y]], q_term[y] - t] = idf[y]
            right[d_term[x] - t, place[x]] = weights[x]
            scores += left @ right
        scores = np.round(scores, 9)
        many = scores.shape[1] > k
        edge = np.partition(scores, -k, axis=1)[:, -k] if many else np.zeros(len(own))
        i, j = np.nonzero((scores >= edge[:, None]) & (scores > 0))
        held = sorted(zip(i.tolist(), (-scores[i, j]).tolist(), ids.take(pa.array(j)).to_pylist(), strict=True), key=lambda r: (r[0], r[1], r[2] is None, r[2]))
        count: dict[int, int] = {}
        for i_, s, doc in held:
            if doc is not None and count.get(i_, 0) < k:
                count[i_] = count.get(i_, 0) + 1
                out.append((queries[own[i_]], doc, -s))
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def _first(place: np.ndarray, n: int) -> np.ndarray:
    """The first place at which each of 0 .. n - 1 stands."""
    out = np.empty(n, np.int64)
    out[place[::-1]] = np.arange(len(place))[::-1]
    return out


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, block: int = QUERIES) -> DataFrame:
    """query_id, doc_id, score (to nine places), rank: the sum over a query's distinct terms of (ln((1 + N) / (1 + df)) + 1) x tf / sqrt(length), the
    k best, ties by id.

    queries: query_id (unique), text; they are taken about `block` at a time. A first pass looks at each query's most promising block, which
    gives it a score that its k-th best document has at least; then all blocks are gone through, each leaving out the queries that can't reach it.
    """
    spark, out = queries.sparkSession, None
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    fields = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {index.postings.schema['docs'].dataType.elementType['doc_id'].dataType.simpleString()}, score double"
    kinds = to_arrow_schema(T._parse_datatype_string(fields))
    parts = max(1, -(-queries.count() // block))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    for p in range(parts):
        mine = checkpointed(words.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).join(index.terms, "term"))
        small = F.broadcast if mine.count() <= ASKED else lambda df: df
        asked = small(mine.groupBy("term").agg(F.collect_list(F.struct("query_id", "idf")).alias("asked")))
        hits = index.postings.join(asked, "term").select("block", "docs", "best", "asked")

        def scored(rows: DataFrame, least: dict) -> DataFrame:
            held = spark.sparkContext.broadcast(least)  # a number for each of at most `block` queries
            return rows.groupBy("block").applyInArrow(lambda table: _block_scores(table, k, held.value, kinds), fields)

        bounds = index.postings.select("block", "term", "best").join(small(mine), "term").groupBy("query_id", "block").agg(F.sum(F.col("best") * F.col("idf")).alias("most"))
        promising = bounds.groupBy("query_id").agg(F.max_by("block", "most").alias("block"))
        few = index.postings.join(small(mine.join(promising, "query_id").groupBy("term", "block").agg(F.collect_list(F.struct("query_id", "idf")).alias("asked"))), ["term", "block"])
        least = {}
        if bounds.select("block").distinct().count() >= SKIP:
            least = {r.query_id: r.score for r in best(scored(few.select("block", "docs", "best", "asked"), {})).filter(F.col("rank") == k).select("query_id", "score").collect()}
        part = scored(hits, least)
        out = part if out is None else out.unionByName(part)
    return best(out)
