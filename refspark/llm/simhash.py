"""SimHash fingerprints, and near-duplicate groups by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most `distance` bits apart agree on one segment to within
distance // segments bits, so each is looked up, for every segment, under all values in that small Hamming ball; each
match is verified over the whole fingerprint. Buckets with too many members for that are linked by bit masks instead.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns, text_bytes

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; bit k is set if it is in over half the XXH64 of the text's word shingles. No words: 0."""
    words = text.translate(_LOWER).split()  # at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    n = max(1, len(words) - shingle + 1)
    start, stop = (stop - size + 1)[:n].tolist(), stop[-n:].tolist()
    h = xxhash.xxh64_intdigest
    return majority(np.fromiter((h(joined[a:b], seed) for a, b in zip(start, stop, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """64 bits; bit k is set if it is in over half of the hashes (unsigned 64 bits each)."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):  # 64 bytes a hash at a time
        part = hashes[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; null and empty texts have 0."""

    def make():
        return lambda batch: [pa.array(np.array([fingerprint(t, shingle, seed) for t in text_bytes(batch.column(text))], np.uint64).view(np.int64))]

    return map_columns(docs, [text], [doc_id], "fp bigint", make)


def links(nodes: DataFrame, distance: int = 2, segments: int = 2, hot: int = 4096) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of nodes.fp at most `distance` bits apart. nodes: read from files, fp distinct.

    A bucket of a segment with over `hot` members isn't joined with itself: its members, and those in its Hamming ball, are
    grouped by the fingerprint without each set of `distance` bits. Such a group has at most 2**distance members, so no task
    gets a large one, and two fingerprints within the distance share one. Both ways are exact. A pair may come more than once.
    """
    width = 64 // segments
    sizes = [width] * (segments - 1) + [64 - width * (segments - 1)]
    value = [F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << sizes[k]) - 1) for k in range(segments)]

    def ball(k: int, radius: int, upward: bool):
        """s and v of all values within the radius of segment k, or of those that aren't lower."""
        masks = F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for r in range(radius + 1) for c in combinations(range(sizes[k]), r)])
        every = F.transform(masks, lambda mask: F.struct(F.lit(k).alias("s"), value[k].bitwiseXOR(mask).alias("v"), (mask == 0).alias("same")))
        return F.filter(every, lambda x: x["v"] >= value[k]) if upward else every

    def rows(radius: int, upward: bool = False) -> DataFrame:
        sides = F.concat(*[ball(k, radius, upward) for k in range(segments)])
        return nodes.select("fp", F.explode(sides).alias("x")).select("fp", "x.s", "x.v", "x.same")

    radius = distance // segments
    members = rows(0).drop("same")
    probes = rows(radius, upward=True)  # of two values, the lower finds the higher
    large = cut(members.groupBy("s", "v").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("s", "v"), "hot-buckets")
    crowded = None
    if not large.isEmpty():
        around = rows(radius).join(large, ["s", "v"], "left_semi").select("fp").distinct()
        masks = F.array(*[F.lit(int(np.array(sum(1 << i for i in c), np.uint64).view(np.int64))) for c in combinations(range(64), distance)])
        crowded = (
            around.select("fp", F.explode(masks).alias("m")).groupBy("m", F.expr("fp & ~m").alias("rest")).agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
            .select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).filter("a < b")
        )
        members = members.join(large, ["s", "v"], "left_anti")
    p, m = probes.alias("p"), members.alias("m")
    pairs = p.join(m, (F.col("p.s") == F.col("m.s")) & (F.col("p.v") == F.col("m.v")) & (F.col("p.fp") != F.col("m.fp")) & (~F.col("p.same") | (F.col("p.fp") < F.col("m.fp"))) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("m.fp"))) <= distance))
    pairs = pairs.select(F.col("p.fp").alias("a"), F.col("m.fp").alias("b"))
    return pairs if crowded is None else pairs.union(crowded)


def components(edges: DataFrame) -> DataFrame:
    """v, label: for each end of an edge (a, b) the smallest end that it can reach.

    Each round takes the least label among the neighbours and then the label of the label, so chains halve; every round is
    written to the shared folder. Ends when no label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        around = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("low"))
        lower = cut(labels.join(around, labels.v == around.a).select("v", F.least("label", "low").alias("label"), F.col("label").alias("old")), "lower")
        up = lower.select(F.col("v").alias("u"), F.col("label").alias("top"))
        after = cut(lower.join(up, F.col("label") == F.col("u")).select("v", F.least("label", "top").alias("label"), "old"), "labels")
        if after.filter("label <> old").isEmpty():
            return after.select("v", "label")
        labels = after.select("v", "label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, distance: int = 2, segments: int = 2, hot: int = 4096) -> DataFrame:
    """doc_id, fp and component_id of every row of docs: the smallest doc_id reachable over links between fingerprints.

    Exact copies share a fingerprint, so only distinct fingerprints are searched. Null and empty texts have fingerprint 0, which
    links like any other. A repeated row comes out as often as it came in. A null doc_id stays null and is never the smallest.
    """
    own = cut(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    nodes = cut(own.groupBy("fp").agg(F.min(doc_id).alias("first")), "nodes")
    label = components(links(nodes, distance, segments, hot))
    joined = label.join(nodes, label.v == nodes.fp)
    low = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = cut(label.join(low, "label").select(F.col("v").alias("fp"), "component_id"), "linked")
    of = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "groups")
    return own.join(of, "fp").select(doc_id, "fp", "component_id")


def near_duplicate_digest(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The row of each document that op9's contract asks for."""
    found = near_duplicates(docs, doc_id)
    return found.select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
