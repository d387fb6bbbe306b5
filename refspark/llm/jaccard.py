"""SimHash near-duplicates held to an exact rule: word shingles of a Jaccard similarity of `over / under` at least.

Operator 9's search proposes pairs, the rule decides. Fingerprints are of single distinct words here, not of shingles: a changed word
changes five shingles and moves a shingle fingerprint five times as far. Multi-index hashing finds the pairs within `distance` bits: each
fingerprint is looked up under all values of the small Hamming balls around its segments. Every pair found is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_columns, text_bytes
from .simhash import _LOWER, components, majority

#: Members of a chain of near fingerprints whose ranks lead a round of comparisons of their own, round by round. The others meet by rare shingles.
ROUNDS = ((1, 1), (2, 8), (9, 64))
#: Steps of commonness, in members, and the size of the table that tells it.
COMMON, LEVELS = (8, 64, 512, 4096), 1 << 20
#: Members ranked in one task.
SALT = 100_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()  # at \x20 and \x09-\x0D


def shingles(words: list[bytes], size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of the word shingles as signed longs, ascending; a shorter text is one shingle, one without words none."""
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(length) - 1
    n = max(1, len(words) - size + 1)
    start, stop = (stop - length + 1)[:n].tolist(), stop[-n:].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b], seed) for a, b in zip(start, stop, strict=True)), np.uint64, n).view(np.int64))


def node_of(words: list[bytes], seed: int = 42) -> int:
    """A text's words as a signed long: copies up to case and spaces share it."""
    h = xxhash.xxh64_intdigest(b" ".join(words), seed)
    return h - (1 << 64) if h >> 63 else h


def _bits(nodes: DataFrame, count: int) -> np.ndarray:
    """One bit for each node by its low bits, 16 times as many bits as nodes, up to 16 MB: what isn't in it needn't be read again."""
    size = 1 << min(27, max(10, (16 * count).bit_length()))
    low = F.col("node").bitwiseAND(size - 1)
    got = nodes.select(F.shiftright(low, 3).alias("at"), F.expr(f"shiftleft(1, int((node & {size - 1}) & 7))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(size >> 3, np.uint8)
    out[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64)
    return out


def merged(label: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, label: the groups of `label` joined by edges (a, b) between their nodes or new ones."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if label is None:
        known = ends.withColumn("label", F.col("node"))
    else:
        known = label.unionByName(ends.join(label, "node", "left_anti").withColumn("label", F.col("node")))
    known = cut(known, "known")
    x, y = known.select(F.col("node").alias("a"), F.col("label").alias("x")), known.select(F.col("node").alias("b"), F.col("label").alias("y"))
    between = edges.join(x, "a").join(y, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    top = components(between).select(F.col("v").alias("label"), F.col("label").alias("top"))
    return cut(known.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def commonness(rest: DataFrame) -> np.ndarray:
    """How common the shingles of the chains' members are, by the low bits of shingle and chain: the number of COMMON's steps that their count there exceeds.

    Each task counts its members' shingles in a table of LEVELS numbers; of the sums only those beyond the first step come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(LEVELS, np.int64)
        for batch in batches:
            hs = batch.column("hs")
            chain = np.repeat(batch.column("chain").to_numpy(), np.diff(hs.offsets.to_numpy()))
            np.add.at(table, (hs.flatten().to_numpy() ^ chain) & (LEVELS - 1), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["at", "c"])

    counts = rest.select("chain", "hs").mapInArrow(count, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c")).filter(F.col("c") > COMMON[0])
    got = counts.toPandas()
    out = np.zeros(LEVELS, np.uint8)
    out[got["at"].to_numpy(np.int64)] = (got["c"].to_numpy(np.int64)[:, None] > np.array(COMMON)).sum(1)
    return out


def by_rare_shingles(rest: DataFrame, over: int, under: int) -> DataFrame:
    """The shingles by which the members of a chain can be similar: chain, h, node, fp, part, n, i, lead.

    rest: chain, node, fp, part and hs, the distinct shingles. A member's shingles are put in an order that all members share, less common ones
    first, and i is the place in it. Of two members with a Jaccard similarity of over / under the first shingle that they share has at
    most n - over / under * n others before it in either; in the shorter one, as both have most of it in common, at most n - 2 over / (over + under)
    * n, which is what lead says. So of texts that all share a common part, but have more of their own than that, no two meet. How
    common a shingle is need only be known roughly: any order that is the same for all finds all.
    """
    levels = rest.sparkSession.sparkContext.broadcast(commonness(rest))

    def make():
        def work(batch: pa.RecordBatch) -> list:
            level, sizes, out = levels.value, [], []
            for chain, hs in zip(batch.column("chain").to_pylist(), batch.column("hs"), strict=True):
                h = hs.values.to_numpy()
                common = level[(h ^ np.int64(chain)) & (LEVELS - 1)]
                sizes.append(len(h))
                out.append(h[np.lexsort((h, common))[: len(h) * (under - over) // under + 1]])
            return [sizes, out]

        return work

    placed = map_columns(rest, ["chain", "hs"], ["chain", "node", "fp", "part"], "n int, first array<bigint>", make)
    placed = placed.select("chain", "node", "fp", "part", "n", F.posexplode("first").alias("i", "h"))
    return placed.withColumn("lead", F.expr(f"i * {over + under} <= n * {under - over}"))


def groups_in_chains(members: DataFrame, sets: DataFrame, over: int, under: int, distance: int) -> DataFrame | None:
    """node, label: the groups of members linked by a Jaccard similarity of over / under at least and fingerprints within the distance; null without links.

    members: node, fp, chain; only members of one chain are compared. sets: node, hs (distinct shingles). Each round compares texts that are
    in different groups by then: all with the text nearest to their chain's middle, with the next ones, and the rest by rare shingles, first with
    one holder of each. So a group of copies costs links in proportion to its size as soon as one round meets a text that all are copies of.
    """
    def near(x: str, y: str):
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("hs").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("hs").alias("y"))
        j = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
        return cut(j.filter(F.col("i") * (over + under) >= over * (F.size("x") + F.size("y"))).select("a", "b"), "edges")

    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    middle = reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * F.col(f"b{i}") > F.col("k"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(0).cast("long") for i in range(64)])
    chains = cut(members.groupBy("chain").agg(F.count("*").alias("k"), *ones).select("chain", "k", middle.alias("middle")), "chains")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))  # what all others were copied from lies in their middle
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / SALT))
    ranked = members.join(chains, "chain").withColumn("far", far)
    ranked = cut(ranked.withColumn("r", F.row_number().over(W.partitionBy("chain", salt).orderBy("far", "node"))), "ranked")
    last = ROUNDS[-1][1] + 1
    tops = ranked.filter(F.col("r") < last).withColumn("place", F.least(F.lit(last), F.row_number().over(W.partitionBy("chain").orderBy("far", "node"))))
    ranked = cut(tops.unionByName(ranked.filter(F.col("r") >= last).withColumn("place", F.lit(last))).drop("r", "far", "middle"), "places")
    label = None

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows with their groups so far, of chains that have more than one."""
        parts = rows.withColumn("part", F.col("node")) if label is None else rows.join(label, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")
        some = parts.groupBy("chain").agg((F.min("part") < F.max("part")).alias("mixed")).filter("mixed").select("chain")
        return cut(parts.join(some, "chain"), "parts")

    def add(pairs: DataFrame) -> None:
        nonlocal label
        new = verified(cut(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs"))
        if not new.isEmpty():
            label = merged(label, new)

    for low, high in ROUNDS:
        parts = mixed(ranked.filter(F.col("k") > low))
        if parts.isEmpty():
            break
        x, y = parts.filter(F.col("place").between(low, high)).alias("x"), parts.filter(F.col("place") >= low).alias("y")
        add(x.join(y, F.expr("x.chain = y.chain and x.part <> y.part and (x.place < y.place or x.place = y.place and x.node < y.node)") & near("x.fp", "y.fp")))
    else:
        rest = ranked.filter(F.col("place") == last)
        parts = mixed(rest)
        if not parts.isEmpty():
            keys = cut(by_rare_shingles(cut(parts.select("chain", "node", "fp", "part").join(sets, "node"), "rest"), over, under), "keys")
            similar = F.expr(f"least(x.n, y.n) * {under} >= greatest(x.n, y.n) * {over} and least(x.n - x.i, y.n - y.i) * {over + under} >= (x.n + y.n) * {over}") & near("x.fp", "y.fp")
            first = keys.filter("lead").groupBy("chain", "h").agg(F.min_by(F.struct("node", "fp", "part", "n", "i"), F.struct("i", "n", "node")).alias("f")).select("chain", "h", "f.*")
            add(first.alias("x").join(keys.alias("y"), F.expr("x.chain = y.chain and x.h = y.h and x.part <> y.part") & similar))
            current = mixed(rest).select("node", "part")
            keys = keys.drop("part").join(current, "node")
            x, y = keys.filter("lead").alias("x"), keys.alias("y")
            add(x.join(y, F.expr("x.chain = y.chain and x.h = y.h and x.part <> y.part and (x.n < y.n or x.n = y.n and x.node < y.node)") & similar))
    return label


def near_duplicates(docs: DataFrame, keep: list[str], text: str = "text", size: int = 5, over: int = 4, under: int = 5, distance: int = 7, segments: int = 4, seed: int = 42) -> DataFrame:
    """The columns `keep` of every row of docs, node (its words' hash) and part: equal for rows linked by pairs of Jaccard >= over / under
    whose word fingerprints are at most `distance` bits apart.

    Null texts and texts without words are copies of each other. First fingerprints are chained: those that share a segment are held
    against the least of them, and then the balls around segments are searched for pairs that aren't in one chain yet, so a large group of
    copies makes as many links as it has members. Texts are compared within a chain: all with the one nearest to its middle, then with the
    next ones, and the others where they share a rare shingle: first with one holder of it, then those that are in different groups by then. In
    every round only texts in different groups are compared. Repeated rows come out as often as they came in; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def first():
        def work(batch):
            nodes, prints = [], []
            for t in text_bytes(batch.column(text)):
                words = words_of(t)
                nodes.append(node_of(words, seed))
                prints.append(majority(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in set(words)), np.uint64)))
            return [pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64))]

        return work

    own = cut(map_columns(docs, [text], keep, "node bigint, fp bigint", first), "own")
    nodes = cut(own.groupBy("node").agg(F.first("fp").alias("fp")), "nodes")
    width = 64 // segments
    value = [F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) for k in range(segments)]
    masks = F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for r in range(distance // segments + 1) for c in combinations(range(width), r)])

    def ball(k: int):
        """The values within the radius of segment k that aren't lower: of two values, the lower finds the higher."""
        every = F.transform(masks, lambda m: F.struct(F.lit(k).alias("s"), value[k].bitwiseXOR(m).alias("v"), (m == 0).alias("same")))
        return F.filter(every, lambda x: x["v"] >= value[k])

    def chained(label: DataFrame | None) -> DataFrame:
        return nodes.withColumn("part", F.col("node")) if label is None else nodes.join(label, "node", "left").select("node", "fp", F.coalesce("label", "node").alias("part"))

    def near(x: str, y: str):
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance

    exact = F.array(*[F.struct(F.lit(k).alias("s"), value[k].alias("v")) for k in range(segments)])
    members = nodes.select("node", "fp", F.inline(exact))
    lead = members.groupBy("s", "v").agg(F.min(F.struct("node", "fp")).alias("lead"), F.count("*").alias("k")).filter("k > 1")
    star = members.join(lead, ["s", "v"]).filter((F.col("node") != F.col("lead.node")) & near("fp", "lead.fp"))
    chain = merged(None, cut(star.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "star"))
    placed = cut(chained(chain), "chained")
    p = placed.select("node", "fp", "part", F.inline(F.concat(*[ball(k) for k in range(segments)]))).alias("p")
    m = placed.select("node", "fp", "part", F.inline(exact)).alias("m")
    found = p.join(m, F.expr("p.s = m.s and p.v = m.v and p.part <> m.part and (not p.same or p.node < m.node)") & near("p.fp", "m.fp"))
    chain = merged(chain, cut(found.select(F.least("p.node", "m.node").alias("a"), F.greatest("p.node", "m.node").alias("b")).distinct(), "found"))
    members = cut(nodes.join(chain, "node").select("node", "fp", F.col("label").alias("chain")), "members")
    bits = spark.sparkContext.broadcast(_bits(members, members.count()))

    def again():
        mask, known = len(bits.value) * 8 - 1, bits.value

        def work(batch):
            out = []
            for t in text_bytes(batch.column(text)):
                words = words_of(t)
                node = node_of(words, seed)
                out.append((node, shingles(words, size, seed)) if known[(node & mask) >> 3] >> (node & 7) & 1 else (None, None))
            return [[x for x, _ in out], [x for _, x in out]]

        return work

    sets = map_columns(docs, [text], [], "node bigint, hs array<bigint>", again).filter("node is not null")
    sets = cut(sets.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hs").alias("hs")), "sets")

    label = groups_in_chains(members, sets, over, under, distance)
    label = label if label is not None else members.select("node", F.col("node").alias("label"))
    of = cut(nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("part")), "groups")
    return own.select(*keep, "node").join(of, "node").select(*keep, "node", "part")
