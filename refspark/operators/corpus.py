"""The evidence corpus: claim text, families, concepts and what recurs in them, retrieval, and reports over traces and runs."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refspark.shared import checkpointed

# Spellings of methods and components, and the words of a text that name a component.
METHOD_ALIASES = {
    "single": "single", "standalone": "single", "regime": "regime_blend", "regime_blend": "regime_blend", "regime_blends": "regime_blend", "regime-blend": "regime_blend",
    "regime blend": "regime_blend", "regime blended": "regime_blend", "regime conditioned blend": "regime_blend", "ensemble": "ensemble", "ensembles": "ensemble", "blend": "ensemble",
    "basket": "ensemble", "overlay": "overlay", "overlays": "overlay",
}
COMPONENT_ALIASES = {
    "carry": "carry", "funding": "carry", "funding_carry": "carry", "basis": "carry", "trend": "trend", "trend_following": "trend", "trendfollowing": "trend", "ewmac": "trend",
    "moving_average": "trend", "moving_average_crossover": "trend", "momentum": "momentum", "value": "value", "reversal": "mean_reversion", "mean_reversion": "mean_reversion",
    "vol": "volatility", "volatility": "volatility", "vrp": "volatility", "microstructure": "microstructure", "macro": "macro", "tail": "tail", "stat_arb": "stat_arb", "arbitrage": "arbitrage",
}
COMPONENT_WORDS = (
    ("carry", ("funding carry", "carry", "funding", "basis")),
    ("trend", ("trend-following", "trend following", "trend", "ewmac", "moving average crossover", "moving-average crossover", "moving average")),
    ("momentum", ("momentum",)),
    ("value", ("value",)),
    ("mean_reversion", ("mean reversion", "mean-reversion", "reversal")),
    ("volatility", ("volatility", "realized vol", "implied vol", "vrp", "garch")),
    ("microstructure", ("order book", "liquidation", "microstructure", "depth")),
    ("macro", ("macro", "cpi", "fed", "recession", "inflation", "treasury")),
    ("tail", ("tail", "skew", "crash")),
    ("stat_arb", ("stat arb", "statistical arbitrage")),
    ("arbitrage", ("arbitrage",)),
)
METHOD_WORDS = (
    ("regime_blend", ("regime blend", "regime-blend", "regime_blend", "regime conditioned blend", "regime-conditioned blend")),
    ("ensemble", ("ensemble", "basket", "blend of", "blended")),
    ("overlay", ("overlay",)),
)
# Data domains and the words that name them, tried in this order.
DATA_DOMAINS = (
    ("prediction_market", ("polymarket", "kalshi", "prediction market", "election", "event contract")),
    ("weather", ("weather", "temperature", "noaa", "hdd", "cdd")),
    ("crypto", ("btc", "eth", "sol", "crypto", "bitcoin", "funding", "perp", "altcoin")),
    ("equities", ("equity", "equities", "stock", "spx", "s&p", "sp500", "nasdaq", "share")),
    ("macro", ("cpi", "fed", "recession", "inflation", "treasury", "bond", "macro", "rate")),
)
# Claim types whose trials are a family by type and domain, and what says that a claim is one preregistered test.
TYPED_FAMILIES = ("predictive_regression", "factor_spanning", "cross_sectional_sort", "event_study", "forecast_skill", "formulaic_signal")
PREREGISTERED = (
    r"\b(?:exactly\s+)?one\s+pre[- ]?registered\s+statistic\b",
    r"\bsingle\s+pre[- ]?registered\s+statistic\b",
    r"\b(?:one|single)\s+(?:declared\s+)?deflation cohort\b",
    r"\bcounts?\s+as\s+one\s+pre[- ]?registered\s+search\b",
    r"\bpre[- ]?registered\s+search\s+denominator\s*(?:of\s+|is\s+|=\s*)1\b",
    r"\b(?:deflation\s+)?cohort\s+denominator\s*(?:of\s+|is\s+|=\s*)1\b",
)
ONE_TEST = r"\b(?:one|single)\s+(?:pooled\s+)?test\b|\bpooled\s+test\b.{0,40}\b(?:one|single)\b"
PREREGISTRATION = r"\bpre[- ]?registered\b|\bdeflation cohort\b|\bpre[- ]?registered search\b|\b(?:exactly\s+)?one\s+pre[- ]?registered\s+statistic\b|\bsingle\s+pre[- ]?registered\s+statistic\b"
# Wording that says more than a verdict can; the first words are too strong for a statement too.
OVERCLAIMS = ("validated", "proven", "confirmed alpha", "caused by", "research-supported", "guarantees")
STRONG_CLAIMS = OVERCLAIMS + ("alpha", "edge", "reliable", "robust", "works", "effective", "predicts", "outperforms")
# Punctuation that is folded before a quotation is looked for, and words that say nothing in a series' name.
FOLDS = {
    "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
}
LONG_FOLDS = {"…": "...", "→": "->", "⇒": "->", "⟶": "->"}
FILLER = ("usd", "close", "px", "last", "value", "series", "the", "rate")
CONTEXT_CAP = 1200
# Words that name no series, words too common to name one alone, and the tickers of assets that prose spells out.
PROSE_STOP = ("a", "an", "and", "as", "at", "by", "daily", "for", "from", "in", "index", "of", "on", "signal", "the", "to", "with")
GENERIC = ("abs", "change", "delta", "funding", "native", "perp", "price", "prices", "prob", "probability", "ret", "return", "returns", "rv", "signal", "spot", "vol", "volume")
TICKERS = {
    "bitcoin": "btc", "ethereum": "eth", "solana": "sol", "ripple": "xrp", "dogecoin": "doge", "cardano": "ada",
    "chainlink": "link", "binance": "bnb", "polkadot": "dot", "avalanche": "avax", "litecoin": "ltc", "polygon": "matic",
}
# Classes of candidates, and those that can be tested now.
CANDIDATE_CLASSES = ("testable_now", "testable_with_new_module", "requires_data_acquisition", "conceptual_only")
TESTABLE = CANDIDATE_CLASSES[:2]
#: Cells in which a set's words are counted, and words hashed at a time; candidates compared at first, for each pair asked for, and at most at a time.
CELLS, HASHED = 64, 65_536
COMPARED, MOST_COMPARED = 20, 262_144


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _first(text: Column, table: tuple, other: str) -> Column:
    out = F.lit(other)
    for name, words in reversed(table):
        out = F.when(_any(text, words), name).otherwise(out)
    return out


def data_domain(text: Column) -> Column:
    return _first(F.lower(F.coalesce(text, F.lit(""))), DATA_DOMAINS, "general")


def preregistered_single(text: Column) -> Column:
    """Whether a text says that it is one preregistered test of one cohort; plain statistical prose doesn't."""
    low, said = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in PREREGISTERED:
        said = said | low.rlike(p)
    return said | (low.rlike(r"\bno multiplicity correction\b") & low.rlike(ONE_TEST) & low.rlike(PREREGISTRATION))


def _slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strategy_family(text: Column, components: Column, method: Column, strategy_class: Column) -> Column:
    """components+components::method: as declared where that can be read, else by the words of the text; without any, by the class."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(components, lambda c: F.coalesce(_table(COMPONENT_ALIASES)[_slug(c)], _slug(c))), lambda c: c != "")))
    spoken = F.regexp_replace(F.lower(F.trim(method)), "[_-]", " ")
    how = F.coalesce(_table(METHOD_ALIASES)[spoken], _table(METHOD_ALIASES)[_slug(method)])
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_sort(F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in COMPONENT_WORDS])))
    slug = F.coalesce(_slug(strategy_class), F.lit(""))
    other = F.array(F.when(slug == "", "unspecified").otherwise(F.coalesce(_table(COMPONENT_ALIASES)[slug], slug)))
    key = lambda c, m: F.concat(F.array_join(c, "+"), F.lit("::"), m)
    return F.when((F.size(names) > 0) & how.isNotNull(), key(names, how)).otherwise(key(F.when(F.size(found) > 0, found).otherwise(other), _first(low, METHOD_WORDS, "single")))


def trial_family(claim_id: Column, claim_type: Column, single: Column, unanchored: Column, strategy_class: Column, registered: Column, domain: Column) -> Column:
    """The family whose trials deflate a claim: its type and domain; generated or external claims of a domain; else its registered class and domain."""
    by = lambda name: F.concat(name, F.lit("::"), domain)
    own = F.when(registered, by(strategy_class)).otherwise(by(F.lit("external")))
    out = F.when(claim_type.isin(*TYPED_FAMILIES), by(claim_type)).when(unanchored, by(F.lit("generated"))).otherwise(own)
    return F.when((claim_type == "provided_series_statistic") & single, F.concat(F.lit("provided_series_statistic::"), claim_id.cast("string"))).otherwise(out)


def overclaim_flags(statement: Column, mechanism: Column, explanation: Column, verdict: Column) -> Column:
    """Names of fields whose wording is too strong, and of an explanation that its verdict can't carry."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    strong = _any(low(explanation), STRONG_CLAIMS)
    weak = ~verdict.isin("watch", "research-supported") & (F.trim(low(explanation)) != "") & ~strong
    return F.array_compact(F.array(F.when(_any(low(statement), OVERCLAIMS), F.lit("statement:overclaim")), F.when(_any(low(mechanism), STRONG_CLAIMS), F.lit("mechanism:overclaim")), F.when(strong, F.lit("surviving_explanation:overclaim")), F.when(weak, F.lit("surviving_explanation:verdict_too_weak"))))


def evidence_direction(verdict: Column) -> Column:
    return F.when(verdict.isin("watch", "research-supported"), "positive").when(verdict == "kill", "negative").otherwise("unknown")


def concept_rows(records: DataFrame) -> DataFrame:
    """concept_id, statement, direction, surviving, boundary: one observation for each verdict. records: id, statement, verdict, kill_reason, explanation."""
    text = F.trim(F.coalesce("statement", F.lit("")))
    said = F.when(text != "", F.concat(F.lit("Experiment on: "), text)).otherwise("Experiment observation")
    survives = F.when(F.col("verdict").isin("watch", "research-supported"), F.coalesce("explanation", F.lit(""))).otherwise("")
    return records.select(F.col("id").alias("concept_id"), said.alias("statement"), evidence_direction(F.col("verdict")).alias("direction"), survives.alias("surviving"), F.col("kill_reason").alias("boundary"))


def canonical_span(text: Column) -> Column:
    """Text with punctuation folded to ASCII, without marks of emphasis and code, white space as single spaces."""
    out = F.translate(F.coalesce(text, F.lit("")), "".join(FOLDS), "".join(FOLDS.values()))
    for a, b in LONG_FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"\*\*|__|`|\*", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def span_grounded(span: Column, text: Column) -> Column:
    """Whether a quotation stands in a text: whole, or each of its fragments of five words or 25 characters; an empty one never does."""
    whole, source = canonical_span(span), canonical_span(text)
    pieces = F.split(F.coalesce(span, F.lit("")), r"(?<=[.!?])\s+|[\r\n]+\s*(?:[-*•]\s+|\d+[.)]\s+)?|\s+(?=(?:[-*•]|\d+[.)])\s+)")
    pieces = F.filter(F.transform(pieces, canonical_span), lambda x: (F.size(F.regexp_extract_all(x, F.lit(r"(?U)(\w+)"), F.lit(1))) >= 5) | (F.length(x) >= 25))
    return (whole != "") & (source.contains(whole) | ((F.size(pieces) > 0) & F.forall(pieces, lambda x: source.contains(x))))


def key_tokens(name: Column, drop_filler: bool = True) -> Column:
    """The words of a series' name, without a namespace before a dot."""
    words = F.filter(F.split(F.element_at(F.split(F.lower(F.trim(name)), r"\."), -1), "[^a-z0-9]+"), lambda x: x != "")
    return F.filter(words, lambda x: ~x.isin(*FILLER)) if drop_filler else words


def resolve_alias(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """name, key: the catalogue key that a name stands for; null if none or more than one does, or if another key is the same plus one word.

    Keys meet names by their words in order of the alphabet: equal, or one's words beginning or ending the other's, from two words on. A name
    is exploded into its own beginnings and ends and looked up, so names and keys are joined by equality. names: name; catalog: key.
    """
    words = lambda c: F.array_sort(key_tokens(F.col(c)))
    join = lambda a: F.array_join(a, "_")
    keys = catalog.select("key").distinct().select("key", words("key").alias("w"), F.array_sort(F.array_distinct(key_tokens(F.col("key"), False))).alias("all"))
    keys = keys.withColumn("norm", join("w")).withColumn("same", F.count("*").over(W.partitionBy("norm")))
    less = keys.select(F.col("key").alias("other"), "all", F.explode("all").alias("out")).select("other", join(F.array_sort(F.array_except("all", F.array("out")))).alias("base"))
    base = keys.select("key", join(F.array_sort(F.array_distinct("w"))).alias("base")).filter("base <> ''")
    sibling = base.join(less, "base").filter("key <> other").select("key").distinct().withColumn("sibling", F.lit(True))
    ends = lambda w: F.array_distinct(F.concat(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: join(F.slice(w, 1, n))), F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: join(F.slice(w, F.size(w) - n + 1, n)))))
    parts = lambda w: F.when(F.size(w) > 2, ends(w)).otherwise(F.array().cast("array<string>"))
    asked = names.select("name").distinct().withColumn("w", words("name")).withColumn("norm", join("w"))
    exact = asked.join(keys.select("key", "norm", "same"), "norm").select("name", "key", F.lit(True).alias("exact"), "same")
    single = keys.filter("same = 1 and size(w) >= 2")
    longer = asked.filter("size(w) >= 2").join(single.select("key", F.explode(parts(F.col("w"))).alias("norm")), "norm").select("name", "key")
    shorter = asked.select("name", F.explode(parts(F.col("w"))).alias("norm")).join(single.select("key", "norm"), "norm").select("name", "key")
    near = longer.unionByName(shorter).distinct().withColumns({"exact": F.lit(False), "same": F.lit(1).cast("long")})
    found = exact.unionByName(near).join(sibling, "key", "left")
    g = found.groupBy("name").agg(F.bool_or("exact").alias("any"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.max(F.when(F.col("exact"), F.struct("key", "sibling"))).alias("e"), F.max(F.when(~F.col("exact"), F.struct("key", "sibling"))).alias("k"))
    hit = F.when(F.col("any"), F.when(F.col("n_exact") == 1, F.col("e"))).when(F.col("n_near") == 1, F.col("k"))
    return names.select("name").distinct().join(g.select("name", F.when(hit["sibling"].isNull(), hit["key"]).alias("key")), "name", "left")


def recurring_claims(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, direction, statement, support) of claims that two or more concepts state with one direction, and their edges (concept_id, key, direction, type)."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce("statement", F.lit(""))), "[^a-z0-9]+", " "))
    rows = concepts.filter(F.col("direction").isin("positive", "negative")).withColumn("key", key).filter("key <> ''")
    nodes = rows.groupBy("key", "direction").agg(F.min_by("statement", "concept_id").alias("statement"), F.count("*").alias("support")).filter("support >= 2")
    return nodes, rows.join(nodes.select("key", "direction"), ["key", "direction"], "left_semi").select("concept_id", "key", "direction", F.lit("recurs_as").alias("type"))


def family_principles(concepts: DataFrame, least: int = 3, *, year: int, half_life: float = 4.0) -> DataFrame:
    """family, direction, granularity, support, confidence, domains: evidence that recurs in a family, at every grain that its concepts share.

    concepts: concept_id, direction, components (an array), method, year, domain. A concept counts for its whole family, for its set of
    components and for each component; confidence is the mean of 0.5 ^ (age / half_life).
    """
    both = F.array_join(F.array_sort("components"), "+")
    keys = F.concat(F.array(F.struct(F.concat_ws("::", both, "method").alias("family"), F.lit(0).alias("grain")), F.struct(both.alias("family"), F.lit(1).alias("grain"))), F.transform("components", lambda c: F.struct(c.alias("family"), F.lit(2).alias("grain"))))
    rows = concepts.filter(F.col("direction").isin("positive", "negative")).select("concept_id", "direction", "year", "domain", F.inline(keys))
    once = rows.groupBy("concept_id", "direction", "year", "domain", "family").agg(F.min("grain").alias("grain"))
    fresh = F.pow(F.lit(0.5), F.greatest(F.lit(0), year - F.col("year")) / half_life)
    g = once.groupBy("family", "direction").agg(F.min("grain").alias("grain"), F.count("*").alias("support"), F.avg(fresh).alias("confidence"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
    name = F.element_at(F.array(F.lit("specific"), F.lit("components"), F.lit("component")), F.col("grain") + 1)
    return g.filter(F.col("support") >= least).select("family", "direction", name.alias("granularity"), "support", "confidence", "domains")


def mechanisms(principles: DataFrame, supports: DataFrame) -> DataFrame:
    """direction, families, domains, support: a direction whose family principles span two domains or more; each supporting concept counts once.

    supports: family, direction, concept_id, domain.
    """
    j = supports.join(principles.select("family", "direction"), ["family", "direction"], "left_semi")
    g = j.groupBy("direction").agg(F.count_distinct("family").alias("families"), F.count_distinct("domain").alias("domains"), F.count_distinct("concept_id").alias("support"))
    return g.filter("domains >= 2")


def cover(sets: list[tuple[list[str], int, int | None]], least: int) -> list[tuple[str, int, int | None]]:
    """Labels, the one with most kills first (of equal ones the first by name), each with its kills and their newest year; a label's kills go with it.

    sets: labels, number of kills with just these, newest year. A label's number only falls, so the heap's top is counted anew and taken if it is
    still the largest.
    """
    where: dict[str, list[int]] = {}
    for k, (labels, _, _) in enumerate(sets):
        for label in labels:
            where.setdefault(label, []).append(k)
    gone = [False] * len(sets)
    heap = [(-sum(sets[k][1] for k in ks), label) for label, ks in where.items()]
    heapify(heap)
    out = []
    while heap:
        said, label = heappop(heap)
        left = [k for k in where[label] if not gone[k]]
        n = sum(sets[k][1] for k in left)
        if n < -said:
            if n >= least:
                heappush(heap, (-n, label))
            continue
        if n < least:
            break
        out.append((label, n, max((sets[k][2] for k in left if sets[k][2] is not None), default=None)))
        for k in left:
            gone[k] = True
    return out


def principles(kills: DataFrame, least: int = 3, *, year: int, half_life: float = 4.0) -> DataFrame:
    """level, label, kill_reason, n, newest, confidence: what structural kills have in common, each kill supporting one principle.

    kills: claim_id, at, kill_reason, domain, components (an array), method, year; components null where no family is known. First whole
    families, then methods of what is left, then single components, the largest group first, and by domain the kills without a family. A kill has
    one reason, so the components of all reasons are covered at once, each by one task over its distinct sets of components, not its kills.
    """
    one = kills.groupBy("claim_id").agg(F.min_by(F.struct(*[c for c in kills.columns if c != "claim_id"]), "at").alias("k")).select("claim_id", "k.*")

    def graded(groups: DataFrame, level: str) -> DataFrame:
        age = F.greatest(F.lit(0), year - F.coalesce("newest", F.lit(year)))
        return groups.filter(F.col("n") >= least).select(F.lit(level).alias("level"), "label", "kill_reason", "n", F.coalesce("newest", F.lit(year)).alias("newest"), F.round(0.5 * F.pow(F.lit(0.5), age / half_life), 3).alias("confidence"))

    def rows(groups: DataFrame, level: str) -> DataFrame:
        return graded(groups.groupBy("label", "kill_reason").agg(F.count("*").alias("n"), F.max("year").alias("newest")), level)

    known = one.filter("components is not null and method is not null")
    by_family = known.withColumn("label", F.concat_ws("::", F.array_join(F.array_sort("components"), "+"), "method"))
    exact = rows(by_family, "exact")
    left = by_family.join(exact.select("label", "kill_reason"), ["label", "kill_reason"], "left_anti").withColumn("label", F.col("method"))
    methods = rows(left, "method")
    left = left.join(methods.select("label", "kill_reason"), ["label", "kill_reason"], "left_anti")
    names = F.array_sort(F.array_distinct(F.array_compact("components")))
    sets = left.filter("kill_reason is not null").groupBy("kill_reason", names.alias("names")).agg(F.count("*").alias("n"), F.max("year").alias("newest"))

    def covered(table: pa.Table) -> pa.Table:
        found = cover(list(zip(table.column("names").to_pylist(), table.column("n").to_pylist(), table.column("newest").to_pylist(), strict=True)), least)
        label, n, newest = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"label": pa.array(label, pa.string()), "kill_reason": pa.array(table.column("kill_reason").to_pylist()[:1] * len(found), pa.string()), "n": pa.array(n, pa.int64()), "newest": pa.array(newest, pa.int64())})

    single = sets.withColumn("newest", F.col("newest").cast("long")).groupBy("kill_reason").applyInArrow(covered, "label string, kill_reason string, n bigint, newest bigint")
    single = graded(single.withColumn("newest", F.col("newest").cast(kills.schema["year"].dataType)), "component")
    return exact.unionByName(methods).unionByName(rows(one.filter("components is null or method is null").withColumn("label", F.col("domain")), "domain")).unionByName(single)


def contrastive(records: DataFrame, least_kills: int = 3, least_survivors: int = 2) -> DataFrame:
    """kill_reason, domain, n_kills, survivor_domains, n_domains: a reason that recurs in a domain while others have survivors.

    The domains with survivors are one row, an array of a domain each, so reasons meet them without pairs of rows.
    """
    kills = records.filter("structural and kill_reason is not null").groupBy("kill_reason", "domain").agg(F.count("*").alias("n_kills")).filter(F.col("n_kills") >= least_kills)
    alive = records.filter(F.col("verdict").isin("watch", "research-supported")).groupBy("domain").agg(F.count("*").alias("n")).filter(F.col("n") >= least_survivors)
    names = alive.agg(F.array_sort(F.collect_list("domain")).alias("alive"))
    j = kills.join(F.broadcast(names)).withColumn("alive", F.array_remove("alive", F.col("domain"))).filter("size(alive) > 0")
    return j.select("kill_reason", "domain", "n_kills", F.array_join("alive", ",").alias("survivor_domains"), F.size("alive").cast("long").alias("n_domains"))


def dependency_safe(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, safe: an aggregate is safe unless it rests, over any chain of aggregates, on an unanchored source.

    nodes: node_id, source_type (null for aggregates). links: node_id, rests_on. A node with a source of its own is a leaf. Unsafety walks up
    one link a round and each node is marked once, so cycles end; the rounds are as many as the longest chain.
    """
    from refspark.operators.reserve import UNANCHORED

    edges = links.join(nodes.filter("source_type is null").select("node_id"), "node_id", "left_semi").select("node_id", "rests_on").distinct()
    bad = checkpointed(nodes.filter(F.lower("source_type").isin(*UNANCHORED)).select("node_id").distinct())
    new = bad
    while not new.isEmpty():
        up = edges.join(new.select(F.col("node_id").alias("rests_on")), "rests_on", "left_semi").select("node_id").distinct()
        new = checkpointed(up.join(bad, "node_id", "left_anti"))
        bad = checkpointed(bad.unionByName(new))
    aggregates = nodes.filter("source_type is null").select("node_id")
    return aggregates.join(bad.withColumn("bad", F.lit(True)), "node_id", "left").select("node_id", F.col("bad").isNull().alias("safe"))


def eligible_nodes(nodes: DataFrame, overlapping: DataFrame, safe: DataFrame) -> DataFrame:
    """Nodes that may be shown: with an id and a text, of an anchored source that is no confirmation, off the reserve, and resting on nothing unanchored.

    overlapping: node_id of what shares data with a reserve. safe: dependency_safe's rows.
    """
    from refspark.operators.reserve import UNANCHORED

    source = F.coalesce(F.lower("source_type"), F.lit(""))
    ok = nodes.filter(F.col("node_id").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~source.isin("confirmation", *UNANCHORED))
    return ok.join(overlapping.select("node_id").distinct(), "node_id", "left_anti").join(safe.filter("not safe").select("node_id"), "node_id", "left_anti")


def expand_eligible(seeds: DataFrame, edges: DataFrame, eligible: DataFrame, hops: int = 1, k: int = 6) -> DataFrame:
    """query_id, node_id, score, rank: the k best of each query among its seeds and what lies within `hops` edges of them, half the score a step.

    Only eligible nodes are walked over. seeds: query_id, node_id, score.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.join(eligible.select(F.col("node_id").alias("b")), "b", "left_semi")
    best = seeds.join(eligible.select("node_id"), "node_id", "left_semi").select("query_id", "node_id", "score")
    for _ in range(hops):
        step = best.join(both, F.col("node_id") == F.col("a")).select("query_id", F.col("b").alias("node_id"), (F.col("score") * 0.5).alias("score"))
        best = best.unionByName(step).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).filter(F.col("rank") <= k)


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """start, a, b, type, direction (out or in, seen from the start), depth of the edges within `depth` steps of a start, each at its least depth."""
    sides = edges.select(F.col("a").alias("at"), F.col("b").alias("to"), "a", "b", "type", F.lit("out").alias("direction"))
    sides = sides.unionByName(edges.select(F.col("b").alias("at"), F.col("a").alias("to"), "a", "b", "type", F.lit("in").alias("direction")))
    front, out = starts.select(F.col("id").alias("start"), F.col("id").alias("at")), None
    seen = front
    for d in range(1, depth + 1):
        step = front.join(sides, "at").select("start", "to", "a", "b", "type", "direction", F.lit(d).alias("depth"))
        out = step if out is None else out.unionByName(step)
        front = step.select("start", F.col("to").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        seen = seen.unionByName(front)
    return out.drop("to").groupBy("start", "a", "b", "type").agg(F.min(F.struct("depth", "direction")).alias("m")).select("start", "a", "b", "type", "m.direction", "m.depth")


def isolation_score(claims: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """claim_id, neighbours, family_present, isolation: 1 / (1 + neighbours + 1 if one of them names a word of the mechanism).

    claims: claim_id, mechanism. hits: claim_id, text, rank, of which the first `most` count.
    """
    near = hits.filter(F.col("rank") <= most)
    terms = claims.select("claim_id", F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("mechanism", F.lit(""))), r"[^\p{L}\p{N}]", " "), " +"), lambda x: F.length(x) >= 4).alias("terms"))
    j = terms.join(near, "claim_id", "left")
    named = F.exists("terms", lambda t: F.lower("text").contains(t))
    g = j.groupBy("claim_id").agg(F.count("text").alias("neighbours"), F.coalesce(F.bool_or(named), F.lit(False)).alias("family_present"))
    return g.withColumn("isolation", F.round(1.0 / (1 + F.col("neighbours") + F.col("family_present").cast("int")), 4))


def format_context(nodes: DataFrame, by: str = "query_id", cap: int = CONTEXT_CAP) -> DataFrame:
    """by, context: a line for each node in order of rank, up to `cap` characters; the line that crosses it is cut if over 20 are left.

    nodes: by, rank, level, statement, direction, support; at most some dozen of a query.
    """
    line = F.concat(F.lit("["), F.coalesce("level", F.lit("corpus")), F.lit("] "), F.trim("statement"), F.lit(" ("), F.coalesce("direction", F.lit("unknown")), F.lit(") - supported by "), F.col("support").cast("string"), F.lit(" observations"))
    rows = nodes.filter(F.trim(F.coalesce("statement", F.lit(""))) != "").withColumn("line", line)
    run = W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("line") + 1).over(run), F.lit(0))  # with the line break that follows each
    rows = rows.withColumn("at", before)
    kept = F.when(F.col("at") + F.length("line") <= cap, F.col("line")).when((F.col("at") <= cap) & (cap - F.greatest(F.col("at") - 1, F.lit(0)) > 20), F.rtrim(F.substring("line", F.lit(1), (cap - F.greatest(F.col("at") - 1, F.lit(0))).cast("int"))))
    lines = rows.withColumn("kept", kept).filter("kept is not null").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "kept"))).alias("l"))
    return lines.select(by, F.substring(F.array_join(F.transform("l", lambda x: x["kept"]), "\n"), 1, cap).alias("context"))


def triage_report(traces: DataFrame) -> DataFrame:
    """part (verdict or exit_stage), name, n: both distributions in one pass over the traces."""
    g = traces.select(F.coalesce("verdict", F.lit("unknown")).alias("verdict"), F.coalesce("exit_stage", F.lit("unknown")).alias("exit_stage"))
    sides = F.array(F.struct(F.lit("verdict").alias("part"), F.col("verdict").alias("name")), F.struct(F.lit("exit_stage").alias("part"), F.col("exit_stage").alias("name")))
    return g.groupBy("verdict", "exit_stage").agg(F.count("*").alias("n")).select("n", F.inline(sides)).groupBy("part", "name").agg(F.sum("n").alias("n"))


def audit_summary(events: DataFrame) -> DataFrame:
    """run, stage, duration_ms, gates, exits, malformed. events: run, event, stage, duration_ms (text or number), gate; a null event is malformed."""
    ms = F.expr("try_cast(duration_ms as double)")
    g = events.groupBy("run", F.coalesce("stage", F.lit("unknown")).alias("stage"))
    return g.agg(F.coalesce(F.sum(ms), F.lit(0.0)).alias("duration_ms"), F.count_if(F.col("event") == "gate_outcome").alias("gates"), F.count_if(F.col("event") == "exit").alias("exits"), F.count_if(F.col("event").isNull()).alias("malformed"))


def run_history(decisions: DataFrame, k: int = 50) -> DataFrame:
    """run_id, started, kills, watches, supported, others of the newest k runs."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    g = decisions.groupBy("run_id").agg(F.min("at").alias("started"), n("kill").alias("kills"), n("watch").alias("watches"), n("research-supported").alias("supported"), F.count("*").alias("all"))
    return g.select("run_id", "started", "kills", "watches", "supported", (F.col("all") - F.col("kills") - F.col("watches") - F.col("supported")).alias("others")).orderBy(F.desc("started"), "run_id").limit(k)


def _signed(sets: DataFrame, values: int, bands: int) -> DataFrame:
    """sets (w and other columns) with n, their size, hs, a hash for each band of `values` MinHash values, and cells, their words counted by cell; without w."""
    kept = [f for f in sets.schema if f.name != "w"]
    fields = T.StructType([*kept, *T._parse_datatype_string("n int, hs array<int>, cells array<tinyint>")])
    draw = np.random.default_rng(14).integers(0, 2**64, (3, values * bands), np.uint64)
    flip, times, join = draw[0], draw[1] | np.uint64(1), draw[2] | np.uint64(1)

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("v")
            size = np.diff(w.offsets.to_numpy())
            word, edges = w.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(size)))
            hs, cells = np.zeros((len(size), bands), np.uint64), np.zeros((len(size), CELLS), np.int8)
            at = 0
            while at < len(size):  # some words at a time
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + HASHED, "right")) - 1)
                own, starts = word[edges[at] : edges[end]], edges[at:end] - edges[at]
                for k in range(values * bands):
                    x = (own ^ flip[k]) * times[k]
                    x = (x ^ (x >> np.uint64(29))) * times[0]
                    hs[at:end, k // values] = hs[at:end, k // values] * join[0] + np.minimum.reduceat(x, starts) * join[k]
                row = np.repeat(np.arange(end - at), size[at:end])
                counts = np.bincount(row * CELLS + (own % np.uint64(CELLS)).astype(np.int64), minlength=(end - at) * CELLS)
                cells[at:end] = np.minimum(counts, 127).reshape(end - at, CELLS)
                at = end
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(size.astype(np.int32)), lists((hs >> np.uint64(32)).astype(np.uint32).view(np.int32)), lists(cells)], names=fields.names)

    hashed = sets.filter("size(w) > 0").select(*[f.name for f in kept], F.transform("w", lambda x: F.xxhash64(x)).alias("v"))
    return hashed.mapInArrow(sign, fields)


def _met_pairs(signed: DataFrame) -> DataFrame:
    """a, b (a < b), bound of the signed sets (id, n, hs, cells) that share a band, each pair once: in the first band that it shares.

    No two sets are more alike than bound: words that differ by d in a cell are d words that only one of the two sets has. Sets' hashes and
    cells are joined to the bands that two sets share alone, and no pair is written before it is known to be new and its bound asked for.
    """
    banded = signed.select("id", F.posexplode("hs").alias("band", "h"))
    crowd = banded.groupBy("band", "h").agg(F.count("*").alias("__n")).filter("__n > 1").select("band", "h")
    met = banded.join(crowd, ["band", "h"], "left_semi").join(signed.select("id", "n", "hs", "cells"), "id")
    j = met.alias("x").join(met.alias("y"), F.expr("x.band = y.band and x.h = y.h and x.id < y.id"))
    first = F.expr("not exists(zip_with(slice(x.hs, 1, x.band), slice(y.hs, 1, x.band), (p, q) -> p = q), z -> z)")
    apart = F.expr("aggregate(zip_with(x.cells, y.cells, (p, q) -> abs(int(p) - int(q))), 0, (s, d) -> s + d)")
    both = F.expr("x.n + y.n")
    return j.filter(first).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), ((both - apart) / (both + apart)).alias("bound"))


def _banded_pairs(sets: DataFrame, values: int, bands: int) -> DataFrame:
    """_met_pairs of sets (id, w) by bands of `values` MinHash values."""
    return _met_pairs(checkpointed(_signed(sets, values, bands)))


def similar_statements(records: DataFrame, least: float = 0.6, top: int = 50, bands: int = 32) -> DataFrame:
    """a, b, similarity, a_verdict, b_verdict: the `top` most alike pairs of statements, by the Jaccard similarity of their words.

    Candidates share a band of MinHash values, two to a band: at 0.6 a pair is missed with a chance of 0.64 ^ bands (1e-6 for 32). They are only
    looked for if bands of six values, 18 of them, don't find `top` pairs of 0.9 (a pair of 0.9 is missed by all with a chance of 1e-6): where
    so many are, all of the result lies above, and texts that are less alike needn't meet. Statements with the same words are one set, compared
    once; of its members the first `top` + 1 can be in the result. Equal statements are one, the smallest id's, so copies make no pairs of their
    own. records: id, statement, verdict. Runs jobs when it is called.

    Texts and words are neither shuffled nor written, only their hashes are: words are read again for the candidates that are compared. These are
    taken some at a time, by the most that they can be alike, until `top` pairs are known to be more alike than any other can be.
    """

    def said(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col("statement").isNotNull()).select("id", "verdict", F.lower("statement").alias("t"))
        rows = rows.withColumn("w", F.array_distinct(F.filter(F.split("t", "[^a-z0-9]+"), lambda x: x != "")))
        return rows.select("id", "verdict", F.unhex(F.sha2("t", 256)).alias("text"), F.unhex(F.sha2(F.array_join(F.array_sort("w"), " "), 256)).alias("of"), "w")

    kept = [F.first(c).alias(c) for c in ("n", "hs", "cells")]
    one = _signed(said(records), 6, 18).groupBy("text").agg(F.min("id").alias("id"), F.min_by("verdict", "id").alias("verdict"), F.first("of").alias("of"), *kept).drop("text")
    k = F.row_number().over(W.partitionBy("of").orderBy("id"))
    members = checkpointed(one.withColumn("k", k).filter(F.col("k") <= top + 1))
    ends = ("a", "b", "similarity", "a_verdict", "b_verdict")

    def exact(pairs: DataFrame, sets: DataFrame) -> list[tuple]:
        """The first `top` of the pairs as (-similarity, a, b, a_of, b_of)."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        words = said(records.join(F.broadcast(asked), "id", "left_semi")).select("of", "w").dropDuplicates(["of"])
        of = checkpointed(sets.join(F.broadcast(asked), "id", "left_semi").select("id", "of").join(words, "of"))
        side = lambda c: of.select(F.col("id").alias(c), F.col("w").alias(f"{c}w"), F.col("of").alias(f"{c}_of"))
        j = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", F.size(F.array_intersect("aw", "bw")) / F.size(F.array_union("aw", "bw")))
        best = j.filter(F.col("similarity") >= least).select("similarity", "a", "b", "a_of", "b_of").distinct().orderBy(F.desc("similarity"), "a", "b").limit(top)
        return [(-r.similarity, r.a, r.b, bytes(r.a_of), bytes(r.b_of)) for r in best.collect()]

    def alike(sets: DataFrame, least: float) -> list[tuple]:
        """The first `top` pairs of the signed sets that are alike by `least`."""
        pairs, best, last, most = _met_pairs(sets).filter(F.col("bound") >= least), [], None, COMPARED * top
        before = lambda s, a, b: (F.col("bound") > s) | ((F.col("bound") == s) & (F.struct("a", "b") < F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))))
        while True:
            rest = pairs.filter(before(-best[-1][0], *best[-1][1:3])) if len(best) == top else pairs
            if last:
                rest = rest.filter(~before(*last) & ~((F.col("a") == last[1]) & (F.col("b") == last[2])))
            part = checkpointed(rest.orderBy(F.desc("bound"), "a", "b").limit(most))
            n = part.count()
            if n:
                best = sorted({*best, *(r for r in exact(part, sets) if -r[0] >= least)})[:top]
                end = part.orderBy("bound", F.desc("a"), F.desc("b")).first()
                last = (end.bound, end.a, end.b)
            if n < most or (len(best) == top and -best[-1][0] > last[0]):
                return best
            most = min(16 * most, MOST_COMPARED)

    own = lambda c, rows: rows.select(F.col("of").alias(f"{c}_of"), F.col("id").alias(c), F.col("verdict").alias(f"{c}_verdict"))
    within = own("a", members).join(own("b", members.filter("k > 1")), F.expr("a_of = b_of and a < b")).withColumn("similarity", F.lit(1.0)).select(*ends)
    within = checkpointed(within.orderBy("a", "b").limit(top))
    same = within.count()
    far = alike(members.filter("k = 1"), max(least, 0.9)) if same < top else []
    if least < 0.9 and same + len(far) < top:
        far = alike(checkpointed(_signed(said(records).select("id", "of", "w"), 2, bands).groupBy("of").agg(F.min("id").alias("id"), *kept)), least)
    far = records.sparkSession.createDataFrame([(-s, a, b) for s, _, _, a, b in far], "similarity double, a_of binary, b_of binary")
    across = far.join(own("a", members), "a_of").join(own("b", members), "b_of")
    low, high = F.least(F.struct("a", "a_verdict"), F.struct(F.col("b").alias("a"), F.col("b_verdict").alias("a_verdict"))), F.greatest(F.struct("a", "a_verdict"), F.struct(F.col("b").alias("a"), F.col("b_verdict").alias("a_verdict")))
    across = across.select("similarity", low.alias("l"), high.alias("h")).select(F.col("l.a").alias("a"), F.col("h.a").alias("b"), "similarity", F.col("l.a_verdict").alias("a_verdict"), F.col("h.a_verdict").alias("b_verdict"))
    return across.unionByName(within).orderBy(F.desc("similarity"), "a", "b").limit(top)


def prose_tokens(text: Column) -> Column:
    """The words of a text that may name a series, each asset's name followed by its ticker."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*PROSE_STOP))
    ticker = lambda w: _table(TICKERS)[w]
    return F.flatten(F.transform(words, lambda w: F.when(ticker(w).isNull(), F.array(w)).otherwise(F.array(w, ticker(w)))))


def resolve_series(prose: DataFrame, catalog: DataFrame) -> DataFrame:
    """id, series, score, full: the catalogue's series whose words a text covers best; null if it covers under half of them, or one word only.

    A word covers another if one begins with the other, three letters at least; each word of the text covers one of a name, in order. Ties go
    to more distinct words of the text, then to the later name. One word is enough for a name of one word that isn't generic. prose: id, text; catalog: name.

    Texts of the same words are looked up once. To be covered whole a name's rarest word must be covered, so a text first meets the names by that
    word alone; only texts that cover no name whole are then looked up by the rarest of a name's words of which one must be covered for a half.
    """
    names = catalog.filter(F.trim("name") != "").select("name").distinct().select("name", prose_tokens(F.col("name")).alias("n")).filter("size(n) > 0")
    texts = prose.select("id", prose_tokens(F.col("text")).alias("d")).withColumn("said", F.array_join("d", " "))
    asked = checkpointed(texts.groupBy("said").agg(F.first("d").alias("d")).filter("size(d) > 0"))
    covers = lambda a, b: (F.length(a) >= 3) & (F.length(b) >= 3) & (a.startswith(b) | b.startswith(a))
    begun = lambda w: F.explode(F.transform(F.sequence(F.lit(3), F.length(w)), lambda k: F.substring(w, F.lit(1), k))).alias("h")
    words = names.select("name", F.size("n").alias("k"), F.explode(F.array_distinct("n")).alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df"))
    rare = checkpointed(words.join(often, "w").withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("df", "w"))).filter("length(w) >= 3"))

    def step(used: Column, word: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda i: ~F.array_contains(used, i) & covers(word, F.get("d", i)))
        return F.when(F.size(free) > 0, F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    def best(of: DataFrame, most: Column) -> DataFrame:
        """said and its best name (b), among those that have one of their first `most` words by rarity covered."""
        key, said = rare.filter(F.col("r") <= most).select("name", "w"), of.select("said", F.explode(F.array_distinct("d")).alias("u")).filter("length(u) >= 3")
        longer = said.select("said", begun(F.col("u"))).join(key, F.col("h") == F.col("w")).select("said", "name")
        shorter = said.join(key.select("name", begun(F.col("w"))), F.col("h") == F.col("u")).select("said", "name")
        j = longer.unionByName(shorter).distinct().join(of, "said").join(names, "name").withColumn("used", F.aggregate("n", F.array().cast("array<int>"), step))
        j = j.withColumns({"score": F.size("used") / F.size("n"), "words": F.size(F.array_distinct(F.transform("used", lambda i: F.get("d", i)))), "k": F.size("n"), "one": F.get("n", F.lit(0))})
        return j.groupBy("said").agg(F.max(F.struct("score", "words", "name", "k", "one")).alias("b"))

    whole = checkpointed(best(asked, F.lit(1)).filter("b.score = 1"))
    half = best(asked.join(whole, "said", "left_anti"), F.col("k") - F.ceil(F.col("k") / 2) + 1)
    alone = (F.col("b.k") == 1) & (F.col("b.score") == 1.0) & (F.length("b.one") >= 3) & ~F.col("b.one").isin(*GENERIC)
    ok = (F.col("b.score") >= 0.5) & ((F.col("b.words") >= 2) | alone)
    found = whole.unionByName(half).select("said", F.when(ok, F.col("b.name")).alias("series"), F.when(ok, F.col("b.score")).alias("score"), F.when(ok, F.col("b.score") == 1.0).alias("full"))
    return texts.select("id", "said").join(found, "said", "left").drop("said")


def admit_candidates(candidates: DataFrame, nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """run, candidate, candidate_class, reasons, admitted: generated claims that may be tested, and why the others may not.

    candidates: run, candidate (in order), statement, candidate_class, cites (node ids), params (a map of name to text), grid (names), inputs
    (series). A statement that a run has made before, in any case and spacing, is its duplicate. nodes: node_id of what may be cited; catalog: name.
    """
    none = F.array().cast("array<string>")
    said = F.lower(F.trim(F.regexp_replace(F.coalesce("statement", F.lit("")), r"\s+", " ")))
    kind = F.when(F.col("candidate_class").isin(*CANDIDATE_CLASSES), F.col("candidate_class")).otherwise("conceptual_only")
    c = candidates.withColumns({"candidate_class": kind, "__again": F.row_number().over(W.partitionBy("run", said).orderBy("candidate")) > 1, "__empty": said == ""})
    cited = c.select("run", "candidate", F.explode("cites").alias("node_id")).join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("run", "candidate").distinct().withColumn("__grounded", F.lit(True))
    unknown = c.select("run", "candidate", F.explode("inputs").alias("name")).join(catalog.select("name").distinct(), "name", "left_anti").select("run", "candidate").distinct().withColumn("__unknown", F.lit(True))
    j = c.join(cited, ["run", "candidate"], "left").join(unknown, ["run", "candidate"], "left")
    number = F.forall(F.map_values("params"), lambda v: v.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"))
    outside = F.size(F.array_except(F.coalesce("grid", none), F.coalesce(F.map_keys("params"), none))) > 0
    flaws = [
        (F.col("__again"), "duplicate_in_run"), (~F.col("candidate_class").isin(*TESTABLE), "not_testable"), (F.col("__empty"), "missing_statement"), (F.col("__grounded").isNull(), "ungrounded"),
        (~F.coalesce(number, F.lit(True)), "params_not_numeric"), (outside, "grid_outside_params"), (F.col("__unknown").isNotNull(), "unknown_series"),
    ]
    reasons = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in flaws]))
    return j.select("run", "candidate", "candidate_class", reasons.alias("reasons"), (F.size(reasons) == 0).alias("admitted"))
