"""Kill records, receipts, Merkle roots and traces: canonical text, hashes over it, and what holds or breaks them."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refspark.functions.numbers import significant
from refspark.operators.scan import folded

# The record format's version and fields, the hash before a chain's first event, and words that name no series.
SCHEMA_VERSION = 1
REQUIRED = ("schema_version", "claim_statement", "verdict", "kill_reason", "spec", "receipt")
ZERO_HASH = "0" * 64
KILL_STAGE = {"unfalsifiable": "P3", "fee_curve": "P4", "dedup": "P5"}
STOP_WORDS = tuple(
    "the a an and or of to in on for with by from as at is are be this that these those it its long short leg legs side only both net gross "
    "cannot_operationalize unspecified none nan null tbd unknown the_".split()
)
#: Kills that say nothing of the claim itself.
UNFAITHFUL = ("unfaithful_spec", "cannot_replicate")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with the keys in order, nulls included: the same fields give the same text whatever their order."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def json_digest(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def chain_hash(prev: Column, payload: Column) -> Column:
    """The hash of an event: over its canonical text and the hash before it."""
    return F.sha2(F.concat_ws("|", prev, payload), 256)


def verify_chain(events: DataFrame, by: str = "run") -> DataFrame:
    """by, events, broken_seq: the first event that has a wrong number (from 0 on), doesn't name the hash before it, or whose own hash
    isn't that of its payload; null for a whole chain. events: by, seq, prev_hash, hash, payload."""
    w = W.partitionBy(by).orderBy("seq", "hash")
    wrong = (F.col("seq") != F.row_number().over(w) - 1) | (F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(ZERO_HASH))) | (F.col("hash") != chain_hash(F.col("prev_hash"), F.col("payload")))
    bad = events.withColumns({"__wrong": F.coalesce(wrong, F.lit(True)), "__at": F.row_number().over(w) - 1})
    return bad.groupBy(by).agg(F.count("*").alias("events"), F.min(F.when(F.col("__wrong"), F.col("__at"))).cast("long").alias("broken_seq"))


def build_chain(events: DataFrame, by: str = "run") -> DataFrame:
    """by, seq, prev_hash and hash of events (by, seq, payload), from ZERO_HASH on. A hash needs the one before, so a run is one task's time; its
    events are streamed, 64 bytes each, in the order of their numbers, and events of one number in that of their payloads' hashes."""
    digest = events.select(by, "seq", F.sha2("payload", 256).alias("__d"))

    def step(before: str, row: tuple) -> tuple[str, tuple[str, str]]:
        hashed = sha256((before if row[2] is None else f"{before}|{row[2]}").encode()).hexdigest()
        return hashed, (before, hashed)

    return folded(digest, [by], ["seq", "__d"], "prev_hash string, hash string", ZERO_HASH, step).drop("__d")


def merkle_root(series: DataFrame, by: str = "series_id") -> DataFrame:
    """by, root: SHA-256 leaves of "time|value" (second, ten significant digits) in order of time, hashed pairwise level by level; an odd node is its
    own pair. A series without a value has the hash of nothing.

    All series rise together: a level is one aggregation by (series, place / 2), and halves the rows. The number of levels comes from a job
    that counts the longest series while the plan is built.
    """
    leaf = F.sha2(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), significant(F.col("value"), 10)), 256)
    w = W.partitionBy(by)
    level = series.filter("value is not null").select(by, leaf.alias("h"), (F.row_number().over(w.orderBy("ts", "value")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    most = level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        pair = F.sha2(F.concat(F.min_by("h", "k"), F.max_by("h", "k")), 256)
        level = level.groupBy(by, F.floor(F.col("k") / 2).alias("k"), "n").agg(F.when(F.col("n") == 1, F.first("h")).otherwise(pair).alias("h"))
        level = level.select(by, "h", "k", F.ceil(F.col("n") / 2).alias("n"))
        most = (most + 1) // 2
    return series.select(by).distinct().join(level.select(by, "h"), by, "left").select(by, F.coalesce("h", F.sha2(F.lit(""), 256)).alias("root"))


def merkle_mismatch(recorded: DataFrame, local: DataFrame, name: str = "series_id") -> DataFrame:
    """name, recorded, local of the series whose recorded root isn't the local one."""
    j = recorded.select(name, F.col("root").alias("recorded")).join(local.select(name, F.col("root").alias("local")), name)
    return j.filter("recorded <> local")


def build_receipt(decisions: DataFrame) -> DataFrame:
    """decisions (claim_statement, spec, verdict, kill_reason, data_footprint, all texts) with spec_hash and receipt_hash."""
    out = decisions.withColumn("spec_hash", F.sha2(F.coalesce("spec", F.lit("{}")), 256))
    return out.withColumn("receipt_hash", _receipt_hash(F.col("claim_statement"), F.col("spec_hash"), F.col("verdict"), F.col("kill_reason"), F.col("data_footprint")))


def _receipt_hash(statement: Column, spec_hash: Column, verdict: Column, reason: Column, footprint: Column) -> Column:
    return json_digest(schema_version=F.lit(SCHEMA_VERSION), claim_statement=F.coalesce(statement, F.lit("")), spec_hash=spec_hash, verdict=verdict, kill_reason=reason, data_footprint=footprint)


def export_kills(decisions: DataFrame, contributor: str | None = None) -> DataFrame:
    """The records of kills alone: schema_version, claim_statement, spec, verdict, kill_reason, receipt (a struct) and, unless anonymous, contributor_id."""
    kills = build_receipt(decisions.filter("verdict = 'kill'").withColumn("claim_statement", F.coalesce("claim_statement", F.lit(""))))
    receipt = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "claim_statement", "spec_hash", "verdict", "kill_reason", "data_footprint", "receipt_hash")
    who = [F.lit(contributor).alias("contributor_id")] if contributor else []
    return kills.select("claim_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "claim_statement", "spec", "verdict", "kill_reason", receipt.alias("receipt"), *who)


def validate_record(record: DataFrame) -> DataFrame:
    """record with `reason`: ok, or the first thing that is wrong with it; a receipt's hash is computed anew."""
    r = F.col("receipt")
    same = lambda a, b: F.col(a).eqNullSafe(b)
    checks = [
        (F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), "unsupported_schema_version"), (~same("verdict", F.lit("kill")), "non_kill_record"), (r.isNull(), "receipt_not_object"),
        (F.coalesce(r["schema_version"] != SCHEMA_VERSION, F.lit(True)), "receipt_schema_mismatch"),
        (~_receipt_hash(r["claim_statement"], r["spec_hash"], r["verdict"], r["kill_reason"], r["data_footprint"]).eqNullSafe(r["receipt_hash"]), "receipt_hash_mismatch"),
        (~same("claim_statement", r["claim_statement"]), "claim_statement_mismatch"), (~same("verdict", r["verdict"]), "verdict_mismatch"), (~same("kill_reason", r["kill_reason"]), "kill_reason_mismatch"),
        (~F.sha2(F.coalesce("spec", F.lit("{}")), 256).eqNullSafe(r["spec_hash"]), "spec_hash_mismatch"),
    ]
    out = F.lit("ok")
    for wrong, name in reversed(checks):
        out = F.when(wrong, name).otherwise(out)
    return record.withColumn("reason", out)


def ingest_records(records: DataFrame, seen: DataFrame) -> DataFrame:
    """records with `outcome`: invalid, duplicate (its receipt, or its statement and spec, is among those seen or earlier in the batch) or ingested.

    records: record_id and a kill record's columns. seen: receipt_hash, claim_spec_key.
    """
    checked = validate_record(records)
    key = F.sha2(F.concat_ws("\x00", F.coalesce("claim_statement", F.lit("")), F.col("receipt.spec_hash")), 256)
    keyed = checked.withColumns({"__receipt": F.col("receipt.receipt_hash"), "__claim": key})
    for mine, theirs in (("__receipt", "receipt_hash"), ("__claim", "claim_spec_key")):
        known = seen.select(F.col(theirs).alias(mine)).distinct().withColumn(f"{mine}_seen", F.lit(True))
        keyed = keyed.join(known, mine, "left")
    valid = F.col("reason") == "ok"
    first = lambda k: F.row_number().over(W.partitionBy(k, valid).orderBy("record_id")) > 1
    again = F.coalesce(F.col("__receipt_seen"), F.col("__claim_seen"), F.lit(False)) | first("__receipt") | first("__claim")
    return keyed.withColumn("outcome", F.when(~valid, "invalid").when(again, "duplicate").otherwise("ingested")).drop("__receipt", "__claim", "__receipt_seen", "__claim_seen")


def exit_stage(verdict: Column, reason: Column, stages: Column, stage: Column) -> Column:
    """Where a claim left: by its verdict and reason, the stages that it reached (an array), and the stage that an engine error names."""
    has = lambda name: F.array_contains(F.coalesce(stages, F.array().cast("array<string>")), name)
    error = F.when(stage.startswith("P"), F.split(stage, " ")[0]).when(stage == "module run", "P7").when(F.coalesce(stage, F.lit("")) != "", stage).otherwise("engine_error")
    killed = F.lit("P8")
    for name, where in KILL_STAGE.items():
        killed = F.when(reason == name, where).otherwise(killed)
    review = F.when(has("P6_variable_coverage"), "P6_variable_coverage").when(has("P6_auto_impl_no_progress"), "P6_auto_impl_no_progress").otherwise("P6")
    out = F.when(F.size(stages) > 0, F.element_at(stages, -1)).otherwise("unknown")
    out = F.when(verdict == "kill", killed).when(verdict == "engine_error", error).otherwise(out)
    out = F.when((verdict == "cannot_replicate") & (reason == "unfaithful_spec"), "P6_pre_fidelity").otherwise(out)
    data = F.when(has("P6_data_availability"), "P6_data_availability").otherwise("P7")
    return F.when(verdict == "needs_data", data).when(verdict == "pending_module", "P6").when(verdict == "needs_review", review).otherwise(out)


def missing_series(reason: Column, catalog: Column | None = None) -> Column:
    """The series that a reason says are missing, each once in any case: of every part between commas or semicolons (after data_unavailable:,
    if it stands there) the first word that isn't a stop word and is catalogued or looks like a key (with _, a dot or a digit); else [unspecified]."""
    tail = F.regexp_replace(F.coalesce(reason, F.lit("")), r"(?s)^.*?data_unavailable:", "")
    words = F.transform(F.split(tail, "[,;]"), lambda p: F.regexp_replace(F.regexp_extract(p, r"([a-zA-Z][a-zA-Z0-9_.]{2,})", 1), r"^[ ._]+|[ ._]+$", ""))
    known = lambda x: (F.array_contains(catalog, x) | F.array_contains(catalog, F.lower(x))) if catalog is not None else F.lit(False)
    words = F.filter(words, lambda x: (x != "") & ~F.lower(x).isin(*STOP_WORDS) & (x.rlike("[_.0-9]") | known(x)))
    low = F.transform(words, lambda x: F.lower(x))
    once = F.filter(words, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.when(F.size(once) > 0, once).otherwise(F.array(F.lit("unspecified")))


def missing_inputs(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """claim, input: declared inputs that the catalog hasn't. claims: claim, inputs (an array)."""
    return claims.select("claim", F.explode("inputs").alias("input")).distinct().join(catalog.select(F.col("name").alias("input")).distinct(), "input", "left_anti").select("claim", "input")


def decision_records(decisions: DataFrame, analysis: DataFrame) -> DataFrame:
    """claim_id, verdict, kill_reason, domain, family, date, structural: decisions with what their claim's latest analysis adds.

    A kill is structural if its edge was seen in sample first and it had the power to see one. analysis: claim_id, at, domain, family, date.
    """
    last = analysis.withColumn("__k", F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("at")))).filter("__k = 1")
    j = decisions.alias("d").join(last.alias("a"), "claim_id", "left")
    pick = lambda c: F.coalesce(f"d.{c}", f"a.{c}").alias(c)
    structural = (F.col("d.verdict") == "kill") & ~F.coalesce(F.col("d.kill_reason"), F.lit("")).isin(*UNFAITHFUL) & F.coalesce(F.col("d.replicated"), F.lit(True)) & F.coalesce(F.col("d.power_sufficient"), F.lit(True))
    return j.select("claim_id", "d.verdict", "d.kill_reason", F.coalesce("d.domain", "a.domain", F.lit("other")).alias("domain"), pick("family"), pick("date"), structural.alias("structural"))


def latest_verdicts(index: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows by `at`, ties by claim_id; 1 to 1000 of them."""
    return index.orderBy(F.desc("at"), "claim_id").limit(min(1000, max(1, limit)))


def list_by_prefix(nodes: DataFrame, prefix: str, n: int) -> DataFrame:
    """node_id and title of the first n nodes whose id starts so."""
    return nodes.filter(F.col("node_id").startswith(prefix)).orderBy("node_id").select("node_id", "title").limit(n)


def proposed_principles(decisions: DataFrame, by: str, least: int = 3) -> DataFrame:
    """by, kill_reason, kills: where at least that many kills that count all have one reason. Kills of unfaithful tests, or never seen in sample, don't."""
    ok = decisions.filter((F.col("verdict") == "kill") & ~F.coalesce(F.col("kill_reason"), F.lit("")).isin(*UNFAITHFUL) & F.coalesce(F.col("replicated"), F.lit(False)))
    g = ok.groupBy(by).agg(F.count("*").alias("kills"), F.min("kill_reason").alias("kill_reason"), F.max("kill_reason").alias("__last"))
    return g.filter((F.col("kills") >= least) & (F.col("kill_reason") == F.col("__last"))).drop("__last")


def register_search(candidates: DataFrame, budgets: DataFrame) -> DataFrame:
    """run, family, denominator: for every family that a run touched, the larger of its budget and what it emitted in all."""
    emitted = candidates.groupBy("run").agg(F.count("*").alias("emitted")).join(budgets, "run", "left")
    return candidates.select("run", "family").distinct().join(emitted, "run").select("run", "family", F.greatest("emitted", "budget").alias("denominator"))


def extract_facts(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """entity, concept, tag, end, filed, value: of a concept's candidate tags the first that the entity has data for.

    documents: entity, json of tag -> list of {end, filed, val}. tags: concept, tag, priority. Rows whose three fields don't all parse go.
    """
    facts = F.from_json("json", "map<string, array<struct<end:string, filed:string, val:string>>>")
    rows = documents.select("entity", F.explode(facts).alias("tag", "rows")).select("entity", "tag", F.inline("rows"))
    rows = rows.select("entity", "tag", F.expr("try_cast(end as date)").alias("end"), F.expr("try_cast(filed as date)").alias("filed"), F.expr("try_cast(val as double)").alias("value")).dropna()
    found = rows.join(tags, "tag")
    first = F.min("priority").over(W.partitionBy("entity", "concept"))
    return found.withColumn("__first", first).filter("priority = __first").select("entity", "concept", "tag", "end", "filed", "value")
