"""Whether a declared specification, a JSON record, says what its claim's text says, with a reason for each point on which they differ.

Everything is decided in columns: the record's fields are read by a schema, its keys and values by one expression over its strings, the text
by the spans of `claimtext`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refspark.operators.claimtext import extract
from refspark.shared import checkpointed

# Parts of keys that name an added gate, wordings of values that state one, and keys whose values are the claim's own text.
GATE_KEYS = (
    "gate", "gates", "significance", "p_value", "pvalue", "alpha", "multiplicity", "multiple_testing", "bonferroni", "fdr", "data_quality", "quality_gate", "quality_filter",
    "minimum_observation", "minimum_observations", "minimum_sample", "minimum_obs", "min_observation", "min_observations", "min_obs", "min_sample", "threshold", "thresholds",
)
GATE_VALUES = (
    r"\bp\s*(?:<=|<)\s*0?\.\d+\b",
    r"\bp[-\s]?value\b",
    r"\bsignificance\b",
    r"\bbonferroni\b",
    r"\balpha\s*=",
    r"\bfdr\b",
    r"\breject\s+if\b",
    r"\btop\s+\d+(?:\.\d+)?%",
    r"\bmin(?:imum)?\b.{0,24}\bobs(?:ervation|ervations)?\b",
)
TEXT_KEYS = ("claim_statement", "claim_source_span", "claim_mechanism", "source_span", "claimed_metric_quote")
# Number words of horizons in order of precedence, the sizes of benchmark sets, and words that name what a series measures.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12}
UNITS = "(?:d|day|days|period|periods|month|months|quarter|quarters|year|years)"
BENCHMARKS = {"capm": 1, "ff3": 3, "ff5": 5, "carhart": 4}
BENCHMARK_NAMES = {
    "capm": r"(?:^|_)capm(?:_|$)|(?:^|_)mkt(?:_|$)|(?:^|_)market(?:_|$)",
    "ff3": r"(?:^|_)ff3(?:_|$)|fama_french_3|three_factor|(?:^|_)smb(?:_|$)|(?:^|_)hml(?:_|$)",
    "ff5": r"(?:^|_)ff5(?:_|$)|fama_french_5|five_factor|(?:^|_)rmw(?:_|$)|(?:^|_)cma(?:_|$)",
    "carhart": r"(?:^|_)carhart(?:_|$)",
}
MEASURES = ("volume", "funding", "price", "returns", "return", "rate", "oi", "spread", "basis", "spot", "perp", "open", "close", "high", "low")
WALKS = ("random_walk", "rw", "naive", "persistence", "last_value")
MEANS = ("historical_mean", "expanding_mean", "mean", "expanding_historical_mean")
TEMPLATE = "deterministic-template"
CHECKED = ("predictive_regression", "factor_spanning", "cross_sectional_sort", "event_study", "forecast_skill")

_BASE = "kind string, series string, full_coverage boolean, unmatched_name_tokens array<string>, score double, matched_tokens array<string>, transform string, base_series string, `window` string"
_BINDING = f"struct<{', '.join(f.replace(' ', ':', 1) for f in _BASE.split(', '))}, base_resolution:struct<full_coverage:boolean,unmatched_name_tokens:array<string>,score:double,matched_tokens:array<string>,series:string>>"
_SPEC = (
    "claim_type string, _llm_mode string, inputs array<string>, predictor string, target string, horizon string, estimator string, candidate_factor string, benchmark_factors array<string>, benchmark_set string, "
    "panel_inputs struct<returns:string,characteristic:string>, characteristic string, n_buckets string, rebalance string, hold string, return_series string, event_calendar string, `window` array<string>, "
    "event_window array<string>, baseline string, market_series string, estimation_window string, model_forecast string, benchmark string, benchmark_forecast string, benchmark_series string, loss string, "
    f"claim_statement string, claim_mechanism string, claim_source_span string, claim_translation string, binding_provenance map<string, {_BINDING}>"
)


#: So many different claims and records at most are handed to every task.
REPEATED = 10_000


def norm(name: Column) -> Column:
    """A name's letters and digits in lower case, joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _filled(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    out = F.trim(c)
    return F.when(out != "", out)


def series_name(value: Column) -> Column:
    """The series that a field names: a string, or a record of one or of what is derived from one. Empty if none."""
    at = lambda *keys: F.coalesce(*[_filled(F.get_json_object(value, f"$.{k}")) for k in keys])
    how, base = at("transform"), F.coalesce(at("base_series"), F.lit(""))
    derived = F.when(how == "realized_vol", F.concat(F.lit("realized_vol("), base, F.lit(","), F.coalesce(at("window"), F.lit("")), F.lit(")"))).when(how.isNotNull(), F.concat(how, F.lit("("), base, F.lit(")"))).otherwise(base)
    record = F.when(at("kind") == "derived_series", derived).otherwise(F.coalesce(at("series", "id", "name", "key"), F.lit("")))
    return F.when(value.startswith("{"), record).otherwise(F.coalesce(F.trim(value), F.lit("")))


def names(text: Column, name: Column) -> Column:
    """Whether a normalised text has a name, or all of the name's words of two letters or more."""
    held, own = F.concat(F.lit("_"), text, F.lit("_")), norm(name)
    has = lambda word: held.contains(F.concat(F.lit("_"), word, F.lit("_")))
    words = F.filter(F.split(own, "_"), lambda w: F.length(w) > 1)
    return (own != "") & (has(own) | ((F.size(words) > 0) & F.forall(words, has)))


def added_gate(spec: Column) -> Column:
    """Whether a key of the record, at any depth, names a gate, or a value states one; the claim's own text may."""
    tokens = F.regexp_extract_all(F.coalesce(spec, F.lit("")), F.lit(r'("(?:[^"\\]|\\.)*"\s*:?)'), F.lit(1))
    bare = lambda t: F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)
    zero = F.struct(F.lit("").alias("key"), F.lit(False).alias("hit"))

    def step(acc: Column, token: Column) -> Column:
        key, own = token.endswith(":"), norm(bare(token))
        stated = ~acc["key"].isin(*TEXT_KEYS) & F.lower(bare(token)).rlike("|".join(f"(?:{p})" for p in GATE_VALUES))
        return F.struct(F.when(key, own).otherwise(acc["key"]).alias("key"), (acc["hit"] | F.when(key, own.rlike("|".join(GATE_KEYS))).otherwise(stated)).alias("hit"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["hit"])


def horizon_of(value: Column) -> Column:
    """A declared horizon as a number of periods, one at least; null if it has none."""
    at = lambda k: F.nullif(F.nullif(F.get_json_object(value, f"$.{k}"), F.lit("0")), F.lit(""))
    own = F.lower(F.when(value.startswith("{"), F.coalesce(at("periods"), at("days"), at("h"), at("value"))).otherwise(value))
    digits = F.regexp_extract(own, rf"\b(\d+)\s*{UNITS}?\b", 1)
    out = F.lit(None).cast("int")
    for word, n in reversed(NUMBER_WORDS.items()):
        out = F.when(own.rlike(rf"\b{word}\b"), F.lit(n)).otherwise(out)
    exact = own.rlike(r"^-?\d+(\.\d+)?$")
    least = lambda n: F.when(n.isNotNull(), F.greatest(F.lit(1), n))
    return F.when(exact, least(F.floor(own.try_cast("double")).try_cast("int"))).when(digits != "", least(digits.try_cast("int"))).otherwise(out)


def horizons(text: Column) -> Column:
    """The horizons that a text names, as an array of numbers."""
    after = r"(?:\s*[- ]?ahead|\s+forward|\s+future)?\b"
    digits = F.transform(F.regexp_extract_all(text, F.lit(rf"\b(\d+)\s*[- ]?{UNITS}{after}"), F.lit(1)), lambda x: F.when(x.try_cast("int").isNotNull(), F.greatest(F.lit(1), x.try_cast("int"))))
    words = [F.when(text.rlike(rf"\b{w}\s*[- ]?{UNITS}{after}"), F.lit(n)) for w, n in NUMBER_WORDS.items()]
    return F.array_distinct(F.concat(digits, F.array_compact(F.array(*words, F.when(text.rlike(r"\bnext[- ](?:day|period)\b|\bone[- ](?:day|period)\b"), F.lit(1))))))


def _derived(p: Column) -> Column:
    return F.lower(F.coalesce(p["kind"], F.lit(""))).isin("derived", "derived_series")


def _certain(p: Column) -> Column:
    """A binding is literal in full, or covers the name's words with a score of a half and more."""
    covered = lambda x: F.coalesce(x["full_coverage"], F.lit(False)) & (F.size(F.coalesce(x["unmatched_name_tokens"], F.array().cast("array<string>"))) == 0) & (F.coalesce(x["score"], F.lit(0.0)) >= 0.5) & (F.size(F.coalesce(x["matched_tokens"], F.array().cast("array<string>"))) > 0)
    return F.when(F.lower(p["kind"]) == "literal", F.coalesce(p["full_coverage"], F.lit(False))).when(_derived(p), covered(p["base_resolution"])).otherwise(covered(p))


def _bound(p: Column, value: Column) -> Column:
    """A binding is that of the field's value."""
    at = lambda k: F.coalesce(F.get_json_object(value, f"$.{k}"), F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    span = lambda a, b: F.coalesce(_filled(a), _filled(b), F.lit("1"))
    derived = (at("kind") == "derived_series") & (text(p["transform"]) == at("transform")) & (text(p["base_series"]) == at("base_series")) & (span(p["window"], at("window")) == span(at("window"), p["window"]))
    return F.when(_derived(p), F.coalesce(derived, F.lit(False))).otherwise(F.trim(text(p["series"])) == series_name(value))


def _evidence(p: Column) -> Column:
    found = F.coalesce(F.when(_derived(p), p["base_resolution"]["matched_tokens"]).otherwise(p["matched_tokens"]), F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda t: F.lower(F.element_at(F.split(t, "~"), -1))), lambda t: F.length(t) >= 3)


def _other_measure(text: Column, p: Column) -> Column:
    """The series of a partial binding measures something, and the text names another measure."""
    whole = F.when(_derived(p), p["base_resolution"]["full_coverage"]).otherwise(p["full_coverage"])
    own = F.when(_derived(p), p["base_resolution"]["series"]).otherwise(p["series"])
    measures = lambda c: F.array_intersect(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), F.array(*map(F.lit, MEASURES)))
    return ~F.coalesce(whole, F.lit(False)) & (F.size(measures(own)) > 0) & (F.size(F.array_except(measures(text), measures(own))) > 0)


def _ordered(text: Column, p: Column, t: Column) -> Column:
    """The predictor's words stand before the verb of prediction and the target's after it."""
    halves = F.split(text, r"\b(?:predicts?|forecasts?|forecasting|leads?|explains?)\b", 2)
    before, after = norm(F.get(halves, F.lit(0))), F.get(halves, F.lit(1))
    some = lambda held, words: F.exists(words, lambda w: F.concat(F.lit("_"), held, F.lit("_")).contains(F.concat(F.lit("_"), norm(w), F.lit("_"))))
    how = F.lower(F.coalesce(t["transform"], F.lit("")))
    said = F.when(how == "realized_vol", after.rlike(r"\b(?:realized\s+vol(?:atility)?|rv)\b")).when(how == "log_returns", after.rlike(r"\blog\s+returns?\b")).when(how == "returns", after.rlike(r"\breturns?\b")).otherwise(False)
    return (F.size(halves) == 2) & some(before, _evidence(p)) & some(norm(after), _evidence(t)) & (~_derived(t) | said)


def _named_in_order(text: Column, predictor: Column, target: Column) -> Column:
    """Without bindings: predictor .. predicts .. target, or target .. on .. predictor, within some letters of the normalised text."""
    a, b = norm(predictor), norm(target)
    one = lambda x: F.concat(F.lit("(?:^|_)"), x, F.lit("(?:_|$)"))
    forward = F.concat(one(a), F.lit(".{0,80}(?:predict|predicts|forecast|forecasts|lead|leads).{0,80}"), one(b))
    backward = F.concat(one(b), F.lit(".{0,50}(?:on|against).{0,30}"), one(a))
    return (a != "") & (b != "") & (a != b) & names(text, predictor) & names(text, target) & (F.rlike(text, forward) | F.rlike(text, backward))


def spec_reasons(df: DataFrame, claim: list[str], spec: str = "spec", kind: str = "claim_type") -> DataFrame:
    """df with reasons: why the specification isn't what the claim of type `kind` says; empty if it is, null for types that have no such check.

    claim: the columns of the claim's text (its statement, mechanism, horizon, quotation, span). spec: the record as JSON; null or no record gives
    no_spec alone. The text is what the columns and the record's own copies of them say, each once. A text that is silent on a point agrees
    with any value. A claim's alpha, if its type is factor_spanning, is no gate unless a key or a value of the record names one.
    """
    own = df.withColumns({"__s": F.from_json(spec, _SPEC), "__json": F.col(spec)})
    s = F.col("__s")
    said = F.array(*[F.lower(F.trim(c)) for c in [*map(F.col, claim), s["claim_statement"], s["claim_mechanism"], s["claim_source_span"], s["claim_translation"]]])
    own = own.withColumn("__text", F.array_join(F.array_distinct(F.filter(said, lambda c: c.isNotNull() & (c != ""))), " "))
    own = extract(own, ["__text"]).withColumn("__norm", norm(F.col("__text"))).withColumn("__gate", added_gate(F.col("__json")))
    text, flat, stated = F.col("__text"), F.col("__norm"), F.col("parameters")
    mode = lambda name: (s["_llm_mode"] != TEMPLATE) | s["_llm_mode"].isNull() | (s["claim_type"] != name) | s["claim_type"].isNull()
    nth = lambda k: F.get(s["inputs"], F.lit(k))
    field = lambda c, k: F.coalesce(_filled(s[c]), nth(k), F.lit(""))
    bindings = F.coalesce(F.size(s["binding_provenance"]), F.lit(0)) > 0
    binding = lambda name: F.try_element_at(s["binding_provenance"], F.lit(name))
    resolved = lambda p, value: p.isNotNull() & (F.lower(F.coalesce(p["kind"], F.lit(""))) != "unresolved") & _bound(p, value) & _certain(p)
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    differs = lambda a, b: a.isNotNull() & ~a.eqNullSafe(b)

    predictor, target = field("predictor", 0), field("target", 1)
    p, t = binding("predictor"), binding("target")
    paired = _bound(p, predictor) & _bound(t, target) & _certain(p) & _certain(t) & ~_other_measure(text, p) & ~_other_measure(text, t) & _ordered(text, p, t)
    estimator = F.lower(F.coalesce(s["estimator"], F.lit("")))
    regression = [
        ("not_a_template", mode("predictive_regression")),
        ("no_pair", (F.size(F.filter(F.coalesce(s["inputs"], F.array().cast("array<string>")), lambda x: F.trim(x) != "")) < 2) | (series_name(predictor) == "") | (series_name(target) == "") | (predictor == target)),
        ("estimator", (estimator != "") & ~estimator.rlike("ols|covariance|single_predictor")),
        ("order_of_mention", wrong(F.when(bindings, paired).otherwise(_named_in_order(flat, series_name(predictor), series_name(target))))),
        ("horizon", wrong(F.array_contains(horizons(text), horizon_of(s["horizon"])))),
    ]
    candidate = field("candidate_factor", 0)
    one = _filled(F.get_json_object("__json", "$.benchmark_factors"))
    declared = F.when(F.size(s["benchmark_factors"]) > 0, s["benchmark_factors"]).when(one.isNotNull() & ~one.startswith("["), F.array(one)).otherwise(F.slice(s["inputs"], 2, 1000))
    hedges = F.filter(F.transform(F.coalesce(declared, F.array().cast("array<string>")), series_name), lambda x: x != "")
    family = F.lower(F.coalesce(s["benchmark_set"], F.lit("")))
    sizes, spelled = F.lit(None).cast("int"), F.lit(False)
    for name, n in BENCHMARKS.items():
        sizes, spelled = F.when(family == name, F.lit(n)).otherwise(sizes), F.when(family == name, flat.rlike(BENCHMARK_NAMES[name])).otherwise(spelled)
    c = binding("candidate_factor")
    spanning = [
        ("not_a_template", mode("factor_spanning")),
        ("no_candidate", (series_name(candidate) == "") | (F.size(hedges) < 1) | F.array_contains(hedges, series_name(candidate))),
        ("benchmark_set", (family != "") & (~family.isin(*BENCHMARKS) | ~spelled)),
        ("benchmark_size", (family != "") & F.coalesce(F.size(hedges) != sizes, F.lit(False))),
        ("estimator", (estimator != "") & ~(estimator.contains("ols") & estimator.contains("is"))),
        ("no_alpha", ~text.rlike(r"\b(alpha|intercept|spanning|spanned|controlling|controls?)\b")),
        ("candidate", wrong(F.when(c.isNotNull(), resolved(c, candidate)).otherwise(names(flat, series_name(candidate))))),
    ]
    buckets = F.trim(s["n_buckets"]).try_cast("double").cast("int")
    sort = [
        ("not_a_template", mode("cross_sectional_sort")),
        ("no_panel", _filled(s["panel_inputs"]["returns"]).isNull() | _filled(s["panel_inputs"]["characteristic"]).isNull() | buckets.isNull() | (buckets < 2) | _filled(s["rebalance"]).isNull() | _filled(s["hold"]).isNull()),
        ("characteristic", wrong(names(flat, s["characteristic"]))),
        ("buckets", differs(stated["buckets"], buckets)),
        ("cadence", _filled(s["rebalance"]).isNotNull() & differs(stated["rebalance"], F.upper(F.trim(s["rebalance"])))),
        ("no_sort", ~text.rlike(r"\bsort|sorted|sorting|rank|ranked|ranking\b") | ~text.rlike(r"\btop|bottom|spread|high[- ]?minus[- ]?low|long[- ]short\b")),
    ]
    returns, baseline = field("return_series", 0), F.lower(F.trim(F.coalesce(_filled(s["baseline"]), F.lit("mean_adjusted"))))
    given = F.coalesce(F.when(F.size(s["window"]) > 0, s["window"]), s["event_window"])
    low, high = F.get(given, F.lit(0)).try_cast("int"), F.get(given, F.lit(1)).try_cast("int")
    calendar = F.when(s["event_calendar"].startswith("{"), F.coalesce(*[_filled(F.get_json_object(s["event_calendar"], f"$.{k}")) for k in ("path", "table", "table_path", "calendar_path", "event_calendar_path")])).otherwise(_filled(s["event_calendar"]))
    r = binding("return_series")
    study = [
        ("not_a_template", mode("event_study")),
        ("no_calendar", (series_name(returns) == "") | calendar.isNull()),
        ("estimation_window", wrong(s["estimation_window"].try_cast("double") >= 5)),
        ("event_window", wrong(low <= high) | differs(stated["event_window"], F.struct(low.alias("start"), high.alias("end")))),
        ("baseline", ~baseline.isin("mean_adjusted", "market_model") | differs(stated["baseline"], baseline) | ((baseline == "market_model") & (series_name(s["market_series"]) == ""))),
        ("no_event", ~text.rlike(r"\b(?:abnormal\s+returns?|cumulative\s+abnormal\s+returns?|car)\b") | ~text.rlike(r"\b(?:event|announcement|earnings|fomc|listing|addition|halving)\b")),
        ("return_series", wrong(F.when(r.isNotNull(), resolved(r, returns)).otherwise(series_name(returns) != ""))),
    ]
    model = field("model_forecast", 0)
    rival = F.coalesce(_filled(s["benchmark"]), _filled(s["benchmark_forecast"]), _filled(s["benchmark_series"]), F.lit(""))
    at = lambda k: _filled(F.get_json_object(rival, f"$.{k}"))
    word = F.regexp_replace(F.lower(F.trim(F.when(rival.startswith("{"), F.coalesce(at("method"), at("family"), at("benchmark"), at("kind"))).otherwise(rival))), "-", "_")
    method = F.when(word.isin(*WALKS), "random_walk").when(word.isin(*MEANS), "historical_mean")
    rival_series = series_name(rival)
    m, b = binding("model_forecast"), binding("benchmark")
    spoken = (~method.eqNullSafe(F.lit("random_walk")) | text.rlike(r"\b(random[- ]walk|naive|persistence)\b")) & (~method.eqNullSafe(F.lit("historical_mean")) | text.rlike(r"\bhistorical\s+mean\b|\bexpanding\s+mean\b"))
    with_bindings = resolved(m, model) & resolved(t, target) & F.when(rival_series != "", resolved(b, rival_series)).otherwise(method.isNotNull() & spoken)
    without = names(flat, series_name(model)) & names(flat, series_name(target)) & ((rival_series == "") | names(flat, rival_series)) & spoken
    skill = [
        ("not_a_template", mode("forecast_skill")),
        ("no_pair", s["inputs"].isNull() | (series_name(model) == "") | (series_name(target) == "") | (series_name(model) == series_name(target))),
        ("benchmark", F.when(rival_series != "", rival_series.isin(series_name(model), series_name(target))).otherwise(method.isNull())),
        ("loss", ~F.lower(F.coalesce(_filled(s["loss"]), F.lit("squared_error"))).isin("squared_error", "mse", "msfe")),
        ("no_forecast", ~text.rlike(r"\b(?:forecast|forecasts|forecasting|predicts?|prediction)\b") | ~text.rlike(r"\b(?:msfe|mspe|rmse|diebold[- ]mariano|clark[- ]west|out[- ]of[- ]sample\s+r|oos\s+r|benchmark|random[- ]walk|naive)\b")),
        ("binding", wrong(F.when(bindings, with_bindings).otherwise(without))),
        ("benchmark_method", method.isNotNull() & differs(stated["benchmark_method"], method)),
    ]
    out = F.lit(None).cast("array<string>")
    for name, rules in zip(CHECKED, (regression, spanning, sort, study, skill), strict=True):
        found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(why)) for why, c in [*rules, ("added_gate", F.col("__gate"))]]))
        out = F.when(F.col(kind) == name, found).otherwise(out)
    missing = s.isNull() | ~F.trim(F.coalesce("__json", F.lit(""))).startswith("{")
    out = F.when(F.col(kind).isin(*CHECKED) & missing, F.array(F.lit("no_spec"))).otherwise(out)
    return own.withColumn("reasons", out).drop("__s", "__json", "__text", "__norm", "__gate", "spans", "parameters")


def spec_matches_text(df: DataFrame, claim: list[str], spec: str = "spec", kind: str = "claim_type") -> DataFrame:
    """spec_reasons, with matches: whether there is no reason; null for types without a check.

    What is the same in type, text and record is judged once. Where that leaves at most REPEATED of them, they are handed to every task and no
    row of df is shuffled; otherwise each row is judged by itself. Runs a job when it is called.
    """
    of = list(dict.fromkeys([kind, *claim, spec]))
    each = checkpointed(df.select(*of).distinct().limit(REPEATED + 1))
    if each.count() > REPEATED:
        return spec_reasons(df, claim, spec, kind).withColumn("matches", F.size("reasons") == 0)
    judged = checkpointed(spec_reasons(each, claim, spec, kind)).select(*[F.col(c).alias(f"__of_{c}") for c in of], "reasons")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in of])
    return df.join(F.broadcast(judged), same).select(*df.columns, "reasons").withColumn("matches", F.size("reasons") == 0)
