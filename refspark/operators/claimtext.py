"""What a claim's text says: its type, and the parameters that it states.

All patterns are looked for in one pass. From each pattern the words are derived of which every match has one; an automaton over all these
words finds those that a text has, and only their patterns are run on it. What was found goes on as an array of small records, and columns
decide: which type goes first, what forbids it, which of several values holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The wordings by which claims are told apart, in lower case.
CUES = {
    "one_cohort": (
        r"\bone\s+(?:declared\s+)?deflation cohort\b",
        r"\bsingle\s+(?:declared\s+)?deflation cohort\b",
    ),
    "named_series": (
        r"\bdeclared series\b",
        r"\bprovided series\b",
        r"\bpre-?computed series\b",
    ),
    "pooled": (
        r"\bpooled\s+(?:one[- ]sample\s+)?statistic\b",
        r"\bcohort[- ]level mean\b",
        r"\bcohort[- ]mean\b",
        r"\bone[- ]sample\b",
        r"\bpooled mean\b",
        r"\bsingle (?:pooled )?statistic\b",
        r"\bone (?:pooled )?statistic\b",
    ),
    "encoded": (
        r"\balready\s+(?:pre-?)?encodes?\b.{0,40}\b(?:p&l|pnl|net|return|returns|profit|edge)\b",
        r"\bseries\b.{0,40}\balready\s+encodes?\b",
    ),
    "declared": (
        r"\b(?:provided|pre-?computed|declared|pre-?encoded)\s+(?:net\s+)?(?:p&l|pnl|return|returns|series)\b",
        r"\bpool these\s+\d*\s*(?:[\w&.-]+\s+)*series\b",
    ),
    "construction": (
        r"\bgo\s+long\b|\bgo\s+short\b|\blong[- ]short\b|\blong[- ]only\b|\bshort[- ]only\b",
        r"\bentry\b|\bexit\b",
        r"\bposition\b|\bpositions\b",
        r"\bsignal\b",
        r"\bmomentum\b",
        r"\brebalance\b|\brebalanced\b|\brebalancing\b",
    ),
    "venue": (
        r"\bevent[- ]market\b",
        r"\bprediction[- ]market\b",
        r"\bkalshi\b",
        r"\bpolymarket\b",
    ),
    "bracket": (
        r"\bbracket(?:s|ed)?\b",
        r"\bstrike(?:s)?\b",
        r"\bbinary\s+market\b",
        r"\bsettled?\s+(?:inside|within)\b",
    ),
    "pricing": (
        r"\bdeclared\s+(?:bracket\s+)?pricing\s+model\b",
        r"\bnormal[_ -]bracket\b",
        r"\bpricing\s+model\b.{0,80}\b(?:mu|forecast|spot)\b.{0,40}\bsigma\b",
        r"\bphi\s*\(",
        r"\bprobability\s+model\b.{0,80}\bbracket\b",
    ),
    "direction": (
        r"\b(?:predicts?|forecasts?|forecasting)\b",
        r"\bleads?\b.{0,60}\b(?:target|return|returns|volatility|rv|realized|outcome)\b",
        r"\b(?:target|return|returns|volatility|rv|realized|outcome)\b.{0,60}\b(?:on|against)\b.{0,30}\b(?:predictor|signal)\b",
    ),
    "regression": (
        r"\bregress(?:ion|ed|es|)\b",
        r"\bols\b|\bleast\s+squares\b|\blinear\s+regression\b",
        r"\bcoefficient\b|\bbeta\b",
        r"\bt\s*[-=]\s*-?\d+(?:\.\d+)?\b|\bt[- ]stat(?:istic)?\b",
        r"\br\s*(?:\^2|2)\b|\br-squared\b",
        r"\bmsfe\b|\brmse\b",
    ),
    "horizon": (
        r"\bnext[- ](?:day|week|period|month|quarter|year)\b",
        r"\bforward\b",
        r"\bfuture\b",
        r"\b\d+[-\s]*(?:d|day|days|week|weeks|period|periods|month|months|quarter|quarters|year|years)[- ]ahead\b",
        r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten)[- ](?:day|week|month|quarter|year)s?[- ]?ahead\b",
        r"\bh[- ]?ahead\b",
        r"\b\d+[- ](?:day|week|month|quarter|year)s?\s+horizon\b",
        r"\b(?:daily|weekly|monthly|quarterly|annual|yearly)\s+horizon\b",
        r"\bnext\s+\d+\s+(?:days?|weeks?|months?|quarters?|years?)\b",
        r"\bhorizon\s+of\s+\d+\s+(?:days?|weeks?|months?|quarters?|years?)\b",
    ),
    "strategy": (
        r"\bsharpe\b",
        r"\bpnl\b|\bp&l\b",
        r"\bprofit(?:s|ability)?\b",
        r"\bcagr\b|\bannualized\s+return\b",
        r"\bdrawdown\b",
        r"\bwin[- ]?rate\b|\bhit[- ]?rate\b",
        r"\binformation\s+ratio\b",
        r"\bturnover\b",
        r"\bstrateg(?:y|ies)\b",
        r"\bposition(?:s| sizing)?\b",
        r"\bentry\b|\bexit\b",
        r"\bexcess\s+returns?\b|\bstrategy\s+returns?\b",
        r"\btradeable\b|\btradable\b",
    ),
    "model": (
        r"\b(?:forecast|forecasts|forecasting|predicts?|prediction)\b",
        r"\bmodel\s+(?:forecast|prediction)\b",
    ),
    "accuracy": (
        r"\bmsfe\b|\bmspe\b|\brmse\b",
        r"\bmean\s+squared\s+(?:forecast\s+)?error\b",
        r"\bout[- ]of[- ]sample\s+r\s*(?:\^2|2)\b|\boos\s+r\s*(?:\^2|2)\b",
        r"\bdiebold[- ]mariano\b|\bclark[- ]west\b",
    ),
    "rival": (
        r"\bbeats?\b.{0,80}\b(?:random[- ]walk|benchmark|naive|historical\s+mean)\b",
        r"\boutperform(?:s|ed)?\b.{0,80}\b(?:random[- ]walk|benchmark|naive|historical\s+mean)\b",
        r"\b(?:random[- ]walk|benchmark|naive|historical\s+mean)\b.{0,80}\b(?:forecast|model|msfe|rmse|mspe)\b",
        r"\brelative\s+(?:to|against)\b.{0,80}\b(?:random[- ]walk|benchmark|naive|historical\s+mean)\b",
        r"\b(?:msfe|mspe|rmse)\s+ratio\b",
        r"\b(?:msfe|mspe|rmse)\s*[=:]\s*0?\.\d+\b",
        r"\bout[- ]of[- ]sample\s+r\s*(?:\^2|2)\b|\boos\s+r\s*(?:\^2|2)\b",
    ),
    "unseen": (
        r"\bout[- ]of[- ]sample\b|\boos\b",
        r"\bholdout\b",
    ),
    "timing": (
        r"\baround\b.{0,60}\b(?:event|announcement|earnings|fomc|listing|addition|halving)\b",
        r"\b(?:following|after|before)\b.{0,60}\b(?:event|announcement|earnings|fomc|listing|addition|halving)\b",
        r"\b(?:event|announcement|earnings|fomc|listing|addition|halving)\b.{0,60}\b(?:window|date|day|days)\b",
    ),
    "abnormal": (
        r"\babnormal\s+returns?\b",
        r"\bcumulative\s+abnormal\s+returns?\b",
        r"\bcar\b",
    ),
    "window": (
        r"\bevent\s+window\b",
        r"\[\s*-?\d+\s*,\s*\+?\d+\s*\]\s*(?:day|days)?\s*window\b",
        r"\bwindow\s*\[\s*-?\d+\s*,\s*\+?\d+\s*\]",
    ),
    "alpha": (
        r"\balpha\b",
        r"\bintercept\b",
        r"\babnormal\s+returns?\b",
    ),
    "control": (
        r"\bafter\s+controlling\s+for\b",
        r"\bcontrolling\s+for\b",
        r"\bcontrol(?:s|led)?\s+for\b",
        r"\bnet\s+of\b.{0,60}\bfactors?\b",
        r"\bspanning\b|\bspanned\b",
        r"\bregress(?:ion|ed|es|)?\b.{0,80}\bon\b.{0,80}\bfactors?\b",
    ),
    "factors": (
        r"\bcapm\b",
        r"\bff\s*3\b|\bfama[- ]french\s+3\b|\bthree[- ]factors?\b",
        r"\bff\s*5\b|\bfama[- ]french\s+5\b|\bfive[- ]factors?\b",
        r"\bcarhart\b",
        r"\bmkt[- ]rf\b|\bsmb\b|\bhml\b|\brmw\b|\bcma\b",
    ),
    "sort": (
        r"\bsort(?:ed|s|ing)?\s+(?:stocks?|assets?|firms?|entities|securities|the\s+cross[- ]section)?\s*(?:by|on)\b",
        r"\bportfolio(?:s)?\s+sort(?:ed|s)?\s+(?:by|on)\b",
        r"\bcross[- ]sectional\s+sort\b",
        r"\brank(?:ed|s|ing)?\s+(?:stocks?|assets?|firms?|entities|securities)?\s*(?:by|on)\b",
    ),
    "spread": (
        r"\btop[- ]minus[- ]bottom\b",
        r"\btop\s+(?:decile|quintile|bucket|portfolio).{0,60}\bbottom\b",
        r"\bbottom\s+(?:decile|quintile|bucket|portfolio).{0,60}\btop\b",
        r"\bhigh[- ]minus[- ]low\b|\bhigh\s+minus\s+low\b|\bhml\b",
        r"\bdecile\s+spread\b|\bquintile\s+spread\b|\blong[- ]short\s+spread\b",
        r"\blong[- ]short\b.{0,80}\b(?:decile|quintile|characteristic|sort|rank)\b",
    ),
    "characteristic": (
        r"\bcharacteristic\b",
        r"\bbook[- ]to[- ]market\b|\bvalue\b",
        r"\bmomentum\b",
        r"\bsize\b|\bmarket\s+cap(?:italization)?\b",
        r"\bquality\b|\bprofitability\b|\binvestment\b",
        r"\baccruals?\b|\basset\s+growth\b|\bleverage\b|\bearnings\b",
    ),
    "formula": (r"\bsignal\s*(?:formula|dsl)?\s*[:=]\s*[^.;\n]+",),
    "trade_series": (r"\btrade_series\s*[:=]\s*[a-zA-Z][a-zA-Z0-9_.]*",),
    "descriptive": (
        r"\bunconditional\s+(?:mean|average|bias|frequency|correlation)\b",
        r"\b(?:mean|average)\s+(?:bias|return|effect|difference)\b",
        r"\bcorrelation\b",
        r"\bfrequency\b",
        r"\bfraction\b",
        r"\bpercent(?:age)?\s+of\b",
        r"\bobservations?\b",
        r"\bci\b|\bconfidence interval\b",
    ),
    "trading": (
        r"\bsignal\b",
        r"\bentry\b|\bexit\b",
        r"\bposition\b|\bpositions\b",
        r"\bpnl\b|\bp&l\b",
        r"\bsharpe\b",
        r"\btrade\b|\btrading\b",
        r"\bmomentum\b",
        r"\blong\b|\bshort\b",
        r"\bstrategy\b",
    ),
    "structural": (
        r"\bmarket structure\b",
        r"\bmicrostructure\b",
        r"\bcauses?\b",
        r"\bmechanism\b",
        r"\binstitutional\b",
        r"\bshould\b",
    ),
}
# Cues that may stand in a claim's source as well as in the claim.
SHARED = ("venue", "bracket", "pooled", "encoded", "declared")
# What states a parameter, in order of precedence, with the value if the wording gives it.
PARAMETERS = (
    ("event_window", r"\[\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\]\s*(?:day|days)?\s*window", None),
    ("event_window", r"window\s*\[\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\]", None),
    ("event_window", r"\bevent\s+window\s*(?:of|=|:)?\s*\[\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\]", None),
    ("event_days", r"\b(?:over|during)\s+(?:the\s+)?(\d+)\s*(?:day|trading[- ]day)s?\s+after\b", None),
    ("estimation_window", r"\bestimation\s+window\s*(?:of|=|:)?\s*(\d+)", None),
    ("estimation_window", r"\b(\d+)\s*(?:day|trading[- ]day)s?\s+estimation\s+window\b", None),
    ("estimation_window", r"\busing\s+(\d+)\s*(?:pre[- ]event|prior)\s*(?:day|trading[- ]day)s?\b", None),
    ("buckets", r"\bdecile(?:s)?\b|\btop\s+10%\b|\bbottom\s+10%\b", "10"),
    ("buckets", r"\bvigintile(?:s)?\b|\btop\s+5%\b|\bbottom\s+5%\b", "20"),
    ("buckets", r"\boctile(?:s)?\b", "8"),
    ("buckets", r"\bsextile(?:s)?\b", "6"),
    ("buckets", r"\bquintile(?:s)?\b|\btop\s+20%\b|\bbottom\s+20%\b", "5"),
    ("buckets", r"\bquartile(?:s)?\b|\btop\s+25%\b|\bbottom\s+25%\b", "4"),
    ("buckets", r"\btercile(?:s)?\b|\btertile(?:s)?\b|\btop\s+third\b|\bbottom\s+third\b", "3"),
    ("buckets", r"\b(\d+)\s+(?:bucket|portfolio|group|fractile)s?\b", None),
    ("rebalance", r"\bmonthly\b|\beach\s+month\b", "ME"),
    ("rebalance", r"\bquarterly\b|\beach\s+quarter\b", "QE"),
    ("rebalance", r"\bannually\b|\byearly\b|\beach\s+year\b|\bannual\s+rebalanc", "YE"),
    ("rebalance", r"\bweekly\b|\beach\s+week\b", "W"),
    ("rebalance", r"\bdaily\b|\beach\s+day\b", "D"),
    ("horizon", r"\b(\d+)\s*(?:d|day|days|period|periods)[- ]ahead\b", None),
    ("horizon", r"\bh\s*=\s*(\d+)\b", None),
    ("horizon", r"\b(\d+)\s*(?:d|day|days)\s+horizon\b", None),
    ("baseline", r"\bmarket[- ]model\b|\bmarket\s+adjusted\b|\bcapm[- ]adjusted\b", "market_model"),
    ("baseline", r"\bmean[- ]adjusted\b|\bconstant[- ]mean\b|\bhistorical\s+mean\b", "mean_adjusted"),
    ("benchmark_set", r"\bff\s*5\b|\bfama[- ]french\s+5\b|\bfive[- ]factor\b|\brmw\b|\bcma\b", "ff5"),
    ("benchmark_set", r"\bcarhart\b", "carhart"),
    ("benchmark_set", r"\bff\s*3\b|\bfama[- ]french\s+3\b|\bthree[- ]factor\b|\bsmb\b|\bhml\b", "ff3"),
    ("benchmark_set", r"\bcapm\b|\bmarket\s+factor\b|\bmkt[- ]rf\b", "capm"),
    ("benchmark_method", r"\bhistorical\s+mean\b|\bexpanding\s+mean\b", "historical_mean"),
    ("benchmark_method", r"\brandom[- ]walk\b|\bnaive\b|\bpersistence\b|\blast\s+value\b", "random_walk"),
)
CLAIM_TYPES = (
    "event_market_strategy", "event_study", "factor_spanning", "cross_sectional_sort", "forecast_skill", "predictive_regression",
    "formulaic_signal", "provided_series_statistic", "descriptive_statistical", "trading_strategy", "structural_proposition",
)
DEFAULT_TYPE = "trading_strategy"


def needed(pattern: str) -> tuple[str, ...]:
    """Words of which every match of a pattern has at least one; none if that can't be said. Long words rather than few."""

    def best(*found: tuple[str, ...]) -> tuple[str, ...]:
        return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=())

    def walk(items) -> tuple[str, ...]:
        found, run = [], ""
        for kind, arg in [*items, (None, None)]:
            if kind is _parser.LITERAL:
                run += chr(arg)
                continue
            found, run = [*found, (run,) if run else ()], ""
            if kind is _parser.SUBPATTERN:
                found.append(walk(arg[3]))
            elif kind is _parser.BRANCH:
                each = [walk(branch) for branch in arg[1]]
                found.append(tuple(dict.fromkeys(w for e in each for w in e)) if all(each) else ())
            elif kind is _parser.MAX_REPEAT and arg[0] > 0:
                found.append(walk(arg[2]))
        return best(*found)

    return walk(list(_parser.parse(pattern)))


class Scanner:
    """Runs of many patterns over a text those that can match it."""

    def __init__(self, patterns: tuple[str, ...]):
        self.patterns = [re.compile(p) for p in patterns]
        self.always, words = [], {}
        for k, p in enumerate(patterns):
            need = needed(p)
            if not need:
                self.always.append(k)
            for w in need:
                words.setdefault(w, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for w, ks in words.items():
            self.automaton.add_word(w, tuple(ks))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        out = set(self.always)
        for _, ks in self.automaton.iter(text):
            out.update(ks)
        return sorted(out)


@cache
def scanner(patterns: tuple[str, ...]) -> Scanner:
    """One for each Python worker and table of patterns."""
    return Scanner(patterns)


def _scan(df: DataFrame, texts: list[Column], field: str, kind: str, find: Callable[[list[str]], list[dict]]) -> DataFrame:
    """df with `field`, what find makes of the row's texts, as an array of records of the type `kind`. Columns of that name are replaced."""
    own = df.drop(field)
    schema = T.StructType([*own.schema.fields, T.StructField(field, T._parse_datatype_string(f"array<{kind}>"))])
    arrow, names, n = to_arrow_schema(schema), own.columns, len(texts)
    given = df.select(*[f"`{c}`" for c in own.columns], *[t.alias(f"__text{k}") for k, t in enumerate(texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(len(names) + k).to_pylist() for k in range(n)], strict=True)
            made = pa.array([find([t or "" for t in row]) for row in rows], arrow.field(field).type)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], made], schema=arrow)

    return given.mapInArrow(run, schema)


def _low(*columns: str | Column) -> Column:
    """Lower-cased texts joined by a space; null as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]))


def find_cues(df: DataFrame, claim: list[str], source: str | None = None) -> DataFrame:
    """df with cues: for each pattern of CUES that the claim's columns match, its cue, whether it was found with the source's text, and the place.

    Cues of SHARED are looked for in the claim alone and, as `sourced`, in the claim with its source behind it. Null and empty texts have no cues.
    """
    patterns = tuple(dict.fromkeys(p for ps in CUES.values() for p in ps))
    of = {p: [c for c, ps in CUES.items() if p in ps] for p in patterns}
    shared = {p: [c for c in of[p] if c in SHARED] for p in patterns}
    cues, both = [of[p] for p in patterns], [shared[p] for p in patterns]
    sourced = source is not None

    def find(texts: list[str]) -> list[dict]:
        s, out = scanner(patterns), []
        for text, named, whole in ((texts[0], cues, False), (texts[1], both, True)) if sourced else ((texts[0], cues, False),):
            for k in s.candidates(text):
                if named[k] and (m := s.patterns[k].search(text)):
                    out += [{"cue": c, "sourced": whole, "start": m.start()} for c in named[k]]
        return out

    texts = [_low(*claim)] + ([F.concat_ws(" ", _low(*claim), _low(source))] if sourced else [])
    return _scan(df, texts, "cues", "struct<cue:string,sourced:boolean,start:int>", find)


def claim_type(blank: Column, cues: str = "cues", sourced: bool = False) -> Column:
    """The first type whose cues are all there and that nothing forbids; strategies where nothing tells, and where a claim is blank."""

    def count(cue: str, whole: bool = False) -> Column:
        return F.size(F.filter(cues, lambda c: (c["cue"] == cue) & (c["sourced"] == F.lit(whole and sourced))))

    def has(*names: str, whole: bool = False) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (count(n, whole) > 0)
        return out

    plain = ~has("strategy")
    built = lambda encoded: F.when((count("construction") >= 2) & ~encoded, "trading_strategy").otherwise("provided_series_statistic")
    return (
        F.when(blank, DEFAULT_TYPE)
        .when(has("venue", "bracket", whole=True) & has("pricing"), "event_market_strategy")
        .when(plain & has("timing", "abnormal", "window"), "event_study")
        .when(has("alpha", "control", "factors"), "factor_spanning")
        .when(has("sort", "spread", "characteristic"), "cross_sectional_sort")
        .when(plain & has("model", "accuracy", "rival", "unseen"), "forecast_skill")
        .when(plain & has("direction", "regression", "horizon"), "predictive_regression")
        .when(has("formula", "trade_series"), "formulaic_signal")
        .when(has("one_cohort"), "provided_series_statistic")
        .when(has("named_series"), built(has("encoded")))
        .when(has("pooled", whole=True) & (has("encoded", whole=True) | has("declared", whole=True)), built(has("encoded", whole=True)))
        .when(has("descriptive") & (count("descriptive") >= count("trading")), "descriptive_statistical")
        .when(has("trading"), "trading_strategy")
        .when(has("structural"), "structural_proposition")
        .otherwise(DEFAULT_TYPE)
    )


def classify(df: DataFrame, claim: list[str], source: str | None = None) -> DataFrame:
    """df with claim_type, one of CLAIM_TYPES, and its cues. A null or blank claim, whatever its source says, is a strategy."""
    found = find_cues(df, claim, source)
    return found.withColumn("claim_type", claim_type(~_low(*claim).rlike(r"\S"), sourced=source is not None))


def find_spans(df: DataFrame, claim: list[str]) -> DataFrame:
    """df with spans: each place of the claim's columns that states a parameter, with its kind, rank of the wording, number among that wording's
    matches, and the one or two values as they stand."""
    patterns = tuple(p for _, p, _ in PARAMETERS)

    def find(texts: list[str]) -> list[dict]:
        s, out = scanner(patterns), []
        for k in s.candidates(texts[0]):
            kind, _, value = PARAMETERS[k]
            for nth, m in enumerate(s.patterns[k].finditer(texts[0])):
                first = value or m.group(1)
                out.append({"kind": kind, "rank": k, "nth": nth, "value": first, "until": m.group(2) if m.re.groups > 1 else None, "start": m.start(), "stop": m.end()})
        return out

    return _scan(df, [_low(*claim)], "spans", "struct<kind:string,rank:int,nth:int,value:string,until:string,start:int,stop:int>", find)


def parameters(spans: str = "spans", strict: bool = False) -> Column:
    """One record of what the spans state: event_window, estimation_window, buckets, rebalance, horizon, baseline, benchmark_set, benchmark_method,
    and contradicts, the kinds with more than one value.

    The first wording in order of precedence counts, at its first place; a window that ends before it starts is passed over. Null where
    nothing is stated or a number is beyond an int. A span within a longer one of its kind says nothing of its own. With `strict` a
    kind that contradicts itself is null.
    """
    number = lambda x: F.expr("int(0)") if x is None else x.try_cast("int")

    def first(kind: str, ok: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
        return F.get(F.filter(spans, lambda s: (s["kind"] == kind) & (s["nth"] == 0) & ok(s)), F.lit(0))

    def outer(kind: tuple[str, ...]) -> Column:
        own = F.filter(spans, lambda s: s["kind"].isin(*kind))
        covers = lambda t, s: (t["start"] <= s["start"]) & (t["stop"] >= s["stop"]) & (t["stop"] - t["start"] > s["stop"] - s["start"])
        return F.filter(own, lambda s: ~F.exists(own, lambda t: covers(t, s)))

    window = first("event_window", lambda s: number(s["value"]) <= number(s["until"]))
    days = number(first("event_days")["value"])
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    made = {
        "event_window": F.when(window.isNotNull(), pair(number(window["value"]), number(window["until"]))).when(days.isNotNull(), pair(F.lit(0), F.greatest(F.lit(0), days - 1))),
        "estimation_window": (n := number(first("estimation_window")["value"]), F.when(n.isNotNull(), F.greatest(F.lit(5), n)))[1],
        "buckets": (n := number(first("buckets")["value"]), F.when(n.isNotNull(), F.greatest(F.lit(2), n)))[1],
        "rebalance": first("rebalance")["value"],
        "horizon": number(first("horizon")["value"]),
        "baseline": first("baseline")["value"],
        "benchmark_set": first("benchmark_set")["value"],
        "benchmark_method": first("benchmark_method")["value"],
    }
    both = {"event_window": ("event_window", "event_days")}
    said = lambda s: F.concat_ws(",", s["kind"], F.ltrim(s["value"], F.lit("+")), F.ltrim(s["until"], F.lit("+")))
    several = {k: F.size(F.array_distinct(F.transform(outer(both.get(k, (k,))), said))) > 1 for k in made}
    fields = [(F.when(~several[k], c) if strict else c).alias(k) for k, c in made.items()]
    return F.struct(*fields, F.array_compact(F.array(*[F.when(several[k], F.lit(k)) for k in made])).alias("contradicts"))


def extract(df: DataFrame, claim: list[str], strict: bool = False) -> DataFrame:
    """df with spans and parameters, see there."""
    return find_spans(df, claim).withColumn("parameters", parameters(strict=strict))
