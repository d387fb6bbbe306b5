"""Queries of what claims say: their types, their parameters, and whether a specification says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from refspark.operators import claimtext as t
from refspark.operators import specs as p
from refspark.plans import views

# A claim and its type, one at least for each way in which a type is found or refused.
CLAIMS = (
    ("The pooled mean is tested across the one declared deflation cohort", "provided_series_statistic"),
    ("The provided series has a positive mean", "provided_series_statistic"),
    ("Go long on the signal of the declared series and rebalance", "trading_strategy"),
    ("The declared series already encodes net profit; entry and exit on a signal", "provided_series_statistic"),
    ("A one-sample test of the declared net return", "provided_series_statistic"),
    ("A one-sample test of momentum with entry and exit of the declared returns", "trading_strategy"),
    ("A one-sample test of a carry spread", "trading_strategy"),
    ("Kalshi brackets are mispriced under a normal bracket", "event_market_strategy"),
    ("Kalshi brackets are mispriced", "trading_strategy"),
    ("Abnormal returns around the earnings announcement in a [-1,+3] day window", "event_study"),
    ("Abnormal returns around the earnings announcement in a [-1,+3] day window give a Sharpe of 2", "trading_strategy"),
    ("The factor earns alpha after controlling for CAPM", "factor_spanning"),
    ("The intercept is spanned by the five-factor model, a strategy", "factor_spanning"),
    ("Stocks sorted by size: top-minus-bottom is positive", "cross_sectional_sort"),
    ("Firms ranked on book-to-market: high minus low earns profits", "cross_sectional_sort"),
    ("The model forecast beats the random walk out-of-sample by RMSE", "forecast_skill"),
    ("The model forecast beats the random walk out-of-sample by RMSE and drawdown", "trading_strategy"),
    ("Funding predicts volatility 5-day ahead with a coefficient of 0.2", "predictive_regression"),
    ("Funding predicts returns next day, t=3, r2 small", "predictive_regression"),
    ("Funding predicts tradable returns next day with a beta of 1", "trading_strategy"),
    ("trade_series: px.close signal = zscore(px)", "formulaic_signal"),
    ("The unconditional mean of observations", "descriptive_statistical"),
    ("The correlation of a signal with momentum of a trade", "trading_strategy"),
    ("Market structure causes it", "structural_proposition"),
    ("Nothing is said here", "trading_strategy"),
    ("   ", "trading_strategy"),
)
def _record(window="", estimation="", buckets="", rebalance="", horizon="", baseline="", family="", method="", contradicts="") -> str:
    return "|".join(map(str, (window, estimation, buckets, rebalance, horizon, baseline, family, method, contradicts)))


# What a claim says of its parameters, and the record of it.
STATED = (
    ("returns in a [-1, +3] day window over deciles", _record("-1:3", buckets=10)),
    ("an event window of [2,-2], window [0,5], using 120 prior days", _record("0:5", 120, contradicts="event_window")),
    ("over the 10 trading days after, with a 2 day estimation window, market-model", _record("0:9", 5, baseline="market_model")),
    ("quintiles, each month, 5 periods-ahead; h = 9", _record(buckets=5, rebalance="ME", horizon=5, contradicts="horizon")),
    ("sorted in 1 groups each week; random-walk", _record(buckets=2, rebalance="W", method="random_walk")),
    ("deciles and quartiles, annually, against the historical mean", _record(buckets=10, rebalance="YE", baseline="mean_adjusted", method="historical_mean", contradicts="buckets")),
    ("fama-french 5 factors with smb and hml", _record(family="ff5", contradicts="benchmark_set")),
    ("carhart, daily, 99999999999999999999 day horizon", _record(rebalance="D", family="carhart")),
    ("nothing", _record()),
)
TEMPLATE = '"_llm_mode": "deterministic-template"'
_REGRESSION = '{"claim_type": "predictive_regression", ' + TEMPLATE + ', "inputs": ["funding_rate", "btc_vol"], "horizon": "5 days"%s}'
_SORT = '{"claim_type": "cross_sectional_sort", ' + TEMPLATE + ', "panel_inputs": {"returns": "r", "characteristic": "c"}, "characteristic": "size", "n_buckets": %s, "rebalance": "%s", "hold": "1M"%s}'
_STUDY = '{"claim_type": "event_study", ' + TEMPLATE + ', "return_series": "spx", "event_calendar": {"path": "fomc"}, "window": [%s], "estimation_window": 60, "baseline": "%s"%s}'
_SPAN = '{"claim_type": "factor_spanning", ' + TEMPLATE + ', "inputs": ["carry", "mkt"], "benchmark_set": "%s", "benchmark_factors": [%s]%s}'
_SKILL = '{"claim_type": "forecast_skill", ' + TEMPLATE + ', "inputs": ["garch", "btc_vol"], "benchmark": "%s"%s}'
_R, _C, _E, _A, _K = "predictive_regression", "cross_sectional_sort", "event_study", "factor_spanning", "forecast_skill"
_RT, _CT = "Funding rate predicts BTC vol 5-day ahead", "Firms sorted by size in quintiles, monthly: top less bottom"
_ET, _AT = "Abnormal returns around FOMC, event window [-1, 3], mean-adjusted", "Carry earns alpha after controlling for CAPM"
_KT = "The garch forecast of btc vol has a lower RMSE than the random walk"
_BOUND = ', "binding_provenance": {"predictor": {"kind": "%s", "series": "funding_rate", "full_coverage": true, "score": 0.9, "matched_tokens": ["funding"]}, "target": {"kind": "resolved", "series": "%s", "full_coverage": %s, "score": 0.8, "matched_tokens": ["x~vol"]}}'
# A claim's type, its text, a specification, and the reasons against it.
DECLARED = (
    (_R, _RT, _REGRESSION % "", ""),
    (_R, _RT, None, "no_spec"),
    (_R, _RT, "[1]", "no_spec"),
    (_R, "BTC vol predicts funding rate 5-day ahead", _REGRESSION % "", "order_of_mention"),
    (_R, "A regression of BTC vol on funding rate, next day", _REGRESSION % "", "horizon"),
    (_R, _RT, _REGRESSION % ', "estimator": "lasso"', "estimator"),
    (_R, _RT, _REGRESSION % ', "rules": [{"p_value_max": 0.05}]', "added_gate"),
    (_R, _RT, _REGRESSION % ', "notes": ["a", "Reject if small"]', "added_gate"),
    (_R, _RT, _REGRESSION % ', "claim_mechanism": "significance of it"', ""),
    (_R, _RT, _REGRESSION % ', "target": "funding_rate"', "no_pair;order_of_mention"),
    (_R, _RT, _REGRESSION.replace("deterministic-template", "model") % "", "not_a_template"),
    (_R, "Funding rate predicts the vol of bitcoin 5-day ahead", _REGRESSION % (_BOUND % ("literal", "btc_vol", "true")), ""),
    (_R, "Funding rate predicts the vol of bitcoin 5-day ahead", _REGRESSION % (_BOUND % ("literal", "eth_vol", "true")), "order_of_mention"),
    (_R, "The vol of bitcoin predicts funding rate 5-day ahead", _REGRESSION % (_BOUND % ("literal", "btc_vol", "true")), "order_of_mention"),
    (_R, "Funding rate predicts the vol of bitcoin 5-day ahead", _REGRESSION % (_BOUND % ("literal", "btc_vol", "false")), "order_of_mention"),
    (_C, _CT, _SORT % (5, "ME", ""), ""),
    (_C, _CT, _SORT % (10, "me", ""), "buckets"),
    (_C, _CT, _SORT % (5, "QE", ""), "cadence"),
    (_C, "Firms sorted by value: top less bottom", _SORT % (7, "QE", ""), "characteristic"),
    (_C, "The size of firms matters", _SORT % (7, "QE", ""), "no_sort"),
    (_C, _CT, _SORT % ('"x"', "ME", ""), "no_panel;buckets"),
    (_E, _ET, _STUDY % ("-1, 3", "mean_adjusted", ""), ""),
    (_E, _ET, _STUDY % ("-1, 4", "mean_adjusted", ""), "event_window"),
    (_E, _ET, _STUDY % ("-1, 3", "market_model", ', "market_series": "spx"'), "baseline"),
    (_E, _ET, _STUDY % ("-1, 3", "mean_adjusted", ', "min_obs": 20'), "added_gate"),
    (_E, "Returns rise", _STUDY % ("-1, 3", "mean_adjusted", ""), "no_event"),
    (_E, _ET, (_STUDY % ("-1, 3", "mean_adjusted", "")).replace('{"path": "fomc"}', '""'), "no_calendar"),
    (_E, _ET, (_STUDY % ("-1, 3", "mean_adjusted", "")).replace("60", "2"), "estimation_window"),
    (_A, _AT, _SPAN % ("capm", '"mkt"', ""), ""),
    (_A, _AT, _SPAN % ("ff3", '"mkt"', ""), "benchmark_set;benchmark_size"),
    (_A, _AT, _SPAN % ("capm", '"mkt", "smb"', ""), "benchmark_size"),
    (_A, _AT, _SPAN % ("capm", '"carry"', ""), "no_candidate"),
    (_A, "Carry beats CAPM", _SPAN % ("capm", '"mkt"', ""), "no_alpha"),
    (_A, "Value earns alpha beyond the market", _SPAN % ("capm", '"mkt"', ""), "candidate"),
    (_A, _AT, _SPAN % ("capm", '"mkt"', ', "estimator": "ridge"'), "estimator"),
    (_K, _KT, _SKILL % ("random-walk", ""), ""),
    (_K, _KT, _SKILL % ("mean", ""), "binding;benchmark_method"),
    (_K, _KT, _SKILL % ("garch", ""), "benchmark"),
    (_K, _KT, _SKILL % ("random-walk", ', "loss": "absolute"'), "loss"),
    (_K, "The garch model of btc vol", _SKILL % ("naive", ""), "no_forecast;binding"),
    ("trading_strategy", _RT, _REGRESSION % "", None),
)


def _quoted(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + str(v).replace("'", "''") + "'"


def _pick(values, key: str) -> str:
    """The key's value by its remainder, for Spark and other engines."""
    return f"CASE CAST({key} % {len(values)} AS INT) " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values)) + " END"


def planted_types(s, d):
    """A claim for each order and each document, the document's text being its source."""
    text = _pick([c for c, _ in CLAIMS], "id")
    rows = views.table(s, d, "orders").selectExpr("'order' origin", "o_orderkey id", "o_orderpriority source")
    rows = rows.unionByName(views.table(s, d, "documents").selectExpr("'document' origin", "doc_id id", "text source"))
    return t.classify(rows.withColumn("claim", F.expr(text)), ["claim"], "source").select("origin", "id", "claim_type")


def types(s, d):
    """Every document and every turn of a conversation as a claim, behind one of the planted sentences for every third."""
    rows = views.table(s, d, "documents").selectExpr("'document' origin", "cast(doc_id as string) id", "doc_id k", "text").unionByName(views.table(s, d, "conversations").selectExpr("'turn' origin", "concat(conv_id, ':', turn) id", "conv_id k", "text"))
    rows = rows.selectExpr("origin", "id", f"if(k % 3 = 0, {_pick([c for c, _ in CLAIMS], 'k')}, '') said", "text")
    return t.classify(rows, ["said", "text"]).select("origin", "id", "claim_type")


def stated(s, d):
    """The parameters that the documents' planted sentences and whole texts state."""
    rows = views.table(s, d, "documents").selectExpr("doc_id id", f"{_pick([c for c, _ in STATED], 'doc_id')} said", "text")
    r = t.extract(rows, ["said", "text"]).select("id", "parameters.*")
    window = F.concat_ws(":", "event_window.start", "event_window.end")
    parts = [window, "estimation_window", "buckets", "rebalance", "horizon", "baseline", "benchmark_set", "benchmark_method"]
    return r.select("id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in parts], F.array_join("contradicts", ",")).alias("stated"))


def declared(s, d):
    rows = views.table(s, d, "orders").selectExpr("o_orderkey id", *[f"{_pick([r[k] for r in DECLARED], 'o_orderkey')} {c}" for k, c in enumerate(("claim_type", "said", "spec"))])
    r = p.spec_matches_text(rows, ["said"])
    return r.select("id", "matches", F.array_join("reasons", ";").alias("reasons"))


QUERIES = {
    "h10_planted_claim_types": planted_types,
    "h10_claim_types": types,
    "h19_extract_params": stated,
    "h34_spec_matches_text": declared,
}

# A word's edge is one of ASCII letters in that engine, so other letters are made ASCII ones there.
_LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}]"
_ANY = {c: "(" + " OR ".join(f"regexp_matches(x, {_quoted(w)})" for w in ws) + ")" for c, ws in t.CUES.items()}
_COUNT = {c: "(" + " + ".join(f"CAST(regexp_matches(x, {_quoted(w)}) AS INT)" for w in ws) + ")" for c, ws in t.CUES.items()}
SQL = {
    "h10_planted_claim_types": f"WITH r AS (SELECT 'order' AS origin, o_orderkey AS id FROM orders UNION ALL SELECT 'document', doc_id FROM documents) SELECT origin, id, {_pick([c for _, c in CLAIMS], 'id')} AS claim_type FROM r",
    "h10_claim_types": f"""WITH r AS (SELECT 'document' AS origin, CAST(doc_id AS VARCHAR) AS id, doc_id AS k, text FROM documents UNION ALL SELECT 'turn', conv_id || ':' || turn, conv_id, text FROM conversations),
x AS (SELECT origin, id, regexp_replace(lower(CASE WHEN k % 3 = 0 THEN {_pick([c for c, _ in CLAIMS], 'k')} ELSE '' END || ' ' || coalesce(text, '')), {_quoted(_LETTERS)}, 'q', 'g') AS x FROM r),
c AS (SELECT origin, id, trim(x) = '' AS blank, {', '.join(f'{v} AS "{k}"' for k, v in _ANY.items())}, {_COUNT['construction']} AS n_construction, {_COUNT['descriptive']} AS n_descriptive, {_COUNT['trading']} AS n_trading FROM x)
SELECT origin, id, CASE WHEN blank THEN 'trading_strategy' WHEN venue AND bracket AND pricing THEN 'event_market_strategy' WHEN NOT strategy AND timing AND abnormal AND "window" THEN 'event_study' WHEN alpha AND control AND factors THEN 'factor_spanning'
  WHEN sort AND spread AND characteristic THEN 'cross_sectional_sort' WHEN NOT strategy AND model AND accuracy AND rival AND unseen THEN 'forecast_skill' WHEN NOT strategy AND direction AND regression AND horizon THEN 'predictive_regression'
  WHEN formula AND trade_series THEN 'formulaic_signal' WHEN one_cohort THEN 'provided_series_statistic' WHEN named_series OR pooled AND (encoded OR declared) THEN CASE WHEN n_construction >= 2 AND NOT encoded THEN 'trading_strategy' ELSE 'provided_series_statistic' END
  WHEN n_descriptive > 0 AND n_descriptive >= n_trading THEN 'descriptive_statistical' WHEN n_trading > 0 THEN 'trading_strategy' WHEN structural THEN 'structural_proposition' ELSE 'trading_strategy' END AS claim_type FROM c""",
    "h19_extract_params": f"SELECT doc_id AS id, {_pick([v for _, v in STATED], 'doc_id')} AS stated FROM documents",
    "h34_spec_matches_text": f"SELECT o_orderkey AS id, {_pick([r[3] for r in DECLARED], 'o_orderkey')} = '' AS matches, {_pick([r[3] for r in DECLARED], 'o_orderkey')} AS reasons FROM orders",
}
