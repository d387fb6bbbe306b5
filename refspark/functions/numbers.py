"""Numbers as text, the same way in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(value: Column, digits: int = 10) -> Column:
    """A double with so many significant digits: plain from 0.0001 to below 10^digits, else with an exponent of two digits or more; no zeros
    at the end of a fraction. nan, inf and -inf for those; null for null. (What C's "%.10g" writes; ties round up.)"""
    v = value.cast("double")
    raw = F.regexp_extract(F.format_string(f"%.{digits - 1}e", F.abs(v)), r"^(\d)(?:\.(\d+))?e([+-]\d+)$", 0)
    figures = F.regexp_replace(F.split(raw, "e")[0], r"\.", "")
    exponent = F.regexp_replace(F.split(raw, "e")[1], r"\+", "").cast("int")
    dot = lambda whole, rest: F.concat(whole, F.when(F.regexp_replace(rest, "0+$", "") == "", "").otherwise(F.concat(F.lit("."), F.regexp_replace(rest, "0+$", ""))))
    large = dot(F.substring(figures, F.lit(1), exponent + 1), F.substring(figures, exponent + 2, F.lit(digits)))
    small = dot(F.lit("0"), F.concat(F.repeat(F.lit("0"), -exponent - 1), figures))
    far = F.concat(dot(F.substring(figures, 1, 1), F.substring(figures, 2, digits)), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    far = F.when(F.abs(exponent) > 99, F.concat(F.regexp_replace(far, r"\d\d$", ""), F.abs(exponent).cast("string"))).otherwise(far)
    text = F.when((exponent < -4) | (exponent >= digits), far).when(exponent < 0, small).otherwise(large)
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.concat(F.when(v < 0, "-").otherwise(""), F.lit("inf"))).otherwise(F.concat(sign, text))


def exact(value: Column) -> Column:
    """A double as the shortest text of 15 significant digits that stands for it, or else as its own text, so that different doubles differ."""
    short = significant(value, 15)
    return F.when(short.try_cast("double") == value.cast("double"), short).otherwise(F.coalesce(F.when(F.isnan(value.cast("double")), "nan"), value.cast("double").cast("string")))
