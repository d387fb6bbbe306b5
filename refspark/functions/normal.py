"""The normal distribution as SQL text over an expression; the same text runs in Spark and in other SQL engines."""

from __future__ import annotations

#: Coefficients of the published rational approximations (Hart's for the distribution, Acklam's for its inverse).
CDF_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_LOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}e0"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}e0)"
    return out


def norm_cdf(x: str) -> str:
    """P(Z <= x); x within +-37, beyond that 0 or 1. Null for null and NaN."""
    z = f"least(abs({x}), 37.0e0)"
    tail = f"exp(-{z} * {z} / 2) * {_polynomial(CDF_TOP, z)} / {_polynomial(CDF_LOW, z)}"
    far = f"exp(-{z} * {z} / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65e0))))) / 2.506628274631e0"
    return f"(CASE WHEN ({x}) IS NULL OR isnan(CAST({x} AS DOUBLE)) THEN NULL WHEN ({x}) > 0 THEN 1 - (CASE WHEN {z} < 7.07106781186547e0 THEN {tail} ELSE {far} END) ELSE (CASE WHEN {z} < 7.07106781186547e0 THEN {tail} ELSE {far} END) END)"


def norm_ppf(p: str) -> str:
    """x with P(Z <= x) = p, to about 1e-9; null unless 0 < p < 1, for NaN too."""
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - 0.5e0)"
    r = f"({q} * {q})"
    return (
        f"(CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 OR isnan(CAST({p} AS DOUBLE)) THEN NULL WHEN ({p}) < 0.02425e0 THEN {_polynomial(PPF_C, low)} / {_polynomial(PPF_D, low)} "
        f"WHEN ({p}) <= 0.97575e0 THEN {_polynomial(PPF_A, r)} * {q} / {_polynomial(PPF_B, r)} ELSE -{_polynomial(PPF_C, high)} / {_polynomial(PPF_D, high)} END)"
    )
