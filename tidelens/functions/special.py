"""Special functions Spark lacks, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import c

# Abramowitz and Stegun formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x) -> Column:
    """Error function, absolute error below 1.5e-7."""
    x = c(x)
    t = F.lit(1.0) / (F.lit(1.0) + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def normal_pdf(x) -> Column:
    x = c(x)
    return F.exp(-0.5 * x * x) / F.lit(math.sqrt(2 * math.pi))


def normal_cdf(x) -> Column:
    return 0.5 * (1.0 + erf(c(x) / F.lit(math.sqrt(2.0))))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


# Acklam's rational approximation of the inverse normal.
PROBIT_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
            1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
PROBIT_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
            6.680131188771972e1, -1.328068155288572e1)
PROBIT_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783)
PROBIT_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)


def _horner(coef, t) -> Column:
    out = F.lit(coef[0])
    for k in coef[1:]:
        out = out * t + F.lit(k)
    return out


def probit(p) -> Column:
    """Inverse of the normal distribution function for 0 < p < 1."""
    p = c(p)
    q = p - 0.5
    r = q * q
    mid = _horner(PROBIT_A, r) * q / (_horner(PROBIT_B, r) * r + 1.0)
    tl = F.sqrt(-2.0 * F.log(p))
    th = F.sqrt(-2.0 * F.log(1.0 - p))
    lo = _horner(PROBIT_C, tl) / (_horner(PROBIT_D, tl) * tl + 1.0)
    hi = -_horner(PROBIT_C, th) / (_horner(PROBIT_D, th) * th + 1.0)
    return F.when(p < 0.02425, lo).when(p > 1 - 0.02425, hi).otherwise(mid)
