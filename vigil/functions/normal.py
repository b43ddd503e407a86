"""The normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# P. J. Acklam's rational approximation of the inverse normal
# distribution function (relative error below 1.15e-9).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
_LOW = 0.02425


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function of p in (0, 1)."""
    q, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    r = q * q
    outer = _polynomial(_C, tail) / _polynomial(_D, tail)
    return F.when(p < _LOW, outer).when(p > 1 - _LOW, -outer).otherwise(_polynomial(_A, r) * q / _polynomial(_B, r))


def truncation(mean: float, std: float, low: float, high: float) -> tuple[float, ...]:
    """Arguments of ``truncated_normal`` for a normal within [low, high]."""
    if std <= 0 or high <= low:
        mean = min(max(mean, low), high)
        return mean, 0.0, 0.5, 0.5, mean, mean
    return mean, std, normal_cdf((low - mean) / std), normal_cdf((high - mean) / std), low, high


def truncated_normal(u: Column, mean: Column, std: Column, p_low: Column, p_high: Column, low: Column, high: Column) -> Column:
    """Truncated normal draw from a uniform u in (0, 1): the quantile at a
    share between those of both ends."""
    x = mean + std * normal_quantile(p_low + u * (p_high - p_low))
    return F.least(F.greatest(x, low), high)
