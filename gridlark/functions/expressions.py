"""Column expressions that several operators share; safe under ANSI mode."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL for a zero denominator."""
    return a / F.nullif(b, F.lit(0.0))


def round_to(x: Column, digits: int) -> Column:
    """``x`` to a number of digits in double arithmetic: Spark's own ``round`` goes through decimal text for each value.

    The factor is the next double above the power of ten, so that halves go away from zero. Short, as it stands in
    queries once for each of many columns. Infinite values and NaN stay as they are.
    """
    return F.rint(x * math.nextafter(10.0**digits, math.inf)) / 10.0**digits


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both; NULL if one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def r2(y: Column, p: Column) -> Column:
    """Coefficient of determination; NULL for a constant target."""
    return 1 - ratio(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def skill(model: Column, naive: Column) -> Column:
    """Share of the naive error that a model saves."""
    return 1 - model / (naive + 1e-9)


def average_rank(by: list[str], order: Column) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(w.orderBy(order).rangeBetween(0, 0)) - 1) / 2


# Coefficients of a published rational approximation of the normal tail, lowest power first.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(_TAIL):
        poly = (poly + c) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


# Coefficients of a published rational approximation of the normal inverse, highest power first
# (numerator and denominator of the middle, numerator and denominator of the tails), and where the tails begin.
INVERSE_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
INVERSE_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
INVERSE_TAIL_FROM = 0.02425


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_inverse(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, to about 1e-8."""
    middle, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    inner = polynomial(INVERSE_MIDDLE[0], middle * middle) * middle / polynomial(INVERSE_MIDDLE[1], middle * middle)
    lower = polynomial(INVERSE_TAIL[0], tail) / polynomial(INVERSE_TAIL[1], tail)
    return F.when(F.least(p, 1 - p) >= INVERSE_TAIL_FROM, inner).otherwise(F.when(p < 0.5, lower).otherwise(-lower))


def poisson_one(u: Column) -> Column:
    """The Poisson(1) number of a uniform one: how many thresholds of the distribution function it reaches."""
    count, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 7):
        total += term
        count = count + (u >= total).cast("int")
        term /= k
    return count
