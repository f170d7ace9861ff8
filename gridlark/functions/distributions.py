"""Distribution functions as column expressions: incomplete beta and gamma functions, and what tests of forecasts take from them.

They iterate (``aggregate`` over a sequence) and so are meant for tables of results, a row for each test, not for points.
Probabilities are good to about 1e-12; tails beyond that come out as 0. Arguments out of range and NULLs give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
# Coefficients of Stirling's series for the logarithm of the gamma function, in 1/x, 1/x^3 and so on.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_SHIFT = 10


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _share(x: Column) -> Column:
    """A probability without what rounding put outside 0 and 1; NULL stays NULL, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: keeps expressions, and their plans, small."""
    return F.transform(F.array(value), body)[0]


def _correction(x: Column) -> Column:
    """What Stirling's formula lacks, for x of at least 10."""

    def of(r: Column) -> Column:
        out = F.lit(0.0)
        for c in reversed(_STIRLING):
            out = out * r * r + c
        return out * r

    return let(1 / x, of)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""

    def of(v: Column) -> Column:
        product = v
        for k in range(1, _SHIFT):
            product = product * (v + k)
        stirling = let(F.when(v >= _SHIFT, v).otherwise(v + _SHIFT), lambda u: (u - 0.5) * F.log(u) - u + 0.5 * math.log(2 * math.pi) + _correction(u))
        return stirling - F.when(v >= _SHIFT, 0.0).otherwise(F.log(product))

    return let(x, of)


def log_beta(a: Column, b: Column) -> Column:
    """Logarithm of the beta function; the large terms of a large argument cancel before they are rounded."""

    def of(v: Column) -> Column:
        big, small = v["big"], v["small"]
        apart = log_gamma(big) - log_gamma(big + small)
        together = small - (big - 0.5) * F.log1p(small / big) - small * F.log(big + small) + _correction(big) - _correction(big + small)
        return log_gamma(small) + F.when(big >= _SHIFT, together).otherwise(apart)

    return let(F.struct(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")), of)


def _log_part(x: Column, rest: Column) -> Column:
    """Logarithm of x, given 1 - x as well."""
    return F.when(x < 0.5, F.log(x)).otherwise(F.log1p(-rest))


def _away_from_zero(x: Column) -> Column:
    return let(x, lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v))


def _lentz(steps: Column, first: Column, term: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Value of a continued fraction ``first + t1 / (... + t2 / ...)`` by Lentz's method; ``term(k)`` is numerator and denominator of step k."""

    def step(s: Column, k: Column) -> Column:
        top, bottom = term(k)

        def next_(t: Column) -> Column:
            d, c = 1 / _away_from_zero(t["bottom"] + t["top"] * s["d"]), _away_from_zero(t["bottom"] + t["top"] / s["c"])
            return let(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct((s["f"] * n["c"] * n["d"]).alias("f"), n["c"].alias("c"), n["d"].alias("d")))

        return let(F.struct(top.alias("top"), bottom.alias("bottom")), next_)

    start = let(first, lambda f: F.struct(f.alias("f"), f.alias("c"), F.lit(0.0).alias("d")))
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, step)["f"]


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function."""

    def term(k: Column) -> tuple[Column, Column]:
        def top(m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd)

        return let(F.floor(k / 2).cast("double"), top), F.lit(1.0)

    return 1 / _lentz(steps, F.lit(1.0), term)


def incomplete_beta(a: Column | float, b: Column | float, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function at x; ``rest`` is 1 - x, which the caller may know more exactly."""

    def of(v: Column) -> Column:
        a, b, x, rest = v["a"], v["b"], v["x"], v["rest"]
        front = F.exp(a * _log_part(x, rest) + b * _log_part(rest, x) - log_beta(a, b))
        # one fraction for both sides of the mean: the other side's is that of the mirrored function
        low = x < (a + 1) / (a + b + 2)
        side = F.struct(F.when(low, a).otherwise(b).alias("a"), F.when(low, b).otherwise(a).alias("b"), F.when(low, x).otherwise(rest).alias("x"))
        steps = F.least(F.lit(200_000.0), 120 + 12 * F.sqrt(F.least(a, b)))
        found = let(side, lambda s: front / s["a"] * _beta_fraction(s["a"], s["b"], s["x"], steps))
        inside = F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(_share(let(found, lambda f: F.when(low, f).otherwise(1 - f))))
        return F.when((a > 0) & (b > 0), inside)

    return let(F.struct(_d(a).alias("a"), _d(b).alias("b"), _d(x).alias("x"), _d(rest).alias("rest")), of)


def upper_gamma(a: Column | float, x: Column) -> Column:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""

    def of(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        steps = F.least(F.lit(200_000.0), 120 + 12 * F.sqrt(a))
        add = lambda s, k: let(s["t"] * x / (a + k), lambda t: F.struct((s["sum"] + t).alias("sum"), t.alias("t")))
        series = F.aggregate(F.sequence(F.lit(1), steps.cast("int")), F.struct((1 / a).alias("sum"), (1 / a).alias("t")), add)["sum"]
        fraction = 1 / _lentz(steps, x + 1 - a, lambda k: (-k * (k - a), x + 2 * k + 1 - a))
        inner = F.when(x < a + 1, 1 - front * series).otherwise(front * fraction)
        return F.when(a > 0, F.when(x <= 0, 1.0).otherwise(_share(inner)))

    return let(F.struct(_d(a).alias("a"), _d(x).alias("x")), of)


def chi2_sf(x: Column, df: Column | float) -> Column:
    """Probability that a chi-squared variable of ``df`` degrees is above x."""
    return upper_gamma(_d(df) / 2, x / 2)


def t_two_sided(t: Column, df: Column | float) -> Column:
    """Probability that Student's t of ``df`` degrees is further from 0 than t; beyond 1e5 degrees by the normal law at a transformed t."""

    def of(v: Column) -> Column:
        df, t2 = v["df"], v["t2"]
        shrunk = 1 - 1 / (4 * df)
        normal = upper_gamma(0.5, t2 * shrunk * shrunk / (1 + t2 / (2 * df)) / 2)
        return F.when(df > 1e5, normal).when(df > 0, incomplete_beta(df / 2, 0.5, df / (df + t2), t2 / (df + t2)))

    return let(F.struct(_d(df).alias("df"), (_d(t) * _d(t)).alias("t2")), of)


def one_sided(t: Column, two: Column) -> Column:
    """Probability of a value above t, from that of one further from 0, for a law that is even."""
    return F.when(t >= 0, two / 2).otherwise(1 - two / 2)


def t_sf(t: Column, df: Column | float) -> Column:
    """Probability that Student's t of ``df`` degrees is above t."""
    return let(t_two_sided(t, df), lambda two: one_sided(t, two))


def binomial_sf(k: Column, n: Column, p: Column | float) -> Column:
    """Probability of at least k successes in n trials of probability p."""
    k, n, p = _d(k), _d(n), _d(p)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(incomplete_beta(k, n - k + 1, p, 1 - p))


def normal_cdf_exact(z: Column) -> Column:
    """Standard normal distribution function by its series, to about 1e-15; further out than 9 it is 0 or 1."""

    def of(x: Column) -> Column:
        add = lambda s, k: let(s["t"] * x * x / (2 * k + 1), lambda t: F.struct((s["sum"] + t).alias("sum"), t.alias("t")))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("sum"), x.alias("t")), add)["sum"]
        inner = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total
        return F.when(x <= -9, 0.0).when(x >= 9, 1.0).when(x.isNotNull(), inner)

    return let(_d(z), of)


def studentised_range_sf(q: Column, k: Column | int) -> Column:
    """Probability that the range of k standard normal variables is above q.

    Quadrature with even steps over the place of the largest: the integrand and all its derivatives vanish at both
    ends, so that few nodes give full precision.
    """
    step, nodes = 0.2, 90

    def of(v: Column) -> Column:
        q, k = v["q"], v["k"]
        value = lambda z: F.exp(-z * z / 2) * F.pow(F.greatest(normal_cdf_exact(z) - normal_cdf_exact(z - q), F.lit(0.0)), k - 1)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(nodes)), F.lit(0.0), lambda s, i: s + let(step * i - 9.0, value))
        return F.when(q <= 0, 1.0).otherwise(_share(1 - k * total * step / math.sqrt(2 * math.pi)))

    return let(F.struct(_d(q).alias("q"), (k if isinstance(k, Column) else F.lit(k)).cast("double").alias("k")), of)
