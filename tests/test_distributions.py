"""Distribution functions against closed forms, exact sums and published table values."""

import math
from fractions import Fraction

import pytest

from gridlark.functions import distributions as ds
from pyspark.sql import functions as F


def values(spark, rows, *columns):
    df = spark.createDataFrame(rows, "a double, b double, x double")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_log_gamma_and_beta(spark):
    rows = [(a, b, 0.0) for a in (0.5, 1.0, 3.7, 9.99, 10.0, 40.5, 1e4) for b in (0.5, 2.0, 33.0)] + [(1e9, 0.5, 0.0)]
    for (a, b, _), (g, beta) in zip(rows, values(spark, rows, ds.log_gamma(F.col("a")), ds.log_beta(F.col("a"), F.col("b"))), strict=True):
        assert g == pytest.approx(math.lgamma(a), abs=1e-12, rel=1e-14)
        if a < 1e6:
            assert beta == pytest.approx(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b), abs=2e-10)
        else:  # gamma(a) / gamma(a + 1/2) by its expansion
            assert beta == pytest.approx(math.lgamma(b) - 0.5 * math.log(a) + 1 / (8 * a), abs=1e-13)


def test_student(spark):
    """One and two degrees have closed forms; large ones tend to the normal law; further values are from tables."""
    rows = [(t, df, 0.0) for t in (0.0, 0.3, 1.0, -1.7, 2.5, 40.0) for df in (1.0, 2.0, 4.0)]
    for (t, df, _), (two, above) in zip(rows, values(spark, rows, ds.t_two_sided(F.col("a"), F.col("b")), ds.t_sf(F.col("a"), F.col("b"))), strict=True):
        u = abs(t)
        want = {1.0: 1 - 2 / math.pi * math.atan(u), 2.0: 1 - u / math.sqrt(2 + u * u), 4.0: 1 - u / math.sqrt(4 + u * u) * (1 + 2 / (4 + u * u))}[df]
        assert two == pytest.approx(want, abs=1e-12) and above == pytest.approx(want / 2 if t >= 0 else 1 - want / 2, abs=1e-12)
    tables = [(2.228138852, 10.0, 0.05), (2.042272456, 30.0, 0.05), (2.750, 30.0, 0.0100)]
    for (_, _, p), (two,) in zip(tables, values(spark, tables, ds.t_two_sided(F.col("a"), F.col("b"))), strict=True):
        assert two == pytest.approx(p, abs=1e-5)
    big = [(t, 1e9, 0.0) for t in (0.1, 1.0, 1.7, 1.8, 3.0, 6.0)]
    for (t, _, _), (two,) in zip(big, values(spark, big, ds.t_two_sided(F.col("a"), F.col("b"))), strict=True):
        assert two == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-9)
    assert values(spark, [(1.0, 0.0, 0.0), (None, 3.0, 0.0), (2.0, None, 0.0)], ds.t_two_sided(F.col("a"), F.col("b"))) == [(None,)] * 3


def test_chi_squared(spark):
    """Even degrees are Poisson sums; 1 and 3 follow from the error function."""
    rows = [(x, df, 0.0) for x in (0.0, 0.01, 0.7, 5.99, 11.0, 12.1, 80.0, 900.0) for df in (1.0, 2.0, 3.0, 10.0, 200.0)]
    for (x, df, _), (p,) in zip(rows, values(spark, rows, ds.chi2_sf(F.col("a"), F.col("b"))), strict=True):
        if df % 2 == 0:
            want = math.fsum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(int(df) // 2)) if x else 1.0
        else:
            want = math.erfc(math.sqrt(x / 2)) + (math.sqrt(2 * x / math.pi) * math.exp(-x / 2) if df == 3 else 0.0)
        assert p == pytest.approx(want, abs=1e-12)


def test_binomial_tail(spark):
    rows = [(float(k), float(n), p) for n, ks in ((12, range(14)), (48, (0, 20, 29, 40, 48)), (1000, (480, 500, 530))) for k in ks for p in (0.5, 0.6)]
    for (k, n, p), (got,) in zip(rows, values(spark, rows, ds.binomial_sf(F.col("a"), F.col("b"), F.col("x"))), strict=True):
        q, n, k = Fraction(p).limit_denominator(10), int(n), int(k)
        assert got == pytest.approx(float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))), abs=1e-11)


def test_normal_and_range(spark):
    rows = [(z, 2.0, 0.0) for z in (-12.0, -8.0, -3.3, -0.1, 0.0, 1.0, 5.5, 8.9, 20.0)]
    for (z, _, _), (p, range_of_two) in zip(rows, values(spark, rows, ds.normal_cdf_exact(F.col("a")), ds.studentised_range_sf(F.col("a"), 2)), strict=True):
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-15)
        assert range_of_two == pytest.approx(min(1.0, math.erfc(z / 2)) if z > 0 else 1.0, abs=1e-12)
    # upper 5 % points of the range for an infinite number of degrees, as tables have them
    table = [(2.771808, 2.0, 0.0), (3.314493, 3.0, 0.0), (3.633160, 4.0, 0.0), (3.857656, 5.0, 0.0), (4.474124, 10.0, 0.0)]
    for (p,) in values(spark, table, ds.studentised_range_sf(F.col("a"), F.col("b"))):
        assert p == pytest.approx(0.05, abs=2e-7)
