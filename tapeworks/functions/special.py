"""Tails of test statistics as column expressions, for one row a test.

Series and continued fractions run a fixed number of terms, enough for full double precision where they are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 300
_TINY = 1e-300


def _sum(terms: int, start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda s, k: step(s, k.cast("double")))


def _fraction(terms: int, b0: Column, a, b) -> Column:
    """The continued fraction b0 + a(1) / (b(1) + a(2) / (b(2) + ...)) by Lentz' rule."""
    guard = lambda x: F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)
    start = F.struct(guard(b0).alias("f"), guard(b0).alias("c"), F.lit(0.0).alias("d"))

    def step(s, k):
        d = 1 / guard(b(k) + a(k) * s["d"])
        c = guard(b(k) + a(k) / s["c"])
        return F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    return _sum(terms, start, step)["f"]


def gamma_tail(a: float, x: Column) -> Column:
    """The regularised upper incomplete gamma function of a fixed order a > 0; 1 for x <= 0, NULL for NULL."""
    front = F.exp(F.lit(a) * F.log(x) - x - F.lit(math.lgamma(a)))
    series = _sum(TERMS, F.struct(F.lit(1.0 / a).alias("t"), F.lit(1.0 / a).alias("s")), lambda s, k: F.struct((s["t"] * x / (k + a)).alias("t"), (s["s"] + s["t"] * x / (k + a)).alias("s")))["s"]
    tail = front / _fraction(TERMS, x + (1 - a), lambda k: -k * (k - a), lambda k: x + (2 * k + 1 - a))
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(tail)


def chi_square_tail(x: Column, freedom: int) -> Column:
    """The chance that a chi-square variable exceeds x."""
    return gamma_tail(freedom / 2, x / 2)


def kolmogorov_tail(x: Column) -> Column:
    """The chance that the supremum of a Brownian bridge exceeds x."""
    below = F.sqrt(F.lit(2 * math.pi)) / x * _sum(20, F.lit(0.0), lambda s, k: s + F.exp(-((2 * k - 1) ** 2) * (math.pi**2) / (8 * x * x)))
    above = 2 * _sum(20, F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    return F.when(x <= 0, F.lit(1.0)).when(x < 1, 1 - below).otherwise(above)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series after a shift by ten."""
    y = x + 10
    shift = sum((F.log(x + k) for k in range(1, 10)), F.log(x))
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    # The coefficients of Stirling's series.
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return stirling + series - shift


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 and 0 <= x <= 1."""

    def small(a, b, x):
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a

        def term(k):
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd)

        return front / _fraction(TERMS, F.lit(1.0), term, lambda k: F.lit(1.0))

    inside = F.when(x < (a + 1) / (a + b + 2), small(a, b, x)).otherwise(1 - small(b, a, 1 - x))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """The chance that a Student variable is farther from zero than t; NULL without a degree of freedom."""
    df = F.when(freedom > 0, freedom.cast("double"))
    return beta_share(df / 2, F.lit(0.5), df / (df + t * t))
