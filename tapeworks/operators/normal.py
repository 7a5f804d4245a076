"""The normal distribution as column expressions, and what rests on it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Chebyshev fit of the complementary error function, to 1.2e-7 (Numerical Recipes).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: A rational fit of the upper quantile, to 4.5e-4 (Abramowitz and Stegun 26.2.23).
TOP, BOTTOM = [2.515517, 0.802853, 0.010328], [1.0, 1.432788, 0.189269, 0.001308]


def _polynomial(x: Column, c: list[float]) -> Column:
    return reduce(lambda a, k: a * x + F.lit(k), reversed(c[:-1]), F.lit(c[-1]))


def normal_cdf(x: Column) -> Column:
    """To an absolute error of 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = t * F.exp(-z * z + _polynomial(t, ERFC)) / 2
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normal_quantile(p: Column) -> Column:
    """A rational start, then two steps of Newton's method on normal_cdf(); null outside (0, 1)."""

    def start(q: Column) -> Column:
        return _let(F.sqrt(-2 * F.ln(F.least(q, 1 - q))), lambda t: (t - _polynomial(t, TOP) / _polynomial(t, BOTTOM)) * F.when(q < 0.5, -1).otherwise(1))

    def better(x: Column, q: Column) -> Column:
        return x - (normal_cdf(x) - q) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)

    return F.when((p > 0) & (p < 1), _let(_let(start(p), lambda x: better(x, p)), lambda x: better(x, p)))


def deflated_sharpe(sharpe: Column, benchmark: Column, n: Column, skewness: Column, excess: Column) -> Column:
    """Probability that the Sharpe ratio of n marks beats the benchmark, given its moments; null where they leave no variance, or below two marks."""
    variance = 1 - skewness * sharpe + (excess + 2) / 4 * sharpe * sharpe
    return F.when((variance > 0) & (n > 1), normal_cdf((sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(variance)))


def stop_hit_probability(sigma: Column, days: int, stop: float = 0.2, drift: float = 0.0) -> Column:
    """Chance that a walk of annual volatility sigma and drift falls by stop within days, by the reflection principle; 0 without volatility."""
    b, t = -math.log(1 - stop), days / 365
    s = sigma * math.sqrt(t)
    p = normal_cdf((-b - drift * t) / s) + F.exp(-2 * drift * b / (sigma * sigma)) * normal_cdf((-b + drift * t) / s)
    return F.when(sigma > 0, p).when(sigma <= 0, 0.0)
