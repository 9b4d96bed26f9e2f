"""The normal and t distributions as column expressions (Spark has no erf and no probit)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational fit of the complementary error function
# (fractional error below 1.2e-7 everywhere), lowest power first.
ERFC_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)

# Published rational fit of the inverse normal distribution
# (relative error below 1.15e-9), highest power first, and its split point.
PROBIT_CENTRE_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PROBIT_CENTRE_BOTTOM = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
PROBIT_TAIL_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PROBIT_TAIL_BOTTOM = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
PROBIT_SPLIT = 0.02425

# Asymptotic series of gamma(b + 1/2) / (gamma(b) sqrt(b)) in 1 / b, highest
# power first.
GAMMA_STEP = (869.0 / 4194304, -399.0 / 262144, -21.0 / 32768, 5.0 / 1024, 1.0 / 128, -1.0 / 8, 1.0)


def polynomial(x: Column, highest_first: tuple[float, ...]) -> Column:
    total = F.lit(highest_first[0])
    for factor in highest_first[1:]:
        total = total * x + F.lit(factor)
    return total


def two_sided_tail(z: Column) -> Column:
    """Probability that a standard normal is farther from zero than `z`."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    return t * F.exp(polynomial(t, tuple(reversed(ERFC_FIT))) - x * x)


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1."""
    centred = p - 0.5
    squared = centred * centred
    centre = (
        polynomial(squared, PROBIT_CENTRE_TOP) * centred / polynomial(squared, PROBIT_CENTRE_BOTTOM)
    )
    depth = F.sqrt(F.log(F.least(p, F.lit(1.0) - p)) * -2.0)
    tail = polynomial(depth, PROBIT_TAIL_TOP) / polynomial(depth, PROBIT_TAIL_BOTTOM)
    return (
        F.when(p < PROBIT_SPLIT, tail)
        .when(p > 1.0 - PROBIT_SPLIT, -tail)
        .otherwise(centre)
    )


def normal_density(x: Column, mean: Column, deviation: Column) -> Column:
    z = F.try_divide(x - mean, deviation)
    return F.try_divide(F.exp(z * z * -0.5), deviation * F.lit(math.sqrt(2.0 * math.pi)))


def _gamma_step(b: Column, shift: int = 24) -> Column:
    """gamma(b + 1/2) / gamma(b): the asymptotic series at b + shift, brought down by steps."""
    up = b + shift
    ratio = F.sqrt(up) * polynomial(F.lit(1.0) / up, GAMMA_STEP)
    for k in range(shift):
        ratio = ratio * (b + k) / (b + k + 0.5)
    return ratio


def _power_sum(a: Column, c: Column, x: Column, terms: int = 320) -> Column:
    """1 + a/c x + a(a+1)/(c(c+1)) x^2 + ..., all terms positive."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (a + k) / (c + k) * x
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: acc["total"])


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n rows, from its t statistic.

    With b half the degrees of freedom it is the regularised incomplete beta function of
    (b, 1/2) at 1 - rho^2, here as a series of positive terms of fixed depth: directly where
    rho^2 is above one half, else as one minus the function of (1/2, b) at rho^2. Where the
    series would need more terms the value is below 1e-17 and given as 0. A perfect
    correlation gives 0, fewer than three rows give no value.
    """
    b = (n - F.lit(2)).cast("double") / 2
    y = rho * rho
    x = F.lit(1.0) - y
    front = F.exp(b * F.log(x)) * F.sqrt(y) * _gamma_step(b) / F.lit(math.sqrt(math.pi))
    upper = front / b * _power_sum(b + 0.5, b + 1.0, x)
    lower = F.lit(1.0) - front * 2.0 * _power_sum(b + 0.5, F.lit(1.5), y)
    return (
        F.when((n <= 2) | rho.isNull(), F.lit(None).cast("double"))
        .when(F.abs(rho) >= 1.0, F.lit(0.0))
        .when(-b * F.log(x) > 40.0, F.lit(0.0))
        .when(y > 0.5, upper)
        .otherwise(F.greatest(lower, F.lit(0.0)))
    )
