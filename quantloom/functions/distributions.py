"""P-values. The normal tail comes from the error function, Student's t from the incomplete beta
function; both as plain functions and as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta, evaluated from the tail."""
    value = 0.0
    for m in range(300, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = odd / (1.0 + even / (1.0 + value))
    return 1.0 / (1.0 + value)


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x))
    return scale * _beta_fraction(a, b, x) / a


def student_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) with df degrees of freedom."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


# -- the same as column expressions: no Python on the executors --------------------------


#: Steps of the continued fractions and of the error function's series; all are past convergence for double precision.
FRACTION_STEPS, TAIL_STEPS, SERIES_STEPS = 300, 120, 80
#: Series of the logarithm of the gamma function in 1/z, 1/z³, …, used from z = 10 on (fixed values).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
_SHIFT = 10


def log_gamma(x: Column) -> Column:
    z = x + _SHIFT
    tail = sum((F.lit(c) / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    shifted = sum((F.log(x + k) for k in range(_SHIFT)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - shifted


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of ``incomplete_beta``, folded from its last term."""

    def term(value: Column, m: Column) -> Column:
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return odd / (1 + even / (1 + value))

    steps = F.transform(F.sequence(F.lit(FRACTION_STEPS), F.lit(1), F.lit(-1)), lambda m: m.cast("double"))
    return 1 / (1 + F.aggregate(steps, F.lit(0.0), term))


def beta_column(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; the side on which the fraction converges fast is taken."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, u = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    # at the ends the logarithms have no value; the result is known there
    inside = (x > 0) & (x < 1)
    safe = F.when(inside, u).otherwise(0.5)
    scale = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(safe) + q * F.log(1 - safe))
    part = scale * _fraction(p, q, safe) / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(turned, 1 - part).otherwise(part)


def p_normal(z: Column) -> Column:
    """P(Z > z): a series of positive terms up to |z| = 3, a continued fraction beyond."""
    size = F.abs(z)
    density = F.exp(-size * size / 2) / math.sqrt(2 * math.pi)
    start = F.struct(size.alias("term"), size.alias("sum"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * size * size / (2 * k + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    steps = F.transform(F.sequence(F.lit(1), F.lit(SERIES_STEPS)), lambda k: k.cast("double"))
    near = 0.5 - density * F.aggregate(steps, start, add, lambda s: s["sum"])
    down = F.transform(F.sequence(F.lit(TAIL_STEPS), F.lit(1), F.lit(-1)), lambda k: k.cast("double"))
    far = density / F.aggregate(down, size, lambda value, k: size + k / value)
    tail = F.when(size <= 3, near).otherwise(far)
    return F.when(z < 0, 1 - tail).otherwise(tail)


def p_student(t: Column, df: Column) -> Column:
    """Two-sided Student p-value; null for a null statistic or no degree of freedom."""
    d = df.cast("double")
    return F.when(t.isNotNull() & (df > 0), beta_column(d / 2, F.lit(0.5), d / (d + t * t)))
