"""Column helpers shared by all operators. NULL in gives NULL out unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ANNUAL_BARS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def positive_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL unless the denominator is above zero."""
    return F.when(col(den) > 0, F.try_divide(col(num).cast("double"), col(den).cast("double")))


def change(now: str | Column, past: str | Column) -> Column:
    """Relative change, NULL unless the past value is above zero."""
    return F.when(col(past) > 0, (col(now) - col(past)) / col(past))


def clip(c: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Clip that keeps NULL (greatest and least alone would drop it)."""
    value = col(c)
    bounded = value
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(float(high)))
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(float(low)))
    return F.when(value.isNotNull(), bounded)


def no_nan(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over pairs; NULL where a side does not vary (the built-in
    raises a division error there)."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def nonzero(c: str | Column) -> Column:
    """Zero counts as missing."""
    return F.when(col(c) != 0, col(c))


def steps(value: str | Column, rungs: Sequence[tuple[str, float, float]], otherwise: float | None = 0.0) -> Column:
    """Score ladder: rungs are (comparison, threshold, points), first match wins.

    Comparisons: ``>``, ``>=``, ``<``, ``<=``. A NULL value gives NULL.
    """
    v = col(value)
    tests = {
        ">": lambda t: v > t,
        ">=": lambda t: v >= t,
        "<": lambda t: v < t,
        "<=": lambda t: v <= t,
    }
    chain = F.when(v.isNull(), F.lit(None).cast("double"))
    for op, threshold, points in rungs:
        chain = chain.when(tests[op](F.lit(float(threshold))), F.lit(float(points)))
    return chain if otherwise is None else chain.otherwise(F.lit(float(otherwise)))


def above(value: str | Column, pairs: Sequence[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Descending ladder: first threshold the value exceeds wins."""
    return steps(value, [(">", t, p) for t, p in pairs], otherwise)


def below(value: str | Column, pairs: Sequence[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Ascending ladder: first threshold the value stays under wins."""
    return steps(value, [("<", t, p) for t, p in pairs], otherwise)


def mean_present(items: Sequence[Column], default: float = 50.0) -> Column:
    """Mean of the non-NULL items, the default when there is none."""
    total = sum((F.coalesce(i, F.lit(0.0)) for i in items), F.lit(0.0))
    count = sum((i.isNotNull().cast("int") for i in items), F.lit(0))
    return F.coalesce(F.try_divide(total, count.cast("double")), F.lit(float(default)))


def by_bar(*keys: str, order: str = "date") -> WindowSpec:
    """Time axis of one series. A series has at most one row per trading day, so its
    window group is bounded by the calendar however large the panel grows."""
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(order)


def trailing(n: int, *keys: str, order: str = "date") -> WindowSpec:
    """The last n rows up to and including the current one."""
    return by_bar(*keys, order=order).rowsBetween(-(n - 1), 0)


def previous(n: int, *keys: str, order: str = "date") -> WindowSpec:
    """The n rows before the current one."""
    return by_bar(*keys, order=order).rowsBetween(-n, -1)


def upto(*keys: str, order: str = "date") -> WindowSpec:
    return by_bar(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, frame_count: Column, n: int) -> Column:
    """Keep a rolling value only where its frame holds n observations."""
    return F.when(frame_count >= n, value)
