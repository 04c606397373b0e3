"""Weights that need a small linear-algebra solve per (strategy, date).

Spark selects the candidates, joins their look-back returns and splits the groups; a
group is the chosen names of one book on one date (top-n by construction) times the
look-back, so a task sees a bounded matrix. NumPy does the solve inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar

KEYS = ("strategy", "date")


def lookback_returns(picks: DataFrame, returns: DataFrame, bars: int = 252, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each pick with its returns of the ``bars`` bars up to the pick date, as
    (…, ticker, lag_date, ret). The bar at each distinct (ticker, date) is found by an as-of
    fill, then the window is addressed by bar number."""
    from quantloom.operators.asof import asof_backward

    numbered = returns.where("ret IS NOT NULL").select("ticker", F.col("date").alias("bar_date"), "ret", F.row_number().over(by_bar()).alias("bar"))
    bars_at = numbered.select("ticker", F.col("bar_date").alias("date"), "bar")
    found = asof_backward(picks.select("ticker", "date").distinct(), bars_at, ["bar"]).where("bar IS NOT NULL")
    at = picks.join(found.select("ticker", "date", "bar"), ["ticker", "date"]).withColumn("bar", F.explode(F.sequence(F.greatest(F.col("bar") - (bars - 1), F.lit(1)), F.col("bar"))))
    return at.join(numbered.select("ticker", "bar", F.col("bar_date").alias("lag_date"), "ret"), ["ticker", "bar"]).drop("bar")


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    wide = pdf.pivot_table(index="lag_date", columns="ticker", values="ret", aggfunc="first").fillna(0.0)
    first = pdf.drop_duplicates("ticker").set_index("ticker").loc[list(wide.columns)]
    return list(wide.columns), wide.to_numpy(dtype=float), first["score"].to_numpy(dtype=float)


def _covariance(x: np.ndarray, annual: float = 252.0, shrinkage: float = 0.3) -> np.ndarray:
    cov = np.atleast_2d(np.cov(x, rowvar=False)) * annual if len(x) > 1 else np.eye(x.shape[1])
    return (1 - shrinkage) * cov + shrinkage * np.eye(len(cov)) * np.trace(cov) / len(cov)


def project_capped_simplex(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """Nearest vector with low ≤ w ≤ high and Σ w = 1, by bisection on the shift. Bounds
    that no such vector can meet (see ``feasible``) are widened to 1/n."""
    n = len(w)
    low, high = min(low, 1.0 / n), max(high, 1.0 / n)
    a, b = w.min() - high - 1.0, w.max() - low + 1.0
    for _ in range(100):
        mid = (a + b) / 2
        if np.clip(w - mid, low, high).sum() > 1.0:
            a = mid
        else:
            b = mid
    return np.clip(w - (a + b) / 2, low, high)


def feasible(n: int, low: float, high: float) -> bool:
    """Whether n weights within the bounds can sum to 1."""
    return n * low <= 1.0 <= n * high


def kelly_weights(samples: DataFrame, max_position: float = 0.25, shrinkage: float = 0.3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Σ⁻¹μ per group, floored at 0, capped, scaled to 1; equal weights if nothing is left."""
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, mu = _matrix(pdf)
        raw = np.clip(np.linalg.solve(_covariance(x, shrinkage=shrinkage), mu), 0.0, max_position)
        w = raw / raw.sum() if raw.sum() > 0 else np.full(len(names), 1.0 / len(names))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(names) for k in keys}, "ticker": names, "weight": w})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name in keys)
    ordered = samples.select(*[c for c in samples.columns if c in keys], "ticker", "lag_date", "ret", "score")
    return ordered.groupBy(*keys).applyInPandas(solve, f"{schema}, ticker string, weight double")


METHODS = ("max_sharpe", "min_variance", "risk_parity", "mean_variance")


def constrained_weights(
    samples: DataFrame,
    method: str = "mean_variance",
    low: float = 0.0,
    high: float = 0.25,
    risk_aversion: float = 2.0,
    rf: float = 0.04,
    steps: int = 400,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Long-only weights with box bounds by projected gradient per group.

    ``max_sharpe`` and ``mean_variance`` use the score as expected return; ``risk_parity``
    equalises each name's share of the variance. ``bounds_met`` is false where a group has too
    few or too many names for the bounds, which are then widened to 1/n.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, mu = _matrix(pdf)
        cov = _covariance(x)
        n = len(names)
        scale = np.trace(cov) / n
        # one scale for return and risk, so that the trade-off between them is as given
        cov, w = cov / scale, np.full(n, 1.0 / n)
        gain = mu / scale

        def objective(v: np.ndarray) -> float:
            var = v @ cov @ v
            if method == "min_variance":
                return var
            if method == "mean_variance":
                return risk_aversion / 2 * var - v @ gain
            if method == "max_sharpe":
                return -(v @ mu - rf) / np.sqrt(var)
            part = v * (cov @ v) / var
            return float(((part - 1.0 / n) ** 2).sum())

        def gradient(v: np.ndarray) -> np.ndarray:
            cv = cov @ v
            var = v @ cv
            if method == "min_variance":
                return 2 * cv
            if method == "mean_variance":
                return risk_aversion * cv - gain
            if method == "max_sharpe":
                return -(mu / np.sqrt(var) - (v @ mu - rf) * cv / var**1.5)
            part = v * cv / var - 1.0 / n
            jac = (np.diag(cv) + v[:, None] * cov) / var - np.outer(v * cv, 2 * cv) / var**2
            return 2 * jac.T @ part

        rate, best = 0.5, objective(w)
        for _ in range(steps):
            trial = project_capped_simplex(w - rate * gradient(w), low, high)
            value = objective(trial)
            if value < best - 1e-12:
                w, best, rate = trial, value, rate * 1.2
            else:
                rate *= 0.5
                if rate < 1e-8:
                    break
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in keys}, "ticker": names, "weight": project_capped_simplex(w, low, high), "bounds_met": feasible(n, low, high)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name in keys)
    ordered = samples.select(*[c for c in samples.columns if c in keys], "ticker", "lag_date", "ret", "score")
    return ordered.groupBy(*keys).applyInPandas(solve, f"{schema}, ticker string, weight double, bounds_met boolean")


def _move(target: pd.Series, held: pd.Series, step: float, dust: float) -> pd.Series:
    """One turnover-limited move from the held weights; longs then sum to 1 and shorts to -1."""
    names = held.index.union(target.index)
    was = held.reindex(names, fill_value=0.0)
    moved = was + (target.reindex(names, fill_value=0.0) - was).clip(-step, step)
    moved = moved[moved.abs() > dust]
    long, short = moved[moved > 0].sum(), -moved[moved < 0].sum()
    return moved.where(moved <= 0, moved / (long or 1.0)).where(moved >= 0, moved / (short or 1.0))


def turnover_path(targets: DataFrame, step: float = 0.05, dust: float = 0.001, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Turnover-limited weights over all dates: each date moves from the weights actually
    held before it.

    A fold in one plan: a strategy's rows pass a task in date order and only the weights held
    last and the rows of the date being read are in memory, so a path of any length needs one cross-section. The
    rescaled sides tie every name of a date to the one before, so a strategy's dates cannot be split; strategies run in parallel.
    """
    keys = list(keys)
    width = len(keys)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, day, read, held = None, None, [], None

        def closed() -> pd.DataFrame:
            nonlocal held
            target = pd.concat(read).set_index("ticker")["weight"]
            held = target if held is None else _move(target, held, step, dust)
            head = {k: pd.Series([v] * len(held), dtype=object) for k, v in zip(keys, book)}
            return pd.DataFrame({**head, "ticker": list(held.index), "weight": held.to_numpy(), "date": [day] * len(held)})

        for frame in frames:
            for group, rows in frame.groupby([*keys, "date"], sort=False, dropna=False):
                group = tuple(None if pd.isna(v) else v for v in group)
                if group != (None if book is None else (*book, day)):
                    if read:
                        yield closed()
                    if book != group[:width]:
                        held = None
                    book, day, read = group[:width], group[width], []
                read.append(rows[["ticker", "weight"]])
        if read:
            yield closed()

    rows = targets.select(*keys, "ticker", "weight", "date").repartition(*keys).sortWithinPartitions(*keys, "date")
    return rows.mapInPandas(fold, rows.schema)
