"""Mean-variance books under beta, sector, volatility, turnover, gross and neutrality limits.

Spark selects a book's names, joins their look-back returns and attributes, and splits the books; a
task solves one book at a time, whose size is the book's number of names. The limits are
convex sets of linear images of the weights; an alternating-direction splitting projects onto each set in turn. An empty
intersection is told by a certificate: multipliers that cancel and whose support values add up below zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.solve import KEYS, _covariance, _matrix

SOLVED, EMPTY, OPEN = "solved", "empty", "open"


@dataclass(frozen=True)
class Limits:
    """``None`` switches a limit off. Volatility is annual; turnover is ½ Σ|Δw| against ``prior_weight``; sector weights
    and neutral exposures (columns, standardised within the book) are bounded on both sides."""

    low: float = 0.0
    high: float = 0.25
    budget: float = 1.0
    beta: tuple[float, float] | None = None
    sector: float | None = None
    volatility: float | None = None
    turnover: float | None = None
    gross: float | None = None
    neutral: tuple[str, ...] = field(default=())
    neutral_band: float = 0.5


@dataclass(frozen=True)
class Block:
    """``image @ w`` has to lie in a set, given by its projection and its support function."""

    image: np.ndarray
    project: Callable[[np.ndarray], np.ndarray]
    support: Callable[[np.ndarray], float]


def band(image: np.ndarray, low, high) -> Block:
    low, high = np.broadcast_to(low, len(image)).astype(float), np.broadcast_to(high, len(image)).astype(float)
    return Block(image, lambda z: np.clip(z, low, high), lambda y: float(np.where(y > 0, high * y, low * y).sum()))


def ball(image: np.ndarray, radius: float) -> Block:
    def project(z: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(z)
        return z if size <= radius else z * (radius / size)

    return Block(image, project, lambda y: radius * float(np.linalg.norm(y)))


def _to_absolute_sum(z: np.ndarray, radius: float) -> np.ndarray:
    """Nearest vector with Σ|x| ≤ radius: every entry shrinks by the same amount, down to 0."""
    sizes = np.abs(z)
    if sizes.sum() <= radius:
        return z
    down = np.sort(sizes)[::-1]
    cut = (np.cumsum(down) - radius) / np.arange(1, len(z) + 1)
    return np.sign(z) * np.maximum(sizes - cut[np.flatnonzero(down >= cut)[-1]], 0.0)


def absolute_sum(image: np.ndarray, centre: np.ndarray, radius: float) -> Block:
    return Block(image, lambda z: centre + _to_absolute_sum(z - centre, radius), lambda y: float(y @ centre) + radius * float(np.abs(y).max(initial=0.0)))


def split_solve(quadratic: np.ndarray, linear: np.ndarray, blocks: Sequence[Block], steps: int = 6000, exact: float = 1e-8) -> tuple[np.ndarray, str]:
    """Minimise ½ wᵀQw + qᵀw subject to all blocks; (weights, status)."""
    image = np.vstack([b.image for b in blocks])
    edges = np.cumsum([0, *[len(b.image) for b in blocks]])
    pieces = [slice(a, z) for a, z in zip(edges, edges[1:])]
    n = len(linear)
    scale = max(np.trace(quadratic) / n, np.abs(linear).max(), 1e-12)  # steps suit an objective of size one
    quadratic, linear = quadratic / scale, linear / scale
    w, z, y = np.zeros(n), np.zeros(len(image)), np.zeros(len(image))
    rho, small, over = 1.0, 1e-6, 1.6

    def inverse() -> np.ndarray:
        return np.linalg.inv(quadratic + small * np.eye(n) + rho * image.T @ image)

    solve = inverse()
    for step in range(1, steps + 1):
        w = solve @ (small * w - linear + image.T @ (rho * z - y))
        mixed = over * (image @ w) + (1 - over) * z
        aim = mixed + y / rho
        z = np.concatenate([b.project(aim[s]) for b, s in zip(blocks, pieces)])
        moved = rho * (mixed - z)
        y = y + moved
        if step % 25:
            continue
        apart = np.abs(image @ w - z).max()
        pull = np.abs(quadratic @ w + linear + image.T @ y).max()
        if apart < exact and pull < 10 * exact:
            return w, SOLVED
        size = np.abs(moved).max()
        if size > exact and np.abs(image.T @ moved).max() < 1e-6 * size and sum(b.support(moved[s]) for b, s in zip(blocks, pieces)) < -1e-6 * size:
            return w, EMPTY
        ratio = np.sqrt((apart + 1e-15) / (pull + 1e-15))
        if step % 100 == 0 and not 0.2 < ratio < 5:
            rho = float(np.clip(rho * ratio, 1e-4, 1e6))
            solve = inverse()
    return w, SOLVED if apart < 1e-6 else OPEN


def blocks_of(limits: Limits, cov: np.ndarray, beta: np.ndarray, sectors: np.ndarray, exposures: np.ndarray, prior: np.ndarray, dropped: float) -> list[Block]:
    """One block per limit. ``dropped`` is prior weight on names that are no longer in the book."""
    n = len(cov)
    ones, each = np.ones((1, n)), np.eye(n)
    out = [band(ones, limits.budget, limits.budget), band(each, limits.low, limits.high)]
    if limits.beta is not None:
        out.append(band(beta[None, :], *limits.beta))
    if limits.sector is not None:
        out.append(band(np.array([sectors == s for s in np.unique(sectors)], float), -limits.sector, limits.sector))
    if len(exposures):
        out.append(band(exposures, -limits.neutral_band, limits.neutral_band))
    if limits.volatility is not None:
        out.append(ball(np.linalg.cholesky(cov + 1e-12 * np.trace(cov) * each).T / limits.volatility, 1.0))
    if limits.gross is not None:
        out.append(absolute_sum(each, np.zeros(n), limits.gross))
    if limits.turnover is not None:
        out.append(absolute_sum(each, prior, 2 * limits.turnover - dropped))
    return out


def standardised(values: np.ndarray) -> np.ndarray:
    return (values - values.mean()) / (values.std() + 1e-8)


def limited_weights(samples: DataFrame, limits: Limits, risk_aversion: float = 2.0, ridge: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weights of each book that maximise α·w − λ/2·wᵀΣw − ridge·|w|² within the limits, α being the standardised score.

    ``samples`` has one row per name and look-back date (…, ticker, lag_date, ret, score) with the attributes
    that the limits need: beta, sector, prior_weight, dropped_weight and the neutral columns, constant per name.
    Returns a row per name with ``status``: ``solved``; ``empty`` if no weights meet all limits, proven by a certificate (weights are null
    then); ``open`` if the steps ran out. ``book_*`` are the measured quantities of the whole book.
    """
    keys = list(keys)
    wanted = [c for c in ("beta", "sector", "prior_weight", "dropped_weight", *limits.neutral) if c in samples.columns]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, score = _matrix(pdf)
        about = pdf.drop_duplicates("ticker").set_index("ticker").loc[names]
        n = len(names)

        def column(name: str, default: float) -> np.ndarray:
            return about[name].fillna(default).to_numpy(float) if name in about else np.full(n, default)

        cov, beta, prior = _covariance(x), column("beta", 1.0), column("prior_weight", 0.0)
        dropped = float(column("dropped_weight", 0.0)[0])
        sectors = about["sector"].fillna("Unknown").to_numpy(str) if "sector" in about else np.full(n, "Unknown")
        exposures = np.array([standardised(column(c, 0.0)) for c in limits.neutral])
        if limits.turnover is not None and dropped > 2 * limits.turnover:
            w, status = np.full(n, np.nan), EMPTY
        else:
            blocks = blocks_of(limits, cov, beta, sectors, exposures, prior, dropped)
            w, status = split_solve(risk_aversion * cov + 2 * ridge * np.eye(n), -standardised(score), blocks)
        if status == EMPTY:
            w = np.full(n, np.nan)
        return pd.DataFrame({
            **{k: [pdf[k].iloc[0]] * n for k in keys}, "ticker": names, "weight": w, "status": status,
            "book_beta": beta @ w, "book_volatility": np.sqrt(max(w @ cov @ w, 0.0)) if status != EMPTY else np.nan,
            "book_turnover": (np.abs(w - prior).sum() + dropped) / 2, "book_gross": np.abs(w).sum(), "sector": sectors,
            "book_exposure": float(np.abs(exposures @ w).max()) if len(exposures) else 0.0,
        })

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name in keys)
    numbers = ", ".join(f"{c} double" for c in ("book_beta", "book_volatility", "book_turnover", "book_gross"))
    ordered = samples.select(*[c for c in samples.columns if c in keys], "ticker", "lag_date", "ret", "score", *wanted)
    return ordered.groupBy(*keys).applyInPandas(solve, f"{schema}, ticker string, weight double, status string, {numbers}, sector string, book_exposure double")


def violations(books: DataFrame, limits: Limits, keys: Sequence[str] = KEYS, slack: float = 1e-5) -> DataFrame:
    """Per book the number of broken limits, counted from its weights, and whether its status is unproven."""
    keys = list(keys)
    w = F.col("weight")
    by_sector = books.where("status <> 'empty'").groupBy(*keys, "sector").agg(F.abs(F.sum("weight")).alias("_s")).groupBy(*keys).agg(F.max("_s").alias("_sector"))
    measured = [F.first(c).alias(c) for c in ("book_beta", "book_volatility", "book_turnover", "book_gross", "book_exposure", "status")]
    book = books.groupBy(*keys).agg(F.sum(w).alias("_total"), F.min(w).alias("_low"), F.max(w).alias("_high"), *measured).join(by_sector, keys, "left")
    broken = [F.abs(F.col("_total") - limits.budget) > slack, F.col("_low") < limits.low - slack, F.col("_high") > limits.high + slack]
    if limits.beta is not None:
        broken.append(~F.col("book_beta").between(limits.beta[0] - slack, limits.beta[1] + slack))
    for bound, name in ((limits.sector, "_sector"), (limits.volatility, "book_volatility"), (limits.turnover, "book_turnover"), (limits.gross, "book_gross"), (limits.neutral_band if limits.neutral else None, "book_exposure")):
        if bound is not None:
            broken.append(F.col(name) > bound + slack)
    count = sum((F.coalesce(b, F.lit(False)).cast("int") for b in broken), F.lit(0))
    return book.select(*keys, F.when(F.col("status") == EMPTY, 0).otherwise(count).alias("violations"), (F.col("status") == OPEN).cast("int").alias("unproven"), "status")
