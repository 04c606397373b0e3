"""Limited books: projections, objective against random feasible books, certificates of empty sets."""

import numpy as np
import pytest

from quantloom.operators import limited
from quantloom.operators.limited import EMPTY, SOLVED, Limits, blocks_of, split_solve, standardised


def book(seed: int, n: int = 8):
    rng = np.random.default_rng(seed)
    cov = np.cov((rng.normal(size=(126, n)) * rng.uniform(0.005, 0.03, n)).T) * 252
    return rng, 0.7 * cov + 0.3 * np.eye(n) * np.trace(cov) / n, rng.normal(1, 0.4, n), np.array(["a", "b"])[np.arange(n) % 2], rng.dirichlet(np.ones(n))


def holds(blocks, w, slack=1e-6):
    return all(np.abs(b.image @ w - b.project(b.image @ w)).max() < slack for b in blocks)


@pytest.mark.parametrize("seed", range(6))
def test_not_above_the_best_random_feasible_book(seed):
    rng, cov, beta, sectors, prior = book(seed)
    limits = Limits(high=0.4, beta=(0.6, 1.4), sector=0.7, volatility=0.6, turnover=0.7)
    blocks = blocks_of(limits, cov, beta, sectors, np.empty((0, 8)), prior, 0.0)
    q, a = 2 * cov + 0.02 * np.eye(8), -standardised(rng.normal(size=8))
    w, status = split_solve(q, a, blocks)
    assert status == SOLVED and holds(blocks, w)
    found = [v for v in rng.dirichlet(np.ones(8), 4000) if holds(blocks, v)]
    assert len(found) > 20
    assert w @ q @ w / 2 + a @ w <= min(v @ q @ v / 2 + a @ v for v in found) + 1e-7


@pytest.mark.parametrize("limits", [
    Limits(high=0.05), Limits(high=0.4, beta=(5.0, 6.0)), Limits(high=0.4, sector=0.3), Limits(high=0.4, volatility=0.001), Limits(high=0.4, turnover=0.0, beta=(-9.0, 0.0)),
])
def test_an_empty_set_is_proven(limits):
    _, cov, beta, sectors, prior = book(1)
    blocks = blocks_of(limits, cov, beta, sectors, np.empty((0, 8)), prior, 0.0)
    assert split_solve(np.eye(8), np.zeros(8), blocks)[1] == EMPTY


def test_absolute_sum_projection_is_nearest():
    rng = np.random.default_rng(4)
    for _ in range(50):
        z = rng.normal(size=6)
        x = limited._to_absolute_sum(z, 1.0)
        assert np.abs(x).sum() <= 1 + 1e-12
        others = rng.dirichlet(np.ones(6), 300) * rng.choice([-1, 1], (300, 6))
        assert ((x - z) ** 2).sum() <= ((others - z) ** 2).sum(axis=1).min() + 1e-12


def test_books_as_rows(spark):
    rng = np.random.default_rng(7)
    rows = [("s", d, f"T{i}", lag, float(rng.normal() * 0.01), float(i), 1.0 + 0.1 * i, "xy"[i % 2], 0.2 if i < 5 else None, 0.0) for d in (1, 2) for i in range(8) for lag in range(40)]
    samples = spark.createDataFrame(rows, "strategy string, date int, ticker string, lag_date int, ret double, score double, beta double, sector string, prior_weight double, dropped_weight double")
    limits = Limits(high=0.3, beta=(1.0, 1.3), sector=0.6, turnover=0.4)
    out = limited.limited_weights(samples, limits)
    assert {r.status for r in out.select("status").distinct().collect()} == {SOLVED}
    assert [(r.violations, r.unproven) for r in limited.violations(out, limits).collect()] == [(0, 0)] * 2
    tighter = Limits(high=0.3, beta=(1.0, 1.05), sector=0.6, turnover=0.4)
    assert all(r.violations >= 1 for r in limited.violations(out, tighter).collect())
    none = limited.limited_weights(samples, Limits(high=0.3, beta=(9.0, 9.5)))
    assert {(r.status, r.weight != r.weight or r.weight is None) for r in none.collect()} == {(EMPTY, True)}


def test_turnover_path_equals_step_by_step(spark):
    import random

    from quantloom.operators import solve, weights

    rng = random.Random(11)
    rows = [(s, f"2020-0{d}-01", f"T{i}", rng.uniform(-0.2, 0.2)) for s in ("a", "b", None) for d in range(1, 7 if s else 3) for i in range(25) if rng.random() < 0.7]
    targets = spark.createDataFrame(rows, "strategy string, date string, ticker string, weight double")
    got = {(r.strategy, r.date, r.ticker): r.weight for r in solve.turnover_path(targets, step=0.05).collect()}
    want = {}
    for s in ("a", "b", None):
        held = None
        for day in sorted({r[1] for r in rows if r[0] == s}):
            today = spark.createDataFrame([r for r in rows if r[0] == s and r[1] == day], targets.schema).select(weights.F.lit("s").alias("k"), "ticker", "weight")
            now = today if held is None else weights.limit_turnover(today, held, ["k"], 0.05)
            kept = [(r.k, r.ticker, r.weight) for r in now.select("k", "ticker", "weight").collect()]
            held = spark.createDataFrame(kept, "k string, ticker string, weight double")
            want.update({(s, day, t): w for _, t, w in kept})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    assert solve.turnover_path(targets.where("false")).collect() == []
