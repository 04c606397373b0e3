"""Resampling, ranks, weights and distributions."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.distributions import incomplete_beta, normal_tail, student_two_sided
from quantloom.operators import evaluation, returns, solve, technical, validation, weights
from quantloom.operators.xsection import extreme_share, pct_rank


def series(spark, values, name="s"):
    rows = [(name, date(2020, 1, 1) + timedelta(days=30 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "strategy string, date date, r double")


def test_bootstrap_signs_and_interval(spark):
    up = validation.bootstrap(series(spark, [0.02, 0.03, 0.01, 0.02, 0.01, 0.03, 0.02, 0.01]), n_iter=2000).first()
    assert up["mean"] > 0 and up.p_value < 0.05 and up.ci_low > 0
    down = validation.bootstrap(series(spark, [-0.02, -0.01, -0.03, -0.02, -0.01]), n_iter=2000).first()
    assert down["mean"] < 0 and down.p_value > 0.95
    rng = random.Random(123)
    mixed = validation.bootstrap(series(spark, [rng.gauss(0.01, 0.02) for _ in range(30)]), n_iter=2000)
    row = mixed.first()
    assert row.ci_low <= row["mean"] <= row.ci_high
    again = mixed.first()  # hash draws repeat; only summation order may differ
    assert (again.p_value, again.ci_low, again.ci_high) == pytest.approx((row.p_value, row.ci_low, row.ci_high), rel=1e-12)


def ics(spark, score, actual):
    rows = [(1, f"T{i}", float(s), float(a)) for i, (s, a) in enumerate(zip(score, actual))]
    df = spark.createDataFrame(rows, "g int, ticker string, s double, a double")
    return validation.information_coefficient(df, ["g"], "s", "a").first()


def test_information_coefficient(spark):
    assert ics(spark, range(1, 11), range(1, 11)).ic == pytest.approx(1.0)
    assert ics(spark, range(1, 11), range(10, 0, -1)).ic == pytest.approx(-1.0)
    assert ics(spark, range(5), range(5)).ic == 0.0
    rng = random.Random(42)
    noise = ics(spark, [rng.random() for _ in range(100)], [rng.random() for _ in range(100)])
    assert abs(noise.ic) < 0.3 and 0 < noise.ic_pvalue <= 1


def test_distributions_against_known_values():
    assert normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert student_two_sided(12.7062047362, 1) == pytest.approx(0.05, abs=1e-8)
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_rank_matches_brute_force_with_ties_nulls_and_extremes(spark):
    rng = random.Random(1)
    values = [None, 0.0, -0.0, 1e-300, -1e300, 1e300] + [rng.choice([-2.5, 0.0, 1.0, 1.0, 3e5]) if i % 3 else rng.gauss(0, 1) for i in range(300)]
    df = spark.createDataFrame([(i % 2, f"T{i:04d}", v, -v if v is not None else None) for i, v in enumerate(values)], "date int, ticker string, x double, y double")
    got = {r.ticker: (r.rx, r.ry, r.one) for r in pct_rank(pct_rank(df, ["date"], {"x": "rx", "y": "ry"}), ["date"], {"x": "one"}).collect()}
    for g in (0, 1):
        own = [(f"T{i:04d}", v) for i, v in enumerate(values) if i % 2 == g]
        seen = [v for _, v in own if v is not None]
        for t, v in own:
            if v is None:
                assert got[t] == (None, None, None)
                continue
            below, tied = sum(o < v for o in seen), sum(o == v for o in seen)
            want = (below + (tied + 1) / 2) / len(seen)
            assert got[t][0] == pytest.approx(want) and got[t][2] == pytest.approx(want)
            assert got[t][1] == pytest.approx((len(seen) + 1) / len(seen) - want)


def test_extreme_share_cuts_ties_in_order(spark):
    df = spark.createDataFrame([(1, f"T{i:02d}", 5.0 if i < 15 else float(i)) for i in range(20)], "g int, ticker string, x double")
    top = sorted(r.ticker for r in extreme_share(df, ["g"], "x", 0.4, ["ticker"]).collect())
    assert top == ["T00", "T01", "T02", "T15", "T16", "T17", "T18", "T19"]


def test_auc_matches_pair_count(spark):
    rng = random.Random(5)
    rows = [(1, round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(80)]
    got = evaluation.auc(spark.createDataFrame(rows, "g int, score double, target_binary int"), ["g"]).first().auc
    pos, neg = [s for _, s, t in rows if t], [s for _, s, t in rows if not t]
    assert got == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))


def test_exponential_average_equals_the_recursion(spark):
    """Slow to fast averages in one call, across the borders of their blocks."""
    rng = random.Random(3)
    n, alphas = 5000, (0.001, 0.01, 1 / 14, 2 / 13, 0.5, 0.9)
    xs = [rng.uniform(1, 100) for _ in range(n)]
    rows = [("A", date(1990, 1, 1) + timedelta(days=i), x, x if i else None) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double, late double")
    asked = {f"e{k}": ("x", a) for k, a in enumerate(alphas)} | {"l": ("late", 1 / 14)}
    got = technical.ema(df, asked).orderBy("date").collect()
    e, late = [xs[0]] * len(alphas), None
    assert got[0].l is None
    for i in range(1, n):
        e = [(1 - a) * y + a * xs[i] for a, y in zip(alphas, e)]
        late = xs[i] if i == 1 else late * 13 / 14 + xs[i] / 14
        assert [got[i][f"e{k}"] for k in range(len(alphas))] == pytest.approx(e, rel=1e-9) and got[i].l == pytest.approx(late, rel=1e-9)


def test_weight_properties(spark):
    rows = [(1, f"T{i:02d}", (i * 37 % 30) / 30.0, 0.05 + i / 40.0) for i in range(30)]
    df = spark.createDataFrame(rows, "date int, ticker string, score double, volatility_20d double")
    inv = weights.inverse_vol(weights.top_n(df, 10)).agg(F.sum("weight"), F.count("weight")).first()
    assert inv[0] == pytest.approx(1.0) and inv[1] == 10
    sides = weights.continuous_weights(df).agg(F.sum(F.when(F.col("weight") > 0, F.col("weight"))), F.sum(F.when(F.col("weight") < 0, F.col("weight")))).first()
    assert sides[0] == pytest.approx(1.0) and sides[1] == pytest.approx(-1.0)


def test_overlay_sums_to_one_with_minimum_bucket(spark):
    df = spark.createDataFrame([(1, f"T{i:02d}", 40.0 + i) for i in range(24)], "date int, ticker string, score double")
    index = spark.createDataFrame([("T03", 1, 0.07), ("T05", 2, 0.06), ("T08", 3, 0.03), ("T09", 4, 0.02)], "ticker string, index_rank int, index_weight double")
    book = weights.overlay_weights(weights.overlay_select(df, index, 20, 3), 20, "hybrid", 0.25)
    got = book.collect()
    assert len(got) == 20 and sum(r.weight for r in got) == pytest.approx(1.0)
    assert sum(r.weight for r in got if r.is_mega_cap) == pytest.approx(0.25)
    assert {r.ticker for r in got if r.is_mega_cap} == {"T03", "T05", "T08"}


def test_constrained_weights_obey_bounds(spark):
    rng = random.Random(11)
    rows = [("s", date(2021, 1, 31), f"T{j}", date(2020, 1, 1) + timedelta(days=i), rng.gauss(0.001 * j, 0.01 * (j + 1)), 0.02 * j) for j in range(6) for i in range(80)]
    df = spark.createDataFrame(rows, "strategy string, date date, ticker string, lag_date date, ret double, score double")
    for method in solve.METHODS:
        w = {r.ticker: r.weight for r in solve.constrained_weights(df, method, 0.05, 0.40).collect()}
        assert sum(w.values()) == pytest.approx(1.0, abs=1e-9)
        assert all(0.05 - 1e-9 <= v <= 0.40 + 1e-9 for v in w.values())
        # the covariance is shrunk by design, so optimality is checked under that matrix
        x = np.array([[r[4] for r in rows if r[2] == f"T{j}"] for j in range(6)]).T
        cov, mu = solve._covariance(x), np.array([0.02 * j for j in range(6)])
        loss = {
            "min_variance": lambda v: v @ cov @ v,
            "mean_variance": lambda v: v @ cov @ v - v @ mu,
            "max_sharpe": lambda v: -(v @ mu - 0.04) / np.sqrt(v @ cov @ v),
            "risk_parity": lambda v: np.sum((v * (cov @ v) / (v @ cov @ v) - 1 / 6) ** 2),
        }[method]
        own = np.array([w[f"T{j}"] for j in range(6)])
        draws = np.random.default_rng(0)
        best = min(loss(solve.project_capped_simplex(draws.normal(1 / 6, 0.3, 6), 0.05, 0.40)) for _ in range(5000))
        assert loss(own) <= best + 1e-6, method
    narrow = solve.constrained_weights(df, "min_variance", 0.0, 0.10).collect()
    assert not any(r.bounds_met for r in narrow) and sum(r.weight for r in narrow) == pytest.approx(1.0)
    kelly = [r.weight for r in solve.kelly_weights(df).collect()]
    assert sum(kelly) == pytest.approx(1.0) and min(kelly) >= 0


def test_delisting_and_missing_entry(spark):
    rows = [("A", -1, 100.0, None), ("B", 1, 100.0, None), ("C", 1, None, 5.0), ("D", 1, 100.0, 110.0), ("E", -1, 100.0, 90.0)]
    df = spark.createDataFrame(rows, "ticker string, side int, entry_price double, exit_price double")
    got = {r.ticker: r.h for r in df.select("ticker", returns.holding_return(F.col("side") < 0).alias("h")).collect()}
    assert got["A"] == -0.30 and got["B"] == -0.20 and got["C"] is None
    assert got["D"] == pytest.approx(0.10) and got["E"] == pytest.approx(0.10)


def test_product_survives_total_loss(spark):
    from quantloom.operators.risk import drawdowns

    got = drawdowns(series(spark, [0.1, -1.0, 0.5])).orderBy("date").collect()
    assert [round(r.drawdown, 6) for r in got] == [0.0, -1.0, -1.0]
    assert not any(math.isnan(r.drawdown) for r in got)


def test_mean_variance_is_not_worse_than_a_grid_of_books(spark):
    """Volatile names, so that the scale of the covariance is far from 1."""
    from itertools import product

    rng = np.random.default_rng(3)
    days = [date(2020, 1, 1) + timedelta(days=d) for d in range(60)]
    returns = {t: rng.normal(0, sd, 60) for t, sd in (("A", 0.01), ("B", 0.02), ("C", 0.03))}
    scores = {"A": 0.02, "B": 0.06, "C": 0.10}
    rows = [("s", days[-1], t, d, float(r), scores[t]) for t, rets in returns.items() for d, r in zip(days, rets)]
    df = spark.createDataFrame(rows, "strategy string, date date, ticker string, lag_date date, ret double, score double")
    got = {r.ticker: r.weight for r in solve.constrained_weights(df, "mean_variance", 0.0, 0.8).collect()}
    cov, mu = solve._covariance(np.column_stack([returns[t] for t in "ABC"])), np.array([scores[t] for t in "ABC"])

    def objective(w):
        scale = np.trace(cov) / 3
        return w @ cov @ w / scale - w @ mu / scale

    grid = [np.array([a, b, 100 - a - b]) / 100 for a, b in product(range(81), repeat=2) if 20 <= a + b <= 100]
    assert objective(np.array([got[t] for t in "ABC"])) <= min(map(objective, grid)) + 1e-9


def test_distribution_columns_equal_the_functions(spark):
    from pyspark.sql import functions as F

    from quantloom.functions.distributions import p_normal, p_student

    cases = [(t, d) for t in (-40.0, -3.1, -0.2, 0.0, 1e-9, 0.7, 2.2, 2.99, 3.01, 7.5, 30.0, 1e8) for d in (1, 2, 3, 10, 57, 1000, 200_000)]
    rows = spark.createDataFrame([*cases, (None, 5), (1.0, 0), (float("nan"), 3)], "t double, d int").select("t", "d", p_student(F.col("t"), F.col("d")).alias("p"), p_normal(F.col("t")).alias("z")).collect()
    for r in rows:
        if r.t is None or r.d == 0:
            assert r.p is None
        elif r.t == r.t:
            assert r.p == pytest.approx(student_two_sided(r.t, r.d), rel=1e-9, abs=1e-300), (r.t, r.d)
            assert r.z == pytest.approx(normal_tail(r.t), rel=1e-10, abs=1e-300), r.t


def test_cut_inside_a_value_that_most_rows_share(spark):
    from quantloom.operators.xsection import numbered, range_parts

    rng = random.Random(8)
    rows = [(g, f"T{i:05}", 1.0 if rng.random() < 0.9 else rng.random() * 2) for g in ("a", "b", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, ticker string, x double").repartition(8)
    for largest in (True, False):
        got = {(r.g, r.ticker) for r in extreme_share(df, ["g"], "x", 0.3, ["ticker"], largest).collect()}
        for g in ("a", "b"):
            own = sorted(((-x if largest else x), t) for h, t, x in rows if h == g)[:900]
            assert {t for h, t in got if h == g} == {t for _, t in own}
    sizes = [r["count"] for r in range_parts(df.where("x = 1"), ["g", "x", "ticker"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    placed = numbered(df, ["g"], ["x", "ticker"], "p").collect()
    for g in ("a", "b", None):
        own = sorted((r.x, r.ticker, r.p) for r in placed if r.g == g)
        assert [p for *_, p in own] == list(range(1, 3001))
