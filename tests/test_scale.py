"""Findings of round 3: work that grew faster than the input."""

import datetime as dt
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quantloom.operators import factors, panel


def _grid(spark, tickers, days, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.02, (days, tickers))
    first = dt.date(2020, 1, 1)
    rows = [(f"T{j:03d}", first + dt.timedelta(days=t), float(x[t, j])) for j in range(tickers) for t in range(days)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double"), x


def test_covariance_of_many_small_blocks(spark):
    grid, x = _grid(spark, 90, 12)
    want = np.cov(x, rowvar=False)
    got = {(r.ticker_i, r.ticker_j): r["cov"] for r in factors.covariance(grid, block=2).collect()}
    assert len(got) == 90 * 91 // 2 and all(i <= j for i, j in got)
    assert all(abs(v - want[int(i[1:]), int(j[1:])]) < 1e-12 for (i, j), v in got.items())


def test_covariance_moves_a_series_a_bounded_number_of_times(spark, monkeypatch):
    """Before, each (ticker, date) row moved once per block of ``block`` tickers."""

    def seen(batches):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"ticker_i": ["n"], "ticker_j": ["n"], "cov": [float(n)]})

    seen.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    monkeypatch.setattr(factors, "_pair_products", seen)
    grid, _ = _grid(spark, 90, 12)
    moved = sum(r["cov"] for r in factors.covariance(grid, block=2).collect())
    assert moved == 90 * factors.MOST_BLOCKS


def test_shrinkage_makes_the_pairs_once(spark):
    grid, x = _grid(spark, 20, 15, seed=3)
    out = factors.shrink(factors.covariance(grid), diagonal=factors.mean_variance(grid))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("FlatMapGroupsInArrow", plan)) == 1
    cov = np.cov(x, rowvar=False)
    want = 0.7 * cov + 0.3 * np.diag(cov).mean() * np.eye(20)
    assert all(abs(r["cov"] - want[int(r.ticker_i[1:]), int(r.ticker_j[1:])]) < 1e-12 for r in out.collect())


def test_trailing_parts_against_slices(spark):
    rng = random.Random(5)
    x = [None if rng.random() < 0.2 else rng.uniform(-2, 2) for _ in range(300)]
    first = dt.date(2020, 1, 1)
    rows = [(k, first + dt.timedelta(days=i), v) for k in ("a", None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    out = panel.trailing_parts(df, {"x": (1, 19, 20, 120)}, {"x": {"_hi": 252, "_lo": 7}})
    assert {"x_n19", "x_s120", "x_q20", "_hi", "_lo"} <= set(out.columns)
    for r in out.collect():
        t = (r.date - first).days
        cut = lambda n: [v for v in x[max(0, t - n + 1) : t + 1] if v is not None]
        for n in (1, 19, 20, 120):
            assert r[f"x_n{n}"] == len(cut(n))
            assert abs(r[f"x_s{n}"] - sum(cut(n))) < 1e-9 and abs(r[f"x_q{n}"] - sum(v * v for v in cut(n))) < 1e-9
        assert r["_hi"] == max(cut(252), default=None) and r["_lo"] == min(cut(7), default=None)


def test_bar_features_visit_no_frame_bar_by_bar(spark):
    """Before, every bar summed up to 252 bars again."""
    prices = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0, 1)], "ticker string, date date, adj_close double, volume long")
    plan = panel.bar_features(prices)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"RowFrame, -\d+, currentrow", plan)


def test_screen_blocks_read_written_bars(spark, monkeypatch):
    """Before, every block and the month ends aggregated all lines again."""
    from pyspark.sql import functions as F

    from quantloom.plans import derived

    class Seen(Exception):
        pass

    class Bars(derived.Market):
        def prices(self):
            lines = spark.createDataFrame([("a", dt.date(2020, 1, d), float(d)) for d in (1, 1, 2)], "ticker string, date date, close double")
            return lines.groupBy("ticker", "date").agg(F.max("close").alias("close"), F.max("close").alias("adj_close"))

        def bench(self):
            return self.prices()

    def look(prices):
        raise Seen(prices)

    monkeypatch.setattr(derived.technical, "level_indicators", look)
    try:
        Bars(spark, "none").screen_rows()
    except Seen as seen:
        (prices,) = seen.args
    plan = prices._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and sorted(r.close for r in prices.collect()) == [1.0, 2.0]


def test_scores_take_the_written_month_rows(spark):
    """A plan that has the month-end rows written does not build them from the bars again for the scores."""
    from quantloom.plans.derived import Market

    names = "ticker string, date date, sector string, return_6m double, volatility_20d double, market_volatility double, future_return double, target_excess double"
    rows = spark.createDataFrame([(t, dt.date(2020, 1, 31), None, r, 0.1, 0.2, 0.3, None) for t, r in (("A", 0.5), ("B", None), ("C", 0.5), ("D", -1.0))], names)
    built = []

    class Counted(Market):
        def month_rows(self):
            built.append(1)
            return rows

    both, alone = Counted(spark, "none"), Counted(spark, "none")
    both.month_table()
    found = sorted(map(tuple, both.scores().select("ticker", "score").collect()))
    assert len(built) == 1
    assert found == sorted(map(tuple, alone.scores().select("ticker", "score").collect()))
    assert found == [("A", 2.5 / 3), ("B", None), ("C", 2.5 / 3), ("D", 1 / 3)]
