"""Exposures, volatility and beta as of many rebalance dates against the single-date operators on cut tables."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors, factors_at

START = date(2020, 1, 1)
SCHEMA = "ticker string, date date, ret double"


def panel(spark, days=160, tickers=7):
    rng = random.Random(5)
    rows, market = [], []
    for i in range(days):
        d = START + timedelta(days=2 * i)  # every second day trades
        market.append((d, None if i == 40 else rng.gauss(0.001, 0.01)))
        for t in range(tickers):
            if t == 1 and i % 3:
                continue
            value = rng.gauss(0.0, 0.02)
            if t == 2:
                value = 0.01  # no spread
            if t == 3 and i == 90:
                value = -1.0  # total loss
            rows.append((f"T{t}", d, None if (t == 4 and i % 5 == 0) else value))
    sectors = spark.createDataFrame([(f"T{t}", "A" if t % 2 else "B") for t in range(tickers - 1)], "ticker string, sector string")
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(market, "date date, spy_ret double"), sectors


def marks(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "date date")


@pytest.mark.parametrize("lookback, least", [(50, 12), (400, 60)])
def test_equals_the_single_date_operator_on_cut_tables(spark, lookback, least):
    returns, market, sectors = panel(spark)
    asked = [START + timedelta(days=n) for n in (60, 101, 180, 200, 318, 2000)]  # 101 is no trading date
    early = START - timedelta(days=3)
    got = factors_at.exposures_at(returns, market, sectors, marks(spark, *asked, asked[0], early, None), lookback, least).collect()
    keyed = {(r.as_of, r.ticker): r for r in got}
    assert len(keyed) == len(got) and early not in {r.as_of for r in got}
    total = 0
    for d in asked:
        want = factors.exposures(returns.where(F.col("date") <= F.lit(d)), market.where(F.col("date") <= F.lit(d)), sectors, lookback, least).collect()
        total += len(want)
        for w in want:
            g = keyed[(d, w.ticker)]
            assert (g.n_obs, g.sector) == (w.n_obs, w.sector)
            for c in ("beta", "momentum", "value", "low_vol", "reversal", "volatility"):
                assert g[c] == pytest.approx(w[c], rel=1e-9, abs=1e-12), (d, w.ticker, c)
            if w.ticker != "T2":  # rounding noise of a constant series decides there
                assert g["size"] == pytest.approx(w["size"], rel=1e-9)
    assert total == len(got)


def test_volatility_and_beta(spark):
    returns, market, _ = panel(spark)
    asked = [START + timedelta(days=n) for n in (2, 90, 240)]
    got = {(r.as_of, r.ticker): r for r in factors_at.vol_beta_at(returns, market, marks(spark, *asked), 20, 60, 15).collect()}
    seen = 0
    for d in asked:
        for w in factors.latest_vol_beta(returns.where(F.col("date") <= F.lit(d)), market.where(F.col("date") <= F.lit(d)), 20, 60, 15).collect():
            g = got[(d, w.ticker)]
            seen += 1
            for c in ("beta", "volatility"):
                assert g[c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-9, abs=1e-12))
    assert seen == len(got)


def test_residuals_use_exposures_known_before_the_day(spark):
    returns, market, sectors = panel(spark)
    ends = marks(spark, START + timedelta(days=120), START + timedelta(days=200))
    held = {r.date: r.as_of for r in factors_at.holding_days(returns, ends).collect()}
    assert all(a < d for d, a in held.items()) and min(held) == START + timedelta(days=122)

    def residuals(rows):
        exposure = factors_at.exposures_at(rows, market, sectors, ends, 50, 12)
        return {(r.ticker, r.date): r.residual for r in factors_at.residual_returns_at(rows, market, exposure, ends).where(F.col("date") <= F.lit(START + timedelta(days=240))).collect()}

    base = residuals(returns)
    later = returns.withColumn("ret", F.when(F.col("date") > F.lit(START + timedelta(days=240)), F.col("ret") * 3).otherwise(F.col("ret")))
    changed = residuals(later)
    assert base and base.keys() == changed.keys()
    assert all(changed[k] == pytest.approx(v, rel=1e-9, abs=1e-12) if v is not None else changed[k] is None for k, v in base.items())


def test_large_level_does_not_cancel(spark):
    """Centred pieces: spread 1e-6 around a level of 1000 keeps ten digits."""
    values = [1000 + 1e-6 * math.sin(i) for i in range(120)]
    rows = spark.createDataFrame([("T", START + timedelta(days=i), v, v) for i, v in enumerate(values)], SCHEMA + ", y double")
    cut = factors_at.pieces(rows, marks(spark, *[START + timedelta(days=n) for n in (59, 79, 119)]), 60)
    for r in factors_at.lookback_moments(rows, cut, "y").collect():
        last = (r.as_of - START).days
        part = [v - 1000 for v in values[last - 59 : last + 1]]
        mean = math.fsum(part) / 60
        assert r.n == 60 and r.xx == pytest.approx(math.fsum((v - mean) ** 2 for v in part), rel=1e-6)
        assert r.xy == pytest.approx(r.xx, rel=1e-9)


def test_empty_tables(spark):
    returns, market, sectors = panel(spark, days=30)
    none = spark.createDataFrame([], "date date")
    assert factors_at.exposures_at(returns, market, sectors, none, 50, 12).count() == 0
    assert factors_at.exposures_at(returns.where("false"), market, sectors, marks(spark, START), 50, 12).count() == 0
