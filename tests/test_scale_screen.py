"""Screening blocks over long series: one exchange and no frame visited bar by bar."""

import datetime as dt
import random
import re

import pytest

from quantloom.operators import scores, technical


def _bars(spark, days=280):
    rng = random.Random(3)
    rows = []
    for t in ("A", "B"):
        for i in range(days):
            close = None if t == "B" and i % 9 == 4 else round(rng.uniform(10, 20), 2)
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), rng.uniform(20, 25), rng.uniform(5, 10), close, rng.randrange(1, 500)))
    return spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double, volume long"), rows


def test_levels_against_slices(spark):
    bars, rows = _bars(spark)
    levels = technical.level_indicators(bars)
    # before, every bar visited up to 252 bars again
    assert not re.findall(r"RowFrame, -\d+, currentrow", levels._jdf.queryExecution().optimizedPlan().toString())
    mean = lambda x: sum(x) / len(x)
    for r in levels.collect():
        past = [x for x in rows if x[0] == r.ticker and x[1] <= r.date]
        assert r.bar_no == len(past)
        for k in (20, 50, 200):
            want = mean([x[4] for x in past[-k:] if x[4] is not None])
            assert r[f"sma_{k}"] == (pytest.approx(want, rel=1e-12) if len(past) >= k else None)
        assert r.high_52w == max(x[2] for x in past[-252:]) and r.low_52w == min(x[3] for x in past[-252:])
        assert r.volume_sma_20 == (mean([x[5] for x in past[-20:]]) // 1 if len(past) >= 20 else None)


def test_blocks_go_along_in_one_exchange(spark):
    bars, _ = _bars(spark)
    bench = spark.createDataFrame([("SPY", dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i % 7) for i in range(280)], "ticker string, date date, close double")
    levels = technical.level_indicators(bars)
    both = technical.history_risk(scores.momentum_inputs(levels, along=True), bench, along=True)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1
    key = ["ticker", "date"]
    alone = levels.join(scores.momentum_inputs(bars), key).join(technical.history_risk(bars, bench), key)
    assert sorted(both.columns) == sorted(alone.columns)
    order = sorted(both.columns)
    assert sorted(map(str, both.select(order).collect())) == sorted(map(str, alone.select(order).collect()))
