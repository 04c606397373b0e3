"""Fits in few partitions, screening rows and ranks that move few bytes, pairs of a bounded number of blocks."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors, learn, panel
from quantloom.operators.asof import beside
from quantloom.operators.xsection import rank_table
from quantloom.plans import monthly
from quantloom.session import reliable, spread


def test_small_fits_are_read_in_few_partitions(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"T{k:03}", date(2001, 1 + k % 12, 15), rng.random(), k % 3 // 2) for k in range(600)]
    train = spark.createDataFrame(rows, "ticker string, date date, a double, target_binary int").repartition(16)
    monkeypatch.setattr(learn, "reliable", lambda df: df.repartition(16))
    assert learn.training_rows(train, ["a"]).rdd.getNumPartitions() == learn.LEAST_PARTS
    monkeypatch.setattr(learn, "ROWS_A_PART", 100)
    ready = learn.training_rows(train, ["a"])
    assert ready.rdd.getNumPartitions() == 6
    assert ready.where("is_validation").count() == 120 and ready.count() == 600


def test_rows_dealt_out_by_ticker_stay_where_they_are(spark):
    day = lambda k: date(2001, 1, 1) + timedelta(days=30 * k)
    wide = spark.createDataFrame([(t, day(k), 10 * k) for t in ("A", "B", "C", None) for k in range(4)], "ticker string, date date, x int")
    other = spark.createDataFrame([("A", day(1), 1.0), ("A", day(3), 3.0), ("B", day(0), 0.5), ("D", day(0), 9.0), (None, day(0), 7.0), ("C", None, 8.0)], "ticker string, date date, y double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left"):
            out = beside(spread(wide), spread(other), how)
            # before, both sides moved once more, to be dealt out by ticker and date
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
            assert out.columns == ["ticker", "date", "x", "y"]
            want = wide.join(other, ["ticker", "date"], how)
            assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_values_are_counted_once_for_ranks(spark):
    rows = [(k % 3, random.Random(k).choice([-1.5, 0.0, 0.25, 0.26, 7.0, None])) for k in range(200)]
    table = rank_table(spark.createDataFrame(rows, "k int, value double"), ["k"])
    # before, the counts by value were made and moved a second time for the offsets of the buckets
    assert len(re.findall(r"Aggregate \[k#\d+, value#\d+\]", table._jdf.queryExecution().optimizedPlan().toString())) == 1
    for r in table.collect():
        group = [v for k, v in rows if k == r.k and v is not None]
        assert (r.n_below, r.n_tied, r.n_group) == (sum(v < r.value for v in group), group.count(r.value), len(group))


def test_residuals_and_znorms_are_not_written(spark, monkeypatch):
    rng, names = random.Random(8), [*panel.BASE_FEATURES, "future_return", "future_return_2m"]
    rows = [(f"T{t}", date(2001, m, 28), None if t == 7 else f"s{t % 2}", *[None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in names]) for t in range(8) for m in (1, 2)]
    written = []
    monkeypatch.setattr(monthly, "reliable", lambda df: written.append(df.columns) or reliable(df))
    kind = "ticker string, date date, sector string, " + ", ".join(f"{n} double" for n in names)
    found = {(r.ticker, r.date): r for r in monthly.cross_section(spark.createDataFrame(rows, kind)).collect()}
    assert len(found) == len(rows) and not any(c.endswith("_znorm") for columns in written for c in columns)
    at = 3 + names.index("return_1m")
    for r in rows:
        got, peers = found[r[:2]], [x for x in rows if x[1] == r[1] and x[at] is not None]
        mean = sum(x[at] for x in peers) / len(peers)
        spread_ = (sum((x[at] - mean) ** 2 for x in peers) / (len(peers) - 1)) ** 0.5
        sector = [x[at] for x in peers if x[2] == r[2]]
        if r[at] is None:
            assert got.return_1m_znorm is None and got.return_1m_resid is None and got.return_1m_rank is None
            continue
        assert got.return_1m_znorm == pytest.approx((r[at] - mean) / spread_)
        assert got.return_1m_resid == (None if r[2] is None else pytest.approx(r[at] - sum(sector) / len(sector)))
        assert got.return_1m_rank == pytest.approx(sum(x[at] <= r[at] for x in peers) / len(peers))
        known = [x.future_return_resid for x in found.values() if x.date == r[1] and x.future_return_resid is not None]
        middle = sum(known) / len(known)
        if got.future_return_resid is not None:
            assert got.target_regression == pytest.approx((got.future_return_resid - middle) / (sum((v - middle) ** 2 for v in known) / (len(known) - 1)) ** 0.5)


def test_pairs_of_a_bounded_number_of_blocks(spark):
    rng = random.Random(4)
    rows = [(f"T{t:02}", date(2001, 1, 1) + timedelta(days=k), rng.gauss(0, 1)) for t in range(40) for k in range(12)]
    grid = spark.createDataFrame(rows, "ticker string, date date, ret double")
    pairs = factors.one_factor_covariance(grid, block=1)
    # before, 40 blocks: every ticker's parts moved 40 times
    assert {int(n) for n in re.findall(r"pmod\(xxhash64\(ticker#\d+, 42\), (\d+)\)", pairs._jdf.queryExecution().optimizedPlan().toString())} == {factors.MOST_BLOCKS}
    parts = {r.ticker: r for r in factors.one_factor_parts(grid).collect()}
    found = {(r.ticker_i, r.ticker_j): r.cov for r in pairs.collect()}
    assert len(found) == 40 * 41 // 2
    for (i, j), cov in found.items():
        assert cov == pytest.approx(parts[i].beta * parts[j].beta * parts[i].mvar + (parts[i].resid_var if i == j else 0.0))
