"""Tickers, universes and as-of look-ups on hand-made frames."""

from datetime import date

from pyspark.sql import functions as F

from quantloom.operators import universe
from quantloom.operators.asof import asof_backward, asof_forward, sample_at, snapshot_for

D = date.fromisoformat


def prices(spark, rows):
    return spark.createDataFrame([(t, D(d), float(p)) for t, d, p in rows], "ticker string, date date, px double")


def ask(spark, ticker, day):
    return spark.createDataFrame([(ticker, D(day))], "ticker string, date date")


def look(spark, rows, day):
    got = asof_forward(ask(spark, "A", day), prices(spark, rows), ["px"], at="found", tolerance_days=7).first()
    return got.px, got.found


def test_forward_exact_next_and_never_back(spark):
    exact = [("A", "2023-01-02", 100), ("A", "2023-01-03", 101), ("A", "2023-01-04", 102)]
    assert look(spark, exact, "2023-01-03") == (101.0, D("2023-01-03"))
    gap = [("A", "2023-01-02", 100), ("A", "2023-01-05", 105), ("A", "2023-01-10", 110)]
    assert look(spark, gap, "2023-01-03") == (105.0, D("2023-01-05"))
    assert look(spark, [("A", "2023-01-02", 100), ("A", "2023-01-10", 110)], "2023-01-05") == (110.0, D("2023-01-10"))
    assert look(spark, [("A", "2023-01-03", 100)], "2023-06-01") == (None, None)
    assert look(spark, [("A", "2023-01-10", 100)], "2023-01-02") == (None, None)  # 8 days


def test_backward_takes_same_day_and_never_later(spark):
    facts = prices(spark, [("A", "2023-01-02", 1), ("A", "2023-01-05", 2), ("B", "2023-01-01", 9)])
    asked = spark.createDataFrame([("A", D(d)) for d in ("2023-01-01", "2023-01-04", "2023-01-05")], "ticker string, date date")
    got = {r.date.isoformat(): r.px for r in asof_backward(asked, facts, ["px"]).collect()}
    assert got == {"2023-01-01": None, "2023-01-04": 1.0, "2023-01-05": 2.0}


def test_universe_as_of_with_fallback(spark):
    members = [("2023-01-01", t) for t in ("AAPL", "MSFT", "GOOGL")] + [("2023-06-01", t) for t in ("AAPL", "MSFT", "META")]
    snaps = spark.createDataFrame([(D(d), t) for d, t in members], "snapshot_date date, ticker string")
    days = spark.createDataFrame([(D(d),) for d in ("2023-01-01", "2023-03-15", "2024-01-01", "2020-01-01")], "date date")
    got = {r.date.isoformat(): r.snapshot_date.isoformat() for r in snapshot_for(days, snaps).collect()}
    assert got == {"2023-01-01": "2023-01-01", "2023-03-15": "2023-01-01", "2024-01-01": "2023-06-01", "2020-01-01": "2023-01-01"}
    panel = spark.createDataFrame([(D("2023-03-15"), "GOOGL"), (D("2023-03-15"), "META"), (D("2024-01-01"), "META")], "date date, ticker string")
    kept = {(r.date.isoformat(), r.ticker) for r in universe.members_only(panel, snaps).collect()}
    assert kept == {("2023-03-15", "GOOGL"), ("2024-01-01", "META")}


def test_ticker_variants_and_aliases(spark):
    tickers = spark.createDataFrame([("BRK.B",), ("BRK-B",), ("AAPL",), ("META",)], "ticker string")
    aliases = spark.createDataFrame([("META", "FB"), ("FB", "META")], "ticker string, alias string")
    rows = universe.with_variants(tickers, aliases).groupBy("ticker").agg(F.sort_array(F.collect_set("variant")).alias("v"))
    got = {r.ticker: r.v for r in rows.collect()}
    assert got == {"BRK.B": ["BRK-B", "BRK.B"], "BRK-B": ["BRK-B", "BRK.B"], "AAPL": ["AAPL"], "META": ["FB", "META"]}


def test_month_end_sampling_carries_and_can_expire(spark):
    bars = prices(spark, [("A", "2023-01-20", 1), ("A", "2023-02-27", 2), ("B", "2023-01-31", 5), ("B", "2023-03-31", 6)])
    ends = spark.createDataFrame([(D(d),) for d in ("2023-01-31", "2023-02-28", "2023-03-31")], "date date")
    got = {(r.ticker, r.date.isoformat()): r.px for r in sample_at(bars, ends).collect()}
    assert got == {
        ("A", "2023-01-31"): 1.0, ("A", "2023-02-28"): 2.0, ("A", "2023-03-31"): 2.0,
        ("B", "2023-01-31"): 5.0, ("B", "2023-02-28"): 5.0, ("B", "2023-03-31"): 6.0,
    }
    fresh = {(r.ticker, r.date.isoformat()) for r in sample_at(bars, ends, max_staleness=7).collect()}
    assert fresh == {("A", "2023-02-28"), ("B", "2023-01-31"), ("B", "2023-03-31")}


def test_membership_rebuilt_from_change_log(spark):
    changes = spark.createDataFrame(
        [(D("2020-01-10"), "C", "A", "x"), (D("2021-01-10"), "A", "B", "x")], "date date, added string, removed string, reason string"
    )
    current = spark.createDataFrame([("A",), ("C",), ("Z",)], "ticker string")
    marks = spark.createDataFrame([(D(d),) for d in ("2019-01-01", "2020-06-01", "2022-01-01")], "date date")
    got = {}
    for r in universe.rebuild_membership(current, changes, marks).collect():
        got.setdefault(r.snapshot_date.isoformat(), set()).add(r.ticker)
    assert got == {"2019-01-01": {"A", "B", "Z"}, "2020-06-01": {"B", "C", "Z"}, "2022-01-01": {"A", "C", "Z"}}


def test_peers_match_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [(f"T{i:03d}", f"S{i % 3}", f"I{i % 7}", None if i % 11 == 0 else float(rng.choice([1, 2, 3, 4, 8, 20]) * 1e9 * rng.uniform(0.9, 1.1))) for i in range(150)]
    rows.append(("T900", None, "I1", 1e9))
    meta = spark.createDataFrame(rows, "ticker string, sector string, industry string, market_cap double")
    got = {}
    for r in universe.peers(meta, 3).collect():
        got.setdefault(r.ticker, []).append((-r.score, r.peer))
    for t, s, ind, cap in rows:
        scored = []
        for t2, s2, i2, c2 in rows:
            if t2 == t or s is None or s2 != s:
                continue
            score = 100 + (50 if i2 == ind else 0)
            if cap and c2:
                ratio = max(cap, c2) / min(cap, c2)
                score += 30 if ratio <= 2 else 10 if ratio <= 5 else 0
            scored.append((-score, t2))
        assert sorted(got.get(t, [])) == sorted(scored)[:3], t
