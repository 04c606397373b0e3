"""Look-backs merge two running parts each, and style legs come from one pass."""

import datetime as dt
import random

import pytest

from quantloom.operators import factors_at
from quantloom.operators.factors import STYLE_COEFFICIENTS

D = dt.date(2020, 1, 1)


def test_look_backs_repeat_no_pieces(spark):
    """Before, every piece of the calendar was repeated for each look-back over it and the parts of a look-back were collected."""
    rng = random.Random(2)
    rows = [(t, D + dt.timedelta(days=i), rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for t in "ABC" for i in range(90) if (t, i % 4) != ("B", 1) and not (t == "C" and i > 40)]
    returns = spark.createDataFrame(rows, "ticker string, date date, ret double, spy_ret double")
    marks = [D + dt.timedelta(days=i) for i in range(0, 95, 3)]
    moments = factors_at.lookback_moments(returns, factors_at.pieces(returns, spark.createDataFrame([(m,) for m in marks], "date date"), 17), recent=(5,))
    assert "collect_list" not in moments._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.ticker, r.as_of): r for r in moments.collect()}
    days = sorted({r[1] for r in rows})
    for t in "ABC":
        for m in marks:
            seen = [d for d in days if d <= m][-17:]
            part = [(r[2], r[3]) for r in rows if r[0] == t and r[1] in seen]
            assert ((t, m) in found) == bool(part)
            if part:
                r, x, y = found[(t, m)], [p[0] for p in part], [p[1] for p in part]
                mx, my = sum(x) / len(x), sum(y) / len(y)
                assert r.n == len(x) and r.total == pytest.approx(sum(map(abs, x)), rel=1e-9)
                assert r.xx == pytest.approx(sum((v - mx) ** 2 for v in x), rel=1e-9, abs=1e-15)
                assert r.xy == pytest.approx(sum((v - mx) * (u - my) for v, u in zip(x, y)), rel=1e-9, abs=1e-12)


def test_style_legs_with_ties_and_repeated_rows(spark):
    values = [5.0, 5.0, 5.0, 5.0, 1.0, 2.0, 2.0, 2.0, None, 3.0, 3.0]
    names = [f"T{i:02d}" for i in range(10)] + ["T09"]
    exposure = spark.createDataFrame([(n, D, *[v] * len(STYLE_COEFFICIENTS)) for n, v in zip(names, values)], "ticker string, as_of date, " + ", ".join(f"{f} double" for f in STYLE_COEFFICIENTS))
    f = next(iter(STYLE_COEFFICIENTS))
    ranked = [(n, v) for n, v in zip(names, values) if v is not None]
    quota = int(len(ranked) * 0.3)
    top = sorted(ranked, key=lambda r: (-r[1], r[0]))[:quota]
    bottom = sorted(ranked, key=lambda r: (r[1], r[0]))[:quota]
    found = {r.ticker: (r[f"top_{f}"], r[f"bottom_{f}"]) for r in factors_at.style_sides(exposure).collect()}
    assert found == {n: (float(n in dict(top)), float(n in dict(bottom))) for n in names}
    returns = spark.createDataFrame([(n, D + dt.timedelta(days=1), float(i)) for i, n in enumerate(names[:10])], "ticker string, date date, ret double")
    held = spark.createDataFrame([(D + dt.timedelta(days=1), D)], "date date, as_of date")
    want = sum(int(n[1:]) for n, _ in top) / quota - sum(int(n[1:]) for n, _ in bottom) / quota
    legs = factors_at.style_returns_at(returns, exposure, held).collect()
    assert {r.factor for r in legs} == set(STYLE_COEFFICIENTS) and all(r.factor_return == pytest.approx(want) for r in legs)
