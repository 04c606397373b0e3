"""Per-ticker time-series features, one row per bar.

All windows share ``partitionBy(ticker).orderBy(date)``: one shuffle, one sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import (
    ANNUAL_BARS,
    by_bar,
    change,
    clip,
    full,
    positive_ratio,
    ratio,
    trailing,
    upto,
)
from quantloom.session import spread

YEAR = math.sqrt(ANNUAL_BARS)

# Look-back in bars of each return feature.
RETURN_BARS = {
    "return_1d": 1,
    "return_3d": 3,
    "return_5d": 5,
    "return_1m": 21,
    "return_3m": 63,
    "return_6m": 126,
    "return_12m": 252,
}

# Names of the base features and of the subsets that get residuals and z-norms.
BASE_FEATURES = [
    *RETURN_BARS,
    "volatility_20d",
    "volatility_60d",
    "dist_from_sma_50",
    "dist_from_sma_200",
    "dist_from_52w_high",
    "dist_from_52w_low",
    "volume_ratio_20",
    "volume_ratio_60",
    "volume_zscore",
    "volume_5d_ratio",
    "return_1m_zscore",
    "return_3m_zscore",
    "vol_zscore_rolling",
    "volume_zscore_rolling",
    "mom_vol_interaction",
    "reversal_vol_interaction",
    "sma_vol_interaction",
    "high_mom_interaction",
    "vol_regime_interaction",
]
NO_RESIDUAL = {
    "return_12m",
    "dist_from_52w_high",
    "dist_from_52w_low",
    "volume_ratio_60",
    "volume_5d_ratio",
    "vol_zscore_rolling",
    "volume_zscore_rolling",
    "sma_vol_interaction",
    "high_mom_interaction",
}
RESIDUAL_FEATURES = [f for f in BASE_FEATURES if f not in NO_RESIDUAL]
ZNORM_FEATURES = [f for f in BASE_FEATURES if f not in {"vol_zscore_rolling", "volume_zscore_rolling"}]


def daily_returns(prices: DataFrame, price: str = "adj_close", name: str = "ret") -> DataFrame:
    """Simple return of each bar against the previous one."""
    return prices.withColumn(name, ratio(price, F.lag(price).over(by_bar())) - 1)


def return_features(
    prices: DataFrame, price: str = "adj_close", bars: Mapping[str, int] = RETURN_BARS, reference_lag: bool = False
) -> DataFrame:
    """Returns over several numbers of bars; NULL before that many bars exist.

    ``reference_lag`` looks one bar less far back, a known off-by-one of older code.
    """
    w = by_bar()
    shift = 1 if reference_lag else 0
    past = prices.select(
        "*", F.row_number().over(w).alias("_n"), *[F.lag(price, n - shift).over(w).alias(f"_p{n}") for n in bars.values()]
    )
    return past.select(
        *prices.columns, *[F.when(F.col("_n") > n, change(price, f"_p{n}")).alias(c) for c, n in bars.items()]
    )


def trailing_parts(df: DataFrame, moments: Mapping[str, Sequence[int]], extremes: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Count, sum and sum of squares of the last n bars (``{value}_n{n}``, ``_s``, ``_q``), and maximum and minimum
    (``extremes``: value to the span of ``_hi`` and ``_lo``).

    A sliding frame visits n bars for every bar. Here the last 2b bars are the last b and the b before them, and n is put
    together from the powers of two in it: one look back of b bars per power for all columns. Nothing is subtracted,
    so sums lose no digits.
    """
    w = by_bar()
    doubled: dict[str, tuple[Column, str, list[tuple[str, int]]]] = {}
    for v, spans in moments.items():
        x = F.col(v)
        for kind, part in (("n", x.isNotNull().cast("long")), ("s", F.coalesce(x, F.lit(0.0))), ("q", F.coalesce(x * x, F.lit(0.0)))):
            doubled[f"_d{kind}_{v}"] = (part, "sum", [(f"{v}_{kind}{n}", n) for n in spans])
    for v, named in (extremes or {}).items():
        for out, n in named.items():
            doubled[f"_d{out}_{v}"] = (F.col(v), "max" if out == "_hi" else "min", [(out, n)])
    join = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
    empty = lambda c: None if doubled[c][1] != "sum" else 0 if c.startswith("_dn_") else 0.0
    kept = df.columns
    out, begun, b = df.select("*", *[part.alias(c) for c, (part, _, _) in doubled.items()]), set(), 1
    most = max(n for _, _, spans in doubled.values() for _, n in spans)
    while b <= most:
        live = {c: s for c, s in doubled.items() if max(n for _, n in s[2]) >= b}
        grows = [c for c, s in live.items() if max(n for _, n in s[2]) >= 2 * b]
        hits = [(name, c) for c, s in live.items() for name, n in s[2] if n & b]
        back = {**{c: c for c in grows}, **{name: c for name, c in hits if name in begun}}
        looked = out.select("*", *[F.lag(c, b, empty(of)).over(w).alias(f"_back_{c}") for c, of in back.items()])
        fresh = {name: join[doubled[c][1]](F.col(c), F.col(f"_back_{name}")) if name in begun else F.col(c) for name, c in hits}
        rest = [name for name in begun if name not in fresh]
        wider = [join[doubled[c][1]](F.col(c), F.col(f"_back_{c}")).alias(c) for c in grows]
        out = looked.select(*kept, *sorted(rest), *[e.alias(name) for name, e in fresh.items()], *wider)
        begun |= set(fresh)
        b *= 2
    return out


def _mean(value: str, n: int) -> Column:
    return ratio(f"{value}_s{n}", f"{value}_n{n}")


def _sd(value: str, n: int) -> Column:
    """Sample standard deviation from the moments; rounding noise of a constant frame is 0."""
    k, s1, s2 = (F.col(f"{value}_{c}{n}") for c in "nsq")
    centred = s2 - s1 * s1 / k
    return F.when(k > 1, F.sqrt(F.when(centred > 1e-13 * s2, centred).otherwise(0.0) / (k - 1)))


def _z(value: str, n: int) -> Column:
    spread_ = _sd(value, n)
    return F.when((F.col("bar_no") >= n) & (spread_ > 0), (F.col(value) - _mean(value, n)) / spread_)


def bar_features(prices: DataFrame, forward: int = 21, reference_lag: bool = False) -> DataFrame:
    """Return, volatility, distance, volume and self-relative features of every bar,
    with the forward returns used as labels."""
    w = by_bar()
    p, v = "adj_close", "volume"
    lags = sorted({1, *[n - 1 if reference_lag else n for n in RETURN_BARS.values()]} - {0})
    first = spread(prices.select("ticker", "date", p, F.col(v).cast("double").alias(v))).select(
        "ticker",
        "date",
        p,
        v,
        F.row_number().over(w).alias("bar_no"),
        *[F.lag(p, n).over(w).alias(f"_p{n}") for n in lags],
        F.lead(p, forward).over(w).alias("_f1"),
        F.lead(p, 2 * forward).over(w).alias("_f2"),
    )

    def past(n: int) -> Column:
        n = n - 1 if reference_lag else n
        return F.col(p) if n == 0 else F.col(f"_p{n}")

    first = first.select(
        "ticker",
        "date",
        p,
        v,
        "bar_no",
        (ratio(p, "_p1") - 1).alias("ret"),
        *[F.when(F.col("bar_no") > n, change(p, past(n))).alias(c) for c, n in RETURN_BARS.items()],
        change("_f1", p).alias("future_return"),
        change("_f2", p).alias("future_return_2m"),
    )
    # Means and sums come from running totals (a growing frame is one update per bar, a
    # sliding one n); spreads and extremes are put together from doubled frames.
    h = upto()
    first = first.select(
        "*",
        F.sum(p).over(h).alias("_tp"),
        F.sum(v).over(h).alias("_tv"),
        F.coalesce(F.sum("ret").over(h), F.lit(0.0)).alias("_tr"),
        F.count("ret").over(h).alias("_tc"),
    )
    spans = {"_tp": (50, 200), "_tv": (5, 20, 60), "_tr": (21, 63), "_tc": (21, 63)}
    first = first.select("*", *[F.coalesce(F.lag(t, n).over(w), F.lit(0)).alias(f"{t}{n}") for t, ns in spans.items() for n in ns])
    since = lambda t, n: F.col(t) - F.col(f"{t}{n}")
    mean = lambda t, n: since(t, n) / F.least(F.col("bar_no"), F.lit(n))
    totals = [c for c in first.columns if c.startswith("_")]
    rolled = first.select(
        *[c for c in first.columns if c not in totals],
        mean("_tp", 50).alias("_a50"),
        mean("_tp", 200).alias("_a200"),
        mean("_tv", 5).alias("_v5"),
        mean("_tv", 20).alias("_v20"),
        mean("_tv", 60).alias("_v60"),
        since("_tr", 21).alias("_s21"),
        since("_tr", 63).alias("_s63"),
        since("_tc", 21).alias("_c21"),
        since("_tc", 63).alias("_c63"),
    )
    rolled = trailing_parts(rolled, {"ret": (19, 20, 59), v: (20,)}, {p: {"_hi": 252, "_lo": 252}})
    second = rolled.select(
        *[c for c in first.columns if c not in totals],
        (_sd("ret", 19) * YEAR).alias("volatility_20d"),
        (_sd("ret", 59) * YEAR).alias("volatility_60d"),
        change(p, "_a50").alias("dist_from_sma_50"),
        change(p, "_a200").alias("dist_from_sma_200"),
        change(p, "_hi").alias("dist_from_52w_high"),
        change(p, "_lo").alias("dist_from_52w_low"),
        positive_ratio(v, "_v20").alias("volume_ratio_20"),
        positive_ratio(v, "_v60").alias("volume_ratio_60"),
        F.when(_sd(v, 20) > 0, (F.col(v) - F.col("_v20")) / _sd(v, 20)).alias("volume_zscore"),
        positive_ratio("_v5", "_v20").alias("volume_5d_ratio"),
        full(F.col("_s21"), F.col("_c21"), 21).alias("_sum21"),
        full(F.col("_s63"), F.col("_c63"), 63).alias("_sum63"),
        full(_sd("ret", 20) * YEAR, F.col("ret_n20"), 20).alias("_vol20"),
        full(F.col("_v20"), F.col("bar_no"), 20).alias("_mv20"),
    )
    parts = trailing_parts(second, {"_sum21": (60,), "_sum63": (120,), "_vol20": (60,), "_mv20": (60,)})
    return parts.select(
        *[c for c in second.columns if not c.startswith("_")],
        _z("_sum21", 60).alias("return_1m_zscore"),
        _z("_sum63", 120).alias("return_3m_zscore"),
        _z("_vol20", 60).alias("vol_zscore_rolling"),
        _z("_mv20", 60).alias("volume_zscore_rolling"),
    )


def benchmark_features(bench: DataFrame, forward: int = 21) -> DataFrame:
    """Market volatility and trend per benchmark bar, and the forward benchmark return."""
    w = by_bar()
    p = "adj_close"
    base = bench.select(
        "ticker",
        "date",
        p,
        F.row_number().over(w).alias("_n"),
        (ratio(p, F.lag(p).over(w)) - 1).alias("_r"),
        change(p, F.lag(p, 62).over(w)).alias("market_trend"),
        change(F.lead(p, forward).over(w), F.col(p)).alias("spy_return"),
    )
    return (
        base.withColumn("market_volatility", F.stddev_samp("_r").over(trailing(19)) * YEAR)
        .where("_n >= 63")
        .select("ticker", "date", "market_volatility", "market_trend", "spy_return")
    )


def interactions(df: DataFrame) -> DataFrame:
    """Products of features that only matter together; needs market_volatility."""
    surge = F.log1p("volume_ratio_20")
    calm = F.when(
        F.col("market_volatility") != 0,
        F.when(F.col("market_volatility") > 0, F.col("volatility_20d") / F.col("market_volatility")).otherwise(F.lit(1.0)),
    )
    return df.select(
        "*",
        (F.col("return_1m") * surge).alias("mom_vol_interaction"),
        (-F.col("return_5d") * F.col("volatility_20d")).alias("reversal_vol_interaction"),
        (F.col("dist_from_sma_50") * surge).alias("sma_vol_interaction"),
        (-F.col("dist_from_52w_high") * F.col("return_3m")).alias("high_mom_interaction"),
        (F.col("return_1m") / (calm + 0.5)).alias("vol_regime_interaction"),
    )


def trailing_beta(prices: DataFrame, bench: DataFrame, lookback: int = 252) -> DataFrame:
    """Beta from the bars before the current one: sample covariance over population
    variance, more than 30 valid pairs, clipped to [-1, 3]; 1.0 for the first 60 bars."""
    w, h = by_bar(), upto()
    both = F.col("ret").isNotNull() & F.col("spy_ret").isNotNull()
    zero = lambda x: F.when(both, x).otherwise(0.0)
    x, y = F.col("ret"), F.col("spy_ret")
    parts = {"n": F.lit(1.0), "x": x, "y": y, "xy": x * y, "yy": y * y}
    totals = benchmark_joined(prices, bench).select(
        "ticker", "date", F.row_number().over(w).alias("_n"), *[F.sum(zero(c)).over(h).alias(f"_t{k}") for k, c in parts.items()]
    )
    # Window sums excluding today: running total one bar back minus the one before the window.
    spans = totals.select(
        "ticker",
        "date",
        "_n",
        *[(F.coalesce(F.lag(f"_t{k}", 1).over(w), F.lit(0.0)) - F.coalesce(F.lag(f"_t{k}", lookback + 1).over(w), F.lit(0.0))).alias(k) for k in parts],
    )
    n = F.col("n")
    cov = (F.col("xy") - F.col("x") * F.col("y") / n) / (n - 1)
    centred = F.col("yy") - F.col("y") * F.col("y") / n
    enough = (F.col("_n") > 60) & (n > 30)
    beta = F.when(enough & (centred > 1e-12 * F.col("yy")), clip(cov / (centred / n), -1.0, 3.0))
    return spans.select("ticker", "date", F.coalesce(beta, F.lit(1.0)).alias("beta"))


def benchmark_joined(prices: DataFrame, bench: DataFrame) -> DataFrame:
    """Stock returns with the benchmark return of the same date (NULL when absent)."""
    market = daily_returns(bench, name="spy_ret").select("date", "spy_ret")
    own = daily_returns(spread(prices))
    return own.join(F.broadcast(market), "date", "left")


def excess_label(prices: DataFrame, bench: DataFrame, forward: int = 21) -> DataFrame:
    """Forward return minus the benchmark's return to the same future date (as-of)."""
    from quantloom.operators.asof import asof_backward

    w = by_bar()
    ahead = spread(prices).select(
        "ticker",
        "date",
        F.col("adj_close"),
        F.lead("adj_close", forward).over(w).alias("future_price"),
        F.lead("date", forward).over(w).alias("future_date"),
    ).where("future_price IS NOT NULL")
    days = ahead.select("date").union(ahead.select(F.col("future_date"))).distinct()
    level = asof_backward(
        days.withColumn("series", F.lit("market")),
        bench.select("date", F.col("adj_close").alias("level")).withColumn("series", F.lit("market")),
        ["level"],
        on=["series"],
    ).select("date", "level")
    now = level.withColumnRenamed("level", "bench_now")
    then = level.select(F.col("date").alias("future_date"), F.col("level").alias("bench_then"))
    both = ahead.join(F.broadcast(now), "date").join(F.broadcast(then), "future_date")
    excess = change("future_price", "adj_close") - change("bench_then", "bench_now")
    return both.select(
        "ticker", "date", "future_date", excess.alias("target_excess"), (excess > 0).cast("int").alias("target_binary")
    )


def fundamental_features(fund: DataFrame) -> DataFrame:
    inverse = lambda c: F.when(F.col(c) > 0, 1 / F.col(c))
    return fund.select(
        "*", inverse("pe_ratio").alias("earnings_yield"), inverse("pb_ratio").alias("book_to_price")
    )


def live_features(prices: DataFrame, min_bars: int = 100) -> DataFrame:
    """Features of the newest bar of each ticker from the one-year window before it;
    the first return counts as zero and highs and lows span the whole window."""
    w, newest = by_bar(), Window.partitionBy("ticker")
    recent = spread(prices).withColumn("_last", F.max("date").over(newest)).where("date > add_months(_last, -12)")
    base = recent.select(
        "ticker",
        "date",
        "close",
        "volume",
        F.row_number().over(w).alias("_n"),
        F.coalesce(ratio("close", F.lag("close").over(w)) - 1, F.lit(0.0)).alias("_r"),
        F.col("_last"),
    )

    rolled = base.select(
        "*",
        *[F.lag("close", n).over(w).alias(f"_p{n}") for n in (3, 5, 21, 63, 126)],
        F.first("close").over(upto()).alias("_open"),
        F.max("close").over(upto()).alias("_hi"),
        F.min("close").over(upto()).alias("_lo"),
        F.stddev_samp("_r").over(trailing(20)).alias("_sd20"),
        F.stddev_samp("_r").over(trailing(60)).alias("_sd60"),
        F.avg("close").over(trailing(50)).alias("_a50"),
        F.avg("close").over(trailing(200)).alias("_a200"),
        F.avg("volume").over(trailing(20)).alias("_v20"),
        F.stddev_samp("volume").over(trailing(20)).alias("_vs20"),
    ).where(f"date = _last AND _n >= {min_bars}")

    def back(n: int) -> Column:
        return F.when(F.col("_n") >= n, ratio("close", F.coalesce(f"_p{n}", "_open")) - 1)

    def sma_gap(n: int) -> Column:
        return change("close", full(F.col(f"_a{n}"), F.col("_n"), n))

    return rolled.select(
        "ticker",
        "date",
        F.col("close").alias("current_price"),
        F.col("_r").alias("return_1d"),
        back(3).alias("return_3d"),
        back(5).alias("return_5d"),
        back(21).alias("return_1m"),
        back(63).alias("return_3m"),
        back(126).alias("return_6m"),
        (F.col("_sd20") * YEAR).alias("volatility_20d"),
        (F.col("_sd60") * YEAR).alias("volatility_60d"),
        sma_gap(50).alias("dist_from_sma_50"),
        sma_gap(200).alias("dist_from_sma_200"),
        change("close", "_hi").alias("dist_from_52w_high"),
        change("close", "_lo").alias("dist_from_52w_low"),
        positive_ratio("volume", "_v20").alias("volume_ratio_20"),
        F.when(F.col("_vs20") > 0, (F.col("volume") - F.col("_v20")) / F.col("_vs20")).alias("volume_zscore"),
    )


LIVE_RANKED = [
    "return_1d",
    "return_3d",
    "return_5d",
    "return_1m",
    "return_3m",
    "return_6m",
    "volatility_20d",
    "volatility_60d",
    "dist_from_sma_50",
    "dist_from_sma_200",
    "dist_from_52w_high",
    "dist_from_52w_low",
    "volume_ratio_20",
    "volume_zscore",
]


def require(df: DataFrame, wanted: Mapping[str, float] | list[str], fill: bool = False) -> DataFrame:
    """Keep the wanted columns that exist; absent ones are skipped or filled with 0."""
    present = set(df.columns)
    if fill:
        return df.select("*", *[F.lit(0.0).alias(c) for c in wanted if c not in present])
    return df.select(*[c for c in wanted if c in present])
