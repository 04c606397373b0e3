"""Technical indicators for every bar.

Exponential averages are recursive, y(t) = (1−a)·y(t−1) + a·x(t), seeded with the first
value. They are computed with windows, not with per-row Python: the series is cut into
blocks, inside a block the recursion has the closed form
(1−a)^j · Σ a·x(i)·(1−a)^(−i), and the carry from earlier blocks is the closing value of
the previous block. The block length follows from a: as long as the growing factor stays
finite (below 10^200), which is also so long that what is older than one full block weighs
less than 10^-30 and cannot change a double. Averages whose lengths fit share their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar, full, ratio, trailing, upto
from quantloom.operators.panel import trailing_parts
from quantloom.session import spread

#: Largest growing factor inside a block, and the greatest weight that may be left out.
GROWTH, NEGLIGIBLE = 1e200, 1e-30


def _block_length(alpha: float) -> int:
    return max(1, int(math.log(GROWTH) / -math.log1p(-alpha))) if alpha < 1 else 1


def _shared_blocks(columns: Mapping[str, tuple[str, float]]) -> list[tuple[int, dict[str, tuple[str, float]]]]:
    """(block length, columns): columns share the blocks of the fastest one as long as a block
    still covers all the history that they can show."""
    out: list[tuple[int, dict]] = []
    for name, (source, alpha) in sorted(columns.items(), key=lambda c: -c[1][1]):
        if out and (alpha >= 1 or (1 - alpha) ** out[-1][0] <= NEGLIGIBLE):
            out[-1][1][name] = (source, alpha)
        else:
            out.append((_block_length(alpha), {name: (source, alpha)}))
    return out


def ema(df: DataFrame, columns: Mapping[str, tuple[str, float]], key: str = "ticker") -> DataFrame:
    """Add exponential averages: ``{target: (source, alpha)}``. A source may start late
    (leading NULLs); after its first value it has one at every bar.
    """
    out = df
    for block, some in _shared_blocks(columns):
        out = _ema(out, some, key, block)
    return out.select(*df.columns, *columns)


def _ema(df: DataFrame, columns: Mapping[str, tuple[str, float]], key: str, block: int) -> DataFrame:
    """Exponential averages over blocks of one length.

    Series windows order by (block, date), which is the date order, so the block windows
    and the series windows share one sort.
    """
    sources = sorted({s for s, _ in columns.values()})
    w = upto(key)
    out = df.select(
        "*", (F.row_number().over(by_bar(key)) - 1).alias("_i"), *[F.count(s).over(w).alias(f"_n_{s}") for s in sources]
    )
    out = out.select("*", F.floor(F.col("_i") / block).alias("_b"), (F.col("_i") % block).cast("double").alias("_j"))
    inside = Window.partitionBy(key, "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    series = Window.partitionBy(key).orderBy("_b", "date")
    grow, shrink = (lambda a: F.pow(F.lit(1 - a), -F.col("_j"))), (lambda a: F.pow(F.lit(1 - a), F.col("_j")))
    terms = []
    for t, (s, a) in columns.items():
        weight = F.when(F.col(f"_n_{s}") == 1, F.lit(1.0)).otherwise(F.lit(a))
        terms.append(F.coalesce(weight * F.col(s) * grow(a), F.lit(0.0)).alias(f"_x_{t}"))
    out = out.select("*", *terms)
    out = out.select("*", *[F.sum(f"_x_{t}").over(inside).alias(f"_s_{t}") for t in columns])
    out = out.select("*", *[(F.col(f"_s_{t}") * shrink(a)).alias(f"_y_{t}") for t, (_, a) in columns.items()])
    out = out.select("*", *[F.lag(f"_y_{t}").over(series).alias(f"_l_{t}") for t in columns])
    out = out.select("*", *[F.first(f"_l_{t}").over(inside).alias(f"_c_{t}") for t in columns])
    final = []
    for t, (s, a) in columns.items():
        carry = F.when(F.col("_b") > 0, F.coalesce(f"_c_{t}", F.lit(0.0)) * shrink(a) * (1 - a)).otherwise(0.0)
        final.append(F.when(F.col(f"_n_{s}") > 0, F.col(f"_y_{t}") + carry).alias(t))
    return out.select(*df.columns, *final)


def strength(gain: str, loss: str):
    """Relative strength index from average gain and loss; no loss means 100."""
    g, lo = F.col(gain), F.col(loss)
    return F.when(lo == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + g / lo))


def smoothed_indicators(prices: DataFrame, n: int = 14) -> DataFrame:
    """RSI, MACD, ATR and ADX with exponential / Wilder smoothing."""
    w = by_bar()
    a = 1.0 / n
    moves = spread(prices).select(
        "ticker",
        "date",
        "close",
        "high",
        "low",
        (F.col("close") - F.lag("close").over(w)).alias("_d"),
        F.lag("close").over(w).alias("_pc"),
        (F.col("high") - F.lag("high").over(w)).alias("_up"),
        (F.lag("low").over(w) - F.col("low")).alias("_dn"),
    )
    up, dn = F.col("_up"), F.col("_dn")
    parts = moves.select(
        "ticker",
        "date",
        "close",
        F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))).alias("_g"),
        F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))).alias("_l"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))).alias("_tr"),
        F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)).alias("_pdm"),
        F.when(up.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0)).alias("_mdm"),
    )
    first = ema(
        parts,
        {
            "_e12": ("close", 2 / 13),
            "_e26": ("close", 2 / 27),
            "_ag": ("_g", a),
            "_al": ("_l", a),
            "atr": ("_tr", a),
            "_ap": ("_pdm", a),
            "_am": ("_mdm", a),
        },
    )
    pdi, mdi = 100 * ratio("_ap", "atr"), 100 * ratio("_am", "atr")
    mid = first.select(
        "ticker",
        "date",
        "close",
        "atr",
        F.when(F.col("_ag").isNotNull(), strength("_ag", "_al")).alias("rsi"),
        (F.col("_e12") - F.col("_e26")).alias("macd"),
        F.when(F.col("_ap").isNotNull(), F.coalesce(100 * F.try_divide(F.abs(pdi - mdi), pdi + mdi), F.lit(0.0))).alias("_dx"),
    )
    out = ema(mid, {"macd_signal": ("macd", 0.2), "adx": ("_dx", a)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_dx")


def level_indicators(prices: DataFrame) -> DataFrame:
    """Moving averages, year high and low with distances, volume average and ratio. Means and extremes are
    put together from doubled frames (``trailing_parts``), so no bar visits the last 252."""
    bars = spread(prices.select("ticker", "date", "close", "high", "low", "volume"))
    bars = bars.select("*", F.row_number().over(by_bar()).alias("bar_no"))
    rolled = trailing_parts(bars, {"close": (20, 50, 200), "volume": (20,)}, {"high": {"_hi": 252}, "low": {"_lo": 252}})
    rolled = rolled.select(
        "ticker",
        "date",
        "close",
        "volume",
        "bar_no",
        *[ratio(f"close_s{k}", f"close_n{k}").alias(f"_a{k}") for k in (20, 50, 200)],
        F.col("_hi").alias("high_52w"),
        F.col("_lo").alias("low_52w"),
        ratio("volume_s20", "volume_n20").alias("_v20"),
    )
    out = rolled.select(
        "ticker",
        "date",
        "close",
        "volume",
        "bar_no",
        *[full(F.col(f"_a{k}"), F.col("bar_no"), k).alias(f"sma_{k}") for k in (20, 50, 200)],
        "high_52w",
        "low_52w",
        ((F.col("close") - F.col("high_52w")) / F.col("high_52w") * 100).alias("dist_high_pct"),
        ((F.col("close") - F.col("low_52w")) / F.col("low_52w") * 100).alias("dist_low_pct"),
        full(F.floor("_v20"), F.col("bar_no"), 20).alias("volume_sma_20"),
    )
    return out.withColumn("volume_ratio", F.when(F.col("volume_sma_20") > 0, F.col("volume") / F.col("volume_sma_20")))


def band_indicators(prices: DataFrame) -> DataFrame:
    """Simple-mean RSI, Bollinger position and width, stochastic %K."""
    w = by_bar()
    moves = spread(prices).select(
        "ticker", "date", "close", "high", "low", F.row_number().over(w).alias("_n"), (F.col("close") - F.lag("close").over(w)).alias("_d")
    )
    rolled = moves.select(
        "*",
        F.avg(F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)).over(trailing(14)).alias("_g"),
        F.avg(F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)).over(trailing(14)).alias("_l"),
        F.avg("close").over(trailing(20)).alias("_m"),
        F.stddev_samp("close").over(trailing(20)).alias("_s"),
        F.max("high").over(trailing(14)).alias("_h"),
        F.min("low").over(trailing(14)).alias("_lo"),
    )
    width = 4 * F.col("_s")
    ready = F.col("_n") >= 20
    return rolled.select(
        "ticker",
        "date",
        F.when(F.col("_n") < 15, 50.0).otherwise(strength("_g", "_l")).alias("rsi_simple"),
        F.when(ready & (width > 0), (F.col("close") - F.col("_m") + 2 * F.col("_s")) / width).otherwise(0.5).alias("bb_position"),
        F.when(ready & (F.col("_m") > 0), width / F.col("_m")).otherwise(0.0).alias("bb_width"),
        F.when((F.col("_n") >= 14) & (F.col("_h") > F.col("_lo")), (F.col("close") - F.col("_lo")) / (F.col("_h") - F.col("_lo")) * 100)
        .otherwise(50.0)
        .alias("stochastic_k"),
    )


def flags(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        (F.coalesce("rsi", F.lit(50.0)) < 30).cast("int").alias("rsi_oversold"),
        (F.coalesce("rsi", F.lit(50.0)) > 70).cast("int").alias("rsi_overbought"),
        (F.coalesce("macd", F.lit(0.0)) > F.coalesce("macd_signal", F.lit(0.0))).cast("int").alias("macd_bullish"),
    )


def price_block(prices: DataFrame) -> DataFrame:
    """Single-ticker model features from prices, with neutral defaults on short history."""
    w = by_bar()
    lags = (1, 5, 10, 20, 60)
    base = spread(prices).select(
        "ticker", "date", "close", F.row_number().over(w).alias("_n"), *[F.lag("close", k).over(w).alias(f"_p{k}") for k in lags]
    ).withColumn("_r", ratio("close", "_p1") - 1)
    rolled = base.select(
        "*",
        *[F.stddev_samp("_r").over(trailing(k)).alias(f"_s{k}") for k in (5, 20, 60)],
        *[F.avg("close").over(trailing(k)).alias(f"_a{k}") for k in (20, 50, 200)],
        F.max("close").over(trailing(252)).alias("_hi"),
        F.min("close").over(trailing(252)).alias("_lo"),
        *[F.sum("_r").over(trailing(k)).alias(f"_m{k}") for k in (5, 20)],
        F.avg("_r").over(trailing(10)).alias("_r10"),
        F.avg("_r").over(trailing(20)).alias("_r20"),
    )
    n, c = F.col("_n"), F.col("close")

    def since(k: int, value, default: float):
        return F.coalesce(F.when(n > k, value), F.lit(default))

    return rolled.select(
        "ticker",
        "date",
        *[since(k, ratio("close", f"_p{k}") - 1, 0.0).alias(f"return_{k}d") for k in lags],
        *[since(k + 1, F.col(f"_s{k}"), 0.0).alias(f"volatility_{k}d") for k in (5, 20, 60)],
        (c / F.col("_hi") - 1).alias("pct_from_high_52w"),
        (c / F.col("_lo") - 1).alias("pct_from_low_52w"),
        (F.col("_a20") / c).alias("sma_20"),
        since(50, F.col("_a50") / c, 1.0).alias("sma_50"),
        since(200, F.col("_a200") / c, 1.0).alias("sma_200"),
        since(20, c / F.col("_a20") - 1, 0.0).alias("price_vs_sma20"),
        since(50, c / F.col("_a50") - 1, 0.0).alias("price_vs_sma50"),
        since(6, F.col("_m5"), 0.0).alias("momentum_5d"),
        since(21, F.col("_m20"), 0.0).alias("momentum_20d"),
        since(21, F.try_divide(F.col("_r10"), F.col("_r20")), 1.0).alias("return_acceleration"),
    )


def volume_block(prices: DataFrame) -> DataFrame:
    w = by_bar()
    base = spread(prices).select(
        "ticker",
        "date",
        F.col("volume").cast("double").alias("v"),
        F.row_number().over(w).alias("_n"),
        (ratio("close", F.lag("close").over(w)) - 1).alias("_r"),
        (ratio("volume", F.lag("volume").over(w)) - 1).alias("_dv"),
        (F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")).alias("_obv"),
    )
    rolled = base.select(
        "*",
        *[F.avg("v").over(trailing(k)).alias(f"_a{k}") for k in (5, 10, 20)],
        F.covar_pop("_r", "_dv").over(trailing(20)).alias("_cov"),
        F.stddev_pop(F.when(F.col("_dv").isNotNull(), F.col("_r"))).over(trailing(20)).alias("_sr"),
        F.stddev_pop(F.when(F.col("_r").isNotNull(), F.col("_dv"))).over(trailing(20)).alias("_sv"),
        F.sum("_obv").over(trailing(10)).alias("_o"),
        F.sum("v").over(trailing(10)).alias("_t"),
    )
    n = F.col("_n")
    safe = lambda x, d: F.coalesce(x, F.lit(d))
    return rolled.select(
        "ticker",
        "date",
        safe(F.when(F.col("_a5") > 0, F.col("v") / F.col("_a5")), 1.0).alias("volume_vs_avg_5d"),
        safe(F.when(F.col("_a20") > 0, F.col("v") / F.col("_a20")), 1.0).alias("volume_vs_avg_20d"),
        safe(F.when((n > 10) & (F.col("_a10") > 0), F.col("_a5") / F.col("_a10")), 1.0).alias("volume_trend_5d"),
        safe(F.when(n > 20, F.try_divide(F.col("_cov"), F.col("_sr") * F.col("_sv"))), 0.0).alias("price_volume_corr"),
        safe(F.when((n > 10) & (F.col("_t") > 0), F.col("_o") / F.col("_t")), 0.0).alias("obv_10d"),
    )


# Fundamentals used by a single-ticker model and their neutral defaults.
FUNDAMENTAL_DEFAULTS = {
    "pe_ratio": 20.0,
    "peg_ratio": 2.0,
    "pb_ratio": 3.0,
    "ps_ratio": 2.0,
    "roe": 0.10,
    "roa": 0.05,
    "profit_margin": 0.05,
    "operating_margin": 0.10,
    "revenue_growth": 0.0,
    "earnings_growth": 0.0,
    "debt_to_equity": 1.0,
    "current_ratio": 1.5,
    "dividend_yield": 0.0,
}


def fundamental_block(fund: DataFrame) -> DataFrame:
    """Ratios with neutral defaults; zero counts as missing; payout capped at 2."""
    some = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(d))
    return fund.select(
        "ticker",
        "date",
        *[some(c, d).alias(c) for c, d in FUNDAMENTAL_DEFAULTS.items()],
        F.least(F.coalesce("payout_ratio", F.lit(0.0)), F.lit(2.0)).alias("payout_ratio"),
        (F.coalesce("free_cash_flow", F.lit(0)) > 0).cast("int").alias("has_positive_fcf"),
    )


def training_windows(prices: DataFrame, forward: int = 21, start: int = 60) -> DataFrame:
    """Bars with ``start`` earlier bars and ``forward`` later ones: forward return, direction."""
    w = by_bar()
    rows = spread(prices).select(
        "ticker",
        "date",
        F.row_number().over(w).alias("_n"),
        (ratio(F.lead("close", forward).over(w), F.col("close")) - 1).alias("forward_return"),
    )
    kept = rows.where((F.col("_n") > start) & F.col("forward_return").isNotNull())
    return kept.select("ticker", "date", "forward_return", (F.col("forward_return") > 0).cast("int").alias("direction"))


def history_risk(prices: DataFrame, bench: DataFrame, along: bool = False) -> DataFrame:
    """Risk of the whole history up to each bar: volatility, volatility of volatility,
    worst drawdown and benchmark beta (60 matched returns). Growing frames: linear.
    With ``along`` the rows are those of another block: dealt out by ticker already, and all their columns stay."""
    from quantloom.operators.panel import daily_returns

    market = daily_returns(bench, "close", "spy_ret").select("date", "spy_ret")
    kept = [c for c in prices.columns if c not in ("ticker", "date", "close")] if along else []
    rows = daily_returns(prices if along else spread(prices), "close").join(F.broadcast(market), "date", "left")
    h = upto()
    both = F.col("ret").isNotNull() & F.col("spy_ret").isNotNull()
    one = rows.select(
        "ticker",
        "date",
        "close",
        *kept,
        F.count("ret").over(h).alias("n_returns"),
        F.stddev_samp("ret").over(h).alias("_sd"),
        F.avg("ret").over(h).alias("mean_return"),
        F.stddev_samp("ret").over(trailing(20)).alias("_s20"),
        F.count("ret").over(trailing(20)).alias("_c20"),
        F.max("close").over(h).alias("_peak"),
        F.covar_samp("ret", "spy_ret").over(h).alias("_cov"),
        F.var_samp(F.when(both, F.col("spy_ret"))).over(h).alias("_var"),
        F.count(F.when(both, 1)).over(h).alias("_pairs"),
    )
    two = one.select("*", full(F.col("_s20"), F.col("_c20"), 20).alias("_v"), (F.col("close") / F.col("_peak") - 1).alias("_dd"))
    three = two.select(
        "*", F.stddev_samp("_v").over(h).alias("_vs"), F.avg("_v").over(h).alias("_vm"), F.min("_dd").over(h).alias("_worst")
    )
    return three.select(
        "ticker",
        "date",
        *(["close", *kept] if along else []),
        "n_returns",
        "mean_return",
        F.col("_sd").alias("daily_vol"),
        (F.col("_sd") * (252**0.5) * 100).alias("volatility_annual"),
        F.try_divide(F.col("_vs"), F.col("_vm")).alias("vol_of_vol"),
        (F.abs("_worst") * 100).alias("worst_drawdown"),
        F.when(F.col("_pairs") >= 60, ratio("_cov", "_var")).alias("history_beta"),
    )
