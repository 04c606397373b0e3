"""Month-end feature table: bars by ticker, then cross-sections by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import labels, panel
from quantloom.operators.asof import asof_backward, sample_at
from quantloom.operators.xsection import join_calendar, pct_rank
from quantloom.session import reliable


def month_ends(prices: DataFrame) -> DataFrame:
    """Last trading date of each calendar month."""
    return prices.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date")).select("date")


def month_end_features(
    prices: DataFrame,
    bench: DataFrame,
    meta: DataFrame | None = None,
    forward: int = 21,
    min_bars: int = 252,
    max_staleness: int | None = None,
    reference_lag: bool = False,
) -> DataFrame:
    """Raw features of every ticker as of every month end that has a market row."""
    ends = month_ends(prices)
    bars = panel.bar_features(prices, forward, reference_lag)
    rows = sample_at(bars, ends, max_staleness=max_staleness).where(F.col("bar_no") >= min_bars).where("adj_close > 0")
    market = sample_at(panel.benchmark_features(bench, forward), ends).select(
        "date", "market_volatility", "market_trend", "spy_return"
    )
    out = join_calendar(rows, market, how="inner")
    out = panel.interactions(out)
    known = F.col("spy_return").isNotNull()
    out = out.withColumn("target_excess", F.col("future_return") - F.col("spy_return"))
    out = out.withColumn("future_return", F.when(known, F.col("future_return")))
    if meta is not None:
        out = out.join(meta.select("ticker", "sector"), "ticker", "left")
    return out


def cross_section(df: DataFrame) -> DataFrame:
    """Ranks, sector residuals, z-norms and targets of the month-end rows.

    The rows are written once (they are about a twentieth of the bars) because several
    aggregations meet them again, and so are both tables of group statistics, a row per date and
    per date and sector. The ranks are one long pass over the rows with the residual target; residuals and
    z-norms are added in place after it, so neither is written or moved.
    """
    rows = reliable(labels.smooth_return(df))
    by_date = {f"_m_{c}": F.avg(c) for c in panel.ZNORM_FEATURES}
    by_date |= {f"_s_{c}": F.stddev_samp(c) for c in panel.ZNORM_FEATURES}
    residuals = {**{c: f"{c}_resid" for c in panel.RESIDUAL_FEATURES}, "future_return_smooth": "future_return_resid"}
    dates = reliable(rows.groupBy("date").agg(*[c.alias(n) for n, c in by_date.items()]))
    sectors = reliable(rows.groupBy("date", "sector").agg(*[F.avg(c).alias(f"_g_{c}") for c in residuals]))
    less = lambda c: (F.col(c) - F.col(f"_g_{c}")).alias(residuals[c])
    znorm = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    smooth = "future_return_smooth"
    base = rows.join(sectors.select("date", "sector", f"_g_{smooth}"), ["date", "sector"], "left").select(*rows.columns, less(smooth))
    ranks = {c: f"{c}_rank" for c in panel.BASE_FEATURES}
    ranks |= {"future_return_resid": "future_return_resid_rank", "future_return": "future_return_rank"}
    wide = join_calendar(pct_rank(base, ["date"], ranks), dates).join(sectors.drop(f"_g_{smooth}"), ["date", "sector"], "left")
    wide = wide.select(
        *base.columns,
        *[less(c) for c in panel.RESIDUAL_FEATURES],
        *[znorm(c).alias(f"{c}_znorm") for c in panel.ZNORM_FEATURES],
        *ranks.values(),
    )
    return labels.binary_target(labels.scaled_targets(wide, narrow=base))


def feature_table(prices: DataFrame, bench: DataFrame, meta: DataFrame, forward: int = 21) -> DataFrame:
    """The whole build; rows without a label drop out after the cross-sections."""
    full = cross_section(month_end_features(prices, bench, meta, forward))
    return full.where("target_excess IS NOT NULL")


# The compact feature set and its ranked members.
COMPACT_RANKED = [
    "return_1m",
    "return_3m",
    "return_6m",
    "return_12m",
    "volatility_20d",
    "volatility_60d",
    "dist_from_sma_50",
    "dist_from_sma_200",
    "dist_from_52w_high",
    "dist_from_52w_low",
    "volume_ratio",
]
COMPACT_FUNDAMENTALS = ["earnings_yield", "book_to_price", "roe", "profit_margin", "debt_to_equity"]


def compact_features(prices: DataFrame, bench: DataFrame, fundamentals: DataFrame, forward: int = 21) -> DataFrame:
    """The smaller feature set: tickers with a bar on the rebalance date itself, price and
    fundamental features, market features, label and ranks."""
    rows = month_end_features(prices, bench, None, forward).where("bar_date = date")
    keep = ["ticker", "date", *[c for c in COMPACT_RANKED if c != "volume_ratio"], F.col("volume_ratio_20").alias("volume_ratio")]
    rows = rows.select(*keep, "market_volatility", "market_trend", F.lit(None).cast("double").alias("sector_return"))
    rows = asof_backward(rows, panel.fundamental_features(fundamentals), COMPACT_FUNDAMENTALS)
    rows = rows.join(panel.excess_label(prices, bench, forward).drop("future_date"), ["ticker", "date"], "left")
    return pct_rank(reliable(rows), ["date"], {c: f"{c}_rank" for c in COMPACT_RANKED})
