"""Cross-sectional targets built from forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import clip
from quantloom.operators.xsection import demean, join_calendar, pct_rank, zscore


def smooth_return(df: DataFrame) -> DataFrame:
    """60/40 blend of the one- and two-month forward returns, or the first alone."""
    blend = 0.6 * F.col("future_return") + 0.4 * F.col("future_return_2m")
    return df.withColumn(
        "future_return_smooth", F.when(F.col("future_return_2m").isNull(), F.col("future_return")).otherwise(blend)
    )


def residual_return(df: DataFrame, sector: str = "sector", missing_sector_uses_date: bool = False) -> DataFrame:
    """Smooth return minus the mean of its sector that date."""
    out = demean(df, ["date", sector], {"future_return_smooth": "future_return_resid"})
    if missing_sector_uses_date:
        out = demean(out, ["date"], {"future_return_smooth": "_by_date"})
        out = out.withColumn("future_return_resid", F.coalesce("future_return_resid", "_by_date")).drop("_by_date")
    return out


def rank_targets(df: DataFrame) -> DataFrame:
    return pct_rank(
        df, ["date"], {"future_return_resid": "future_return_resid_rank", "future_return": "future_return_rank"}
    )


def scaled_targets(df: DataFrame, floor: float = 0.10, width: float = 3.0, narrow: DataFrame | None = None) -> DataFrame:
    """Volatility-scaled and z-scored targets from one pass of date statistics. ``narrow`` is a plan of the same rows with
    fewer columns, if there is one, from which the statistics are taken."""
    r = "future_return_resid"
    ready = [rows.withColumn("_t", F.col(r) / clip("volatility_20d", floor)) for rows in (df, df if narrow is None else narrow)]
    table = ready[1].groupBy("date").agg(F.avg("_t").alias("_tm"), F.stddev_samp("_t").alias("_ts"), F.avg(r).alias("_rm"), F.stddev_samp(r).alias("_rs"))
    out = join_calendar(ready[0], table)
    low, high = F.col("_tm") - width * F.col("_ts"), F.col("_tm") + width * F.col("_ts")
    return out.select(
        *df.columns,
        F.when(F.col("_ts").isNull(), F.col("_t")).otherwise(clip("_t", low, high)).alias("target_vol_scaled"),
        F.when(F.col("_rs") > 0, (F.col(r) - F.col("_rm")) / F.col("_rs")).otherwise(0.0).alias("target_regression"),
    )


def vol_scaled_target(df: DataFrame, floor: float = 0.10, width: float = 3.0) -> DataFrame:
    """Residual return over floored volatility, winsorised per date."""
    return scaled_targets(df, floor, width).drop("target_regression")


def regression_target(df: DataFrame) -> DataFrame:
    return zscore(df, ["date"], {"future_return_resid": "target_regression"})


def binary_target(df: DataFrame, cut: float = 0.9, missing_is_zero: bool = False) -> DataFrame:
    """1 for the top decile of residual returns. Ranks are rounded first so that a rank
    sitting on the cut does not depend on floating-point order."""
    hit = (F.round("future_return_resid_rank", 9) >= cut).cast("int")
    return df.withColumn("target_binary", F.coalesce(hit, F.lit(0)) if missing_is_zero else hit)
