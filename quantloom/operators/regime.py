"""Market regimes. All inputs are benchmark-sized (one row per date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar, full, ratio, trailing
from quantloom.operators import ladders


def regime_inputs(bench: DataFrame, vix: DataFrame | None = None, default_vix: float = 20.0) -> DataFrame:
    """Volatility index (default when absent), % distance to the 200-bar mean (0 before
    200 bars) and 20-return volatility in % (15 before that) per benchmark bar."""
    w = by_bar()
    rows = bench.select(
        "ticker", "date", "close", F.row_number().over(w).alias("_n"), (ratio("close", F.lag("close").over(w)) - 1).alias("_r")
    )
    rows = rows.select("*", F.avg("close").over(trailing(200)).alias("_a200"), F.stddev_samp("_r").over(trailing(20)).alias("_sd"))
    out = rows.select(
        "date",
        F.coalesce(full((F.col("close") / F.col("_a200") - 1) * 100, F.col("_n"), 200), F.lit(0.0)).alias("spy_trend"),
        F.coalesce(full(F.col("_sd") * (252**0.5) * 100, F.col("_n"), 20), F.lit(15.0)).alias("spy_volatility"),
    )
    if vix is None:
        return out.withColumn("vix", F.lit(default_vix))
    return out.join(F.broadcast(vix.select("date", "vix")), "date", "left").fillna(default_vix, ["vix"])


def six_state() -> Column:
    v, t, s = F.col("vix"), F.col("spy_trend"), F.col("spy_volatility")
    return (
        F.when((v > 30) | (s > 25), "high_volatility")
        .when((t < -5) & (v > 20), "bear")
        .when((t > 5) & (v < 15), "bull")
        .when((v < 15) & (t > 0), "risk_on")
        .when(v > 25, "risk_off")
        .otherwise("sideways")
    )


def regime_flags(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        *[
            (F.col("regime") == r).cast("int").alias(f"regime_{short}")
            for r, short in [("bull", "bull"), ("bear", "bear"), ("high_volatility", "high_vol"), ("risk_off", "risk_off")]
        ],
        F.col("vix").alias("vix_level"),
    )


def risk_level(df: DataFrame) -> DataFrame:
    """Exposure guard from the volatility index and the 200-bar mean."""
    level = F.when((F.col("vix") > 30) | (F.col("spy_trend") < 0), "HIGH_RISK").when(F.col("vix") > 20, "ELEVATED").otherwise("NORMAL")
    scale = F.when(F.col("risk_level") == "HIGH_RISK", 0.25).when(F.col("risk_level") == "ELEVATED", 0.5).otherwise(1.0)
    return df.withColumn("risk_level", level).withColumn("position_scale", scale)


def three_state(returns: DataFrame, value: str = "spy_ret", lookback: int = 63) -> DataFrame:
    """Crisis / high_vol / normal from volatility and worst drawdown of the last returns.

    The window's returns are folded in an array of at most ``lookback`` values; the
    series is one benchmark.
    """
    w = trailing(lookback, "series")
    rows = returns.where(F.col(value).isNotNull()).withColumn("series", F.lit("market"))
    rolled = rows.select(
        "date",
        F.count(value).over(w).alias("_n"),
        (F.stddev_samp(value).over(w) * (252**0.5)).alias("vol_63"),
        F.collect_list(value).over(w).alias("_rs"),
    )
    start = F.struct(F.lit(1.0).alias("level"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, r: Column) -> Column:
        level = acc["level"] * (1 + r)
        peak = F.coalesce(F.greatest(acc["peak"], level), level)
        return F.struct(level.alias("level"), peak.alias("peak"), F.least(acc["worst"], level / peak - 1).alias("worst"))

    out = rolled.withColumn("drawdown_63", F.aggregate("_rs", start, step)["worst"])
    crisis = (F.col("vol_63") > 0.30) | (F.col("drawdown_63") < -0.15)
    tense = (F.col("vol_63") > 0.22) | (F.col("drawdown_63") < -0.08)
    state = F.when(F.col("_n") < lookback, "normal").when(crisis, "crisis").when(tense, "high_vol").otherwise("normal")
    return out.select("date", "vol_63", "drawdown_63", state.alias("state"))


def regime_parameters(states: DataFrame) -> DataFrame:
    data = [(k, *v.values()) for k, v in ladders.REGIME_PARAMETERS.items()]
    names = list(next(iter(ladders.REGIME_PARAMETERS.values())))
    table = states.sparkSession.createDataFrame([(d[0], *[float(x) for x in d[1:]]) for d in data], ["state", *names])
    return states.join(F.broadcast(table), "state")


def adjust_weights(book: DataFrame, regime: str = "market_regime", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Low dispersion lifts index names (×1.5 against ×0.7, scaled back to the same sum
    of 1); high volatility keeps 30 % in cash."""
    low = (F.col(regime) == "LOW_DISPERSION") | (F.col("dispersion") < 0.15)
    high = (F.col(regime) == "HIGH_VOL") | (F.col("vix") > 30)
    rows = book.withColumn("_w", F.when(low, F.col("weight") * F.when(F.col("is_mega_cap"), 1.5).otherwise(0.7)))
    total = rows.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    rows = rows.join(F.broadcast(total) if keys == ("date",) else total, list(keys))
    out = F.when(low, F.col("_w") / F.col("_t")).when(high, F.col("weight") * 0.70).otherwise(F.col("weight"))
    return rows.withColumn("adjusted_weight", out).drop("_w", "_t")
