"""Risk and performance of return series, keyed by strategy or ticker."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar, ratio, upto
from quantloom.operators.summaries import compound
from quantloom.session import spread

STRATEGY = ("strategy",)


def single_stock(prices: DataFrame, rf: float = 0.02) -> DataFrame:
    """Annual volatility %, Sharpe and worst drawdown % of the history up to each bar,
    from 30 returns on."""
    h = upto()
    rows = spread(prices).select("ticker", "date", "close", (ratio("close", F.lag("close").over(by_bar())) - 1).alias("ret"))
    live = F.when(F.col("ret").isNotNull(), F.col("close"))
    rows = rows.select("*", F.max(live).over(h).alias("_peak"))
    rows = rows.withColumn("_dd", F.when(F.col("ret").isNotNull(), F.col("close") / F.col("_peak") - 1))
    out = rows.select(
        "ticker",
        "date",
        F.count("ret").over(h).alias("_n"),
        F.stddev_samp("ret").over(h).alias("_sd"),
        F.avg("ret").over(h).alias("_mu"),
        F.min("_dd").over(h).alias("_worst"),
    ).where("_n >= 30")
    return out.select(
        "ticker",
        "date",
        (F.col("_sd") * math.sqrt(252) * 100).alias("volatility_annual"),
        F.when(F.col("_sd") > 0, math.sqrt(252) * (F.col("_mu") - rf / 252) / F.col("_sd")).otherwise(0.0).alias("sharpe"),
        (F.col("_worst") * 100).alias("max_drawdown"),
    )


def curves(returns: DataFrame, columns: Sequence[str], keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Running growth ∏(1+r) of each column, valid for any return including −100 %."""
    w = upto(*keys)
    return returns.select("*", *[F.product(1 + F.col(c)).over(w).alias(f"{c}_curve") for c in columns])


def drawdowns(returns: DataFrame, value: str = "r", keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Drawdown of every date from the running peak of the growth curve."""
    w = upto(*keys)
    grown = curves(returns, [value], keys)
    level = F.col(f"{value}_curve")
    peaked = grown.withColumn("_peak", F.max(level).over(w))
    return peaked.withColumn("drawdown", (level - F.col("_peak")) / F.col("_peak")).drop("_peak")


def max_drawdown(returns: DataFrame, value: str = "r", keys: Sequence[str] = STRATEGY) -> DataFrame:
    return drawdowns(returns, value, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def historical_var(value: str = "r", level: float = 0.95) -> Column:
    return F.greatest(-F.percentile(value, 1 - level), F.lit(0.0))


def parametric_var(value: str = "r", level: float = 0.95) -> Column:
    z = NormalDist().inv_cdf(1 - level)
    return F.greatest(-(F.avg(value) + F.stddev_samp(value) * z), F.lit(0.0))


def tail_risk(returns: DataFrame, value: str = "r", level: float = 0.95, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """VaR and the mean loss strictly beyond it (VaR itself when there is none)."""
    var = returns.groupBy(*keys).agg(historical_var(value, level).alias("var"))
    beyond = F.when(F.col(value) < -F.col("var"), F.col(value))
    out = returns.join(var, list(keys)).groupBy(*keys, "var").agg((-F.avg(beyond)).alias("_c"))
    return out.withColumn("cvar", F.greatest(F.coalesce("_c", "var"), F.lit(0.0))).drop("_c")


def omega(value: str = "r", threshold: float = 0.0) -> Column:
    """Gains over losses around a threshold; NULL (unbounded) without losses, 1 if flat."""
    x = F.col(value) - threshold
    gains = F.sum(F.when(x > 0, x).otherwise(0.0))
    losses = -F.sum(F.when(x < 0, x).otherwise(0.0))
    return F.when(losses > 0, gains / losses).when(gains == 0, F.lit(1.0))


def downside(value: str = "r", threshold: float = 0.0) -> Column:
    return F.stddev_samp(F.when(F.col(value) < threshold, F.col(value)))


def sortino(value: str = "r", rf: float = 0.0, periods: int = 252) -> Column:
    """Mean excess over downside deviation; NULL (unbounded) without downside."""
    sd = downside(value)
    return F.when(sd > 0, (F.avg(value) - rf / periods) / sd)


def downside_deviation(value: str = "r", threshold: float = 0.0, periods: int = 252) -> Column:
    return F.when(F.count_if(F.col(value) < threshold) == 0, F.lit(0.0)).otherwise(downside(value, threshold) * math.sqrt(periods))


def calmar(returns: DataFrame, value: str = "r", periods: int = 252, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Annualised mean over the worst drawdown; NULL (unbounded) without drawdown and with gain."""
    mean = returns.groupBy(*keys).agg((F.avg(value) * periods).alias("annual_mean"))
    out = mean.join(max_drawdown(returns, value, keys), list(keys))
    value_ = F.when(F.col("max_drawdown") != 0, F.col("annual_mean") / F.abs("max_drawdown")).when(F.col("annual_mean") <= 0, F.lit(0.0))
    return out.withColumn("calmar", value_)


def all_metrics(returns: DataFrame, value: str = "r", rf: float = 0.04, level: float = 0.95, periods: int = 252, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """The whole risk bundle in one aggregation plus the drawdown and tail joins."""
    base = returns.groupBy(*keys).agg(
        (F.avg(value) * periods).alias("mean_return"),
        (F.stddev_samp(value) * math.sqrt(periods)).alias("volatility"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
        downside_deviation(value, 0.0, periods).alias("downside_deviation"),
        sortino(value, rf, periods).alias("sortino_ratio"),
        omega(value, rf / periods).alias("omega_ratio"),
    )
    out = base.join(tail_risk(returns, value, level, keys), list(keys))
    out = out.join(calmar(returns, value, periods, keys).drop("annual_mean"), list(keys))
    return out.withColumn("sharpe_ratio", (F.col("mean_return") - rf) / F.col("volatility"))


def tear_sheet(monthly: DataFrame, rf: float = 0.05, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Monthly performance report: population volatility, sample covariance over
    population variance for beta, as the report defines them."""
    p, b = F.col("portfolio_return"), F.col("spy_return")
    neg = F.when(p < 0, p)
    base = monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_months"),
        compound(p).alias("_tp"),
        compound(b).alias("_tb"),
        (F.stddev_pop(p) * math.sqrt(12)).alias("volatility"),
        (F.stddev_pop(b) * math.sqrt(12)).alias("spy_volatility"),
        (F.stddev_pop(p - b) * math.sqrt(12)).alias("tracking_error"),
        (F.stddev_pop(neg) * math.sqrt(12)).alias("_down"),
        F.covar_samp(p, b).alias("_cov"),
        F.var_pop(b).alias("_var"),
    )
    years = F.col("n_months") / 12
    out = base.withColumn("annual_return", F.pow(1 + F.col("_tp"), 1 / years) - 1).withColumn(
        "spy_annual_return", F.pow(1 + F.col("_tb"), 1 / years) - 1
    )
    dd = max_drawdown(monthly.withColumn("r", p), "r", keys)
    spy_dd = max_drawdown(monthly.withColumn("r", b), "r", keys).withColumnRenamed("max_drawdown", "spy_max_drawdown")
    out = out.join(dd, list(keys)).join(spy_dd, list(keys))
    over = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    down = F.coalesce("_down", "volatility")
    out = out.select(
        *keys,
        "n_months",
        "annual_return",
        "spy_annual_return",
        "volatility",
        "spy_volatility",
        "tracking_error",
        over(F.col("annual_return") - rf, F.col("volatility")).alias("sharpe"),
        over(F.col("annual_return") - rf, down).alias("sortino"),
        over(F.col("annual_return") - F.col("spy_annual_return"), F.col("tracking_error")).alias("information_ratio"),
        F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(1.0).alias("beta"),
        "max_drawdown",
        "spy_max_drawdown",
        F.when(F.col("max_drawdown") != 0, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
    )
    return out.withColumn("alpha", F.col("annual_return") - (rf + F.col("beta") * (F.col("spy_annual_return") - rf)))


def equity_metrics(daily: DataFrame, value: str = "r", benchmark: str = "b", rf: float = 0.02, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Backtest metrics from dated returns with calendar-day annualisation; alpha compares
    annualised with annualised."""
    base = daily.groupBy(*keys).agg(
        compound(value).alias("total_return"),
        compound(benchmark).alias("benchmark_return"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        (F.stddev_samp(value) * math.sqrt(252)).alias("volatility"),
        F.avg(value).alias("_mu"),
        F.stddev_samp(value).alias("_sd"),
        downside(value).alias("_down"),
    )
    annual = lambda c: F.pow(1 + F.col(c), 365.0 / F.col("days")) - 1
    out = base.join(max_drawdown(daily, value, keys), list(keys))
    out = out.withColumn("annual_return", annual("total_return")).withColumn("annual_benchmark", annual("benchmark_return"))
    excess = F.col("_mu") - rf / 252
    return out.select(
        *keys,
        "total_return",
        "annual_return",
        "benchmark_return",
        (F.col("annual_return") - F.col("annual_benchmark")).alias("alpha"),
        "volatility",
        F.when(F.col("_sd") > 0, excess / F.col("_sd") * math.sqrt(252)).otherwise(0.0).alias("sharpe"),
        F.when(F.col("_down") > 0, excess / F.col("_down") * math.sqrt(252)).otherwise(0.0).alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") != 0, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
    )


def stress(betas: DataFrame, scenarios: DataFrame, fixed_beta: bool = False) -> DataFrame:
    """Shock × beta for every strategy and scenario (both tables are small)."""
    rows = betas.crossJoin(F.broadcast(scenarios))
    return rows.withColumn("expected_loss", F.col("shock") * (F.lit(1.0) if fixed_beta else F.col("beta")))


def book_metrics(weights: DataFrame, grid: DataFrame, rf: float = 0.04, keys: Sequence[str] = STRATEGY, value: str = "ret", annual: float = 252.0) -> DataFrame:
    """wᵀμ, √(wᵀΣw) and Sharpe of books on a full (ticker, date) grid of returns.

    wᵀΣw is the sample variance of the book's own series Σ_i w_i r_it, so no pair of tickers is formed.
    """
    keys = list(keys)
    series = weights.select(*keys, "ticker", "weight").join(grid.select("ticker", "date", value), "ticker").groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col(value)).alias("_x"))
    out = series.groupBy(*keys).agg((F.avg("_x") * annual).alias("expected_return"), F.sqrt(F.var_samp("_x") * annual).alias("volatility"))
    return out.withColumn("sharpe", F.when(F.col("volatility") > 0, (F.col("expected_return") - rf) / F.col("volatility")).otherwise(0.0))


def assess(sheet: DataFrame, years: DataFrame, precision: DataFrame | None = None, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Verbal labels of a tear sheet, and a verdict from the share of years ahead and the
    average precision of the top decile (``precision``: one row, ``avg_precision``)."""
    share = years.groupBy(*keys).agg(F.avg((F.col("excess_return") > 0).cast("double")).alias("share_ahead"))
    rows = sheet.join(share, list(keys))
    if precision is None:
        rows = rows.withColumn("avg_precision", F.lit(None).cast("double"))
    else:
        rows = rows.crossJoin(F.broadcast(precision.select("avg_precision")))
    s, d, b, i = F.col("sharpe"), F.abs("max_drawdown"), F.col("beta"), F.col("information_ratio")
    ahead = F.col("share_ahead")
    return rows.select(
        "*",
        F.when(s > 1.0, "EXCELLENT").when(s > 0.5, "GOOD").otherwise("WEAK").alias("sharpe_label"),
        F.when(d > 0.30, "HIGH RISK").when(d > 0.20, "MODERATE").otherwise("ACCEPTABLE").alias("drawdown_label"),
        F.when(b > 1.5, "HIGH").when(b > 1.0, "ABOVE-MARKET").otherwise("DEFENSIVE").alias("beta_label"),
        F.when(i > 0.5, "STRONG").when(i > 0, "POSITIVE").otherwise("NONE").alias("ratio_label"),
        F.when((ahead >= 0.6) & (F.col("avg_precision") > 0.12), "ROBUST").when(ahead >= 0.5, "MARGINAL").otherwise("WEAK").alias("verdict"),
    )


def assess_ic(summary: DataFrame) -> DataFrame:
    """Labels of an information-coefficient summary."""
    ic, ir = F.col("mean_ic"), F.col("ic_ir")
    return summary.select(
        "*",
        F.when(ic > 0.05, "STRONG").when(ic > 0.02, "MODERATE").when(ic > 0, "WEAK").otherwise("NONE").alias("ic_label"),
        F.when(ir > 0.5, "STABLE").when(ir > 0.2, "MODERATE").otherwise("UNSTABLE").alias("stability_label"),
    )
