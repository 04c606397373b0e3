"""The flagship: monthly momentum book, next-day entry, net of cost, against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import returns, weights
from quantloom.operators.asof import trading_calendar
from quantloom.operators.xsection import pct_rank
from quantloom.plans.monthly import month_end_features
from quantloom.session import reliable


def momentum_book(prices: DataFrame, bench: DataFrame, meta: DataFrame, top_n: int = 20) -> DataFrame:
    """Monthly gross, cost, net and benchmark return of the top-n six-month momentum book."""
    rows = month_end_features(prices, bench, meta).select("ticker", "date", "return_6m", "volatility_20d")
    scored = reliable(pct_rank(reliable(rows), ["date"], {"return_6m": "score"}))
    book = weights.inverse_vol(weights.top_n(scored, top_n)).withColumn("strategy", F.lit("momentum"))
    plan = returns.schedule(scored, trading_calendar(prices))
    held = returns.holding_returns(book, plan, prices)
    monthly = returns.weighted_return(held)
    turnover = weights.holdings_change(book, F.lit(top_n)).select("strategy", "date", "turnover")
    out = monthly.join(turnover, ["strategy", "date"], "left").join(F.broadcast(returns.benchmark_return(plan, bench)), "date")
    net = F.col("raw_return") - returns.trading_cost(F.col("turnover"))
    return out.withColumn("portfolio_return", net).withColumn("excess_return", net - F.col("spy_return"))


def yearly_summary(monthly: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Compounded returns, excess, win rate and months per year."""
    gain = lambda c: F.product(1 + F.col(c)) - 1
    out = monthly.groupBy(*keys, F.year("date").alias("year")).agg(
        gain("portfolio_return").alias("portfolio_return"),
        gain("spy_return").alias("spy_return"),
        F.avg((F.col("portfolio_return") > F.col("spy_return")).cast("double")).alias("win_rate"),
        F.count(F.lit(1)).alias("n_months"),
    )
    return out.withColumn("excess_return", F.col("portfolio_return") - F.col("spy_return"))


def momentum_book_report(prices: DataFrame, bench: DataFrame, meta: DataFrame, top_n: int = 20) -> DataFrame:
    return yearly_summary(momentum_book(prices, bench, meta, top_n))
