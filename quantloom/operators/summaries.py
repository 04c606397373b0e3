"""Calendars and summary tables of return series, portfolios and screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compound(c: str | Column) -> Column:
    """∏(1+r) − 1, safe for returns at or below −100 %."""
    return F.product(1 + (F.col(c) if isinstance(c, str) else c)) - 1


def rebalance_dates(prices: DataFrame, frequency: str, mondays_only: bool = False) -> DataFrame:
    """Trading dates to act on: daily, weekly (first trading day of the week, or Mondays
    only) or monthly (first trading day of the month)."""
    days = prices.select("date").distinct()
    if frequency == "daily":
        return days
    if frequency == "weekly" and mondays_only:
        return days.where(F.weekday("date") == 0)
    unit = {"weekly": "week", "monthly": "month"}[frequency]
    return days.groupBy(F.trunc("date", unit).alias("_p")).agg(F.min("date").alias("date")).select("date")


def yearly(monthly: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Compounded portfolio and benchmark return, excess, win rate and months per year."""
    out = monthly.groupBy(*keys, "year").agg(
        compound("portfolio_return").alias("portfolio_return"),
        compound("spy_return").alias("spy_return"),
        F.avg((F.col("portfolio_return") > F.col("spy_return")).cast("double")).alias("win_rate"),
        F.count(F.lit(1)).alias("n_months"),
    )
    return out.withColumn("excess_return", F.col("portfolio_return") - F.col("spy_return"))


def yearly_sum(monthly: DataFrame, delisted: str, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Compounded returns, summed excess and delisted names per year."""
    return monthly.groupBy(*keys, "year").agg(
        compound("portfolio_return").alias("portfolio_return"),
        compound("spy_return").alias("spy_return"),
        F.sum("excess_return").alias("sum_excess"),
        F.sum(delisted).alias("delisted"),
    )


def total_and_average(years: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Yearly rows with a compounded TOTAL and an AVG row per strategy."""
    fields = ["portfolio_return", "spy_return"]
    rows = years.select(*keys, F.col("year").cast("string").alias("label"), *fields)
    total = years.groupBy(*keys).agg(*[compound(c).alias(c) for c in fields]).withColumn("label", F.lit("TOTAL"))
    mean = years.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in fields]).withColumn("label", F.lit("AVG"))
    out = rows.unionByName(total).unionByName(mean)
    return out.withColumn("excess_return", F.col("portfolio_return") - F.col("spy_return"))


def win_loss(returns: DataFrame, value: str, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    v = F.col(value)
    return returns.groupBy(*keys).agg(
        F.avg((v > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(v > 0, v)).alias("avg_win"),
        F.avg(F.when(v < 0, v)).alias("avg_loss"),
        F.count_if(v > 0).alias("n_wins"),
        F.count_if(v < 0).alias("n_losses"),
    )


def best_worst_year(years: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Best and worst year by excess, years ahead, and the benchmark's losing years."""
    order = F.struct("excess_return", -F.col("year"))
    return years.groupBy(*keys).agg(
        F.max_by("year", order).alias("best_year"),
        F.max("excess_return").alias("best_excess"),
        F.min_by("year", F.struct("excess_return", "year")).alias("worst_year"),
        F.min("excess_return").alias("worst_excess"),
        F.count_if(F.col("excess_return") > 0).alias("years_ahead"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("spy_return") < 0, F.col("year").cast("string")))), ",").alias("bear_years"),
    )


def screen_summary(screen: DataFrame, score: str = "score") -> DataFrame:
    """One row per signal with its count, beside overall count, mean and maximum score."""
    overall = screen.agg(F.count(F.lit(1)).alias("n_all"), F.avg(score).alias("avg_score"), F.max(score).alias("max_score"))
    return screen.groupBy("signal").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(overall))


def turnover_summary(changes: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    out = changes.groupBy(*keys).agg(
        F.avg("turnover").alias("avg_turnover"), F.avg("entered").alias("avg_entered"), F.avg("exited").alias("avg_exited")
    )
    return out.withColumn("annual_turnover", F.col("avg_turnover") * 12).withColumn(
        "annual_slippage", 0.0005 * F.col("avg_turnover") * 12
    )


def class_balance(rows: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    pos = F.sum((F.col(target) == 1).cast("long"))
    neg = F.sum((F.col(target) == 0).cast("long"))
    out = rows.groupBy(*keys).agg(pos.alias("n_pos"), neg.alias("n_neg"))
    return out.withColumn("scale_pos_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0))


def compare_configs(monthly: DataFrame, year: int, config: str = "strategy") -> DataFrame:
    """Total return and one chosen year's return per configuration."""
    one = F.product(F.when(F.col("year") == year, 1 + F.col("portfolio_return")).otherwise(1.0)) - 1
    return monthly.groupBy(config).agg(
        compound("portfolio_return").alias("total_return"), compound("spy_return").alias("spy_total"), one.alias("year_return")
    )


def session_report(results: DataFrame) -> DataFrame:
    """Totals over reconciled sessions."""
    return results.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.avg("portfolio_return").alias("avg_return"),
        F.avg("excess_return").alias("avg_excess"),
        F.avg((F.col("excess_return") > 0).cast("double")).alias("win_rate"),
        F.sum("excess_return").alias("total_excess"),
    )


def sector_returns(returns: DataFrame, value: str = "ret") -> DataFrame:
    return returns.groupBy("date", "sector").agg(F.avg(value).alias("sector_return"))


def fingerprint(table: DataFrame) -> DataFrame:
    """Hash of row and column count, newest date and number of tickers."""
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("d"), F.countDistinct("ticker").alias("t"))
    text = F.concat_ws("|", F.col("n").cast("string"), F.lit(str(len(table.columns))), F.date_format("d", "yyyy-MM-dd"), F.col("t").cast("string"))
    return facts.select(F.md5(text).alias("data_hash"), F.col("n").alias("n_rows"))
