"""Statistical validation by aggregation and hash-driven resampling.

Random draws are functions of (seed, series, iteration, position), so a recomputed task
gives the same numbers and no generator state has to be shared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import correlation, full, trailing
from quantloom.functions.distributions import p_normal, p_student
from quantloom.operators.xsection import pct_rank

STRATEGY = ("strategy",)


#: Iterations that one row carries to a task.
ROUND = 100


def _draw(*parts: Column) -> Column:
    """Uniform in (0, 1) from the MD5 of the parts, which any engine repeats."""
    digest = F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def _iterations(series: DataFrame, n_iter: int, keys: Sequence[str]) -> DataFrame:
    """Each series with every iteration number, spread over tasks in rounds.

    A series is one array (a value per date, so bounded by the calendar); draws are made
    inside the row and are never shuffled.
    """
    rounds = F.explode(F.sequence(F.lit(0), F.lit((n_iter - 1) // ROUND)))
    spread_ = series.withColumn("_round", rounds).repartition(*keys, "_round")
    last = F.least(F.col("_round") * ROUND + ROUND - 1, F.lit(n_iter - 1))
    return spread_.withColumn("iteration", F.explode(F.sequence(F.col("_round") * ROUND, last))).drop("_round")


def bootstrap(returns: DataFrame, value: str = "r", n_iter: int = 10_000, seed: int = 42, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Mean, P(mean ≤ 0) and 95 % interval from resampled means."""
    keys = list(keys)
    rows = returns.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("x")))).alias("xs"))
    rows = rows.withColumn("xs", F.col("xs.x"))
    draw = lambda k: F.get(F.col("xs"), F.floor(_draw(F.lit(seed), *[F.col(c) for c in keys], F.col("iteration"), k) * F.col("n")).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, k: acc + draw(k))
    means = _iterations(rows, n_iter, keys).select(*keys, "mean", (total / F.col("n")).alias("m"))
    return means.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.avg((F.col("m") <= 0).cast("double")).alias("p_value"),
        F.percentile("m", 0.025).alias("ci_low"),
        F.percentile("m", 0.975).alias("ci_high"),
    )


def information_coefficient(rows: DataFrame, by: Sequence[str], score: str, actual: str, key: Sequence[str] = ("ticker",), least: int = 10, p_values: bool = True) -> DataFrame:
    """Spearman and Pearson correlation per group; 0 with fewer than ``least`` pairs."""
    by = list(by)
    valid = rows.where(F.col(score).isNotNull() & F.col(actual).isNotNull()).select(*by, *[k for k in key if k not in by], score, actual)
    ranked = pct_rank(valid, by, {score: "_rs", actual: "_ra"}, [k for k in key if k not in by])
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), correlation("_rs", "_ra").alias("_ic"), correlation(score, actual).alias("_p")
    )
    enough = F.col("n_samples") >= least
    out = out.withColumn("ic", F.when(enough, F.col("_ic")).otherwise(0.0)).withColumn(
        "pearson_ic", F.when(enough, F.col("_p")).otherwise(0.0)
    )
    if p_values:
        r, df = F.col("ic"), F.col("n_samples") - 2
        t = r * F.sqrt(df / F.when(r * r < 1, 1 - r * r))
        p = p_student(t, df)
        out = out.withColumn("ic_pvalue", F.when(enough, F.when(F.abs("ic") >= 1, 0.0).otherwise(p)).otherwise(1.0))
    return out.drop("_ic", "_p")


def ic_summary(ics: DataFrame, ic: str = "ic", keys: Sequence[str] = ()) -> DataFrame:
    out = ics.groupBy(*keys).agg(
        F.avg(ic).alias("mean_ic"),
        F.stddev_pop(ic).alias("std_ic"),
        F.avg((F.col(ic) > 0).cast("double")).alias("share_positive"),
        F.count(ic).alias("n"),
    )
    return out.withColumn("ic_ir", F.when(F.col("std_ic") > 0, F.col("mean_ic") / F.col("std_ic")).otherwise(0.0))


def t_test(returns: DataFrame, value: str = "r", mean0: float = 0.0, keys: Sequence[str] = STRATEGY) -> DataFrame:
    out = returns.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    out = out.withColumn("t_statistic", F.when(F.col("_s") > 0, (F.col("_m") - mean0) / (F.col("_s") / F.sqrt("n"))))
    out = out.withColumn("p_value", p_student(F.col("t_statistic"), F.col("n") - 1))
    return out.select(*keys, "n", "t_statistic", "p_value", (F.col("p_value") < 0.05).alias("significant_5pct"), (F.col("p_value") < 0.01).alias("significant_1pct"))


def monte_carlo(returns: DataFrame, value: str = "r", n_sims: int = 10_000, periods: int | None = None, seed: int = 42, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Terminal wealth of normal paths with the series' mean and spread (Box-Muller from two draws)."""
    keys = list(keys)
    stats = returns.groupBy(*keys).agg(
        F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"), (F.lit(periods) if periods else F.count(value)).cast("int").alias("n")
    )
    cols = [F.lit(seed), *[F.col(c) for c in keys], F.col("iteration")]
    normal = lambda k: F.sqrt(-2 * F.log(_draw(*cols, k, F.lit(1)))) * F.cos(2 * math.pi * _draw(*cols, k, F.lit(2)))
    path = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(1.0), lambda acc, k: acc * (1 + F.col("mu") + F.col("sd") * normal(k)))
    wealth = _iterations(stats, n_sims, keys).select(*keys, path.alias("w"))
    return wealth.groupBy(*keys).agg(
        F.avg("w").alias("mean_terminal"),
        F.median("w").alias("median_terminal"),
        F.percentile("w", 0.05).alias("percentile_5"),
        F.percentile("w", 0.95).alias("percentile_95"),
        F.avg((F.col("w") > 1).cast("double")).alias("prob_gain"),
        F.avg((F.col("w") > 2).cast("double")).alias("prob_double"),
    )


def sharpe_test(returns: DataFrame, value: str = "r", benchmark: float = 0.40, rf: float = 0.04, periods: int = 252, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """z score of the Sharpe ratio against a benchmark ratio, one-sided p-value."""
    out = returns.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    sharpe = F.when(F.col("_s") > 0, (F.col("_m") * periods - rf) / (F.col("_s") * math.sqrt(periods)))
    out = out.withColumn("sharpe_ratio", sharpe)
    out = out.withColumn("z_score", (F.col("sharpe_ratio") - benchmark) / F.sqrt((1 + 0.5 * F.pow("sharpe_ratio", F.lit(2.0))) / F.col("n")))
    return out.withColumn("p_value", p_normal(F.col("z_score"))).drop("_m", "_s")


def permutation_test(returns: DataFrame, value: str = "r", benchmark: str = "b", n_iter: int = 10_000, seed: int = 42, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """P(difference of means of a random relabelling ≥ the observed one).

    A relabelling orders the pooled returns of a series by draws of (seed, series,
    iteration, date, side) and calls the first ones strategy.
    """
    keys = list(keys)
    own, other = F.collect_list(F.struct("date", F.lit(0).alias("side"), F.col(value).alias("x"))), F.collect_list(F.struct("date", F.lit(1).alias("side"), F.col(benchmark).alias("x")))
    series = returns.groupBy(*keys).agg(
        (F.avg(value) - F.avg(benchmark)).alias("observed_difference"), F.count(value).cast("int").alias("n_own"), F.concat(own, other).alias("pool"))
    series = series.withColumn("pool", F.filter("pool", lambda p: p["x"].isNotNull()))
    series = series.withColumn("total", F.aggregate("pool", F.lit(0.0), lambda acc, p: acc + p["x"]))
    cols = [F.lit(seed), *[F.col(c) for c in keys], F.col("iteration")]
    drawn = F.transform("pool", lambda p: F.struct(_draw(*cols, F.date_format(p["date"], "yyyy-MM-dd"), p["side"]).alias("u"), p["date"].alias("date"), p["side"].alias("side"), p["x"].alias("x")))
    first = F.slice(F.array_sort(drawn), F.lit(1), F.col("n_own"))
    rounds = _iterations(series, n_iter, keys).withColumn("s", F.aggregate(first, F.lit(0.0), lambda acc, p: acc + p["x"]))
    diff = F.col("s") / F.col("n_own") - (F.col("total") - F.col("s")) / (F.size("pool") - F.col("n_own"))
    return rounds.groupBy(*keys, "observed_difference").agg(F.avg((diff >= F.col("observed_difference")).cast("double")).alias("p_value"))


def regime_stability(returns: DataFrame, value: str = "r", bars: int = 60, periods: int = 252, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Performance in three equal-width bins of the rolling sum, right-closed."""
    w = trailing(bars, *keys)
    rolled = returns.select(*keys, "date", F.col(value).alias("_x"), full(F.sum(value).over(w), F.count(value).over(w), bars).alias("_roll"))
    ends = rolled.groupBy(*keys).agg(F.min("_roll").alias("_lo"), F.max("_roll").alias("_hi"))
    rows = rolled.where("_roll IS NOT NULL").join(ends, list(keys))
    third = (F.col("_hi") - F.col("_lo")) / 3
    regime = F.when(F.col("_roll") <= F.col("_lo") + third, "Bear").when(F.col("_roll") <= F.col("_lo") + 2 * third, "Neutral").otherwise("Bull")
    out = rows.groupBy(*keys, regime.alias("regime")).agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"), F.count(F.lit(1)).alias("n_periods"))
    return out.select(
        *keys,
        "regime",
        (F.col("_m") * periods).alias("mean_return"),
        (F.col("_s") * math.sqrt(periods)).alias("volatility"),
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * math.sqrt(periods)).otherwise(0.0).alias("sharpe"),
        "n_periods",
    )


def mean_interval(returns: DataFrame, value: str = "r", level: float = 0.95, periods: int = 252, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """Annualised mean with a normal confidence interval."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    out = returns.groupBy(*keys).agg((F.avg(value) * periods).alias("mean_annual_return"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("_se"))
    half = z * F.col("_se") * math.sqrt(periods)
    return out.select(*keys, "mean_annual_return", (F.col("mean_annual_return") - half).alias("ci_lower"), (F.col("mean_annual_return") + half).alias("ci_upper"))


def full_report(returns: DataFrame, value: str = "r", benchmark: str = "b", n_iter: int = 10_000, keys: Sequence[str] = STRATEGY) -> DataFrame:
    """t-test, Monte Carlo, Sharpe test, permutation test and interval per series."""
    excess = returns.withColumn("_e", F.col(value) - F.col(benchmark))
    parts = [
        t_test(excess, "_e", keys=keys).select(*keys, "t_statistic", F.col("p_value").alias("t_pvalue")),
        sharpe_test(returns, value, keys=keys).select(*keys, "sharpe_ratio", "z_score", F.col("p_value").alias("sharpe_pvalue")),
        permutation_test(returns, value, benchmark, n_iter, keys=keys).select(*keys, F.col("p_value").alias("permutation_pvalue")),
        monte_carlo(returns, value, n_iter, keys=keys),
        mean_interval(returns, value, keys=keys),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys))
    return out
