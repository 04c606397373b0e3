"""J and K: risk, performance and statistical validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import risk, validation
from quantloom.operators.labels import residual_return, smooth_return
from quantloom.suite.oracle import add_cte, normal_sql, rank_sql, student_sql
from quantloom.suite.registry import case

add_cte("ser", """SELECT strategy, date, round(0.02::DOUBLE * ln(1 + a) - 0.006::DOUBLE, 8) AS r, round(0.02::DOUBLE * ln(1 + b) - 0.005::DOUBLE, 8) AS b FROM (
  SELECT sector AS strategy, date, avg(ret) AS a, max(spy_ret) AS b FROM rb JOIN meta g ON g.ticker = rb.ticker GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL""")
_RUN = "(PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)"


def _dd_sql(table, value, name="drawdown"):
    return f"SELECT strategy, date, lev / max(lev) OVER {_RUN} - 1 AS {name} FROM (SELECT strategy, date, product(1 + {value}) OVER {_RUN} AS lev FROM {table})"


add_cte("sdd", _dd_sql("ser", "r"))
add_cte("smdd", "SELECT strategy, min(drawdown) AS max_drawdown FROM sdd GROUP BY 1")
add_cte("svar", "SELECT strategy, greatest(-quantile_cont(r, 0.05), 0) AS v FROM ser GROUP BY 1")
add_cte("stail", "SELECT s.strategy, v AS \"var\", greatest(coalesce(-avg(r) FILTER (r < -v), v), 0) AS cvar FROM ser s JOIN svar x ON x.strategy = s.strategy GROUP BY 1, 2")


@case("j01_historical_var", "strategy value_at_risk:8", "SELECT strategy, v AS value_at_risk FROM svar")
def _(m):
    return m.sector_series().groupBy("strategy").agg(risk.historical_var().alias("value_at_risk"))


@case("j02_parametric_var", "strategy value_at_risk:8", "SELECT strategy, greatest(-(avg(r) + stddev_samp(r) * -1.6448536269514722::DOUBLE), 0) AS value_at_risk FROM ser GROUP BY 1")
def _(m):
    return m.sector_series().groupBy("strategy").agg(risk.parametric_var().alias("value_at_risk"))


@case("j03_cvar", "strategy cvar:8", "SELECT * FROM stail")
def _(m):
    return risk.tail_risk(m.sector_series())


@case("j04_omega", "strategy omega:6", "SELECT strategy, sum(greatest(r, 0)) / nullif(-sum(least(r, 0)), 0) AS omega FROM ser GROUP BY 1")
def _(m):
    return m.sector_series().groupBy("strategy").agg(risk.omega().alias("omega"))


@case("j05_sortino", "strategy sortino:8", "SELECT strategy, avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) AS sortino FROM ser GROUP BY 1")
def _(m):
    return m.sector_series().groupBy("strategy").agg(risk.sortino().alias("sortino"))


@case("j06_drawdown_series", "strategy date:d drawdown:6", "SELECT * FROM sdd")
def _(m):
    return risk.drawdowns(m.sector_series())


@case("j07_calmar", "strategy calmar:6", "SELECT s.strategy, avg(r) * 252 / abs(max_drawdown) AS calmar FROM ser s JOIN smdd d ON d.strategy = s.strategy GROUP BY 1, max_drawdown")
def _(m):
    return risk.calmar(m.sector_series())


@case("j08_downside_deviation", "strategy downside_deviation:8", "SELECT strategy, coalesce(stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252), 0) AS downside_deviation FROM ser GROUP BY 1")
def _(m):
    return m.sector_series().groupBy("strategy").agg(risk.downside_deviation().alias("downside_deviation"))


_skew = "SELECT strategy, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS skewness, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS kurtosis FROM (SELECT *, avg(r) OVER (PARTITION BY strategy) AS mu FROM ser) GROUP BY 1"


@case("j09_skew_kurtosis", "strategy skewness:6 kurtosis:6", _skew)
def _(m):
    return m.sector_series().groupBy("strategy").agg(F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"))


@case("j10_all_metrics", "strategy mean_return:6 volatility:6 sharpe_ratio:6 skewness:6 kurtosis:6 value_at_risk:8 cvar:8 max_drawdown:6 downside_deviation:6 sortino_ratio:6 calmar:6 omega_ratio:6",
      f"""SELECT s.strategy, avg(r) * 252 AS mean_return, stddev_samp(r) * sqrt(252) AS volatility, (avg(r) * 252 - 0.04) / (stddev_samp(r) * sqrt(252)) AS sharpe_ratio, any_value(k.skewness) AS skewness, any_value(k.kurtosis) AS kurtosis, any_value(t.var) AS value_at_risk, any_value(t.cvar) AS cvar,
  any_value(d.max_drawdown) AS max_drawdown, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS downside_deviation, (avg(r) - 0.04::DOUBLE / 252) / stddev_samp(CASE WHEN r < 0 THEN r END) AS sortino_ratio, avg(r) * 252 / abs(any_value(d.max_drawdown)) AS calmar,
  sum(greatest(r - 0.04::DOUBLE / 252, 0)) / -sum(least(r - 0.04::DOUBLE / 252, 0)) AS omega_ratio FROM ser s JOIN ({_skew}) k ON k.strategy = s.strategy JOIN stail t ON t.strategy = s.strategy JOIN smdd d ON d.strategy = s.strategy GROUP BY 1""")
def _(m):
    return risk.all_metrics(m.sector_series()).withColumnRenamed("var", "value_at_risk")


add_cte("mdd1", "SELECT strategy, min(drawdown) AS max_drawdown FROM (" + _dd_sql("strat", "portfolio_return") + ") GROUP BY 1")
add_cte("mdd2", "SELECT strategy, min(drawdown) AS spy_max_drawdown FROM (" + _dd_sql("strat", "spy_return") + ") GROUP BY 1")
add_cte("sheet0", """SELECT strategy, count(*) AS n_months, pow(product(1 + portfolio_return), 12.0::DOUBLE / count(*)) - 1 AS annual_return, pow(product(1 + spy_return), 12.0::DOUBLE / count(*)) - 1 AS spy_annual_return,
  stddev_pop(portfolio_return) * sqrt(12) AS volatility, stddev_pop(spy_return) * sqrt(12) AS spy_volatility, stddev_pop(portfolio_return - spy_return) * sqrt(12) AS tracking_error,
  coalesce(stddev_pop(CASE WHEN portfolio_return < 0 THEN portfolio_return END), stddev_pop(portfolio_return)) * sqrt(12) AS dn, covar_samp(portfolio_return, spy_return) / var_pop(spy_return) AS beta FROM strat GROUP BY 1""")
add_cte("sheet", """SELECT s.*, CASE WHEN volatility > 0 THEN (annual_return - 0.05) / volatility ELSE 0 END AS sharpe, CASE WHEN dn > 0 THEN (annual_return - 0.05) / dn ELSE 0 END AS sortino, CASE WHEN tracking_error > 0 THEN (annual_return - spy_annual_return) / tracking_error ELSE 0 END AS information_ratio,
  max_drawdown, spy_max_drawdown, CASE WHEN max_drawdown <> 0 THEN annual_return / abs(max_drawdown) ELSE 0 END AS calmar, annual_return - (0.05 + beta * (spy_annual_return - 0.05)) AS alpha FROM sheet0 s JOIN mdd1 a ON a.strategy = s.strategy JOIN mdd2 b ON b.strategy = s.strategy""")
_sheet = "n_months:i annual_return:6 spy_annual_return:6 volatility:6 spy_volatility:6 tracking_error:6 sharpe:6 sortino:5 information_ratio:6 beta:6 max_drawdown:6 spy_max_drawdown:6 calmar:5 alpha:6"


@case("j11_tear_sheet", "strategy " + _sheet, "SELECT * FROM sheet")
def _(m):
    return risk.tear_sheet(m.strategy_returns())


@case("j12_backtest_metrics", "strategy total_return:6 annual_return:6 benchmark_return:6 alpha:6 volatility:6 sharpe:6 sortino:6 max_drawdown:6 calmar:6", """SELECT *, pow(1 + total_return, 365.0::DOUBLE / days) - 1 AS annual_return, pow(1 + total_return, 365.0::DOUBLE / days) - pow(1 + benchmark_return, 365.0::DOUBLE / days) AS alpha,
  (pow(1 + total_return, 365.0::DOUBLE / days) - 1) / abs(max_drawdown) AS calmar FROM (SELECT s.strategy, product(1 + r) - 1 AS total_return, product(1 + b) - 1 AS benchmark_return, max(date) - min(date) AS days, stddev_samp(r) * sqrt(252) AS volatility,
  (avg(r) - 0.02::DOUBLE / 252) / stddev_samp(r) * sqrt(252) AS sharpe, (avg(r) - 0.02::DOUBLE / 252) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS sortino, any_value(max_drawdown) AS max_drawdown FROM ser s JOIN smdd d ON d.strategy = s.strategy GROUP BY 1)""")
def _(m):
    return risk.equity_metrics(m.sector_series())


# Market shocks of the stress scenarios.
SCENARIOS = {"crisis_2008": -0.50, "covid_2020": -0.34, "rate_shock": -0.20, "correction": -0.10}


@case("j14_stress_test", "strategy scenario fixed:6 expected_loss:6", "SELECT strategy, scenario, shock AS fixed, shock * covar_samp(r, b) / var_samp(b) AS expected_loss FROM ser CROSS JOIN (VALUES "
      + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SCENARIOS.items()) + ") v(scenario, shock) GROUP BY 1, 2, 3")
def _(m):
    beta = m.sector_series().groupBy("strategy").agg((F.covar_samp("r", "b") / F.var_samp("b")).alias("beta"))
    table = m.spark.createDataFrame(list(SCENARIOS.items()), "scenario string, shock double")
    fixed = risk.stress(beta, table, fixed_beta=True).select("strategy", "scenario", F.col("expected_loss").alias("fixed"))
    return risk.stress(beta, table).join(fixed, ["strategy", "scenario"])


@case("j15_cumulative_curves", "strategy date:d portfolio_return_curve:6 spy_return_curve:6 gross_return_curve:6", f"SELECT strategy, date, product(1 + portfolio_return) OVER {_RUN} AS portfolio_return_curve, product(1 + spy_return) OVER {_RUN} AS spy_return_curve, product(1 + gross_return) OVER {_RUN} AS gross_return_curve FROM strat")
def _(m):
    return risk.curves(m.strategy_returns(), ["portfolio_return", "spy_return", "gross_return"])


@case("j17_assessment_labels", "strategy sharpe_label drawdown_label beta_label ratio_label verdict", """SELECT h.strategy, CASE WHEN sharpe > 1 THEN 'EXCELLENT' WHEN sharpe > 0.5 THEN 'GOOD' ELSE 'WEAK' END AS sharpe_label,
  CASE WHEN abs(max_drawdown) > 0.30 THEN 'HIGH RISK' WHEN abs(max_drawdown) > 0.20 THEN 'MODERATE' ELSE 'ACCEPTABLE' END AS drawdown_label, CASE WHEN beta > 1.5 THEN 'HIGH' WHEN beta > 1 THEN 'ABOVE-MARKET' ELSE 'DEFENSIVE' END AS beta_label,
  CASE WHEN information_ratio > 0.5 THEN 'STRONG' WHEN information_ratio > 0 THEN 'POSITIVE' ELSE 'NONE' END AS ratio_label, CASE WHEN ahead >= 0.6 AND avg_precision > 0.12 THEN 'ROBUST' WHEN ahead >= 0.5 THEN 'MARGINAL' ELSE 'WEAK' END AS verdict
  FROM sheet h JOIN (SELECT strategy, avg(CAST(excess_return > 0 AS DOUBLE)) AS ahead FROM years GROUP BY 1) y ON y.strategy = h.strategy CROSS JOIN (SELECT avg(precision_10) AS avg_precision FROM quality) q""")
def _(m):
    from quantloom.operators import evaluation, summaries

    precision = evaluation.yearly_quality(m.scored_targets()).agg(F.avg("precision_10").alias("avg_precision"))
    monthly = m.strategy_returns()
    return risk.assess(risk.tear_sheet(monthly), summaries.yearly(monthly), precision)


@case("j17_ic_labels", "ic_label stability_label", f"SELECT CASE WHEN a > 0.05 THEN 'STRONG' WHEN a > 0.02 THEN 'MODERATE' WHEN a > 0 THEN 'WEAK' ELSE 'NONE' END AS ic_label, CASE WHEN ir > 0.5 THEN 'STABLE' WHEN ir > 0.2 THEN 'MODERATE' ELSE 'UNSTABLE' END AS stability_label FROM (SELECT avg(ic) AS a, avg(ic) / stddev_pop(ic) AS ir FROM icdate)")
def _(m):
    return risk.assess_ic(validation.ic_summary(validation.information_coefficient(_ic_rows(m), ["date"], "score", "future_return_resid", p_values=False)))


# -- K ----------------------------------------------------------------------------


def _draw_sql(*parts):
    """The library's uniform draw."""
    return f"(('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


@case("k01_bootstrap", "strategy mean:6 p_value:4 ci_low:6 ci_high:6", f"""SELECT strategy, any_value(mean) AS mean, avg(CAST(m <= 0 AS DOUBLE)) AS p_value, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
  SELECT strategy, i, any_value(mean) AS mean, avg(xs[1 + CAST(floor(u * n) AS INT)]) AS m FROM (
    SELECT *, {_draw_sql("42", "strategy", "i", "k")} AS u FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, unnest(range(10000)) AS i FROM (
      SELECT strategy, avg(excess_return) AS mean, count(*) AS n, list(excess_return ORDER BY date) AS xs FROM strat GROUP BY 1)))) GROUP BY 1, 2) GROUP BY 1""")
def _(m):
    return validation.bootstrap(m.strategy_returns(), "excess_return")


add_cte("icr", "SELECT date, year(date) AS year, ticker, score, future_return_resid FROM (SELECT s.ticker, s.date, score, t.future_return_resid FROM scores s JOIN tgt2 t ON t.ticker = s.ticker AND t.date = s.date) WHERE score IS NOT NULL AND future_return_resid IS NOT NULL")


def _ic_sql(by):
    return (f"SELECT {by}, count(*) AS n_samples, CASE WHEN count(*) >= 10 THEN corr(rs, ra) ELSE 0 END AS ic, CASE WHEN count(*) >= 10 THEN corr(score, future_return_resid) ELSE 0 END AS pearson_ic FROM (SELECT *, "
            f"{rank_sql('score', by)} AS rs, {rank_sql('future_return_resid', by)} AS ra FROM icr) GROUP BY 1")


def _p_sql(by):
    p = student_sql("t", "df")
    return f"SELECT *, CASE WHEN n_samples < 10 THEN 1.0 WHEN abs(ic) >= 1 THEN 0.0 ELSE {p} END AS ic_pvalue FROM (SELECT *, n_samples - 2.0::DOUBLE AS df, ic * sqrt((n_samples - 2) / nullif(1 - ic * ic, 0)) AS t FROM ({_ic_sql(by)}))"


add_cte("icdate", _ic_sql("date"))


def _ic_rows(m):
    target = residual_return(smooth_return(m.month_table())).select("ticker", "date", "future_return_resid")
    return m.scores().select("ticker", "date", "score").join(target, ["ticker", "date"]).withColumn("year", F.year("date"))


@case("k02_information_coefficient", "year:i n_samples:i ic:8 pearson_ic:8 ic_pvalue:6", _p_sql("year"))
def _(m):
    return validation.information_coefficient(_ic_rows(m), ["year"], "score", "future_return_resid", ["ticker", "date"])


@case("k02_information_coefficient_by_date", "date:d n_samples:i ic:8 pearson_ic:8 ic_pvalue:6", _p_sql("date"))
def _(m):
    return validation.information_coefficient(_ic_rows(m), ["date"], "score", "future_return_resid")


@case("k03_ic_summary", "mean_ic:8 std_ic:8 ic_ir:6 share_positive:6 n:i", f"SELECT avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, avg(ic) / stddev_pop(ic) AS ic_ir, avg(CAST(ic > 0 AS DOUBLE)) AS share_positive, count(*) AS n FROM ({_ic_sql('date')})")
def _(m):
    return validation.ic_summary(validation.information_coefficient(_ic_rows(m), ["date"], "score", "future_return_resid", p_values=False))


@case("k04_t_test", "strategy n:i t_statistic:6", "SELECT strategy, count(*) AS n, avg(r - b) / (stddev_samp(r - b) / sqrt(count(*))) AS t_statistic FROM ser GROUP BY 1")
def _(m):
    return validation.t_test(m.sector_series().withColumn("e", F.col("r") - F.col("b")), "e")


add_cte("ttest", "SELECT strategy, count(*) - 1.0::DOUBLE AS df, avg(r - b) / (stddev_samp(r - b) / sqrt(count(*))) AS t FROM ser GROUP BY 1")


@case("k04_t_test_p_value", "strategy p_value:6 significant_5pct:i", f"SELECT strategy, p_value, CAST(p_value < 0.05 AS INT) AS significant_5pct FROM (SELECT strategy, {student_sql('t', 'df')} AS p_value FROM ttest)")
def _(m):
    return validation.t_test(m.sector_series().withColumn("e", F.col("r") - F.col("b")), "e")


add_cte("montecarlo", f"""SELECT strategy, avg(w) AS mean_terminal, median(w) AS median_terminal, quantile_cont(w, 0.05) AS percentile_5, quantile_cont(w, 0.95) AS percentile_95,
  avg(CAST(w > 1 AS DOUBLE)) AS prob_gain, avg(CAST(w > 2 AS DOUBLE)) AS prob_double FROM (SELECT strategy, i, product(1 + mu + sd * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)) AS w FROM (
    SELECT *, {_draw_sql("42", "strategy", "i", "k", "1")} AS u1, {_draw_sql("42", "strategy", "i", "k", "2")} AS u2 FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, unnest(range(10000)) AS i FROM (
      SELECT strategy, avg(portfolio_return) AS mu, stddev_samp(portfolio_return) AS sd, count(*) AS n FROM strat GROUP BY 1)))) GROUP BY 1, 2) GROUP BY 1""")


@case("k05_monte_carlo", "strategy mean_terminal:4 median_terminal:4 percentile_5:4 percentile_95:4 prob_gain:4 prob_double:4", "SELECT * FROM montecarlo")
def _(m):
    return validation.monte_carlo(m.strategy_returns(), "portfolio_return")


@case("k06_sharpe_significance", "strategy sharpe_ratio:6 z_score:6", "SELECT strategy, sr AS sharpe_ratio, (sr - 0.40) / sqrt((1 + 0.5 * sr * sr) / n) AS z_score FROM (SELECT strategy, count(*) AS n, (avg(r) * 252 - 0.04) / (stddev_samp(r) * sqrt(252)) AS sr FROM ser GROUP BY 1)")
def _(m):
    return validation.sharpe_test(m.sector_series())


add_cte("ztest", "SELECT strategy, (sr - 0.40) / sqrt((1 + 0.5 * sr * sr) / n) AS z FROM (SELECT strategy, count(*) AS n, (avg(r) * 252 - 0.04) / (stddev_samp(r) * sqrt(252)) AS sr FROM ser GROUP BY 1)")


@case("k06_sharpe_p_value", "strategy p_value:6", f"SELECT strategy, {normal_sql('z')} AS p_value FROM ztest")
def _(m):
    return validation.sharpe_test(m.sector_series())


add_cte("pooled", "SELECT strategy, date, 0 AS side, portfolio_return AS x FROM strat UNION ALL SELECT strategy, date, 1, spy_return FROM strat")


add_cte("permuted", f"""SELECT strategy, observed_difference, avg(CAST(s / n_own - (total - s) / n_own >= observed_difference AS DOUBLE)) AS p_value FROM (
  SELECT strategy, i, any_value(observed_difference) AS observed_difference, any_value(total) AS total, any_value(n_own) AS n_own, sum(x) FILTER (k <= n_own) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY strategy, i ORDER BY u, date, side) AS k FROM (SELECT *, {_draw_sql("42", "p.strategy", "i", "strftime(date, '%Y-%m-%d')", "side")} AS u FROM (
      SELECT p.*, observed_difference, total, n_own, unnest(range(10000)) AS i FROM pooled p JOIN (
        SELECT strategy, avg(portfolio_return) - avg(spy_return) AS observed_difference, sum(portfolio_return) + sum(spy_return) AS total, count(*) AS n_own FROM strat GROUP BY 1) o ON o.strategy = p.strategy) p)) GROUP BY 1, 2) GROUP BY 1, 2""")


@case("k07_permutation_test", "strategy observed_difference:6 p_value:4", "SELECT * FROM permuted")
def _(m):
    return validation.permutation_test(m.strategy_returns(), "portfolio_return", "spy_return")


@case("k08_regime_stability", "strategy regime mean_return:6 volatility:6 sharpe:6 n_periods:i", """SELECT strategy, regime, avg(r) * 252 AS mean_return, stddev_samp(r) * sqrt(252) AS volatility, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, count(*) AS n_periods FROM (
  SELECT *, CASE WHEN s <= lo + (hi - lo) / 3 THEN 'Bear' WHEN s <= lo + 2 * ((hi - lo) / 3) THEN 'Neutral' ELSE 'Bull' END AS regime FROM (SELECT *, min(s) OVER (PARTITION BY strategy) AS lo, max(s) OVER (PARTITION BY strategy) AS hi FROM (
  SELECT *, CASE WHEN count(r) OVER (PARTITION BY strategy ORDER BY date ROWS 59 PRECEDING) = 60 THEN sum(r) OVER (PARTITION BY strategy ORDER BY date ROWS 59 PRECEDING) END AS s FROM ser)) WHERE s IS NOT NULL) GROUP BY 1, 2""")
def _(m):
    return validation.regime_stability(m.sector_series())


@case("k09_mean_interval", "strategy mean_annual_return:6 ci_lower:6 ci_upper:6", """SELECT strategy, mu AS mean_annual_return, mu - 1.959963984540054::DOUBLE * se * sqrt(252) AS ci_lower, mu + 1.959963984540054::DOUBLE * se * sqrt(252) AS ci_upper FROM (
  SELECT strategy, avg(r) * 252 AS mu, stddev_samp(r) / sqrt(count(*)) AS se FROM ser GROUP BY 1)""")
def _(m):
    return validation.mean_interval(m.sector_series())


add_cte("bundle", """SELECT *, t * 1.0::DOUBLE AS t_statistic, (sr - 0.40) / sqrt((1 + 0.5 * sr * sr) / n) AS z_score FROM (SELECT strategy, count(*) AS n, count(*) - 1.0::DOUBLE AS df,
  avg(portfolio_return - spy_return) / (stddev_samp(portfolio_return - spy_return) / sqrt(count(*))) AS t, (avg(portfolio_return) * 252 - 0.04) / (stddev_samp(portfolio_return) * sqrt(252)) AS sr,
  avg(portfolio_return) * 252 AS mu, stddev_samp(portfolio_return) / sqrt(count(*)) * sqrt(252) * 1.959963984540054::DOUBLE AS half FROM strat GROUP BY 1)""")


@case("k10_validation_bundle", "strategy t_statistic:6 t_pvalue:6 z_score:6 sharpe_pvalue:6 permutation_pvalue:4 mean_terminal:4 ci_lower:6 ci_upper:6", f"""SELECT b.strategy, t_statistic, {student_sql('t', 'df')} AS t_pvalue, z_score, {normal_sql('z_score')} AS sharpe_pvalue,
  p.p_value AS permutation_pvalue, mean_terminal, mu - half AS ci_lower, mu + half AS ci_upper FROM bundle b JOIN montecarlo m ON m.strategy = b.strategy JOIN permuted p ON p.strategy = b.strategy""")
def _(m):
    from quantloom.session import reliable

    rows = reliable(m.strategy_returns().select("strategy", "date", F.col("portfolio_return").alias("r"), F.col("spy_return").alias("b")))
    return validation.full_report(rows)
