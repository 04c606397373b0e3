"""D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import returns, summaries, weights
from quantloom.operators.labels import binary_target, rank_targets, residual_return, smooth_return
from quantloom.suite.oracle import add_cte
from quantloom.suite.registry import case


@case("d01_month_end_dates", "date:d", "SELECT date FROM mends")
def _(m):
    return m.month_ends()


@case("d02_rebalance_calendars", "frequency date:d", """SELECT 'daily' AS frequency, date FROM cal UNION ALL SELECT 'monday', date FROM cal WHERE isodow(date) = 1
  UNION ALL SELECT 'weekly', min(date) FROM cal GROUP BY date_trunc('week', date) UNION ALL SELECT 'monthly', min(date) FROM cal GROUP BY date_trunc('month', date)""")
def _(m):
    p = m.prices()
    parts = [("daily", False), ("weekly", True), ("weekly", False), ("monthly", False)]
    out = None
    for f, monday in parts:
        rows = summaries.rebalance_dates(p, f, monday).select(F.lit("monday" if monday else f).alias("frequency"), "date")
        out = rows if out is None else out.unionByName(rows)
    return out


@case("d03_compound_return", "strategy total:6 total_spy:6", "SELECT strategy, product(1 + portfolio_return) - 1 AS total, product(1 + spy_return) - 1 AS total_spy FROM strat GROUP BY 1")
def _(m):
    return m.strategy_returns().groupBy("strategy").agg(summaries.compound("portfolio_return").alias("total"), summaries.compound("spy_return").alias("total_spy"))


add_cte("years", """SELECT strategy, year, product(1 + portfolio_return) - 1 AS portfolio_return, product(1 + spy_return) - 1 AS spy_return, avg(CAST(portfolio_return > spy_return AS DOUBLE)) AS win_rate,
  count(*) AS n_months, product(1 + portfolio_return) - product(1 + spy_return) AS excess_return FROM strat GROUP BY 1, 2""")


@case("d04_yearly_summary", "strategy year:i portfolio_return:6 spy_return:6 excess_return:6 win_rate:6 n_months:i", "SELECT * FROM years")
def _(m):
    return summaries.yearly(m.strategy_returns())


@case("d05_yearly_breakdown", "strategy year:i portfolio_return:6 spy_return:6 sum_excess:6 delisted:i", """SELECT strategy, year, product(1 + portfolio_return) - 1 AS portfolio_return, product(1 + spy_return) - 1 AS spy_return,
  sum(excess_return) AS sum_excess, sum(gone) AS delisted FROM strat JOIN (SELECT strategy, date, count(*) FILTER (entry_price > 0 AND exit_price IS NULL) AS gone FROM held GROUP BY 1, 2) g USING (strategy, date) GROUP BY 1, 2""")
def _(m):
    held = returns.priced(m.books(), m.plan(), m.prices())
    gone = held.groupBy("strategy", "date").agg(F.count_if((F.col("entry_price") > 0) & F.col("exit_price").isNull()).alias("gone"))
    return summaries.yearly_sum(m.strategy_returns().join(gone, ["strategy", "date"]), "gone")


@case("d06_total_and_average", "strategy label portfolio_return:6 spy_return:6 excess_return:6", """SELECT strategy, label, p AS portfolio_return, s AS spy_return, p - s AS excess_return FROM (
  SELECT strategy, CAST(year AS VARCHAR) AS label, portfolio_return AS p, spy_return AS s FROM years UNION ALL SELECT strategy, 'TOTAL', product(1 + portfolio_return) - 1, product(1 + spy_return) - 1 FROM years GROUP BY 1
  UNION ALL SELECT strategy, 'AVG', avg(portfolio_return), avg(spy_return) FROM years GROUP BY 1)""")
def _(m):
    return summaries.total_and_average(summaries.yearly(m.strategy_returns()))


@case("d07_win_loss", "strategy win_rate:6 avg_win:6 avg_loss:6 n_wins:i n_losses:i", """SELECT strategy, avg(CAST(excess_return > 0 AS DOUBLE)) AS win_rate, avg(excess_return) FILTER (excess_return > 0) AS avg_win,
  avg(excess_return) FILTER (excess_return < 0) AS avg_loss, count(*) FILTER (excess_return > 0) AS n_wins, count(*) FILTER (excess_return < 0) AS n_losses FROM strat GROUP BY 1""")
def _(m):
    return summaries.win_loss(m.strategy_returns(), "excess_return")


@case("d08_best_worst_year", "strategy best_year:i best_excess:6 worst_year:i worst_excess:6 years_ahead:i bear_years", """SELECT strategy, arg_max(year, excess_return) AS best_year, max(excess_return) AS best_excess, arg_min(year, excess_return) AS worst_year,
  min(excess_return) AS worst_excess, count(*) FILTER (excess_return > 0) AS years_ahead, coalesce(string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FILTER (spy_return < 0), '') AS bear_years FROM years GROUP BY 1""")
def _(m):
    return summaries.best_worst_year(summaries.yearly(m.strategy_returns()))


@case("d10_turnover_summary", "strategy avg_turnover:6 annual_turnover:6 avg_entered:6 avg_exited:6 annual_slippage:8",
      "SELECT strategy, avg(turnover) AS avg_turnover, avg(turnover) * 12 AS annual_turnover, avg(entered) AS avg_entered, avg(exited) AS avg_exited, 0.0005 * avg(turnover) * 12 AS annual_slippage FROM hchange GROUP BY 1")
def _(m):
    from quantloom.plans.derived import BOOKS

    slots = F.element_at(F.create_map(*[F.lit(x) for kv in BOOKS.items() for x in kv]), F.col("strategy"))
    return summaries.turnover_summary(weights.holdings_change(m.books(), slots))


add_cte("bt", "SELECT ticker, date, year(date) AS year, target_binary FROM tgt WHERE target_binary IS NOT NULL")


@case("d12_class_balance", "year:i n_pos:i n_neg:i scale_pos_weight:6", "SELECT year, sum(target_binary) AS n_pos, sum(1 - target_binary) AS n_neg, coalesce(sum(1 - target_binary) / nullif(sum(target_binary), 0), 1.0) AS scale_pos_weight FROM bt GROUP BY 1")
def _(m):
    rows = binary_target(rank_targets(residual_return(smooth_return(m.month_table()))))
    return summaries.class_balance(rows.where("target_binary IS NOT NULL").withColumn("year", F.year("date")), "target_binary", ["year"])


@case("d13_compare_configs", "strategy total_return:6 spy_total:6 year_return:6", """SELECT strategy, product(1 + portfolio_return) - 1 AS total_return, product(1 + spy_return) - 1 AS spy_total,
  product(CASE WHEN year = 2000 THEN 1 + portfolio_return ELSE 1 END) - 1 AS year_return FROM strat GROUP BY 1""")
def _(m):
    return summaries.compare_configs(m.strategy_returns(), 2000)


@case("d14_session_report", "n_sessions:i avg_return:6 avg_excess:6 win_rate:6 total_excess:6", """SELECT count(*) AS n_sessions, avg(portfolio_return) AS avg_return, avg(excess_return) AS avg_excess,
  avg(CAST(excess_return > 0 AS DOUBLE)) AS win_rate, sum(excess_return) AS total_excess FROM strat""")
def _(m):
    return summaries.session_report(m.strategy_returns())


@case("d15_sector_return", "date:d sector sector_return:6", "SELECT date, sector, avg(ret) AS sector_return FROM rets r JOIN meta g ON g.ticker = r.ticker GROUP BY 1, 2")
def _(m):
    return summaries.sector_returns(m.returns().join(m.meta().select("ticker", "sector"), "ticker"))


@case("d16_data_fingerprint", "data_hash n_rows:i", "SELECT md5(count(*) || '|8|' || strftime(max(date), '%Y-%m-%d') || '|' || count(DISTINCT ticker)) AS data_hash, count(*) AS n_rows FROM prices")
def _(m):
    return summaries.fingerprint(m.prices())
