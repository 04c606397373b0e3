"""W: the walk-forward run end to end, with the momentum rank in place of a trained model so
that everything after the scorer has SQL text. ``o05`` runs the trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import evaluation
from quantloom.plans import walkforward
from quantloom.plans.momentum import yearly_summary
from quantloom.session import reliable
from quantloom.suite.oracle import add_cte, rank_sql
from quantloom.suite.registry import case

add_cte("wfyear", "SELECT min(year(date)) + 3 AS y FROM scores")
add_cte("wfbook", """SELECT 'walk_forward' AS strategy, date, raw_return, turnover, spy_return, raw_return - (0.001::DOUBLE + coalesce(0.001::DOUBLE + 0.001::DOUBLE * turnover, 0.0015::DOUBLE)) AS portfolio_return FROM (
  SELECT p.date, raw_return, spy_return, CASE WHEN p.date > (SELECT min(date) FROM scores WHERE year(date) >= (SELECT y FROM wfyear)) THEN h.turnover END AS turnover
  FROM pret p JOIN spyret s ON s.date = p.date LEFT JOIN hchange h ON h.strategy = p.strategy AND h.date = p.date WHERE p.strategy = 'top20' AND year(p.date) >= (SELECT y FROM wfyear))""")


def _scorer(train, test):
    return test.withColumn("pred_proba", F.col("score"))


def _scored(rows, target):
    return walkforward.fold_scores(rows, ["score"], _scorer, target=target)


def _book(m):
    return walkforward.backtest(_scored(m.scores(), "target_excess"), m.prices(), m.bench())


@case("w01_walk_forward_book", "strategy date:d raw_return:8 turnover:8 spy_return:8 portfolio_return:8", "SELECT * FROM wfbook")
def _(m):
    return _book(m)


@case("w02_walk_forward_years", "strategy year:i portfolio_return:6 spy_return:6 excess_return:6 win_rate:6 n_months:i", """SELECT *, portfolio_return - spy_return AS excess_return FROM (SELECT strategy, year(date) AS year, product(1 + portfolio_return) - 1 AS portfolio_return, product(1 + spy_return) - 1 AS spy_return,
  avg(CAST(portfolio_return > spy_return AS DOUBLE)) AS win_rate, count(*) AS n_months FROM wfbook GROUP BY 1, 2)""")
def _(m):
    return yearly_summary(_book(m))


@case("w03_fold_quality", "year:i base_rate:6 precision_n:6 precision_10:6 precision_5:6 bottom_decile:6 lift:6", "SELECT * FROM quality WHERE year >= (SELECT min(year) + 3 FROM tgtrows)")
def _(m):
    # rows without a feature take no part in the quality of a fold
    scored = _scored(reliable(m.scored_targets()), "target_binary")
    return evaluation.yearly_quality(reliable(scored.withColumn("year", F.col("test_year"))))


add_cte("wfmember", "SELECT s.ticker, s.date, coalesce(score, 0) AS pred_proba, year(s.date) AS test_year FROM scores s JOIN snapof o ON o.date = s.date JOIN uni u ON u.snapshot_date = o.snapshot_date AND u.ticker = s.ticker")


@case("w04_member_folds", "ticker date:d test_year:i pred_proba:8", "SELECT * FROM wfmember WHERE test_year >= (SELECT min(test_year) + 3 FROM wfmember)")
def _(m):
    return walkforward.fold_scores(m.scores(), ["score"], _scorer, target="target_excess", snapshots=reliable(m.universe()))


_W24 = "(ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
_W120 = "(ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"
add_cte("wfvol", "SELECT date, max(market_volatility) AS market_volatility FROM scores GROUP BY 1")
add_cte("wfscl", f"""SELECT b.* EXCLUDE (portfolio_return), b.portfolio_return AS gross_return, market_volatility, avg(CASE WHEN portfolio_return > 0 THEN 1.0 ELSE 0.0 END) OVER {_W120} AS wr,
  coalesce(avg(CASE WHEN portfolio_return > 0 THEN portfolio_return END) OVER {_W120}, 0.02) AS gain, abs(coalesce(avg(CASE WHEN portfolio_return < 0 THEN portfolio_return END) OVER {_W120}, 0.02)) AS loss, count(portfolio_return) OVER {_W120} AS seen,
  count(portfolio_return) OVER {_W24} AS near, stddev_pop(portfolio_return) OVER {_W24} * sqrt(12) AS vol FROM wfbook b LEFT JOIN wfvol v USING (date)""")
add_cte("wfscl2", """SELECT *, CASE WHEN near >= 12 AND vol > 0.05 THEN greatest(least(0.15 / vol, 2), 0.25) ELSE 1 END AS vol_scale, CASE WHEN seen >= 24 AND loss > 0 THEN greatest(least((wr - (1 - wr) / (gain / loss)) * 0.25, 0.5), 0.25) ELSE 1 END AS kelly_scale,
  CASE WHEN CASE WHEN market_volatility < 1 THEN market_volatility * 100 ELSE market_volatility END > 2.5 THEN 0.5 ELSE 1 END AS risk_off_scale FROM wfscl""")


@case("w05_scaled_book", "strategy date:d gross_return:6 vol_scale:6 kelly_scale:6 risk_off_scale:2 position_scale:6 portfolio_return:6 excess_return:6", """SELECT *, gross_return * position_scale AS portfolio_return, gross_return * position_scale - spy_return AS excess_return
  FROM (SELECT *, greatest(least(vol_scale * kelly_scale * risk_off_scale, 1.5), 0.5) AS position_scale FROM wfscl2)""")
def _(m):
    scores = m.scores()
    volatility = scores.groupBy("date").agg(F.max("market_volatility").alias("market_volatility"))
    # thresholds as in n11 and n12
    return walkforward.scaled_backtest(_scored(scores, "target_excess"), m.prices(), m.bench(), volatility, threshold=2.5, kelly_periods=24)


add_cte("wfq", f"""SELECT *, ({rank_sql('score', 'year')}) * count(*) OVER (PARTITION BY year) AS rk, sum(target_binary) OVER (PARTITION BY year) AS p, count(*) OVER (PARTITION BY year) AS n FROM tgtrows WHERE year >= (SELECT min(year) + 3 FROM tgtrows)""")
add_cte("wfauc", "SELECT year, (sum(CASE WHEN target_binary = 1 THEN rk ELSE 0 END) - any_value(p) * (any_value(p) + 1) / 2.0) / nullif(any_value(p) * (any_value(n) - any_value(p)), 0) AS auc FROM wfq GROUP BY 1")
add_cte("wfic", f"""SELECT year, count(*) AS n_samples, corr(rs, ra) AS ic, corr(score, future_return_resid) AS pearson_ic FROM (SELECT *, {rank_sql('score', 'year')} AS rs, {rank_sql('future_return_resid', 'year')} AS ra FROM wfq WHERE future_return_resid IS NOT NULL) GROUP BY 1""")


@case("w06_fold_metrics", "test_year:i auc:8 n_samples:i ic:8 pearson_ic:8 precision_n:6 precision_10:6 bottom_decile:6 lift:6", """SELECT a.year AS test_year, auc, n_samples, CASE WHEN n_samples >= 10 THEN ic ELSE 0 END AS ic, CASE WHEN n_samples >= 10 THEN pearson_ic ELSE 0 END AS pearson_ic, precision_n, precision_10, bottom_decile, lift
  FROM wfauc a LEFT JOIN wfic i ON i.year = a.year JOIN quality q ON q.year = a.year""")
def _(m):
    return walkforward.fold_quality(_scored(reliable(m.scored_targets()), "target_binary"))
