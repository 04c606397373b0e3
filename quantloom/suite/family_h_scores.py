"""H, I and P: factor scores, regimes, sentiment; with the screening rows of B, C, D, J."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import ladders, news, regime, scores, summaries, technical
from quantloom.operators.asof import sample_at
from quantloom.suite.oracle import CTES, above_sql, add_cte, below_sql, clip_sql, mean_sql, steps_sql, w
from quantloom.suite.registry import case

_W = "(PARTITION BY ticker ORDER BY date)"
_H = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"

# -- derived tables ---------------------------------------------------------------

add_cte("macro", """SELECT *, CASE WHEN vix > 30 OR spy_volatility > 25 THEN 'high_volatility' WHEN spy_trend < -5 AND vix > 20 THEN 'bear' WHEN spy_trend > 5 AND vix < 15 THEN 'bull'
  WHEN vix < 15 AND spy_trend > 0 THEN 'risk_on' WHEN vix > 25 THEN 'risk_off' ELSE 'sideways' END AS regime FROM (
  SELECT b.date, coalesce(round(market_volatility * 100 / 12, 6), 20.0) AS vix, round(coalesce(CASE WHEN n >= 200 THEN (close / a - 1) * 100 END, 0) * 8, 6) AS spy_trend,
  round(coalesce(CASE WHEN n >= 20 THEN sd * sqrt(252) * 100 END, 15), 6) AS spy_volatility FROM (
    SELECT *, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS a, stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING) AS sd FROM (
      SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS r, row_number() OVER (ORDER BY date) AS n FROM (SELECT date, 100 * pow(close / 50000, 0.08::DOUBLE) AS close FROM bench))) b LEFT JOIN mkt ON mkt.date = b.date)""")
add_cte("hist1", f"""SELECT *, CASE WHEN c20 = 20 THEN s20 END AS v, close / peak - 1 AS dd FROM (SELECT ticker, date, close, count(ret) OVER {_H} AS n_returns, stddev_samp(ret) OVER {_H} AS sd, avg(ret) OVER {_H} AS mean_return,
  stddev_samp(ret) OVER {w(20)} AS s20, count(ret) OVER {w(20)} AS c20, max(close) OVER {_H} AS peak, covar_samp(sv, mv) OVER {_H} AS cov, var_samp(mv) OVER {_H} AS vr, count(mv) OVER {_H} AS pairs FROM rbv)""")
add_cte("hist", f"""SELECT ticker, date, n_returns, mean_return, sd AS daily_vol, sd * sqrt(252) * 100 AS volatility_annual, stddev_samp(v) OVER {_H} / nullif(avg(v) OVER {_H}, 0) AS vol_of_vol,
  abs(min(dd) OVER {_H}) * 100 AS worst_drawdown, CASE WHEN pairs >= 60 THEN cov / nullif(vr, 0) END AS history_beta FROM hist1""")
add_cte("mom", f"""SELECT ticker, date, (close - p21) / p21 * 100 AS mom_1m, (close - p65) / p65 * 100 AS mom_3m, (close - p125) / p125 * 100 AS mom_6m, (close - p251) / p251 * 100 AS mom_12m, close / pc - 1 AS day_change,
  CASE WHEN n >= 20 THEN volume / v20 END AS volume_surge, CASE WHEN n >= 20 THEN 1 - s10 / v10 END AS volume_stability FROM (SELECT *, lag(close, 21) OVER {_W} AS p21, lag(close, 65) OVER {_W} AS p65,
  lag(close, 125) OVER {_W} AS p125, lag(close, 251) OVER {_W} AS p251, avg(volume) OVER {w(20)} AS v20, avg(volume) OVER {w(10)} AS v10, stddev_samp(volume) OVER {w(10)} AS s10 FROM tp)""")
add_cte("nrank", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, doc_id) - 1 AS recency, count(*) OVER (PARTITION BY ticker) AS n_items FROM news")
_ratios = ", ".join(f"avg(CAST(label = '{x}' AS DOUBLE)) AS {x}_ratio" for x in ("positive", "negative", "neutral"))
_nagg = """SELECT *, CASE WHEN article_count >= 4 AND round(nw - od, 9) > 0.1 THEN 'improving' WHEN article_count >= 4 AND round(nw - od, 9) < -0.1 THEN 'deteriorating' ELSE 'stable' END AS trend FROM (
  SELECT ticker, sum({w} * sentiment) / sum({w}) AS sentiment_score, {r}, count(*) AS article_count, arg_max(title, (published_at, -doc_id)) AS latest_headline, {c} AS confidence,
  avg(sentiment) FILTER (recency < n_items // 2) AS nw, avg(sentiment) FILTER (recency >= n_items // 2) AS od FROM nrank GROUP BY 1)"""
add_cte("nseen", "SELECT m.date, n.* FROM news n JOIN mends m ON CAST(published_at AS DATE) <= m.date AND CAST(published_at AS DATE) > m.date - 365")
add_cte("nrankd", "SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY published_at DESC, doc_id) - 1 AS recency, count(*) OVER (PARTITION BY ticker, date) AS n_items FROM nseen")
add_cte("nsentd", _nagg.format(w="exp(-0.1::DOUBLE * recency)", r=_ratios, c="avg(confidence)").replace("SELECT ticker, sum", "SELECT ticker, date, sum").replace("FROM nrank GROUP BY 1", "FROM nrankd GROUP BY 1, 2"))
add_cte("nsent", _nagg.format(w="exp(-0.1::DOUBLE * recency)", r=_ratios, c="avg(confidence)"))
_wr = "(exp(-0.1::DOUBLE * recency) * (1 + relevance))"
add_cte("nsentr", _nagg.format(w=_wr, r=_ratios, c=f"sum({_wr} * confidence) / sum({_wr})"))
_FUND = [c for c in "pe_ratio peg_ratio pb_ratio ps_ratio ev_to_ebitda roe roa debt_to_equity profit_margin operating_margin gross_margin current_ratio quick_ratio revenue_growth earnings_growth dividend_yield payout_ratio free_cash_flow".split()]
add_cte("scr", f"""SELECT t.*, e.date AS d, x.* EXCLUDE (ticker, date), h.* EXCLUDE (ticker, date), f.date AS fundamentals_date, {', '.join('f.' + c for c in _FUND)}, g.sector, g.industry, g.market_cap, k.vix, k.spy_trend, k.spy_volatility, k.regime,
  s.sentiment_score, s.positive_ratio, s.negative_ratio, s.article_count, s.confidence, s.trend, coalesce(q.score, 0.5) AS direction_prob, coalesce((q.score - 0.5) * 12, 0) AS predicted_return, coalesce(abs((q.score - 0.5) * 2), 0) AS model_confidence
  FROM (SELECT t.ticker, e.date FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN mends e) e ASOF JOIN tech t ON t.ticker = e.ticker AND t.date <= e.date
  JOIN mom x ON x.ticker = t.ticker AND x.date = t.date JOIN hist h ON h.ticker = t.ticker AND h.date = t.date ASOF LEFT JOIN fund f ON f.ticker = e.ticker AND f.date <= e.date
  LEFT JOIN meta g ON g.ticker = e.ticker JOIN macro k ON k.date = e.date LEFT JOIN nsentd s ON s.ticker = e.ticker AND s.date = e.date LEFT JOIN scores q ON q.ticker = e.ticker AND q.date = e.date""")


def _rung(name, value):
    pairs, other = getattr(ladders, name), ladders.ELSE.get(name, 0)
    if name.endswith("_UP"):
        return above_sql(value, pairs, other)
    if name.endswith("_DOWN"):
        return below_sql(value, pairs, other)
    return steps_sql(value, [(">=", t, p) for t, p in pairs], other)


def _sum(*parts):
    return "(" + " + ".join(f"coalesce({p}, 0)" for p in parts) + ")"


def _pct(c):
    return f"(nullif({c}, 0) * 100)"


def _pos(c):
    return f"(CASE WHEN {c} > 0 THEN {c} END)"


def _nz(c):
    return f"nullif({c}, 0)"


P: dict[str, str] = {}
P["momentum_price"] = _sum(*[_rung(f"MOMENTUM_{h}_UP", f"mom_{h.lower()}") for h in ("1M", "3M", "6M", "12M")])
P["momentum_trend"] = _sum("CASE WHEN close > sma_20 THEN 5 END", "CASE WHEN close > sma_50 THEN 5 END", "CASE WHEN close > sma_200 THEN 3 END", "CASE WHEN sma_20 > sma_50 THEN 2 END", _rung("ADX_UP", "adx"))
P["momentum_volume"] = _sum("CASE WHEN volume_surge IS NOT NULL AND day_change > 0 THEN CASE WHEN volume_surge > 1.5 THEN 10 WHEN volume_surge > 1.2 THEN 6 ELSE 3 END END", _rung("STABILITY_UP", "volume_stability"))
P["momentum_technical"] = _sum("CASE WHEN macd <> 0 AND macd_signal <> 0 AND macd_hist <> 0 AND macd > macd_signal THEN CASE WHEN macd > 0 THEN 10 ELSE 6 END END",
                               "CASE WHEN rsi >= 55 AND rsi <= 70 THEN 10 WHEN rsi >= 50 AND rsi < 55 THEN 7 WHEN rsi >= 45 AND rsi < 50 THEN 4 WHEN rsi > 70 AND rsi <= 80 THEN 5 WHEN rsi < 30 AND rsi <> 0 THEN 3 END")
P["momentum_score"] = f"CASE WHEN bar_no < 60 THEN 50 ELSE ({P['momentum_price']} + {P['momentum_volume']} + CASE WHEN rsi IS NOT NULL THEN {P['momentum_trend']} + {P['momentum_technical']} ELSE 0 END) / CASE WHEN rsi IS NOT NULL THEN 100.0 ELSE 55.0 END * 100 END"
P["value_valuation"] = _sum(*[_rung(f"VALUE_{n}_DOWN", _pos(c)) for n, c in [("PE", "pe_ratio"), ("PEG", "peg_ratio"), ("PB", "pb_ratio"), ("PS", "ps_ratio"), ("EV", "ev_to_ebitda")]])
P["value_profit"] = _sum(*[_rung(f"VALUE_{n}_UP", _pct(c)) for n, c in [("MARGIN", "profit_margin"), ("ROE", "roe"), ("ROA", "roa"), ("OPMARGIN", "operating_margin")]])
P["value_health"] = _sum(_rung("VALUE_DEBT_DOWN", "debt_to_equity"), _rung("VALUE_CURRENT_UP", _nz("current_ratio")), "CASE WHEN free_cash_flow > 0 THEN 5 END")
P["value_income"] = _sum(_rung("VALUE_YIELD_UP", _pct("dividend_yield")), "CASE WHEN payout_ratio * 100 BETWEEN 30 AND 60 THEN 3 WHEN (payout_ratio * 100 >= 20 AND payout_ratio * 100 < 30) OR (payout_ratio * 100 > 60 AND payout_ratio * 100 <= 70) THEN 2 WHEN payout_ratio <> 0 AND payout_ratio * 100 < 80 THEN 1 END")
P["value_score"] = f"CASE WHEN fundamentals_date IS NULL THEN 50 ELSE {P['value_valuation']} + {P['value_profit']} + {P['value_health']} + {P['value_income']} END"
P["growth_revenue"] = _sum(_rung("GROWTH_REVENUE_UP", _pct("revenue_growth")))
P["growth_earnings"] = _sum(_rung("GROWTH_EARNINGS_UP", _pct("earnings_growth")))
P["growth_quality"] = _sum(_rung("GROWTH_MARGIN_UP", _pct("profit_margin")), _rung("GROWTH_ROE_UP", _pct("roe")))
P["growth_price"] = _sum(_rung("GROWTH_PEG_DOWN", _pos("peg_ratio")))
_g = " + ".join(P[k] for k in ("growth_revenue", "growth_earnings", "growth_quality", "growth_price"))
P["growth_score"] = f"CASE WHEN fundamentals_date IS NULL OR {_g} = 0 THEN 50 ELSE {_g} END"
P["five_beta"] = "CASE WHEN history_beta IS NULL THEN 50 WHEN history_beta BETWEEN 0.8 AND 1.2 THEN 100 WHEN (history_beta >= 0.6 AND history_beta < 0.8) OR (history_beta > 1.2 AND history_beta <= 1.5) THEN 75 WHEN history_beta < 0.6 THEN 40 ELSE 30 END"
P["five_size"] = f"coalesce({_rung('SIZE_FROM', _nz('market_cap'))}, 50)"
P["five_value"] = mean_sql([_rung("FIVE_PB_DOWN", _nz("pb_ratio")), _rung("FIVE_PE_DOWN", _nz("pe_ratio")), _rung("FIVE_PS_DOWN", _nz("ps_ratio"))])
P["five_profit"] = mean_sql([_rung("FIVE_ROE_UP", _nz("roe")), _rung("FIVE_OPMARGIN_UP", _nz("operating_margin")), _rung("FIVE_MARGIN_UP", _nz("profit_margin")), _rung("FIVE_ROA_UP", _nz("roa"))])
P["five_investment"] = mean_sql(["(CASE WHEN free_cash_flow > 0 THEN 70 WHEN free_cash_flow < 0 THEN 30 END)", _rung("FIVE_CURRENT_UP", _nz("current_ratio")), _rung("FIVE_DEBT_DOWN", _nz("debt_to_equity"))])
P["fama_french_score"] = f"CASE WHEN fundamentals_date IS NULL OR sector IS NULL THEN 50 ELSE 0.15::DOUBLE * {P['five_beta']} + 0.20::DOUBLE * {P['five_size']} + 0.25::DOUBLE * {P['five_value']} + 0.25::DOUBLE * {P['five_profit']} + 0.15::DOUBLE * {P['five_investment']} END"
_qr = _rung("QUALITY_ROE_UP", _nz("roe"))
P["quality_profit"] = mean_sql([_qr, _qr, *[_rung(f"QUALITY_{n}_UP", _nz(c)) for n, c in [("ROA", "roa"), ("MARGIN", "profit_margin"), ("OPMARGIN", "operating_margin"), ("GROSS", "gross_margin")]]])
_qd = _rung("QUALITY_DEBT_DOWN", "debt_to_equity")
P["quality_strength"] = mean_sql([_qd, _qd, _rung("QUALITY_CURRENT_UP", _nz("current_ratio")), _rung("QUALITY_QUICK_UP", _nz("quick_ratio"))])
P["quality_cash"] = f"coalesce({_rung('QUALITY_FCF_UP', 'free_cash_flow')}, 50)"
P["quality_dividend"] = mean_sql([
    "(CASE WHEN dividend_yield BETWEEN 0.02 AND 0.04 THEN 100 WHEN dividend_yield >= 0.01 AND dividend_yield < 0.02 THEN 75 WHEN dividend_yield > 0.04 AND dividend_yield <= 0.06 THEN 85 WHEN dividend_yield > 0.06 THEN 50 WHEN dividend_yield <> 0 THEN 60 END)",
    "(CASE WHEN payout_ratio BETWEEN 0.3 AND 0.6 THEN 100 WHEN payout_ratio >= 0.2 AND payout_ratio < 0.3 THEN 90 WHEN payout_ratio > 0.6 AND payout_ratio <= 0.8 THEN 75 WHEN payout_ratio > 0.8 AND payout_ratio <= 1 THEN 50 WHEN payout_ratio > 1 THEN 20 WHEN payout_ratio <> 0 THEN 70 END)"], 60.0)
P["quality_score"] = f"CASE WHEN fundamentals_date IS NULL THEN 50 ELSE 0.35::DOUBLE * {P['quality_profit']} + 0.30::DOUBLE * {P['quality_strength']} + 0.20::DOUBLE * {P['quality_cash']} + 0.15::DOUBLE * {P['quality_dividend']} END"
P["lowvol_volatility"] = f"CASE WHEN bar_no >= 30 THEN coalesce({_rung('LOWVOL_VOL_DOWN', 'volatility_annual')}, 50) ELSE 50 END"
P["lowvol_beta"] = f"coalesce({_rung('LOWVOL_BETA_DOWN', 'history_beta')}, 50)"
P["lowvol_stability"] = f"CASE WHEN bar_no >= 30 THEN coalesce({_rung('LOWVOL_STABILITY_DOWN', 'coalesce(vol_of_vol, 1.0)')}, 50) ELSE 50 END"
P["lowvol_drawdown"] = f"CASE WHEN bar_no >= 30 THEN coalesce({_rung('LOWVOL_DRAWDOWN_DOWN', 'worst_drawdown')}, 50) ELSE 50 END"
P["low_volatility_score"] = f"0.40::DOUBLE * {P['lowvol_volatility']} + 0.30::DOUBLE * {P['lowvol_beta']} + 0.20::DOUBLE * {P['lowvol_stability']} + 0.10::DOUBLE * {P['lowvol_drawdown']}"
P["sentiment_level"] = clip_sql("(sentiment_score + 1) * 50", 0, 100)
P["sentiment_ratio"] = f"CASE WHEN negative_ratio = 0 THEN CASE WHEN positive_ratio > 0.5 THEN 100 WHEN positive_ratio > 0.3 THEN 80 ELSE 60 END ELSE {_rung('SENTIMENT_RATIO_FROM', '(positive_ratio / (negative_ratio + 0.001::DOUBLE))')} END"
P["sentiment_trend"] = "CASE WHEN trend = 'improving' THEN 100 WHEN trend = 'stable' THEN CASE WHEN sentiment_score > 0.2 THEN 75 WHEN sentiment_score < -0.2 THEN 25 ELSE 50 END ELSE 20 END"
P["sentiment_conviction"] = "CASE WHEN article_count >= 20 THEN 50 WHEN article_count >= 10 THEN 40 WHEN article_count >= 5 THEN 30 ELSE article_count * 5 END + confidence * 50"
P["news_sentiment_score"] = f"CASE WHEN coalesce(article_count, 0) = 0 THEN 50 ELSE greatest(least(0.40::DOUBLE * ({P['sentiment_level']}) + 0.30::DOUBLE * ({P['sentiment_ratio']}) + 0.20::DOUBLE * ({P['sentiment_trend']}) + 0.10::DOUBLE * ({P['sentiment_conviction']}), 100), 0) END"
P["return_points"] = "CASE WHEN predicted_return >= 5 THEN 100 WHEN predicted_return >= 3 THEN 80 + (predicted_return - 3) / 2 * 20 WHEN predicted_return >= 1 THEN 60 + (predicted_return - 1) / 2 * 20 WHEN predicted_return >= 0 THEN 50 + predicted_return * 10 WHEN predicted_return >= -1 THEN 40 + (predicted_return + 1) * 10 WHEN predicted_return >= -3 THEN 20 + (predicted_return + 3) / 2 * 20 WHEN predicted_return >= -5 THEN (predicted_return + 5) / 2 * 20 ELSE 0 END"
P["ml_prediction_score"] = f"CASE WHEN bar_no < 60 THEN 50 ELSE greatest(least(0.40::DOUBLE * greatest(least((direction_prob - 0.5) * 200, 100), 0) + 0.35::DOUBLE * ({P['return_points']}) + 0.25::DOUBLE * model_confidence * 100, 100), 0) END"
_S = list(scores.SCORES)
add_cte("scored", "SELECT * EXCLUDE (date, d), d AS date, " + ", ".join(f"{P[n + '_score']} AS {n}_score" for n in _S) + " FROM scr")
add_cte("rweights", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}', {x}::DOUBLE)" for r, t in ladders.REGIME_WEIGHTS.items() for s, x in t.items()) + ") v(regime, strategy, weight)")
add_cte("longscore", " UNION ALL ".join(f"SELECT ticker, date, regime, '{n}' AS strategy, {n}_score AS s FROM scored" for n in _S))
add_cte("comp", """SELECT ticker, date, round(sum(wt * s) / sum(wt), 9) AS composite_score FROM (SELECT l.*, coalesce(r.weight, 0.5) * CASE WHEN abs(s - 50) > 0.1 THEN 1.0 ELSE 0.1 END AS wt
  FROM longscore l LEFT JOIN rweights r ON r.regime = l.regime AND r.strategy = l.strategy) GROUP BY 1, 2""")
add_cte("ana", """SELECT *, CASE WHEN composite_score >= 80 THEN 'STRONG_BUY' WHEN composite_score >= 60 THEN 'BUY' WHEN composite_score >= 40 THEN 'HOLD' WHEN composite_score >= 20 THEN 'SELL' ELSE 'STRONG_SELL' END AS signal,
  CASE WHEN sma_20 IS NULL THEN 'NEUTRAL' WHEN (CASE WHEN close > sma_20 THEN 1 ELSE 0 END + CASE WHEN close > sma_50 THEN 1 ELSE 0 END) / CASE WHEN sma_50 IS NULL THEN 1.0 ELSE 2.0 END >= 0.66 THEN 'BULLISH'
  WHEN (CASE WHEN close > sma_20 THEN 1 ELSE 0 END + CASE WHEN close > sma_50 THEN 1 ELSE 0 END) / CASE WHEN sma_50 IS NULL THEN 1.0 ELSE 2.0 END <= 0.33 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_direction,
  (1 + CASE WHEN fundamentals_date IS NULL THEN 0 ELSE 1 END + CASE WHEN rsi IS NULL THEN 0 ELSE 1 END + CASE WHEN bar_no >= 60 THEN 1 ELSE 0 END) / 4.0 AS data_confidence FROM scored JOIN comp USING (ticker, date)""")


def _part(name, pieces, doc_digits=4):
    contract = "ticker date:d " + " ".join(f"{p}:{doc_digits}" for p in pieces)
    sql = "SELECT ticker, d AS date, " + ", ".join(f"{P[p]} AS {p}" for p in pieces) + " FROM scr"

    def build(m):
        rows = m.screen_rows()
        cols = []
        for p in pieces:
            made = scores.growth_parts().get(p) if p.startswith("growth_") and p != "growth_score" else None
            if made is None:
                made = scores.predicted_return_points() if p == "return_points" else getattr(scores, p)()
            cols.append(made.alias(p))
        return rows.select("ticker", "date", *cols)

    case(name, contract, sql)(build)


@case("h01_normalize_score", "ticker date:d normalized:4", "SELECT ticker, d AS date, greatest(least(mom_1m / 35.0 * 100, 100), 0) AS normalized FROM scr WHERE mom_1m IS NOT NULL")
def _(m):
    return m.screen_rows().where("mom_1m IS NOT NULL").select("ticker", "date", scores.normalize(F.col("mom_1m"), 35.0).alias("normalized"))


_part("h02_momentum_price", ["momentum_price"])
_part("h03_momentum_trend", ["momentum_trend"])
_part("h04_momentum_volume", ["momentum_volume"])
_part("h05_momentum_technical", ["momentum_technical"])
_part("h06_value_valuation", ["value_valuation"])
_part("h07_value_profit", ["value_profit"])
_part("h08_value_health", ["value_health"])
_part("h09_value_income", ["value_income"])
_part("h10_growth", ["growth_revenue", "growth_earnings", "growth_quality", "growth_price", "growth_score"])
_part("h11_five_factor_beta_size", ["five_beta", "five_size"])
_part("h12_five_factor_fundamentals", ["five_value", "five_profit", "five_investment"])
_part("h13_quality_profit", ["quality_profit"])
_part("h14_quality_strength_cash_dividend", ["quality_strength", "quality_cash", "quality_dividend"])
_part("h15_low_volatility_vol_beta", ["lowvol_volatility", "lowvol_beta"])
_part("h16_low_volatility_stability_drawdown", ["lowvol_stability", "lowvol_drawdown"])
_part("h17_sentiment_parts", ["sentiment_level", "sentiment_ratio", "sentiment_trend", "sentiment_conviction"])
_part("h18_model_score", ["return_points", "ml_prediction_score"])


@case("h26_strategy_scores", "ticker date:d " + " ".join(f"{n}_score:4" for n in _S), "SELECT * FROM scored")
def _(m):
    return scores.with_scores(m.screen_rows())


@case("h19_composite", "ticker date:d regime composite_score:4", "SELECT * FROM ana")
def _(m):
    return m.analyses()


@case("h20_signal", "ticker date:d signal", "SELECT * FROM ana")
def _(m):
    return m.analyses()


@case("h21_trend", "ticker date:d trend_direction", "SELECT * FROM ana")
def _(m):
    return m.analyses()


@case("h22_confidence", "ticker date:d data_confidence:4", "SELECT * FROM ana")
def _(m):
    return m.analyses()


@case("h23_strengths_risks", "ticker date:d strengths risks", """SELECT ticker, date, array_to_string(list_filter([CASE WHEN roe > 0.15 THEN format('Strong ROE of {:.1f}%', round(roe * 100 + 1e-7::DOUBLE, 1)) END, CASE WHEN pe_ratio < 15 AND pe_ratio <> 0 THEN format('Attractive P/E of {:.1f}', round(pe_ratio + 1e-7::DOUBLE, 1)) END,
  CASE WHEN rsi < 30 AND rsi <> 0 THEN 'Oversold condition (RSI < 30)' END, CASE WHEN momentum_score > 70 THEN 'Strong price momentum' END, CASE WHEN value_score > 70 THEN 'Attractive valuation' END], lambda x: x IS NOT NULL), '; ') AS strengths,
  array_to_string(list_filter([CASE WHEN debt_to_equity > 1.5 THEN format('High debt/equity ratio: {:.2f}', round(debt_to_equity + 1e-7::DOUBLE, 2)) END, CASE WHEN rsi > 70 THEN 'Overbought condition (RSI > 70)' END], lambda x: x IS NOT NULL), '; ') AS risks FROM ana""")
def _(m):
    return m.analyses().select("ticker", "date", F.array_join("key_strengths", "; ").alias("strengths"), F.array_join("key_risks", "; ").alias("risks"))


@case("h24_thesis_levels", "ticker date:d upside:i entry_price:2 stop_loss:2 price_target:2 risk_reward:4", """SELECT *, (price_target - entry_price) / nullif(entry_price - stop_loss, 0) AS risk_reward FROM (SELECT *, entry_price * CASE WHEN volatility_annual > 40 THEN 0.88::DOUBLE ELSE 0.92::DOUBLE END AS stop_loss, close * (1 + upside / 100.0::DOUBLE) AS price_target FROM (
  SELECT ticker, date, close, volatility_annual, CASE WHEN composite_score >= 70 THEN 15 WHEN composite_score >= 60 THEN 10 WHEN composite_score >= 50 THEN 8 WHEN composite_score >= 40 THEN 5 ELSE 0 END AS upside,
  CASE WHEN sma_20 <> 0 THEN least(close, sma_20 * 1.02::DOUBLE) ELSE close END AS entry_price FROM ana))""")
def _(m):
    return scores.thesis_levels(m.analyses())


@case("h25_quote_change", "ticker date:d change:2 change_percent:6", f"SELECT ticker, date, close - lag(close) OVER {_W} AS change, (close - lag(close) OVER {_W}) / lag(close) OVER {_W} * 100 AS change_percent FROM prices")
def _(m):
    from quantloom.functions.columns import by_bar

    rows = m.prices().select("ticker", "date", "close", F.lag("close").over(by_bar()).alias("before"))
    return rows.select("ticker", "date", (F.col("close") - F.col("before")).alias("change"), ((F.col("close") - F.col("before")) / F.col("before") * 100).alias("change_percent"))


# -- screening rows of other families -----------------------------------------------


@case("b10_screen", "ticker date:d composite_score:4 signal", "SELECT * FROM ana WHERE composite_score >= 45 AND signal IN ('BUY', 'HOLD') ORDER BY composite_score DESC, ticker, date LIMIT 200")
def _(m):
    return scores.screen(m.analyses(), 45, ["BUY", "HOLD"], 200)


@case("b11_hot_buys", "ticker date:d composite_score:4 signal", "SELECT * FROM ana WHERE signal IN ('BUY', 'STRONG_BUY') OR (signal = 'HOLD' AND composite_score >= 55) ORDER BY composite_score DESC, ticker, date LIMIT 15")
def _(m):
    return scores.hot_buys(m.analyses())


@case("b12_top_and_signal", "kind ticker date:d composite_score:4", """SELECT 'top' AS kind, ticker, date, composite_score FROM (SELECT * FROM ana ORDER BY composite_score DESC, ticker, date LIMIT 30)
  UNION ALL SELECT 'buy', ticker, date, composite_score FROM ana WHERE signal = 'BUY'""")
def _(m):
    a = m.analyses().select("ticker", "date", "composite_score", "signal")
    top = a.orderBy(F.desc("composite_score"), "ticker", "date").limit(30).withColumn("kind", F.lit("top"))
    return top.unionByName(a.where("signal = 'BUY'").withColumn("kind", F.lit("buy")))


@case("c15_scores_weights", "ticker date:d strategy s:4 weight:4", "SELECT l.ticker, l.date, l.strategy, s, coalesce(r.weight, 0.5) AS weight FROM longscore l LEFT JOIN rweights r ON r.regime = l.regime AND r.strategy = l.strategy")
def _(m):
    a = m.analyses()
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"{n}_score").alias("s")) for n in _S])
    long = a.select("ticker", "date", "regime", F.explode(pairs).alias("p")).select("ticker", "date", "regime", "p.*")
    return long.join(F.broadcast(scores.regime_weight_table(long)), ["regime", "strategy"], "left").fillna(0.5, ["weight"])


@case("c16_analysis_assembly", "ticker date:d bar_date:d close:2 sector pe_ratio:6 rsi:6 history_beta:6 article_count:6", "SELECT *, d AS asof, date AS bar_date FROM scr".replace("SELECT *, d AS asof, date AS bar_date", "SELECT * EXCLUDE (date, d), d AS date, date AS bar_date"))
def _(m):
    return m.screen_rows()


@case("d09_screen_summary", "signal n:i n_all:i avg_score:6 max_score:6", "SELECT signal, count(*) AS n, (SELECT count(*) FROM ana) AS n_all, (SELECT avg(composite_score) FROM ana) AS avg_score, (SELECT max(composite_score) FROM ana) AS max_score FROM ana GROUP BY 1")
def _(m):
    return summaries.screen_summary(m.analyses(), "composite_score")


@case("e20_regime_block", "date:d regime_bull:i regime_bear:i regime_high_vol:i regime_risk_off:i vix_level:6", """SELECT date, CAST(regime = 'bull' AS INT) AS regime_bull, CAST(regime = 'bear' AS INT) AS regime_bear, CAST(regime = 'high_volatility' AS INT) AS regime_high_vol,
  CAST(regime = 'risk_off' AS INT) AS regime_risk_off, vix AS vix_level FROM macro""")
def _(m):
    return regime.regime_flags(m.macro())


@case("j13_single_stock_risk", "ticker date:d volatility_annual:4 sharpe:6 max_drawdown:4", f"""SELECT ticker, date, sd * sqrt(252) * 100 AS volatility_annual, CASE WHEN sd > 0 THEN sqrt(252) * (mu - 0.02 / 252) / sd ELSE 0 END AS sharpe, mdd * 100 AS max_drawdown FROM (
  SELECT ticker, date, count(ret) OVER {_H} AS n, stddev_samp(ret) OVER {_H} AS sd, avg(ret) OVER {_H} AS mu, min(dd) OVER {_H} AS mdd FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN close / max(CASE WHEN ret IS NOT NULL THEN close END) OVER {_H} - 1 END AS dd FROM rets)) WHERE n >= 30""")
def _(m):
    from quantloom.operators.risk import single_stock

    return single_stock(m.prices())


# -- I ----------------------------------------------------------------------------


@case("i01_six_state_regime", "date:d regime", "SELECT * FROM macro")
def _(m):
    return m.macro()


@case("i02_regime_inputs", "date:d vix:5 spy_trend:5 spy_volatility:5", "SELECT * FROM macro")
def _(m):
    return m.macro()


@case("i03_regime_weights", "date:d regime strategy weight:4", "SELECT date, k.regime, strategy, weight FROM macro k JOIN rweights r ON r.regime = k.regime")
def _(m):
    k = m.macro()
    return k.join(F.broadcast(scores.regime_weight_table(k)), "regime")


@case("i04_risk_level", "date:d risk_level position_scale:2", """SELECT *, CASE risk_level WHEN 'HIGH_RISK' THEN 0.25 WHEN 'ELEVATED' THEN 0.5 ELSE 1.0 END AS position_scale FROM (
  SELECT date, CASE WHEN vix > 30 OR spy_trend < 0 THEN 'HIGH_RISK' WHEN vix > 20 THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_level FROM macro)""")
def _(m):
    return regime.risk_level(m.macro())


add_cte("damp", "SELECT date, 0.05::DOUBLE * spy_ret AS spy_ret, row_number() OVER (ORDER BY date) AS n FROM brets WHERE spy_ret IS NOT NULL")
add_cte("cumd", "SELECT a.n AS anchor, b.n, product(1 + b.spy_ret) OVER (PARTITION BY a.n ORDER BY b.n) AS lev FROM damp a JOIN damp b ON b.n BETWEEN a.n - 62 AND a.n")
add_cte("states", """SELECT d.date, vol_63, drawdown_63, CASE WHEN d.n < 63 THEN 'normal' WHEN vol_63 > 0.30 OR drawdown_63 < -0.15 THEN 'crisis' WHEN vol_63 > 0.22 OR drawdown_63 < -0.08 THEN 'high_vol' ELSE 'normal' END AS state FROM
  (SELECT *, stddev_samp(spy_ret) OVER (ORDER BY n ROWS 62 PRECEDING) * sqrt(252) AS vol_63 FROM damp) d JOIN (SELECT anchor, min(dd) AS drawdown_63 FROM (SELECT anchor, lev / max(lev) OVER (PARTITION BY anchor ORDER BY n) - 1 AS dd FROM cumd) GROUP BY 1) x ON x.anchor = d.n""")


@case("i05_three_state_regime", "date:d vol_63:6 drawdown_63:6 state target_beta:3 max_weight:4 n_stocks:i risk_aversion:2", "SELECT s.*, p.* EXCLUDE (state) FROM states s JOIN (VALUES "
      + ", ".join(f"('{k}', {v['target_beta']}, {v['max_weight']}, {v['n_stocks']}, {v['risk_aversion']})" for k, v in ladders.REGIME_PARAMETERS.items()) + ") p(state, target_beta, max_weight, n_stocks, risk_aversion) ON p.state = s.state")
def _(m):
    from quantloom.operators.panel import daily_returns

    market = daily_returns(m.bench(), name="spy_ret").select("date", (0.05 * F.col("spy_ret")).alias("spy_ret"))
    return regime.regime_parameters(regime.three_state(market))


# -- P ----------------------------------------------------------------------------

add_cte("feed", """SELECT doc_id, ticker, published_at, title, sentiment, relevance FROM news UNION ALL
  SELECT doc_id, 'S' || lpad(CAST((doc_id + 1) % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 9, '0'), published_at, title, -sentiment / 2, relevance / 2 FROM news""")


@case("p01_explode_feed", "doc_id:i ticker sentiment:6 label confidence:6 relevance:6", "SELECT doc_id, ticker, sentiment, CASE WHEN sentiment > 0.15 THEN 'positive' WHEN sentiment < -0.15 THEN 'negative' ELSE 'neutral' END AS label, abs(sentiment) AS confidence, relevance FROM feed")
def _(m):
    n = m.table("supplier").agg(F.count(F.lit(1)).alias("n_s"))
    other = F.concat(F.lit("S"), F.lpad(((F.col("doc_id") + 1) % F.col("n_s") + 1).cast("string"), 9, "0"))
    entry = lambda t, s, r: F.struct(t.alias("ticker"), s.alias("ticker_sentiment_score"), r.alias("relevance_score"))
    feed = m.news().crossJoin(F.broadcast(n)).select("doc_id", "published_at", "title", F.array(
        entry(F.col("ticker"), F.col("sentiment"), F.col("relevance")), entry(other, -F.col("sentiment") / 2, F.col("relevance") / 2)).alias("ticker_sentiment"))
    return news.explode_feed(feed)


@case("p02_class_scores", "doc_id:i signed:6 mass_positive:6 mass_negative:6 mass_neutral:6", """SELECT doc_id, CASE label WHEN 'positive' THEN confidence WHEN 'negative' THEN -confidence ELSE 0 END AS signed, CASE WHEN label = 'positive' THEN confidence ELSE 0 END AS mass_positive,
  CASE WHEN label = 'negative' THEN confidence ELSE 0 END AS mass_negative, CASE WHEN label = 'neutral' THEN confidence ELSE 1 - confidence END AS mass_neutral FROM news""")
def _(m):
    return news.class_scores(m.news())


@case("p03_recency_weighted", "ticker sentiment_score:6 confidence:6", "SELECT * FROM nsent")
def _(m):
    return news.aggregate(m.news())


@case("p04_relevance_weighted", "ticker sentiment_score:6 confidence:6", "SELECT * FROM nsentr")
def _(m):
    return news.aggregate(m.news(), by_relevance=True)


@case("p05_ratios_headline", "ticker positive_ratio:6 negative_ratio:6 neutral_ratio:6 article_count:i latest_headline", "SELECT * FROM nsent")
def _(m):
    return news.aggregate(m.news())


@case("p06_trend", "ticker trend", "SELECT * FROM nsent")
def _(m):
    return news.aggregate(m.news())


@case("p07_neutral_default", "ticker sentiment_score:6 positive_ratio:6 negative_ratio:6 neutral_ratio:6 article_count:i trend confidence:6", """SELECT u.ticker, coalesce(sentiment_score, 0) AS sentiment_score, coalesce(positive_ratio, 0.33) AS positive_ratio, coalesce(negative_ratio, 0.33) AS negative_ratio,
  coalesce(neutral_ratio, 0.34) AS neutral_ratio, coalesce(article_count, 0) AS article_count, coalesce(trend, 'stable') AS trend, coalesce(confidence, 0) AS confidence
  FROM (SELECT ticker FROM meta UNION SELECT ticker || 'X' FROM meta) u LEFT JOIN nsent s ON s.ticker = u.ticker""")
def _(m):
    t = m.meta().select("ticker")
    return news.with_default(t.unionByName(t.select(F.concat("ticker", F.lit("X")).alias("ticker"))), news.aggregate(m.news()))


@case("p08_recent_items", "ticker doc_id:i published_at:t", """SELECT ticker, doc_id, published_at FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, doc_id) AS k FROM news
  WHERE published_at > (SELECT max(published_at) FROM news) - INTERVAL 30 DAY) WHERE k <= 50""")
def _(m):
    n = m.news()
    return news.recent_items(n, n.select(F.col("published_at").alias("as_of")), days_back=30)


@case("p08_named_items", "ticker doc_id:i published_at:t", """SELECT ticker, doc_id, published_at FROM (SELECT n.*, row_number() OVER (PARTITION BY n.ticker ORDER BY published_at DESC, doc_id) AS k FROM news n
  WHERE published_at > (SELECT max(published_at) FROM news) - INTERVAL 400 DAY AND (contains(lower(text), lower(ticker)) OR contains(lower(text), CASE WHEN CAST(substr(ticker, 2) AS INT) % 2 = 0 THEN 'threre' ELSE 'que' END))) WHERE k <= 5""")
def _(m):
    n = m.news()
    # names that occur in the texts
    names = n.select("ticker").distinct().withColumn("company_name", F.when(F.substring("ticker", 2, 9).cast("int") % 2 == 0, "Threre").otherwise("Que"))
    return news.recent_items(n, n.select(F.col("published_at").alias("as_of")), days_back=400, cap=5, names=names)
