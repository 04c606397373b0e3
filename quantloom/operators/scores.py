"""Rule-based factor scores as column expressions on one analysis row per (ticker, date).

Every function takes no data, only column names, so a whole score is evaluated inside
the projection that reads the row. ``SCORES`` is the registry; a user adds a score by
adding a function that returns a Column.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import above, below, by_bar, clip, full, mean_present, nonzero, ratio, steps, trailing
from quantloom.operators import ladders
from quantloom.session import spread


_STAGE: list[dict[str, Column]] = []


@contextmanager
def _staging():
    """Collect ladders as columns of their own while scores are being built, so that a
    ladder used several times in a score is compiled and evaluated once."""
    items: dict[str, Column] = {}
    _STAGE.append(items)
    try:
        yield items
    finally:
        _STAGE.pop()


def rung(name: str, value: str | Column) -> Column:
    """A named ladder applied to a value; NULL stays NULL."""
    if not _STAGE:
        return _ladder(name, value)
    _STAGE[-1].setdefault(f"_pt_{name}", _ladder(name, value))
    return F.col(f"_pt_{name}")


def _ladder(name: str, value: str | Column) -> Column:
    pairs, other = getattr(ladders, name), ladders.ELSE.get(name, 0)
    if name.endswith("_UP"):
        return above(value, pairs, other)
    if name.endswith("_DOWN"):
        return below(value, pairs, other)
    return steps(value, [(">=", t, p) for t, p in pairs], other)


def _points(*parts: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return total


def _pct(c: str) -> Column:
    return nonzero(c) * 100


def _pos(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def normalize(raw: Column, top: float | Column) -> Column:
    return clip(raw / top * 100, 0, 100)


def momentum_inputs(prices: DataFrame, along: bool = False) -> DataFrame:
    """Look-back changes, last-day change, volume ratio and volume stability per bar.
    With ``along`` the rows are those of another block: dealt out by ticker already, and all their columns stay."""
    w = by_bar()
    kept = prices.columns if along else ["ticker", "date"]
    base = (prices if along else spread(prices.select("ticker", "date", "close", "volume"))).select(
        "*",
        F.row_number().over(w).alias("_n"),
        *[F.lag("close", k).over(w).alias(f"_p{k}") for k in (1, 21, 65, 125, 251)],
        F.avg("volume").over(trailing(20)).alias("_v20"),
        F.avg("volume").over(trailing(10)).alias("_v10"),
        F.stddev_samp("volume").over(trailing(10)).alias("_s10"),
    )
    move = lambda k: (F.col("close") - F.col(f"_p{k}")) / F.col(f"_p{k}") * 100
    return base.select(
        *kept,
        move(21).alias("mom_1m"),
        move(65).alias("mom_3m"),
        move(125).alias("mom_6m"),
        move(251).alias("mom_12m"),
        (ratio("close", "_p1") - 1).alias("day_change"),
        full(ratio("volume", "_v20"), F.col("_n"), 20).alias("volume_surge"),
        full(1 - ratio("_s10", "_v10"), F.col("_n"), 20).alias("volume_stability"),
    )


# -- momentum ---------------------------------------------------------------------


def momentum_price() -> Column:
    return _points(*[rung(f"MOMENTUM_{h}_UP", f"mom_{h.lower()}") for h in ("1M", "3M", "6M", "12M")])


def momentum_trend() -> Column:
    up = lambda a, b, p: F.when(F.col(a) > F.col(b), float(p))
    return _points(
        up("close", "sma_20", 5), up("close", "sma_50", 5), up("close", "sma_200", 3), up("sma_20", "sma_50", 2), rung("ADX_UP", nonzero("adx"))
    )


def momentum_volume() -> Column:
    surge = F.when(F.col("day_change") > 0, F.greatest(rung("SURGE_UP", "volume_surge"), F.lit(3.0)))
    return _points(F.when(F.col("volume_surge").isNotNull(), surge), rung("STABILITY_UP", "volume_stability"))


def momentum_technical() -> Column:
    ready = nonzero("macd").isNotNull() & nonzero("macd_signal").isNotNull() & nonzero("macd_hist").isNotNull()
    crossed = F.col("macd") > F.col("macd_signal")
    r = F.col("rsi")
    zone = (
        F.when(r.between(55, 70), 10.0)
        .when((r >= 50) & (r < 55), 7.0)
        .when((r >= 45) & (r < 50), 4.0)
        .when((r > 70) & (r <= 80), 5.0)
        .when((r < 30) & (r != 0), 3.0)
    )
    return _points(F.when(ready & crossed, F.when(F.col("macd") > 0, 10.0).otherwise(6.0)), zone)


def momentum_score() -> Column:
    """Parts over their maximum; without indicators (too short a history) their share drops out."""
    has = F.col("rsi").isNotNull()
    raw = momentum_price() + momentum_volume() + F.when(has, momentum_trend() + momentum_technical()).otherwise(0.0)
    return F.when(F.col("bar_no") < 60, 50.0).otherwise(normalize(raw, F.when(has, 100.0).otherwise(55.0)))


# -- value and growth -------------------------------------------------------------


def value_valuation() -> Column:
    return _points(
        rung("VALUE_PE_DOWN", _pos("pe_ratio")),
        rung("VALUE_PEG_DOWN", _pos("peg_ratio")),
        rung("VALUE_PB_DOWN", _pos("pb_ratio")),
        rung("VALUE_PS_DOWN", _pos("ps_ratio")),
        rung("VALUE_EV_DOWN", _pos("ev_to_ebitda")),
    )


def value_profit() -> Column:
    return _points(
        rung("VALUE_MARGIN_UP", _pct("profit_margin")),
        rung("VALUE_ROE_UP", _pct("roe")),
        rung("VALUE_ROA_UP", _pct("roa")),
        rung("VALUE_OPMARGIN_UP", _pct("operating_margin")),
    )


def value_health() -> Column:
    """A debt ratio of zero counts here; zeros elsewhere are missing."""
    return _points(
        rung("VALUE_DEBT_DOWN", "debt_to_equity"),
        rung("VALUE_CURRENT_UP", nonzero("current_ratio")),
        F.when(F.col("free_cash_flow") > 0, 5.0),
    )


def value_income() -> Column:
    p = _pct("payout_ratio")
    payout = (
        F.when(p.between(30, 60), 3.0)
        .when(((p >= 20) & (p < 30)) | ((p > 60) & (p <= 70)), 2.0)
        .when(p < 80, 1.0)
    )
    return _points(rung("VALUE_YIELD_UP", _pct("dividend_yield")), payout)


def _known() -> Column:
    return F.col("fundamentals_date").isNotNull()


def value_score() -> Column:
    raw = value_valuation() + value_profit() + value_health() + value_income()
    return F.when(_known(), normalize(raw, 100.0)).otherwise(50.0)


def growth_parts() -> dict[str, Column]:
    return {
        "growth_revenue": _points(rung("GROWTH_REVENUE_UP", _pct("revenue_growth"))),
        "growth_earnings": _points(rung("GROWTH_EARNINGS_UP", _pct("earnings_growth"))),
        "growth_quality": _points(rung("GROWTH_MARGIN_UP", _pct("profit_margin")), rung("GROWTH_ROE_UP", _pct("roe"))),
        "growth_price": _points(rung("GROWTH_PEG_DOWN", _pos("peg_ratio"))),
    }


def growth_score() -> Column:
    total = sum(growth_parts().values(), F.lit(0.0))
    return F.when(_known() & (total != 0), normalize(total, 100.0)).otherwise(50.0)


# -- five-factor ------------------------------------------------------------------


def five_beta() -> Column:
    b = F.col("history_beta")
    return (
        F.when(b.isNull(), 50.0)
        .when(b.between(0.8, 1.2), 100.0)
        .when(((b >= 0.6) & (b < 0.8)) | ((b > 1.2) & (b <= 1.5)), 75.0)
        .when(b < 0.6, 40.0)
        .otherwise(30.0)
    )


def five_size() -> Column:
    return F.coalesce(rung("SIZE_FROM", nonzero("market_cap")), F.lit(50.0))


def five_value() -> Column:
    return mean_present(
        [rung("FIVE_PB_DOWN", nonzero("pb_ratio")), rung("FIVE_PE_DOWN", nonzero("pe_ratio")), rung("FIVE_PS_DOWN", nonzero("ps_ratio"))]
    )


def five_profit() -> Column:
    return mean_present(
        [
            rung("FIVE_ROE_UP", nonzero("roe")),
            rung("FIVE_OPMARGIN_UP", nonzero("operating_margin")),
            rung("FIVE_MARGIN_UP", nonzero("profit_margin")),
            rung("FIVE_ROA_UP", nonzero("roa")),
        ]
    )


def five_investment() -> Column:
    cash = F.when(F.col("free_cash_flow") > 0, 70.0).when(F.col("free_cash_flow") < 0, 30.0)
    return mean_present([cash, rung("FIVE_CURRENT_UP", nonzero("current_ratio")), rung("FIVE_DEBT_DOWN", nonzero("debt_to_equity"))])


def fama_french_score() -> Column:
    raw = 0.15 * five_beta() + 0.20 * five_size() + 0.25 * five_value() + 0.25 * five_profit() + 0.15 * five_investment()
    return F.when(_known() & F.col("sector").isNotNull(), clip(raw, 0, 100)).otherwise(50.0)


# -- quality ----------------------------------------------------------------------


def quality_profit() -> Column:
    """ROE counts twice."""
    roe = rung("QUALITY_ROE_UP", nonzero("roe"))
    rest = [("ROA", "roa"), ("MARGIN", "profit_margin"), ("OPMARGIN", "operating_margin"), ("GROSS", "gross_margin")]
    return mean_present([roe, roe, *[rung(f"QUALITY_{n}_UP", nonzero(c)) for n, c in rest]])


def quality_strength() -> Column:
    """Debt counts twice, and a zero debt ratio counts."""
    debt = rung("QUALITY_DEBT_DOWN", "debt_to_equity")
    return mean_present(
        [debt, debt, rung("QUALITY_CURRENT_UP", nonzero("current_ratio")), rung("QUALITY_QUICK_UP", nonzero("quick_ratio"))]
    )


def quality_cash() -> Column:
    return F.coalesce(rung("QUALITY_FCF_UP", "free_cash_flow"), F.lit(50.0))


def quality_dividend() -> Column:
    y, p = nonzero("dividend_yield"), nonzero("payout_ratio")
    yield_ = (
        F.when(y.between(0.02, 0.04), 100.0)
        .when((y >= 0.01) & (y < 0.02), 75.0)
        .when((y > 0.04) & (y <= 0.06), 85.0)
        .when(y > 0.06, 50.0)
        .when(y.isNotNull(), 60.0)
    )
    payout = (
        F.when(p.between(0.3, 0.6), 100.0)
        .when((p >= 0.2) & (p < 0.3), 90.0)
        .when((p > 0.6) & (p <= 0.8), 75.0)
        .when((p > 0.8) & (p <= 1.0), 50.0)
        .when(p > 1.0, 20.0)
        .when(p.isNotNull(), 70.0)
    )
    return mean_present([yield_, payout], 60.0)


def quality_score() -> Column:
    raw = 0.35 * quality_profit() + 0.30 * quality_strength() + 0.20 * quality_cash() + 0.15 * quality_dividend()
    return F.when(_known(), clip(raw, 0, 100)).otherwise(50.0)


# -- low volatility ---------------------------------------------------------------


def _long_enough(c: Column) -> Column:
    return F.when(F.col("bar_no") >= 30, F.coalesce(c, F.lit(50.0))).otherwise(50.0)


def lowvol_volatility() -> Column:
    return _long_enough(rung("LOWVOL_VOL_DOWN", "volatility_annual"))


def lowvol_beta() -> Column:
    return F.coalesce(rung("LOWVOL_BETA_DOWN", "history_beta"), F.lit(50.0))


def lowvol_stability() -> Column:
    return _long_enough(rung("LOWVOL_STABILITY_DOWN", F.coalesce("vol_of_vol", F.lit(1.0))))


def lowvol_drawdown() -> Column:
    return _long_enough(rung("LOWVOL_DRAWDOWN_DOWN", "worst_drawdown"))


def low_volatility_score() -> Column:
    raw = 0.40 * lowvol_volatility() + 0.30 * lowvol_beta() + 0.20 * lowvol_stability() + 0.10 * lowvol_drawdown()
    return clip(raw, 0, 100)


# -- sentiment and model ----------------------------------------------------------


def sentiment_level() -> Column:
    return clip((F.col("sentiment_score") + 1.0) * 50.0, 0, 100)


def sentiment_ratio() -> Column:
    p, n = F.col("positive_ratio"), F.col("negative_ratio")
    clean = F.when(p > 0.5, 100.0).when(p > 0.3, 80.0).otherwise(60.0)
    return F.when(n == 0, clean).otherwise(rung("SENTIMENT_RATIO_FROM", p / (n + 0.001)))


def sentiment_trend() -> Column:
    s = F.col("sentiment_score")
    steady = F.when(s > 0.2, 75.0).when(s < -0.2, 25.0).otherwise(50.0)
    return F.when(F.col("trend") == "improving", 100.0).when(F.col("trend") == "stable", steady).otherwise(20.0)


def sentiment_conviction() -> Column:
    n = F.col("article_count")
    counted = F.when(n < 5, n * 5.0).otherwise(rung("ARTICLES_FROM", n))
    return counted + F.col("confidence") * 50.0


def news_sentiment_score() -> Column:
    raw = 0.40 * sentiment_level() + 0.30 * sentiment_ratio() + 0.20 * sentiment_trend() + 0.10 * sentiment_conviction()
    return F.when(F.coalesce("article_count", F.lit(0)) > 0, clip(raw, 0, 100)).otherwise(50.0)


def predicted_return_points(value: str = "predicted_return") -> Column:
    r = F.col(value)
    return (
        F.when(r >= 5, 100.0)
        .when(r >= 3, 80 + (r - 3) / 2 * 20)
        .when(r >= 1, 60 + (r - 1) / 2 * 20)
        .when(r >= 0, 50 + r * 10)
        .when(r >= -1, 40 + (r + 1) * 10)
        .when(r >= -3, 20 + (r + 3) / 2 * 20)
        .when(r >= -5, (r + 5) / 2 * 20)
        .otherwise(0.0)
    )


def ml_prediction_score() -> Column:
    raw = (
        0.40 * clip((F.col("direction_prob") - 0.5) * 200, 0, 100)
        + 0.35 * predicted_return_points()
        + 0.25 * F.col("model_confidence") * 100
    )
    return F.when(F.col("bar_no") < 60, 50.0).otherwise(clip(raw, 0, 100))


SCORES: dict[str, Callable[[], Column]] = {
    "momentum": momentum_score,
    "value": value_score,
    "growth": growth_score,
    "fama_french": fama_french_score,
    "quality": quality_score,
    "low_volatility": low_volatility_score,
    "news_sentiment": news_sentiment_score,
    "ml_prediction": ml_prediction_score,
}


def with_scores(rows: DataFrame) -> DataFrame:
    with _staging() as items:
        built = [f().alias(f"{n}_score") for n, f in SCORES.items()]
    staged = rows.select("*", *[c.alias(n) for n, c in items.items()])
    return staged.select(*rows.columns, *built)


# -- composite and verdict --------------------------------------------------------


def regime_weight_table(rows: DataFrame) -> DataFrame:
    """The fixed regime × strategy weights as a small table."""
    data = [(r, s, w) for r, t in ladders.REGIME_WEIGHTS.items() for s, w in t.items()]
    return rows.sparkSession.createDataFrame(data, "regime string, strategy string, weight double")


def composite(rows: DataFrame, regime: str = "regime") -> DataFrame:
    """Regime-weighted mean of the scores; one within 0.1 of 50 carries a tenth of its weight.

    The weights of a regime arrive as one map per row from a six-row broadcast table, so
    the scores are combined inside the row.
    """
    table = regime_weight_table(rows).groupBy("regime").agg(
        F.map_from_entries(F.collect_list(F.struct("strategy", "weight"))).alias("_w")
    )
    out = rows.join(F.broadcast(table.withColumnRenamed("regime", regime)), regime, "left")
    num, den = F.lit(0.0), F.lit(0.0)
    for name in SCORES:
        s = F.col(f"{name}_score")
        weight = F.coalesce(F.try_element_at("_w", F.lit(name)), F.lit(0.5))
        active = weight * F.when(F.abs(s - 50.0) > 0.1, 1.0).otherwise(0.1)
        num, den = num + active * s, den + active
    return out.withColumn("composite_score", F.when(den > 0, F.round(num / den, 9)).otherwise(0.0)).drop("_w")


def signal(score: str = "composite_score") -> Column:
    s = F.col(score)
    return F.when(s >= 80, "STRONG_BUY").when(s >= 60, "BUY").when(s >= 40, "HOLD").when(s >= 20, "SELL").otherwise("STRONG_SELL")


def trend_direction() -> Column:
    known = F.col("sma_20").isNotNull().cast("int") + F.col("sma_50").isNotNull().cast("int")
    over = F.coalesce((F.col("close") > F.col("sma_20")).cast("int"), F.lit(0)) + F.coalesce(
        (F.col("close") > F.col("sma_50")).cast("int"), F.lit(0)
    )
    share = F.try_divide(over.cast("double"), known.cast("double"))
    return F.when(share >= 0.66, "BULLISH").when(share <= 0.33, "BEARISH").otherwise("NEUTRAL")


def confidence() -> Column:
    """A quarter each for a quote, fundamentals, indicators and 60 bars of history."""
    present = [F.col("close").isNotNull(), _known(), F.col("rsi").isNotNull(), F.col("bar_no") >= 60]
    return sum((p.cast("int") for p in present), F.lit(0)) / 4.0


def _shown(value: Column, digits: int) -> Column:
    """Rounded for display, half up also where the binary value lies just below the half."""
    return F.round(value + 1e-7, digits)


def strengths() -> Column:
    return F.slice(
        F.array_compact(
            F.array(
                F.when(nonzero("roe") > 0.15, F.format_string("Strong ROE of %.1f%%", _shown(F.col("roe") * 100, 1))),
                F.when(nonzero("pe_ratio") < 15, F.format_string("Attractive P/E of %.1f", _shown(F.col("pe_ratio"), 1))),
                F.when(nonzero("rsi") < 30, F.lit("Oversold condition (RSI < 30)")),
                F.when(F.col("momentum_score") > 70, F.lit("Strong price momentum")),
                F.when(F.col("value_score") > 70, F.lit("Attractive valuation")),
            )
        ),
        1,
        5,
    )


def risks() -> Column:
    return F.slice(
        F.array_compact(
            F.array(
                F.when(nonzero("debt_to_equity") > 1.5, F.format_string("High debt/equity ratio: %.2f", _shown(F.col("debt_to_equity"), 2))),
                F.when(F.col("rsi") > 70, F.lit("Overbought condition (RSI > 70)")),
            )
        ),
        1,
        5,
    )


def thesis_levels(rows: DataFrame, score: str = "composite_score") -> DataFrame:
    """Entry, stop, target and reward-to-risk of each analysis row."""
    s = F.col(score)
    upside = F.when(s >= 70, 15).when(s >= 60, 10).when(s >= 50, 8).when(s >= 40, 5).otherwise(0)
    out = rows.withColumn("upside", upside).withColumn(
        "entry_price", F.when(F.col("sma_20") != 0, F.least("close", F.col("sma_20") * 1.02)).otherwise(F.col("close"))
    )
    out = out.withColumn("stop_loss", F.col("entry_price") * F.when(F.col("volatility_annual") > 40, 0.88).otherwise(0.92))
    out = out.withColumn("price_target", F.col("close") * (1 + F.col("upside") / 100))
    reward = F.try_divide(F.col("price_target") - F.col("entry_price"), F.col("entry_price") - F.col("stop_loss"))
    return out.withColumn("risk_reward", reward)


def analyse(rows: DataFrame) -> DataFrame:
    """Scores, composite, signal, trend, confidence and insights of the analysis rows."""
    out = composite(with_scores(rows))
    return out.select(
        "*",
        signal().alias("signal"),
        trend_direction().alias("trend_direction"),
        confidence().alias("data_confidence"),
        strengths().alias("key_strengths"),
        risks().alias("key_risks"),
    )


def screen(analyses: DataFrame, min_score: float, signals: list[str], limit: int) -> DataFrame:
    hits = analyses.where((F.col("composite_score") >= min_score) & F.col("signal").isin(signals))
    return hits.orderBy(F.desc("composite_score"), "ticker", "date").limit(limit)


def hot_buys(analyses: DataFrame, limit: int = 15) -> DataFrame:
    keep = F.col("signal").isin("BUY", "STRONG_BUY") | ((F.col("signal") == "HOLD") & (F.col("composite_score") >= 55))
    return analyses.where(keep).orderBy(F.desc("composite_score"), "ticker", "date").limit(limit)
