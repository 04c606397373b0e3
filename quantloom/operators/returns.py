"""Holding-period returns, trading costs and exposure scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import above, by_bar, change, clip, previous, ratio
from quantloom.operators.asof import asof_forward, trading_calendar
from quantloom.operators.xsection import join_calendar

TOLERANCE_DAYS = 7
LONG_DELISTED, SHORT_DELISTED = -0.20, -0.30


def schedule(signal_dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signal date, the trading day after it (entry) and the one after the next signal (exit)."""
    w = Window.orderBy("date")
    pairs = signal_dates.select("date").distinct().withColumn("_following", F.lead("date").over(w))
    entry = calendar.select("date", F.col("next_date").alias("entry_date"))
    exit_ = calendar.select(F.col("date").alias("_following"), F.col("next_date").alias("exit_date"))
    out = join_calendar(pairs, entry, how="inner")
    out = out.join(F.broadcast(exit_), "_following").drop("_following")
    return out.where("entry_date IS NOT NULL AND exit_date IS NOT NULL")


def priced(picks: DataFrame, plan: DataFrame, prices: DataFrame, price: str = "adj_close") -> DataFrame:
    """Picks with entry and exit prices on or shortly after the planned dates."""
    planned = join_calendar(picks, plan, how="inner")
    wanted = planned.select("ticker", F.explode(F.array("entry_date", "exit_date")).alias("date")).distinct()
    found = asof_forward(wanted, prices.select("ticker", "date", F.col(price).alias("px")), ["px"], tolerance_days=TOLERANCE_DAYS)
    entry = found.select("ticker", F.col("date").alias("entry_date"), F.col("px").alias("entry_price"))
    exit_ = found.select("ticker", F.col("date").alias("exit_date"), F.col("px").alias("exit_price"))
    return planned.join(entry, ["ticker", "entry_date"], "left").join(exit_, ["ticker", "exit_date"], "left")


def holding_return(short: Column | None = None) -> Column:
    """Entry-to-exit return; a name that stops trading costs 20 % long, 30 % short;
    NULL (skip) without an entry price."""
    short = F.lit(False) if short is None else short
    gain = change("exit_price", "entry_price")
    gone = F.when(short, F.lit(SHORT_DELISTED)).otherwise(F.lit(LONG_DELISTED))
    return F.when(
        F.col("entry_price") > 0, F.when(F.col("exit_price").isNull(), gone).otherwise(F.when(short, -gain).otherwise(gain))
    )


def holding_returns(picks: DataFrame, plan: DataFrame, prices: DataFrame, price: str = "adj_close") -> DataFrame:
    """Return of each pick; ``side`` = -1 marks shorts when the column exists."""
    short = F.col("side") < 0 if "side" in picks.columns else None
    return priced(picks, plan, prices, price).withColumn("hold_return", holding_return(short))


def weighted_return(rows: DataFrame, keys: Sequence[str] = ("strategy", "date")) -> DataFrame:
    """Σ w·r / Σ w over names with a return; the plain mean when weights sum to 0."""
    live = F.col("hold_return").isNotNull()
    total = F.sum(F.when(live, F.col("weight")))
    value = F.when(total > 0, ratio(F.sum(F.when(live, F.col("weight") * F.col("hold_return"))), total)).otherwise(
        F.avg("hold_return")
    )
    return rows.groupBy(*keys).agg(value.alias("raw_return"), F.count("hold_return").alias("n_held")).where("n_held > 0")


def long_short_return(rows: DataFrame, keys: Sequence[str] = ("strategy", "date"), borrow_bps: float = 50.0) -> DataFrame:
    """Half the long leg plus half the (already inverted) short leg, less borrow cost."""

    def leg(sign: int) -> Column:
        mine = (F.col("side") * sign > 0) & F.col("hold_return").isNotNull()
        return ratio(F.sum(F.when(mine, F.abs("weight") * F.col("hold_return"))), F.sum(F.when(mine, F.abs("weight"))))

    out = rows.groupBy(*keys).agg(leg(1).alias("long_return"), leg(-1).alias("short_return"))
    borrow = borrow_bps / 10000 / 12 * 0.5
    return out.withColumn("borrow_cost", F.lit(borrow)).withColumn(
        "gross_return", (F.col("long_return") + F.col("short_return")) / 2 - F.col("borrow_cost")
    )


def signed_return(rows: DataFrame, keys: Sequence[str] = ("strategy", "date"), borrow_bps: float = 50.0) -> DataFrame:
    """Σ signed weight · return over names with both prices, less borrow on the short side."""
    both = F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull() & (F.col("entry_price") > 0)
    move = change("exit_price", "entry_price")
    out = rows.where(both).groupBy(*keys).agg(
        F.sum(F.col("weight") * move).alias("raw_return"),
        F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("short_weight"),
    )
    return out.withColumn("borrow_cost", F.lit(borrow_bps / 10000 / 12) * F.col("short_weight")).withColumn(
        "gross_return", F.col("raw_return") - F.col("borrow_cost")
    )


def trading_cost(turnover: Column, base: float = 0.001) -> Column:
    """Base cost plus 10-20 bps slippage by turnover, 15 bps while turnover is unknown."""
    return F.lit(base) + F.coalesce(0.001 + 0.001 * turnover, F.lit(0.0015))


def two_way_cost(returns: DataFrame, rate: float = 0.001, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Turnover × cost × 2, the first period counting as a full turn."""
    first = F.row_number().over(by_bar(*keys)) == 1
    turn = F.when(first, F.lit(1.0)).otherwise(F.coalesce("turnover", F.lit(0.0)))
    return returns.withColumn("trade_cost", turn * rate * 2)


def spread_cost(price: str) -> Column:
    """Half-spread guess by price band, as a fraction."""
    return above(price, [(100, 2), (50, 5), (20, 10)], otherwise=20) / 10000


def impact_cost(trade_value: Column, daily_value: Column, volatility: Column, coef: float = 0.1, cap: float = 0.05) -> Column:
    """Square-root impact, capped; none when nothing trades."""
    raw = coef * F.sqrt(F.when(daily_value > 0, trade_value / daily_value)) * volatility
    return F.when(daily_value <= 0, F.lit(0.0)).otherwise(clip(raw, None, cap))


def order_costs(
    orders: DataFrame, commission_rate: float = 0.0005, min_commission: float = 1.0, coef: float = 0.1
) -> DataFrame:
    """Commission, spread and impact of each order: needs trade_value, price,
    daily_value and volatility."""
    fee = F.greatest(F.col("trade_value") * commission_rate, F.lit(float(min_commission)))
    out = orders.select(
        "*",
        F.when(F.col("trade_value") > 0, fee / F.col("trade_value")).otherwise(0.0).alias("commission"),
        spread_cost("price").alias("spread"),
        impact_cost(F.col("trade_value"), F.col("daily_value"), F.col("volatility"), coef).alias("impact"),
    )
    total = F.col("commission") + F.col("spread") + F.col("impact")
    return out.withColumn("total", total).withColumn("total_bps", F.col("total") * 10000)


def net_of_turnover(returns: DataFrame, value: str, cost: float = 0.0015) -> DataFrame:
    return returns.withColumn("net_return", F.col(value) - F.col("turnover") * cost)


def vol_target_scale(gross: str = "gross_return", target: float = 0.15, keys: Sequence[str] = ("strategy",)) -> Column:
    """Target over realised volatility of up to 24 earlier periods, at least 12."""
    w = previous(24, *keys)
    vol = F.stddev_pop(gross).over(w) * F.sqrt(F.lit(12.0))
    scale = clip(F.lit(target) / vol, 0.25, 2.0)
    return F.when((F.count(gross).over(w) >= 12) & (vol > 0.05), scale).otherwise(F.lit(1.0))


def kelly_scale(gross: str = "gross_return", keys: Sequence[str] = ("strategy",), min_periods: int = 60, lookback: int = 120) -> Column:
    """Quarter of the win/loss Kelly fraction from earlier periods, within [0.25, 0.5]."""
    w = previous(lookback, *keys)
    g = F.col(gross)
    wins = F.avg(F.when(g > 0, 1.0).otherwise(0.0)).over(w)
    gain = F.coalesce(F.avg(F.when(g > 0, g)).over(w), F.lit(0.02))
    loss = F.abs(F.coalesce(F.avg(F.when(g < 0, g)).over(w), F.lit(0.02)))
    fraction = wins - (1 - wins) / (gain / loss)
    ready = (F.count(gross).over(w) >= min_periods) & (loss > 0)
    return F.when(ready, clip(fraction * 0.25, 0.25, 0.5)).otherwise(F.lit(1.0))


def risk_off_scale(market_volatility: str = "market_volatility", threshold: float = 25.0) -> Column:
    """Half exposure while market volatility, in points, exceeds the threshold."""
    v = F.col(market_volatility)
    points = F.when(v < 1, v * 100).otherwise(v)
    return F.when(points > threshold, F.lit(0.5)).otherwise(F.lit(1.0))


def combined_scale(*scales: Column) -> Column:
    product = F.lit(1.0)
    for s in scales:
        product = product * s
    return clip(product, 0.5, 1.5)


def benchmark_return(plan: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark return entry to exit; 0 when either date has no bar."""
    level = bench.select("date", F.col("adj_close").alias("_l"))
    a = level.select(F.col("date").alias("entry_date"), F.col("_l").alias("_in"))
    b = level.select(F.col("date").alias("exit_date"), F.col("_l").alias("_out"))
    out = plan.join(F.broadcast(a), "entry_date", "left").join(F.broadcast(b), "exit_date", "left")
    return out.select("date", F.coalesce(change("_out", "_in"), F.lit(0.0)).alias("spy_return"))


def open_to_open(picks: DataFrame, prices: DataFrame, entry: str = "entry_date", exit_: str = "exit_date") -> DataFrame:
    """Exact-date open-to-open return. Without an entry the return is -100 %; without
    an exit the last close inside the holding window stands in."""
    opens = prices.select("ticker", "date", F.col("open").alias("_open"))
    a = opens.select("ticker", F.col("date").alias(entry), F.col("_open").alias("entry_price"))
    b = opens.select("ticker", F.col("date").alias(exit_), F.col("_open").alias("_exit_open"))
    out = picks.join(a, ["ticker", entry], "left").join(b, ["ticker", exit_], "left")
    last = last_in_window(out.select("ticker", entry, exit_).distinct(), prices, entry, exit_)
    out = out.join(last, ["ticker", entry, exit_], "left")
    out = out.withColumn("exit_price", F.coalesce("_exit_open", "last_price")).drop("_exit_open", "last_price")
    value = change("exit_price", "entry_price")
    return out.withColumn("hold_return", F.coalesce(value, F.lit(-1.0)))


def last_in_window(spans: DataFrame, prices: DataFrame, start: str, end: str, price: str = "close") -> DataFrame:
    """Last price in (start, end] for each (ticker, start, end). One backward as-of on
    ``end`` finds the newest bar; it counts only if it lies after ``start``."""
    from quantloom.operators.asof import asof_backward

    asked = spans.withColumn("date", F.col(end))
    got = asof_backward(asked, prices.select("ticker", "date", F.col(price).alias("_p")), ["_p"], at="_at")
    return got.select("ticker", start, end, F.when(F.col("_at") > F.col(start), F.col("_p")).alias("last_price"))


def next_trading_day(dates: DataFrame, prices: DataFrame) -> DataFrame:
    """First trading day strictly after each date, trading day or not."""
    calendar = trading_calendar(prices).select("date").withColumn("series", F.lit("calendar"))
    # both sides are calendars: one row per date
    asked = dates.select("date").distinct().select(F.col("date").alias("asked_date"), F.date_add("date", 1).alias("date")).withColumn("series", F.lit("calendar"))
    return asof_forward(asked, calendar.withColumn("next_date", F.col("date")), ["next_date"], on=["series"]).select(
        F.col("asked_date").alias("date"), "next_date"
    )


def reconcile(picks: DataFrame, prices: DataFrame, days: int = 30, price: str = "adj_close") -> DataFrame:
    """Outcome of logged sessions: entry on the next trading day, exit ``days`` later or
    at the latest price; names without an entry are skipped."""
    calendar = trading_calendar(prices).select("date", F.col("next_date").alias("entry_date"))
    planned = join_calendar(picks, calendar, how="inner").where("entry_date IS NOT NULL")
    planned = planned.withColumn("exit_date", F.date_add("entry_date", days))
    wanted = planned.select("ticker", F.explode(F.array("entry_date", "exit_date")).alias("date")).distinct()
    found = asof_forward(wanted, prices.select("ticker", "date", F.col(price).alias("px")), ["px"], tolerance_days=TOLERANCE_DAYS)
    entry = found.select("ticker", F.col("date").alias("entry_date"), F.col("px").alias("entry_price"))
    exit_ = found.select("ticker", F.col("date").alias("exit_date"), F.col("px").alias("_exit"))
    latest = prices.groupBy("ticker").agg(F.max_by(price, "date").alias("_latest"))
    rows = planned.join(entry, ["ticker", "entry_date"]).where("entry_price > 0").join(exit_, ["ticker", "exit_date"], "left").join(latest, "ticker")
    gain = change(F.coalesce("_exit", "_latest"), "entry_price")
    return rows.groupBy("session_id").agg(
        (F.sum(F.col("weight") * gain) / F.sum("weight")).alias("portfolio_return"), F.count(F.lit(1)).alias("n_priced")
    )


def mark_to_market(holdings: DataFrame, prices: DataFrame, price: str = "close", keys: Sequence[str] = ()) -> DataFrame:
    """Σ shares × price per book (``keys``) and trading day, each holding valid until the book's next rebalance."""
    keys = list(keys)
    dates = holdings.select(*keys, "date").distinct()
    spans = dates.withColumn("_until", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))
    rows = holdings.join(spans, [*keys, "date"]).withColumnRenamed("date", "_from")
    # Equal join on (ticker, month) keeps the date test to one holding period.
    last = F.coalesce(F.date_sub("_until", 1), F.add_months("_from", 1200))
    horizon = prices.agg(F.max("date").alias("_end"))
    rows = rows.crossJoin(F.broadcast(horizon)).withColumn("_last", F.least(last, F.col("_end"))).where("_last >= _from")
    months = F.explode(F.sequence(F.trunc("_from", "MM"), F.trunc("_last", "MM"), F.expr("interval 1 month")))
    rows = rows.withColumn("_month", months)
    bars = prices.select("ticker", "date", F.col(price).alias("_p"), F.trunc("date", "MM").alias("_month"))
    met = rows.join(bars, ["ticker", "_month"]).where("date >= _from AND date <= _last")
    return met.groupBy(*keys, "date").agg(F.sum(F.col("shares") * F.col("_p")).alias("value"))
