"""G and the single-ticker blocks E17-E21: technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import technical
from quantloom.operators.asof import sample_at
from quantloom.operators.technical import FUNDAMENTAL_DEFAULTS
from quantloom.suite.oracle import add_cte, w
from quantloom.suite.registry import case

_W = "(PARTITION BY ticker ORDER BY date)"
_H = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"

add_cte("tp", f"""SELECT ticker, date, close, high, low, volume, row_number() OVER {_W} AS n, close - lag(close) OVER {_W} AS d, lag(close) OVER {_W} AS pc,
  high - lag(high) OVER {_W} AS up, lag(low) OVER {_W} - low AS dn FROM prices""")
add_cte("tp2", """SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM tp""")
# one recursion over the bar number carries all smoothed states
add_cte("wild", """SELECT ticker, date, n, close, close AS e12, close AS e26, NULL::DOUBLE AS ag, NULL::DOUBLE AS al, tr AS atr, NULL::DOUBLE AS ap, NULL::DOUBLE AS am FROM tp2 WHERE n = 1
  UNION ALL SELECT t.ticker, t.date, t.n, t.close, w.e12 * 11 / 13 + t.close * 2 / 13, w.e26 * 25 / 27 + t.close * 2 / 27,
  CASE WHEN t.n = 2 THEN t.g ELSE w.ag * 13 / 14 + t.g / 14 END, CASE WHEN t.n = 2 THEN t.l ELSE w.al * 13 / 14 + t.l / 14 END, w.atr * 13 / 14 + t.tr / 14,
  CASE WHEN t.n = 2 THEN t.pdm ELSE w.ap * 13 / 14 + t.pdm / 14 END, CASE WHEN t.n = 2 THEN t.mdm ELSE w.am * 13 / 14 + t.mdm / 14 END FROM wild w JOIN tp2 t ON t.ticker = w.ticker AND t.n = w.n + 1""")
add_cte("wild2", """SELECT *, e12 - e26 AS macd, CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi,
  CASE WHEN n > 1 THEN coalesce(100 * abs(ap / atr - am / atr) / nullif(ap / atr + am / atr, 0), 0) END AS dx FROM wild""")
add_cte("wild3", """SELECT ticker, date, n, close, rsi, macd, atr, macd AS macd_signal, NULL::DOUBLE AS adx FROM wild2 WHERE n = 1
  UNION ALL SELECT t.ticker, t.date, t.n, t.close, t.rsi, t.macd, t.atr, w.macd_signal * 0.8::DOUBLE + t.macd * 0.2::DOUBLE, CASE WHEN t.n = 2 THEN t.dx ELSE w.adx * 13 / 14 + t.dx / 14 END
  FROM wild3 w JOIN wild2 t ON t.ticker = w.ticker AND t.n = w.n + 1""")
add_cte("lvl", f"""SELECT ticker, date, close, volume, n AS bar_no, CASE WHEN n >= 20 THEN avg(close) OVER {w(20)} END AS sma_20, CASE WHEN n >= 50 THEN avg(close) OVER {w(50)} END AS sma_50,
  CASE WHEN n >= 200 THEN avg(close) OVER {w(200)} END AS sma_200, max(high) OVER {w(252)} AS high_52w, min(low) OVER {w(252)} AS low_52w,
  CASE WHEN n >= 20 THEN floor(avg(volume) OVER {w(20)}) END AS volume_sma_20 FROM tp""")
add_cte("tech", "SELECT l.*, volume / nullif(volume_sma_20, 0) AS volume_ratio, rsi, macd, macd_signal, macd - macd_signal AS macd_hist, atr, adx FROM lvl l JOIN wild3 s ON s.ticker = l.ticker AND s.date = l.date")


@case("g01_moving_averages", "ticker date:d sma_20:3 sma_50:3 sma_200:3", "SELECT * FROM lvl")
def _(m):
    return technical.level_indicators(m.prices())


@case("g02_rsi", "ticker date:d rsi:6", "SELECT ticker, date, rsi FROM wild2")
def _(m):
    return technical.smoothed_indicators(m.prices())


@case("g03_rsi_simple", "ticker date:d rsi_simple:6", f"""SELECT ticker, date, CASE WHEN n < 15 THEN 50 WHEN lo = 0 THEN 100 ELSE 100 - 100 / (1 + gn / lo) END AS rsi_simple FROM (
  SELECT ticker, date, n, avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER {w(14)} AS gn, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER {w(14)} AS lo FROM tp)""")
def _(m):
    return technical.band_indicators(m.prices())


@case("g04_macd", "ticker date:d macd:4 macd_signal:4 macd_hist:4", "SELECT ticker, date, macd, macd_signal, macd - macd_signal AS macd_hist FROM wild3")
def _(m):
    return technical.smoothed_indicators(m.prices())


@case("g05_atr", "ticker date:d atr:4", "SELECT ticker, date, atr FROM wild")
def _(m):
    return technical.smoothed_indicators(m.prices())


@case("g06_adx", "ticker date:d adx:6", "SELECT ticker, date, adx FROM wild3")
def _(m):
    return technical.smoothed_indicators(m.prices())


@case("g07_year_range", "ticker date:d high_52w:2 low_52w:2 dist_high_pct:6 dist_low_pct:6", "SELECT *, (close - high_52w) / high_52w * 100 AS dist_high_pct, (close - low_52w) / low_52w * 100 AS dist_low_pct FROM lvl")
def _(m):
    return technical.level_indicators(m.prices())


@case("g08_volume_average", "ticker date:d volume_sma_20:1 volume_ratio:6", "SELECT *, volume / nullif(volume_sma_20, 0) AS volume_ratio FROM lvl")
def _(m):
    return technical.level_indicators(m.prices())


@case("g09_bollinger", "ticker date:d bb_position:6 bb_width:6", f"""SELECT ticker, date, CASE WHEN n >= 20 AND sd > 0 THEN (close - mu + 2 * sd) / (4 * sd) ELSE 0.5 END AS bb_position,
  CASE WHEN n >= 20 THEN 4 * sd / mu ELSE 0 END AS bb_width FROM (SELECT *, avg(close) OVER {w(20)} AS mu, stddev_samp(close) OVER {w(20)} AS sd FROM tp)""")
def _(m):
    return technical.band_indicators(m.prices())


@case("g10_stochastic", "ticker date:d stochastic_k:6", f"""SELECT ticker, date, CASE WHEN n >= 14 AND h > lo THEN (close - lo) / (h - lo) * 100 ELSE 50 END AS stochastic_k FROM (
  SELECT *, max(high) OVER {w(14)} AS h, min(low) OVER {w(14)} AS lo FROM tp)""")
def _(m):
    return technical.band_indicators(m.prices())


@case("g11_flags", "ticker date:d rsi_oversold:i rsi_overbought:i macd_bullish:i", """SELECT ticker, date, CASE WHEN coalesce(rsi, 50) < 30 THEN 1 ELSE 0 END AS rsi_oversold, CASE WHEN coalesce(rsi, 50) > 70 THEN 1 ELSE 0 END AS rsi_overbought,
  CASE WHEN macd > macd_signal THEN 1 ELSE 0 END AS macd_bullish FROM wild3""")
def _(m):
    return technical.flags(technical.smoothed_indicators(m.prices()))


def _since(k, value, default):
    return f"coalesce(CASE WHEN n > {k} THEN {value} END, {default})"


_pb = ", ".join(
    [f"{_since(k, f'close / lag(close, {k}) OVER {_W} - 1', 0)} AS return_{k}d" for k in (1, 5, 10, 20, 60)]
    + [f"{_since(k + 1, f'stddev_samp(r) OVER {w(k)}', 0)} AS volatility_{k}d" for k in (5, 20, 60)]
    + [f"close / max(close) OVER {w(252)} - 1 AS pct_from_high_52w", f"close / min(close) OVER {w(252)} - 1 AS pct_from_low_52w", f"avg(close) OVER {w(20)} / close AS sma_20"]
    + [f"{_since(k, f'avg(close) OVER {w(k)} / close', 1)} AS sma_{k}" for k in (50, 200)]
    + [f"{_since(k, f'close / avg(close) OVER {w(k)} - 1', 0)} AS price_vs_sma{k}" for k in (20, 50)]
    + [f"{_since(k + 1, f'sum(r) OVER {w(k)}', 0)} AS momentum_{k}d" for k in (5, 20)]
    + [f"{_since(21, f'avg(r) OVER {w(10)} / nullif(avg(r) OVER {w(20)}, 0)', 1)} AS return_acceleration"])
_pc = "return_1d return_5d return_10d return_20d return_60d volatility_5d volatility_20d volatility_60d pct_from_high_52w pct_from_low_52w sma_20 sma_50 sma_200 price_vs_sma20 price_vs_sma50 momentum_5d momentum_20d return_acceleration".split()


@case("e17_price_block", "ticker date:d " + " ".join(f"{c}:5" for c in _pc), f"SELECT ticker, date, {_pb} FROM (SELECT *, close / pc - 1 AS r FROM tp)")
def _(m):
    return technical.price_block(m.prices())


@case("e18_volume_block", "ticker date:d volume_vs_avg_5d:6 volume_vs_avg_20d:6 volume_trend_5d:6 price_volume_corr:6 obv_10d:6", f"""SELECT ticker, date, volume / avg(volume) OVER {w(5)} AS volume_vs_avg_5d,
  volume / avg(volume) OVER {w(20)} AS volume_vs_avg_20d, {_since(10, f'avg(volume) OVER {w(5)} / avg(volume) OVER {w(10)}', 1)} AS volume_trend_5d,
  {_since(20, f'corr(r, dv) OVER {w(20)}', 0)} AS price_volume_corr, {_since(10, f'sum(sign(d) * volume) OVER {w(10)} / sum(volume) OVER {w(10)}', 0)} AS obv_10d
  FROM (SELECT *, close / pc - 1 AS r, volume / nullif(lag(volume) OVER {_W}, 0) - 1 AS dv FROM tp)""")
def _(m):
    return technical.volume_block(m.prices())


_fd = ", ".join(f"coalesce(nullif({c}, 0), {d}) AS {c}" for c, d in FUNDAMENTAL_DEFAULTS.items())


@case("e19_fundamental_block", "ticker date:d " + " ".join(f"{c}:6" for c in FUNDAMENTAL_DEFAULTS) + " payout_ratio:6 has_positive_fcf:i",
      f"SELECT ticker, date, {_fd}, least(coalesce(payout_ratio, 0), 2.0) AS payout_ratio, CASE WHEN free_cash_flow > 0 THEN 1 ELSE 0 END AS has_positive_fcf FROM fund")
def _(m):
    return technical.fundamental_block(m.fundamentals())


@case("e21_training_windows", "ticker date:d forward_return:6 direction:i", f"SELECT ticker, date, fr AS forward_return, CASE WHEN fr > 0 THEN 1 ELSE 0 END AS direction FROM (SELECT *, lead(close, 21) OVER {_W} / close - 1 AS fr FROM tp) WHERE n > 60 AND fr IS NOT NULL")
def _(m):
    return technical.training_windows(m.prices())
