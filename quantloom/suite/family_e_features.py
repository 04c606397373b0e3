"""E: per-ticker window features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import ratio
from quantloom.operators import panel
from quantloom.operators.asof import asof_backward
from quantloom.operators.panel import LIVE_RANKED, RETURN_BARS
from quantloom.operators.xsection import pct_rank
from quantloom.plans import monthly
from quantloom.session import reliable
from quantloom.suite.oracle import add_cte, prev, rank_sql, w
from quantloom.suite.registry import case

_W = "(PARTITION BY ticker ORDER BY date)"


def _month(m, *cols):
    return m.month_rows().select("ticker", "date", *cols)


@case("e01_bar_returns", "ticker date:d " + " ".join(f"{c}:6" for c in RETURN_BARS),
      f"SELECT ticker, date, {', '.join(RETURN_BARS)} FROM px")
def _(m):
    return _month(m, *RETURN_BARS)


_ref = ", ".join(
    f"CASE WHEN row_number() OVER {_W} > {n} THEN adj_close / lag(adj_close, {n - 1}) OVER {_W} - 1 END AS {c}" for c, n in RETURN_BARS.items()
)


@case("e01_bar_returns_reference_lag", "ticker date:d " + " ".join(f"{c}:6" for c in RETURN_BARS),
      f"SELECT ticker, date, {_ref} FROM prices")
def _(m):
    return panel.return_features(m.prices(), reference_lag=True)


@case("e02_compounded_return", "ticker date:d r21:6 r63:6 r126:6", f"""SELECT ticker, date, adj_close / lag(adj_close, 21) OVER {_W} - 1 AS r21,
  adj_close / lag(adj_close, 63) OVER {_W} - 1 AS r63, adj_close / lag(adj_close, 126) OVER {_W} - 1 AS r126 FROM prices""")
def _(m):
    return panel.return_features(m.prices(), bars={"r21": 21, "r63": 63, "r126": 126})


@case("e03_volatility", "ticker date:d volatility_20d:6 volatility_60d:6", "SELECT ticker, date, volatility_20d, volatility_60d FROM px")
def _(m):
    return _month(m, "volatility_20d", "volatility_60d")


@case("e04_sma_distance", "ticker date:d dist_from_sma_50:6 dist_from_sma_200:6", "SELECT ticker, date, dist_from_sma_50, dist_from_sma_200 FROM px")
def _(m):
    return _month(m, "dist_from_sma_50", "dist_from_sma_200")


@case("e05_year_high_low_distance", "ticker date:d dist_from_52w_high:6 dist_from_52w_low:6", "SELECT ticker, date, dist_from_52w_high, dist_from_52w_low FROM px")
def _(m):
    return _month(m, "dist_from_52w_high", "dist_from_52w_low")


@case("e06_volume_ratio", "ticker date:d volume_ratio_20:6 volume_ratio_60:6", "SELECT ticker, date, volume_ratio_20, volume_ratio_60 FROM px")
def _(m):
    return _month(m, "volume_ratio_20", "volume_ratio_60")


@case("e07_volume_zscore", "ticker date:d volume_zscore:6", "SELECT ticker, date, volume_zscore FROM px")
def _(m):
    return _month(m, "volume_zscore")


@case("e08_volume_5d_ratio", "ticker date:d volume_5d_ratio:6", "SELECT ticker, date, volume_5d_ratio FROM px")
def _(m):
    return _month(m, "volume_5d_ratio")


@case("e09_return_zscores", "ticker date:d return_1m_zscore:6 return_3m_zscore:6", "SELECT ticker, date, return_1m_zscore, return_3m_zscore FROM px")
def _(m):
    return _month(m, "return_1m_zscore", "return_3m_zscore")


@case("e10_volatility_zscore", "ticker date:d vol_zscore_rolling:6", "SELECT ticker, date, vol_zscore_rolling FROM px")
def _(m):
    return _month(m, "vol_zscore_rolling")


@case("e11_volume_mean_zscore", "ticker date:d volume_zscore_rolling:6", "SELECT ticker, date, volume_zscore_rolling FROM px")
def _(m):
    return _month(m, "volume_zscore_rolling")


_inter = [c for c in panel.BASE_FEATURES if c.endswith("_interaction")]


@case("e12_interactions", "ticker date:d " + " ".join(f"{c}:6" for c in _inter), f"SELECT ticker, date, {', '.join(_inter)} FROM px")
def _(m):
    return _month(m, *_inter)


@case("e13_market_features", "date:d market_volatility:8 market_trend:8", "SELECT date, market_volatility, market_trend FROM mkt")
def _(m):
    return panel.benchmark_features(m.bench())


@case("e14_forward_labels", "ticker date:d future_return:6 future_return_2m:6 spy_return:6 target_excess:6",
      "SELECT ticker, date, future_return, future_return_2m, spy_return, target_excess FROM px")
def _(m):
    return _month(m, "future_return", "future_return_2m", "spy_return", "target_excess")


_FUND = "earnings_yield book_to_price roe profit_margin debt_to_equity".split()


@case("e15_fundamental_features", "ticker date:d " + " ".join(f"{c}:6" for c in _FUND), """SELECT r.ticker, r.date,
  CASE WHEN pe_ratio > 0 THEN 1 / pe_ratio END AS earnings_yield, CASE WHEN pb_ratio > 0 THEN 1 / pb_ratio END AS book_to_price,
  roe, profit_margin, debt_to_equity FROM (SELECT ticker, date FROM px) r
  ASOF LEFT JOIN fund f ON f.ticker = r.ticker AND f.date <= r.date""")
def _(m):
    fund = panel.fundamental_features(m.fundamentals())
    return asof_backward(_month(m), fund, _FUND)


@case("e16_excess_label", "ticker date:d future_date:d target_excess:6 target_binary:i", f"""SELECT a.ticker, a.date, future_date,
  future_price / adj_close - b2.lvl / b1.lvl AS target_excess, CASE WHEN future_price / adj_close - b2.lvl / b1.lvl > 0 THEN 1 ELSE 0 END AS target_binary
  FROM (SELECT ticker, date, adj_close, lead(adj_close, 21) OVER {_W} AS future_price, lead(date, 21) OVER {_W} AS future_date FROM prices) a
  ASOF JOIN (SELECT date, adj_close AS lvl FROM bench) b1 ON b1.date <= a.date ASOF JOIN (SELECT date, adj_close AS lvl FROM bench) b2 ON b2.date <= a.future_date
  WHERE future_price IS NOT NULL""")
def _(m):
    return panel.excess_label(m.prices(), m.bench())


@case("e22_daily_return", "ticker date:d ret:6", "SELECT ticker, date, ret FROM rets")
def _(m):
    return m.returns()


add_cte("rb", "SELECT r.*, spy_ret FROM rets r LEFT JOIN brets USING (date)")
add_cte("rbv", "SELECT *, CASE WHEN ret IS NOT NULL AND spy_ret IS NOT NULL THEN spy_ret END AS mv, CASE WHEN spy_ret IS NOT NULL THEN ret END AS sv FROM rb")
add_cte("betas", f"""SELECT ticker, date, CASE WHEN row_number() OVER {_W} <= 60 OR count(sv) OVER {prev(252)} <= 30 THEN 1.0
  WHEN var_pop(mv) OVER {prev(252)} > 0 THEN greatest(least(covar_samp(sv, mv) OVER {prev(252)} / var_pop(mv) OVER {prev(252)}, 3.0), -1.0) ELSE 1.0 END AS beta FROM rbv""")


@case("e23_trailing_beta", "ticker date:d beta:6", "SELECT ticker, date, beta FROM betas")
def _(m):
    return panel.trailing_beta(m.prices(), m.bench())


def _back(n):
    return f"CASE WHEN n >= {n} THEN close / coalesce(lag(close, {n}) OVER {_W}, first_value(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 END"


add_cte("live0", """SELECT p.ticker, date, close, volume, last, row_number() OVER (PARTITION BY p.ticker ORDER BY date) AS n,
  coalesce(close / nullif(lag(close) OVER (PARTITION BY p.ticker ORDER BY date), 0) - 1, 0) AS r
  FROM prices p JOIN (SELECT ticker, max(date) AS last FROM prices GROUP BY 1) l ON l.ticker = p.ticker WHERE date > last - INTERVAL 12 MONTH""")
add_cte("live", f"""SELECT * EXCLUDE (last, n) FROM (SELECT ticker, date, last, n, close AS current_price, r AS return_1d, {_back(3)} AS return_3d, {_back(5)} AS return_5d,
  {_back(21)} AS return_1m, {_back(63)} AS return_3m, {_back(126)} AS return_6m, stddev_samp(r) OVER {w(20)} * sqrt(252) AS volatility_20d,
  stddev_samp(r) OVER {w(60)} * sqrt(252) AS volatility_60d, CASE WHEN n >= 50 THEN close / avg(close) OVER {w(50)} - 1 END AS dist_from_sma_50,
  CASE WHEN n >= 200 THEN close / avg(close) OVER {w(200)} - 1 END AS dist_from_sma_200,
  close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dist_from_52w_high,
  close / min(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dist_from_52w_low,
  volume / nullif(avg(volume) OVER {w(20)}, 0) AS volume_ratio_20,
  (volume - avg(volume) OVER {w(20)}) / nullif(stddev_samp(volume) OVER {w(20)}, 0) AS volume_zscore FROM live0) WHERE date = last AND n >= 60""")
_lr = ", ".join(f"{rank_sql(c, 'one')} AS {c}_rank" for c in LIVE_RANKED)


@case("e24_live_features", "ticker date:d current_price:4 " + " ".join(f"{c}:6 {c}_rank:6" for c in LIVE_RANKED),
      f"SELECT *, {_lr} FROM (SELECT *, 1 AS one FROM live)")
def _(m):
    rows = reliable(panel.live_features(m.prices(), min_bars=60))
    return pct_rank(rows, [], {c: f"{c}_rank" for c in LIVE_RANKED})


_CR = [c for c in monthly.COMPACT_RANKED]
add_cte("excl", f"""SELECT a.ticker, a.date, future_price / adj_close - b2.lvl / b1.lvl AS target_excess FROM (SELECT ticker, date, adj_close, lead(adj_close, 21) OVER {_W} AS future_price, lead(date, 21) OVER {_W} AS future_date FROM prices) a
  ASOF JOIN (SELECT date, adj_close AS lvl FROM bench) b1 ON b1.date <= a.date ASOF JOIN (SELECT date, adj_close AS lvl FROM bench) b2 ON b2.date <= a.future_date WHERE future_price IS NOT NULL""")
add_cte("compact", """SELECT r.* EXCLUDE (target_excess, roe, profit_margin, debt_to_equity), CASE WHEN pe_ratio > 0 THEN 1 / pe_ratio END AS earnings_yield, CASE WHEN pb_ratio > 0 THEN 1 / pb_ratio END AS book_to_price, f.roe, f.profit_margin, f.debt_to_equity, x.target_excess
  FROM (SELECT *, volume_ratio_20 AS volume_ratio, NULL AS roe, NULL AS profit_margin, NULL AS debt_to_equity FROM px WHERE bar_date = date) r ASOF LEFT JOIN fund f ON f.ticker = r.ticker AND f.date <= r.date LEFT JOIN excl x ON x.ticker = r.ticker AND x.date = r.date""")


@case("e25_compact_features", "ticker date:d " + " ".join(f"{c}:6 {c}_rank:6" for c in _CR) + " " + " ".join(f"{c}:6" for c in monthly.COMPACT_FUNDAMENTALS) + " market_volatility:6 market_trend:6 target_excess:6",
      "SELECT *, " + ", ".join(f"{rank_sql(c)} AS {c}_rank" for c in _CR) + " FROM compact")
def _(m):
    return monthly.compact_features(m.prices(), m.bench(), m.fundamentals())
