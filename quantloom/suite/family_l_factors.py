"""L: factor model and covariance. Test tickers trade one day in five, so look-backs
are five times the usual number of dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import factors, factors_at, panel, technical
from quantloom.operators.factors import STYLE_COEFFICIENTS
from quantloom.operators.universe import enough_returns
from quantloom.session import reliable
from quantloom.suite.oracle import add_cte, clip_sql, z_sql
from quantloom.suite.registry import case

_LB, _LEAST = 1260, 60
_STYLES = list(STYLE_COEFFICIENTS)


def _inputs(m):
    returns = reliable(m.returns().select("ticker", "date", "ret"))
    market = reliable(panel.daily_returns(m.bench(), name="spy_ret").select("date", "spy_ret"))
    return returns, market


def _exposure(m):
    returns, market = _inputs(m)
    return returns, market, reliable(factors.exposures(returns, market, m.meta(), _LB, _LEAST))


def _days(n):
    return f"SELECT date FROM (SELECT DISTINCT date FROM rets) ORDER BY date DESC LIMIT {n}"


add_cte("fdays", _days(_LB))
add_cte("fvar", "SELECT var_samp(spy_ret) AS market_var FROM brets WHERE date IN (SELECT date FROM fdays)")
add_cte("frec", """SELECT ticker, date, ret, spy_ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM rb
  WHERE date IN (SELECT date FROM fdays) AND ret IS NOT NULL AND spy_ret IS NOT NULL""")
add_cte("expo", f"""SELECT f.ticker, max(n) AS n_obs, coalesce(any_value(g.sector), 'Unknown') AS sector, {clip_sql('covar_samp(ret, spy_ret) / any_value(v.market_var)', 0.2, 3.0)} AS beta,
  CASE WHEN max(n) >= 63 THEN product(CASE WHEN k > 21 AND (n < 252 OR k <= 252) THEN 1 + ret ELSE 1 END) - 1 ELSE 0 END AS momentum, avg(abs(ret)) / (stddev_samp(ret) + 1e-8) AS size,
  -(product(CASE WHEN k <= 21 THEN 1 + ret ELSE 1 END) - 1) AS value, -stddev_samp(ret) * sqrt(252) AS low_vol, -(product(CASE WHEN k <= 5 THEN 1 + ret ELSE 1 END) - 1) AS reversal, stddev_samp(ret) * sqrt(252) AS volatility
  FROM frec f LEFT JOIN meta g ON g.ticker = f.ticker CROSS JOIN fvar v WHERE n >= {_LEAST} GROUP BY f.ticker""")
add_cte("expol", " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, {f} AS x FROM expo" for f in _STYLES))
add_cte("legs", """SELECT ticker, factor, CASE WHEN hi <= q THEN 1 END AS top, CASE WHEN lo <= q THEN 1 END AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY x DESC, ticker) AS hi,
  row_number() OVER (PARTITION BY factor ORDER BY x, ticker) AS lo, floor(count(*) OVER (PARTITION BY factor) * 0.3) AS q FROM expol)""")
add_cte("styler", "SELECT r.date, factor, avg(ret) FILTER (top = 1) - avg(ret) FILTER (bottom = 1) AS factor_return FROM rets r JOIN legs l ON l.ticker = r.ticker WHERE date IN (SELECT date FROM fdays) AND ret IS NOT NULL AND (top = 1 OR bottom = 1) GROUP BY 1, 2")
_loads = ", ".join(f"{clip_sql(z_sql(f, 'one'), -2, 2)} AS {f}_load" for f in _STYLES)
add_cte("loads", f"SELECT *, {_loads} FROM (SELECT *, 1 AS one FROM expo)")
_wide = ", ".join(f"max(CASE WHEN factor = '{f}' THEN factor_return END) AS {f}_ret" for f in _STYLES)
_less = " ".join(f"- {f}_load * {c}::DOUBLE * {f}_ret" for f, c in STYLE_COEFFICIENTS.items())
add_cte("residr", f"""SELECT x.ticker, x.date, x.sector, ret, ret - beta * spy_ret - (sector_ret - spy_ret) {_less} AS residual FROM (SELECT r.ticker, r.date, r.ret, l.* EXCLUDE (ticker), avg(r.ret) OVER (PARTITION BY r.date, l.sector) AS sector_ret
  FROM rets r JOIN loads l ON l.ticker = r.ticker WHERE r.date IN (SELECT date FROM fdays) AND r.ret IS NOT NULL) x LEFT JOIN (SELECT date, {_wide} FROM styler GROUP BY 1) s ON s.date = x.date LEFT JOIN brets b ON b.date = x.date""")


@case("l01_exposures", "ticker sector beta:6 log_momentum:6 size:6 log_value:6 low_vol:5 log_reversal:6", "SELECT *, ln(1 + momentum) AS log_momentum, ln(1 - value) AS log_value, ln(1 - reversal) AS log_reversal FROM expo")
def _(m):
    e = _exposure(m)[2]
    return e.select("*", F.log(1 + F.col("momentum")).alias("log_momentum"), F.log(1 - F.col("value")).alias("log_value"), F.log(1 - F.col("reversal")).alias("log_reversal"))


@case("l02_style_returns", "date:d factor factor_return:6", "SELECT * FROM styler")
def _(m):
    returns, _, e = _exposure(m)
    return factors.style_returns(returns, e, factors.last_dates(returns, _LB))


@case("l03_loadings", "ticker " + " ".join(f"{f}_load:6" for f in _STYLES), "SELECT * FROM loads")
def _(m):
    return factors.loadings(_exposure(m)[2])


@case("l04_residual_returns", "ticker date:d residual:5", "SELECT * FROM residr")
def _(m):
    return factors.residual_returns(*_exposure(m), _LB)


@case("l05_risk_reduction", "raw_vol:5 residual_vol:5 risk_reduction_pct:5", "SELECT avg(r) * sqrt(252) AS raw_vol, avg(e) * sqrt(252) AS residual_vol, (1 - avg(e) / avg(r)) * 100 AS risk_reduction_pct FROM (SELECT ticker, stddev_samp(ret) AS r, stddev_samp(residual) AS e FROM residr GROUP BY 1)")
def _(m):
    return factors.risk_reduction(factors.residual_returns(*_exposure(m), _LB))


add_cte("covs", "SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, covar_samp(a.ret, b.ret) AS cov FROM enough a JOIN enough b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2")


def _grid(m):
    returns = reliable(m.returns().select("ticker", "date", "ret"))  # met twice: by its dates and by its rows
    return reliable(enough_returns(returns, missing_share=0.8))


@case("l06_covariance", "ticker_i ticker_j cov:6", "SELECT * FROM covs")
def _(m):
    return factors.covariance(_grid(m), block=24)


@case("l07_shrinkage", "ticker_i ticker_j cov:6", "SELECT ticker_i, ticker_j, 0.7::DOUBLE * cov + CASE WHEN ticker_i = ticker_j THEN 0.3::DOUBLE * (SELECT avg(cov) FROM covs WHERE ticker_i = ticker_j) ELSE 0 END AS cov FROM covs")
def _(m):
    grid = _grid(m)
    return factors.shrink(factors.covariance(grid), diagonal=factors.mean_variance(grid))


add_cte("lwm", """SELECT p, t, ss * pow((t - 1.0::DOUBLE) / t, 2) AS ss, tr * (t - 1.0::DOUBLE) / t AS tr, fourth FROM (SELECT sum(cov * cov * CASE WHEN ticker_i = ticker_j THEN 1 ELSE 2 END) AS ss, sum(cov) FILTER (ticker_i = ticker_j) AS tr, count(*) FILTER (ticker_i = ticker_j) AS p FROM covs)
  CROSS JOIN (SELECT sum(q * q) AS fourth, count(*) AS t FROM (SELECT date, sum(pow(ret - mu, 2)) AS q FROM (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS mu FROM enough) GROUP BY 1))""")


@case("l08_ledoit_wolf", "shrinkage:8 mean_variance:6", "SELECT least((fourth / t - ss) / (p * t), d) / d AS shrinkage, tr / p AS mean_variance FROM (SELECT *, (ss - 2 * tr / p * tr + p * pow(tr / p, 2)) / p AS d FROM lwm)")
def _(m):
    return factors.ledoit_wolf(_grid(m), block=24)


add_cte("ofb", "SELECT *, ret - beta * mk AS e FROM (SELECT g.*, covar_samp(ret, mk) OVER (PARTITION BY ticker) / var_pop(mk) OVER (PARTITION BY ticker) AS beta FROM (SELECT *, avg(ret) OVER (PARTITION BY date) AS mk FROM enough) g)")
add_cte("ofp", "SELECT ticker, any_value(beta) AS beta, var_pop(e) AS rv, var_pop(mk) AS mvar FROM ofb GROUP BY 1")


@case("l09_one_factor_covariance", "ticker_i ticker_j cov:6", "SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, a.beta * b.beta * a.mvar + CASE WHEN a.ticker = b.ticker THEN a.rv ELSE 0 END AS cov FROM ofp a JOIN ofp b ON a.ticker <= b.ticker")
def _(m):
    return factors.one_factor_covariance(_grid(m), block=24)


@case("l10_average_correlation", "avg_correlation:8 n_pairs:i", "SELECT avg(c.cov / (sqrt(a.cov) * (sqrt(b.cov) + 1e-10))) AS avg_correlation, count(*) AS n_pairs FROM covs c JOIN covs a ON a.ticker_i = c.ticker_i AND a.ticker_j = c.ticker_i JOIN covs b ON b.ticker_i = c.ticker_j AND b.ticker_j = c.ticker_j WHERE c.ticker_i < c.ticker_j")
def _(m):
    return factors.average_correlation(_grid(m))


add_cte("nin", "SELECT s.ticker, s.date, score, b.beta, p.return_12m AS momentum FROM scores s LEFT JOIN betas b ON b.ticker = s.ticker AND b.date = s.date LEFT JOIN px p ON p.ticker = s.ticker AND p.date = s.date")
add_cte("nin2", "SELECT *, coalesce(beta, avg(beta) OVER d) - avg(beta) OVER d AS dx, coalesce(momentum, avg(momentum) OVER d) - avg(momentum) OVER d AS dz, score - avg(score) OVER d AS dy FROM nin WINDOW d AS (PARTITION BY date)")
add_cte("nin3", "SELECT *, sum(dx * dx) OVER d AS sxx, sum(dz * dz) OVER d AS szz, sum(dx * dz) OVER d AS sxz, sum(dx * dy) OVER d AS sxy, sum(dz * dy) OVER d AS szy FROM nin2 WINDOW d AS (PARTITION BY date)")


def _neutral_inputs(m):
    beta = panel.trailing_beta(m.prices(), m.bench())
    mom = m.month_table().select("ticker", "date", F.col("return_12m").alias("momentum"))
    return reliable(m.scores().select("ticker", "date", "score").join(beta, ["ticker", "date"], "left").join(mom, ["ticker", "date"], "left"))


@case("l11_neutral_alpha", "ticker date:d alpha:6", """SELECT ticker, date, CASE WHEN sxx * szz - sxz * sxz > 1e-12 * sxx * szz THEN dy - (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) * dx - (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) * dz
  WHEN sxx > 0 THEN dy - sxy / sxx * dx ELSE dy END AS alpha FROM nin3""")
def _(m):
    return factors.neutral_alpha(_neutral_inputs(m))


add_cte("vdays", _days(300))


@case("l12_latest_vol_beta", "ticker beta:6 volatility:5", f"""SELECT coalesce(b.ticker, v.ticker) AS ticker, beta, volatility FROM (SELECT ticker, CASE WHEN count(*) > {_LEAST} THEN {clip_sql('covar_samp(ret, spy_ret) / any_value(market_var)', 0.2, 3.0)} ELSE 1.0 END AS beta FROM frec CROSS JOIN fvar GROUP BY 1) b
  FULL JOIN (SELECT ticker, stddev_samp(ret) * sqrt(252) AS volatility FROM rets WHERE date IN (SELECT date FROM vdays) AND ret IS NOT NULL GROUP BY 1) v ON v.ticker = b.ticker""")
def _(m):
    returns, market = _inputs(m)
    return factors.latest_vol_beta(returns, market, 300, _LB, _LEAST)


@case("l13_matched_beta", "ticker date:d history_beta:6", "SELECT * FROM hist")
def _(m):
    return technical.history_risk(m.prices(), m.bench())


# -- as of every month end ------------------------------------------------------------

add_cte("acal", "SELECT date, row_number() OVER (ORDER BY date) AS t FROM cal")
add_cte("aspan", f"SELECT m.date AS as_of, c.t AS hi, c.t - {_LB} AS lo, c.t - 300 AS vlo FROM mends m JOIN acal c ON c.date = m.date")
add_cte("amkt", "SELECT as_of, var_samp(spy_ret) AS market_var FROM aspan s JOIN acal c ON c.t > s.lo AND c.t <= s.hi JOIN brets b ON b.date = c.date GROUP BY 1")
add_cte("arec", """SELECT as_of, ticker, c.date, ret, spy_ret, row_number() OVER (PARTITION BY as_of, ticker ORDER BY c.date DESC) AS k, count(*) OVER (PARTITION BY as_of, ticker) AS n
  FROM aspan s JOIN acal c ON c.t > s.lo AND c.t <= s.hi JOIN rb ON rb.date = c.date WHERE ret IS NOT NULL AND spy_ret IS NOT NULL""")
add_cte("aexpo", f"""SELECT f.ticker, f.as_of, max(n) AS n_obs, coalesce(any_value(g.sector), 'Unknown') AS sector, {clip_sql('covar_samp(ret, spy_ret) / any_value(v.market_var)', 0.2, 3.0)} AS beta,
  CASE WHEN max(n) >= 63 THEN product(CASE WHEN k > 21 AND (n < 252 OR k <= 252) THEN 1 + ret ELSE 1 END) - 1 ELSE 0 END AS momentum, avg(abs(ret)) / (stddev_samp(ret) + 1e-8) AS size,
  -(product(CASE WHEN k <= 21 THEN 1 + ret ELSE 1 END) - 1) AS value, -stddev_samp(ret) * sqrt(252) AS low_vol, -(product(CASE WHEN k <= 5 THEN 1 + ret ELSE 1 END) - 1) AS reversal, stddev_samp(ret) * sqrt(252) AS volatility
  FROM arec f LEFT JOIN meta g ON g.ticker = f.ticker JOIN amkt v ON v.as_of = f.as_of WHERE n >= {_LEAST} GROUP BY f.ticker, f.as_of""")
_aloads = ", ".join(f"{clip_sql(z_sql(f, 'as_of'), -2, 2)} AS {f}_load" for f in _STYLES)
add_cte("aloads", f"SELECT *, {_aloads} FROM aexpo")
add_cte("aexpol", " UNION ALL ".join(f"SELECT ticker, as_of, '{f}' AS factor, {f} AS x FROM aexpo" for f in _STYLES))
add_cte("alegs", """SELECT ticker, as_of, factor, CASE WHEN hi <= q THEN 1 END AS top, CASE WHEN lo <= q THEN 1 END AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY as_of, factor ORDER BY x DESC, ticker) AS hi,
  row_number() OVER (PARTITION BY as_of, factor ORDER BY x, ticker) AS lo, floor(count(*) OVER (PARTITION BY as_of, factor) * 0.3) AS q FROM aexpol)""")
add_cte("aheld", "SELECT c.date, max(m.date) AS as_of FROM cal c JOIN mends m ON m.date < c.date GROUP BY 1")
add_cte("astyler", "SELECT r.date, factor, avg(ret) FILTER (top = 1) - avg(ret) FILTER (bottom = 1) AS factor_return FROM rets r JOIN aheld h ON h.date = r.date JOIN alegs l ON l.ticker = r.ticker AND l.as_of = h.as_of WHERE ret IS NOT NULL AND (top = 1 OR bottom = 1) GROUP BY 1, 2")
add_cte("aresid", f"""SELECT x.ticker, x.date, x.as_of, x.sector, ret, ret - beta * spy_ret - (sector_ret - spy_ret) {_less} AS residual FROM (SELECT r.date, r.ret, l.*, avg(r.ret) OVER (PARTITION BY r.date, l.sector) AS sector_ret
  FROM rets r JOIN aheld h ON h.date = r.date JOIN aloads l ON l.ticker = r.ticker AND l.as_of = h.as_of WHERE r.ret IS NOT NULL) x LEFT JOIN (SELECT date, {_wide} FROM astyler GROUP BY 1) s ON s.date = x.date LEFT JOIN brets b ON b.date = x.date""")


def _exposure_at(m):
    returns, market = _inputs(m)
    ends = reliable(m.month_ends())
    return returns, market, reliable(factors_at.exposures_at(returns, market, m.meta(), ends, _LB, _LEAST)), ends


@case("l01_exposures_by_date", "ticker as_of:d n_obs:i sector beta:6 log_momentum:6 size:6 log_value:6 low_vol:5 log_reversal:6 volatility:5", "SELECT *, ln(1 + momentum) AS log_momentum, ln(1 - value) AS log_value, ln(1 - reversal) AS log_reversal FROM aexpo")
def _(m):
    e = _exposure_at(m)[2]
    return e.select("*", F.log(1 + F.col("momentum")).alias("log_momentum"), F.log(1 - F.col("value")).alias("log_value"), F.log(1 - F.col("reversal")).alias("log_reversal"))


@case("l02_style_returns_by_date", "date:d factor factor_return:6", "SELECT * FROM astyler")
def _(m):
    returns, _, e, ends = _exposure_at(m)
    return factors_at.style_returns_at(returns, e, factors_at.holding_days(returns, ends))


@case("l03_loadings_by_date", "ticker as_of:d " + " ".join(f"{f}_load:6" for f in _STYLES), "SELECT * FROM aloads")
def _(m):
    return factors_at.loadings_at(_exposure_at(m)[2])


@case("l04_residual_returns_by_date", "ticker date:d as_of:d residual:5", "SELECT * FROM aresid")
def _(m):
    return factors_at.residual_returns_at(*_exposure_at(m))


@case("l05_risk_reduction_by_date", "as_of:d raw_vol:5 residual_vol:5 risk_reduction_pct:5", "SELECT as_of, avg(r) * sqrt(252) AS raw_vol, avg(e) * sqrt(252) AS residual_vol, (1 - avg(e) / avg(r)) * 100 AS risk_reduction_pct FROM (SELECT as_of, ticker, stddev_samp(ret) AS r, stddev_samp(residual) AS e FROM aresid GROUP BY 1, 2) GROUP BY 1 HAVING avg(r) > 0")
def _(m):
    return factors.risk_reduction(factors_at.residual_returns_at(*_exposure_at(m)), ["as_of"]).where("raw_vol > 0")


@case("l12_vol_beta_by_date", "ticker as_of:d beta:6 volatility:5", f"""SELECT coalesce(b.ticker, v.ticker) AS ticker, coalesce(b.as_of, v.as_of) AS as_of, beta, volatility FROM (SELECT ticker, f.as_of, CASE WHEN count(*) > {_LEAST} THEN {clip_sql('covar_samp(ret, spy_ret) / any_value(market_var)', 0.2, 3.0)} ELSE 1.0 END AS beta FROM arec f JOIN amkt v ON v.as_of = f.as_of GROUP BY 1, 2) b
  FULL JOIN (SELECT ticker, as_of, stddev_samp(ret) * sqrt(252) AS volatility FROM aspan s JOIN acal c ON c.t > s.vlo AND c.t <= s.hi JOIN rets r ON r.date = c.date WHERE ret IS NOT NULL GROUP BY 1, 2) v ON v.ticker = b.ticker AND v.as_of = b.as_of""")
def _(m):
    returns, market = _inputs(m)
    return factors_at.vol_beta_at(returns, market, reliable(m.month_ends()), 300, _LB, _LEAST)
