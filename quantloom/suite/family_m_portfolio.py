"""M and N: portfolio construction, returns, costs and exposure scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import limited, panel, regime, returns, risk, solve, weights
from quantloom.plans.derived import BOOKS
from quantloom.session import reliable
from quantloom.suite.oracle import add_cte
from quantloom.suite.registry import case

_top20 = "(SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS place FROM scores QUALIFY place <= 20)"


def _slots():
    return F.element_at(F.create_map(*[F.lit(x) for kv in BOOKS.items() for x in kv]), F.col("strategy"))


@case("m01_equal_weight", "date:d ticker weight:8", f"SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM {_top20}")
def _(m):
    return weights.equal_weight(weights.top_n(m.scores(), 20))


@case("m02_inverse_volatility", "strategy date:d ticker weight:8", "SELECT * FROM books")
def _(m):
    return m.books()


add_cte("cw1", "SELECT ticker, date, CASE WHEN stddev_pop(score) OVER d > 0 THEN coalesce((score - avg(score) OVER d) / stddev_pop(score) OVER d, 0) ELSE 0 END AS z FROM scores WINDOW d AS (PARTITION BY date)")
add_cte("cw2", "SELECT *, greatest(least(z / sum(abs(z)) OVER (PARTITION BY date) * 2, 0.05), -0.05) AS raw FROM cw1")
add_cte("cw", "SELECT ticker, date, CASE WHEN raw > 0 THEN raw / sum(CASE WHEN raw > 0 THEN raw END) OVER (PARTITION BY date) WHEN raw < 0 THEN raw / sum(CASE WHEN raw < 0 THEN -raw END) OVER (PARTITION BY date) ELSE raw END AS weight FROM cw2")


@case("m03_continuous_weights", "date:d ticker weight:8", "SELECT * FROM cw")
def _(m):
    return weights.continuous_weights(m.scores())


add_cte("cwd", "SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM cw)")
add_cte("cwboth", "SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.nxt) AS date, coalesce(a.weight, 0) AS now, coalesce(b.weight, 0) AS was FROM cw a FULL JOIN (SELECT ticker, weight, nxt FROM cw JOIN cwd USING (date) WHERE nxt IS NOT NULL) b ON a.ticker = b.ticker AND a.date = b.nxt")
add_cte("cwlim", "SELECT *, was + greatest(least(now - was, 0.03), -0.03) AS raw FROM cwboth WHERE abs(was + greatest(least(now - was, 0.03), -0.03)) > 0.001")


@case("m04_turnover_limit", "date:d ticker weight:8", "SELECT date, ticker, CASE WHEN raw > 0 THEN raw / sum(CASE WHEN raw > 0 THEN raw END) OVER (PARTITION BY date) WHEN raw < 0 THEN raw / sum(CASE WHEN raw < 0 THEN -raw END) OVER (PARTITION BY date) ELSE raw END AS weight FROM cwlim")
def _(m):
    w = weights.continuous_weights(m.scores()).withColumn("strategy", F.lit("z"))
    return weights.limit_turnover(w, weights.carried_forward(w), ["strategy", "date"], step=0.03)


add_cte("cwk", "SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM cw)")
add_cte("cwt", "SELECT k, ticker, weight FROM cw JOIN cwk ON cwk.date = cw.date")
add_cte("cwpath", """SELECT k, ticker, weight FROM cwt WHERE k = 1 UNION ALL SELECT k, ticker, CASE WHEN raw > 0 THEN raw / sum(CASE WHEN raw > 0 THEN raw END) OVER () WHEN raw < 0 THEN raw / sum(CASE WHEN raw < 0 THEN -raw END) OVER () ELSE raw END FROM (
  SELECT k, ticker, was + greatest(least(now - was, 0.03::DOUBLE), -0.03::DOUBLE) AS raw FROM (SELECT k, ticker, sum(was) AS was, sum(now) AS now FROM (
    SELECT k + 1 AS k, ticker, weight AS was, 0.0::DOUBLE AS now FROM cwpath UNION ALL SELECT k, ticker, 0.0::DOUBLE, weight FROM cwt WHERE k = (SELECT max(k) + 1 FROM cwpath)) WHERE k <= (SELECT max(k) FROM cwk) GROUP BY k, ticker)) WHERE abs(raw) > 0.001""")


@case("m04_turnover_path", "strategy date:d ticker weight:6", "SELECT 'z' AS strategy, date, ticker, weight FROM cwpath JOIN cwk ON cwk.k = cwpath.k")
def _(m):
    w = weights.continuous_weights(m.scores()).withColumn("strategy", F.lit("z"))
    return solve.turnover_path(w, step=0.03)


add_cte("btilt", "SELECT b.strategy, b.date, b.ticker, b.weight, coalesce(x.beta, 1.0) AS beta FROM books b LEFT JOIN betas x ON x.ticker = b.ticker AND x.date = b.date")
add_cte("btilt2", "SELECT *, sum(weight * beta) OVER d AS book_beta, weight * (1 - 0.3::DOUBLE * (beta - avg(beta) OVER d)) AS adj FROM btilt WINDOW d AS (PARTITION BY strategy, date)")


@case("m05_beta_tilt", "strategy date:d ticker book_beta:6 weight_adj:8", "SELECT *, CASE WHEN abs(book_beta - 0.5) < 0.05 THEN weight ELSE adj / sum(abs(adj)) OVER (PARTITION BY strategy, date) END AS weight_adj FROM btilt2")
def _(m):
    beta = panel.trailing_beta(m.prices(), m.bench())
    rows = m.books().select("strategy", "date", "ticker", "weight").join(beta, ["ticker", "date"], "left")
    return weights.beta_tilt(rows, target=0.5, keys=["strategy", "date"])


@case("m06_sector_neutral", "strategy date:d ticker sector_weight:8", """SELECT strategy, date, ticker, CASE WHEN total > 0 THEN score / total ELSE 1.0 / n END / sectors AS sector_weight FROM (SELECT *, sum(score) OVER (PARTITION BY strategy, date, sector) AS total, count(*) OVER (PARTITION BY strategy, date, sector) AS n FROM books)
  JOIN (SELECT strategy, date, count(DISTINCT sector) AS sectors FROM books GROUP BY 1, 2) USING (strategy, date)""")
def _(m):
    return weights.sector_neutral(m.books().drop("weight"), keys=["strategy", "date"])


# a stand-in index: the largest names by market cap, weighted by cap
add_cte("idx", "SELECT ticker, row_number() OVER (ORDER BY market_cap DESC, ticker) AS index_rank, market_cap / 1e13 AS index_weight FROM meta WHERE market_cap IS NOT NULL QUALIFY index_rank <= 15")


def _index(m):
    top = m.meta().where("market_cap IS NOT NULL").orderBy(F.desc("market_cap"), "ticker").limit(15)
    from pyspark.sql import Window

    return top.select("ticker", F.row_number().over(Window.orderBy(F.desc("market_cap"), "ticker")).alias("index_rank"), (F.col("market_cap") / 1e13).alias("index_weight"))


add_cte("ov0", "SELECT s.ticker, s.date, s.score * 100 AS score, index_rank, index_weight, index_rank IS NOT NULL AS mega FROM scores s LEFT JOIN idx i ON i.ticker = s.ticker")
add_cte("ovm", "SELECT * FROM ov0 WHERE mega AND score >= 5 QUALIFY row_number() OVER (PARTITION BY date ORDER BY index_rank, ticker) <= 5")
add_cte("ovr", "SELECT * EXCLUDE (place, used) FROM (SELECT o.*, row_number() OVER (PARTITION BY o.date ORDER BY score DESC NULLS LAST, o.ticker) AS place, coalesce(used, 0) AS used FROM ov0 o LEFT JOIN (SELECT date, count(*) AS used FROM ovm GROUP BY 1) u ON u.date = o.date WHERE NOT mega) WHERE place <= 20 - used")
add_cte("ov", "SELECT *, count(*) FILTER (mega) OVER (PARTITION BY date) AS nm FROM (SELECT * FROM ovm UNION ALL SELECT * FROM ovr)")
add_cte("ovh", "SELECT *, own / sum(own) OVER (PARTITION BY date, mega) * CASE WHEN mega THEN greatest(0.2, nm / 20.0) ELSE 1 - greatest(0.2, nm / 20.0) END AS rawh, CASE WHEN mega THEN index_weight WHEN nm < 20 THEN 1.0 / (20 - nm) ELSE 0 END AS rawc FROM (SELECT *, CASE WHEN mega THEN score * index_weight ELSE score END AS own FROM ov)")
add_cte("ovw", "SELECT *, rawh / sum(rawh) OVER (PARTITION BY date) AS hybrid, rawc / sum(rawc) OVER (PARTITION BY date) AS cap_weighted, 1.0 / count(*) OVER (PARTITION BY date) AS equal FROM ovh")


def _overlay(m):
    rows = m.scores().select("ticker", "date", (F.col("score") * 100).alias("score"), "market_volatility")
    return weights.overlay_select(rows, _index(m), 20, 5)


@case("m07_overlay_selection", "date:d ticker is_mega_cap:i score:6", "SELECT *, mega AS is_mega_cap FROM ov")
def _(m):
    return _overlay(m)


@case("m08_overlay_weights", "method date:d ticker weight:8", " UNION ALL ".join(f"SELECT '{x}' AS method, date, ticker, {x} AS weight FROM ovw" for x in ("equal", "cap_weighted", "hybrid")))
def _(m):
    book = reliable(_overlay(m))
    parts = [weights.overlay_weights(book, 20, x).select(F.lit(x).alias("method"), "date", "ticker", "weight") for x in ("equal", "cap_weighted", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("m09_overlay_summary", "date:d total_stocks:i mega_caps:i other_picks:i mega_cap_weight:8 other_weight:8", "SELECT date, count(*) AS total_stocks, count(*) FILTER (mega) AS mega_caps, count(*) FILTER (NOT mega) AS other_picks, sum(CASE WHEN mega THEN hybrid ELSE 0 END) AS mega_cap_weight, sum(CASE WHEN mega THEN 0 ELSE hybrid END) AS other_weight FROM ovw GROUP BY 1")
def _(m):
    return weights.overlay_summary(weights.overlay_weights(_overlay(m), 20))


@case("i06_regime_adjusted_weights", "date:d ticker adjusted_weight:8", """SELECT date, ticker, CASE WHEN low THEN a / sum(a) OVER (PARTITION BY date) WHEN vix > 30 THEN hybrid * 0.7 ELSE hybrid END AS adjusted_weight FROM (
  SELECT o.*, vix, low, CASE WHEN low THEN hybrid * CASE WHEN mega THEN 1.5 ELSE 0.7 END END AS a FROM ovw o JOIN (SELECT date, vix, vix < 20 AS low FROM macro) k ON k.date = o.date)""")
def _(m):
    book = weights.overlay_weights(_overlay(m), 20)
    state = m.macro().select("date", "vix", F.when(F.col("vix") < 20, "LOW_DISPERSION").otherwise("NORMAL").alias("market_regime"), F.lit(0.2).alias("dispersion"))
    return regime.adjust_weights(book.join(F.broadcast(state), "date"))


@case("m10_conviction", "date:d ticker conviction:6", """SELECT date, ticker, (x - avg(x) OVER d) / (stddev_pop(x) OVER d + 1e-8) AS conviction FROM (SELECT date, ticker, sign(c) * pow(abs(c), 2) AS x FROM (SELECT date, ticker, CASE WHEN max(score) OVER d - min(score) OVER d > 1e-8 THEN (score - min(score) OVER d) / (max(score) OVER d - min(score) OVER d) ELSE 0.5 END - 0.5 AS c FROM scores WINDOW d AS (PARTITION BY date)))
  WINDOW d AS (PARTITION BY date)""")
def _(m):
    return weights.conviction(m.scores())


@case("m11_alpha_tilt", "date:d ticker weight:8", """SELECT date, ticker, w / sum(w) OVER (PARTITION BY date) AS weight FROM (SELECT *, least(a / sum(a) OVER (PARTITION BY date), 0.08) AS w FROM (SELECT *, pow(score - min(score) OVER (PARTITION BY date) + 0.01::DOUBLE, 1.5::DOUBLE) AS a FROM (
  SELECT date, ticker, score, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS place FROM scores QUALIFY place <= 40))) WHERE place <= 20""".replace("SELECT date, ticker, w / sum(w) OVER (PARTITION BY date) AS weight FROM (SELECT *, least", "SELECT date, ticker, w / sum(w) OVER (PARTITION BY date) AS weight FROM (SELECT *, least"))
def _(m):
    return weights.alpha_tilt(m.scores(), 20, power=1.5, cap=0.08)


@case("m12_score_capped", "date:d ticker weight:8", f"SELECT date, ticker, w / sum(w) OVER (PARTITION BY date) AS weight FROM (SELECT *, least(score / sum(score) OVER (PARTITION BY date), 0.0525::DOUBLE) AS w FROM {_top20})")
def _(m):
    return weights.score_capped(m.scores(), 20, cap=0.0525)


add_cte("lsb", """SELECT date, ticker, 1 AS side, 0.5 * inv / sum(inv) OVER (PARTITION BY date) AS w FROM (SELECT *, 1 / greatest(coalesce(volatility_20d, median(volatility_20d) OVER (PARTITION BY date)), 0.10) AS inv FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS place FROM scores QUALIFY place <= 10))
  UNION ALL SELECT date, ticker, -1, -0.5 * inv / sum(inv) OVER (PARTITION BY date) FROM (SELECT *, 1 / greatest(coalesce(volatility_20d, median(volatility_20d) OVER (PARTITION BY date)), 0.10) AS inv FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score ASC NULLS LAST, ticker) AS place FROM scores QUALIFY place <= 10))""")


def _long_short(m):
    s = m.scores()
    return weights.long_short_book(weights.inverse_vol(weights.top_n(s, 10)), weights.inverse_vol(weights.top_n(s, 10, largest=False)))


@case("m13_long_short_book", "date:d ticker side:i signed_weight:8", "SELECT date, ticker, side, w AS signed_weight FROM lsb")
def _(m):
    return _long_short(m)


def _samples(m, bars=252):
    picks = m.books().select("strategy", "date", "ticker", "score")
    return solve.lookback_returns(picks, m.returns(), bars)


@case("m14_kelly_weights", "strategy date:d ticker weight:6")
def _(m):
    return solve.kelly_weights(_samples(m))


@case("m14_kelly_bounds", "strategy date:d total:6 outside:i", "SELECT DISTINCT strategy, date, 1.0::DOUBLE AS total, 0 AS outside FROM books")
def _(m):
    return solve.kelly_weights(_samples(m)).groupBy("strategy", "date").agg(F.sum("weight").alias("total"), F.count_if(F.col("weight") < 0).alias("outside"))


def _constrained(m):
    rows = reliable(_samples(m, 126))
    out = None
    for x in solve.METHODS:
        part = solve.constrained_weights(rows, x, low=0.01, high=0.20).withColumn("method", F.lit(x))
        out = part if out is None else out.unionByName(part)
    return out


@case("m15_constrained_weights", "method strategy date:d ticker weight:6")
def _(m):
    return _constrained(m)


@case("m15_weight_bounds", "method strategy date:d total:6 outside:i", f"""SELECT method, strategy, date, 1.0::DOUBLE AS total, 0 AS outside FROM (SELECT DISTINCT strategy, date FROM books) CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in solve.METHODS)}) v(method)""")
def _(m):
    beyond = F.col("bounds_met") & ((F.col("weight") < 0.01 - 1e-6) | (F.col("weight") > 0.20 + 1e-6))
    return _constrained(m).groupBy("method", "strategy", "date").agg(F.sum("weight").alias("total"), F.count_if(beyond).alias("outside"))


LIMITS = {
    "beta_sector": limited.Limits(high=0.30, beta=(-1.0, 1.5), sector=0.60),
    "volatility_turnover": limited.Limits(high=0.30, volatility=16.0, turnover=0.9),
    "neutral": limited.Limits(high=0.30, beta=(-1.0, 2.0), sector=0.70, neutral=("return_6m",), neutral_band=0.5),
    "long_short": limited.Limits(low=-0.25, high=0.25, budget=0.0, beta=(0.0, 0.0), sector=0.15, gross=1.0),
}


def _limited(m):
    """Look-back rows of every book with what the limits need."""
    picks = m.books().select("strategy", "date", "ticker", "score", "weight", "sector", "return_6m")
    beta = panel.trailing_beta(m.prices(), m.bench()).select("ticker", "date", "beta")
    before = weights.align_weights(picks, weights.carried_forward(picks.select("strategy", "date", "ticker", "weight")), ["strategy", "date"])
    gone = before.where("weight_now = 0").groupBy("strategy", "date").agg(F.sum("weight_before").alias("dropped_weight"))
    about = picks.drop("weight", "score").join(beta, ["ticker", "date"], "left")
    about = about.join(before.select("strategy", "date", "ticker", F.col("weight_before").alias("prior_weight")), ["strategy", "date", "ticker"]).join(gone, ["strategy", "date"], "left")
    return reliable(_samples(m, 126).join(about, ["strategy", "date", "ticker"]))


@case("m15_limit_violations", "limits strategy date:d violations:i unproven:i", f"""SELECT limits, strategy, date, 0 AS violations, 0 AS unproven FROM (SELECT DISTINCT strategy, date FROM books) CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in LIMITS)}) v(limits)""")
def _(m):
    rows, out = _limited(m), None
    for name, limits in LIMITS.items():
        part = limited.violations(reliable(limited.limited_weights(rows, limits)), limits).withColumn("limits", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@case("m16_weight_turnover", "strategy date:d turnover:8", "SELECT f.strategy, f.date, CASE WHEN k = 1 THEN 0 ELSE sum(abs(weight_now - weight_before)) / 2 END AS turnover FROM bookdiff f JOIN bookdates d ON d.strategy = f.strategy AND d.date = f.date GROUP BY 1, 2, k")
def _(m):
    return weights.weight_turnover(m.books())


@case("m17_holdings_turnover", "strategy date:d entered:i exited:i turnover:8", "SELECT * FROM hchange")
def _(m):
    return weights.holdings_change(m.books(), _slots())


add_cte("shares", "SELECT b.strategy, b.ticker, b.date, p.close AS price, floor(b.weight * 1e6 / p.close) AS target FROM books b ASOF JOIN prices p ON p.ticker = b.ticker AND p.date <= b.date")
add_cte("heldsh", "SELECT strategy, ticker, nxt AS date, target AS shares FROM shares JOIN bookdates USING (strategy, date) WHERE nxt IS NOT NULL")


def _quoted(m, columns):
    """The last quote up to each distinct (ticker, date) that any book asks for."""
    from quantloom.operators.asof import asof_backward

    asked = m.books().select("ticker", "date").distinct()
    return asof_backward(asked, m.prices().select("ticker", "date", *columns), columns).select("ticker", "date", *columns)


def _first_shares(m):
    """Whole shares of every book of every strategy, bought from nothing, with the quotes."""
    book = m.books().select("strategy", "date", "ticker", "weight")
    quotes = reliable(_quoted(m, ["close"]).withColumnRenamed("close", "price"))
    empty = book.where("false").select("strategy", "date", "ticker", F.lit(0).cast("long").alias("shares"))
    return book, quotes, reliable(weights.target_shares(book, empty, quotes, 1e6, ["strategy", "date"]))


@case("m18_target_shares", "strategy date:d ticker target:i shares:i order_shares:i action", """SELECT *, target - shares AS order_shares, CASE WHEN target > shares THEN 'BUY' WHEN target < shares THEN 'SELL' ELSE 'HOLD' END AS action FROM (
  SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.date, b.date) AS date, coalesce(a.ticker, b.ticker) AS ticker, coalesce(target, 0) AS target, coalesce(shares, 0) AS shares FROM shares a FULL JOIN heldsh b ON a.ticker = b.ticker AND a.date = b.date AND a.strategy = b.strategy)""")
def _(m):
    book, quotes, first = _first_shares(m)
    moved = weights.carried_forward(first.select("strategy", "date", "ticker", F.col("target").alias("shares")))
    return weights.target_shares(book, moved, quotes, 1e6, ["strategy", "date"])


@case("m19_aligned_or_fallback", "date:d ticker n_names:i is_fallback:i fallback:6", """SELECT date, ticker, n AS n_names, CASE WHEN n < 90 THEN 1 ELSE 0 END AS is_fallback, coalesce(CASE WHEN n < 90 THEN d / nullif(sum(abs(d)) OVER (PARTITION BY date), 0) END, 0) AS fallback FROM (
  SELECT x.date, x.ticker, count(*) OVER (PARTITION BY x.date) AS n, score - avg(score) OVER (PARTITION BY x.date) AS d FROM scores x JOIN rets r ON r.ticker = x.ticker AND r.date = x.date JOIN betas b ON b.ticker = x.ticker AND b.date = x.date)""")
def _(m):
    beta = panel.trailing_beta(m.prices(), m.bench())
    out = weights.aligned_or_fallback(m.scores().select("date", "ticker", "score"), m.returns().select("date", "ticker", "ret"), beta, least=90)
    return out.withColumn("fallback", F.coalesce("fallback_weight", F.lit(0.0)))


add_cte("bookcov", "SELECT b.strategy, sum(b.weight * v.mean_return) AS expected_return FROM lastbook b JOIN (SELECT ticker, avg(ret) * 252 AS mean_return FROM enough GROUP BY 1) v ON v.ticker = b.ticker GROUP BY 1")
add_cte("lastbook", "SELECT * FROM books WHERE date = (SELECT max(date) FROM books)")


@case("j16_book_metrics", "strategy expected_return:5 volatility:5 sharpe:6", """SELECT e.strategy, expected_return, sqrt(v) AS volatility, (expected_return - 0.04) / sqrt(v) AS sharpe FROM bookcov e JOIN (SELECT a.strategy, sum(a.weight * b.weight * c.cov * 252 * CASE WHEN c.ticker_i = c.ticker_j THEN 1 ELSE 2 END) AS v
  FROM covs c JOIN lastbook a ON a.ticker = c.ticker_i JOIN lastbook b ON b.ticker = c.ticker_j AND a.strategy = b.strategy GROUP BY 1) x ON x.strategy = e.strategy""")
def _(m):
    from quantloom.operators.universe import enough_returns

    grid = reliable(enough_returns(m.returns(), missing_share=0.8))
    book = reliable(m.books())
    book = book.join(F.broadcast(book.agg(F.max("date").alias("date"))), "date", "left_semi").select("strategy", "ticker", "weight")
    return risk.book_metrics(book, grid)


# -- N ----------------------------------------------------------------------------


@case("n01_holding_returns", "strategy date:d ticker hold_return:6", "SELECT * FROM hret")
def _(m):
    return returns.holding_returns(m.books(), m.plan(), m.prices())


add_cte("oo", """SELECT b.strategy, b.date, b.ticker, b.weight, entry_date, exit_date, p1.open AS entry_price, p2.open AS xo, CASE WHEN p3.date > entry_date THEN p3.close END AS lastp FROM books b JOIN plan USING (date)
  LEFT JOIN prices p1 ON p1.ticker = b.ticker AND p1.date = entry_date LEFT JOIN prices p2 ON p2.ticker = b.ticker AND p2.date = exit_date ASOF LEFT JOIN prices p3 ON p3.ticker = b.ticker AND p3.date <= plan.exit_date""")


@case("n02_open_to_open", "strategy date:d ticker hold_return:6", "SELECT *, coalesce(CASE WHEN entry_price > 0 THEN coalesce(xo, lastp) / entry_price - 1 END, -1) AS hold_return FROM oo")
def _(m):
    picks = m.books().join(F.broadcast(m.plan()), "date")
    return returns.open_to_open(picks, m.prices())


@case("n03_portfolio_return", "strategy date:d raw_return:6 n_held:i", "SELECT * FROM pret")
def _(m):
    return returns.weighted_return(returns.holding_returns(m.books(), m.plan(), m.prices()))


add_cte("lsheld", """SELECT b.*, b.w AS weight, CASE WHEN p1.date - entry_date <= 7 THEN p1.adj_close END AS ep, CASE WHEN p2.date - exit_date <= 7 THEN p2.adj_close END AS xp FROM lsb b JOIN plan USING (date)
  ASOF LEFT JOIN prices p1 ON p1.ticker = b.ticker AND p1.date >= plan.entry_date ASOF LEFT JOIN prices p2 ON p2.ticker = b.ticker AND p2.date >= plan.exit_date""")
add_cte("lsr", "SELECT *, CASE WHEN ep > 0 THEN CASE WHEN xp IS NULL THEN CASE side WHEN 1 THEN -0.2 ELSE -0.3 END ELSE side * (xp / ep - 1) END END AS hr FROM lsheld")


@case("n04_long_short_return", "date:d long_return:6 short_return:6 borrow_cost:8 gross_return:6", """SELECT *, 50.0::DOUBLE / 10000 / 12 * 0.5 AS borrow_cost, (long_return + short_return) / 2 - 50.0::DOUBLE / 10000 / 12 * 0.5 AS gross_return FROM (SELECT date, sum(abs(w) * hr) FILTER (side = 1) / sum(abs(w)) FILTER (side = 1 AND hr IS NOT NULL) AS long_return,
  sum(abs(w) * hr) FILTER (side = -1) / sum(abs(w)) FILTER (side = -1 AND hr IS NOT NULL) AS short_return FROM lsr GROUP BY 1)""")
def _(m):
    book = _long_short(m).drop("weight").withColumnRenamed("signed_weight", "weight")
    return returns.long_short_return(returns.holding_returns(book, m.plan(), m.prices()), keys=["date"])


@case("n05_signed_return", "date:d raw_return:6 short_weight:8 gross_return:6", "SELECT date, sum(w * (xp / ep - 1)) AS raw_return, sum(greatest(-w, 0)) AS short_weight, sum(w * (xp / ep - 1)) - 50.0::DOUBLE / 10000 / 12 * sum(greatest(-w, 0)) AS gross_return FROM lsheld WHERE ep > 0 AND xp IS NOT NULL GROUP BY 1")
def _(m):
    book = _long_short(m).drop("weight").withColumnRenamed("signed_weight", "weight")
    return returns.signed_return(returns.priced(book, m.plan(), m.prices()), keys=["date"])


@case("n06_turnover_cost", "strategy date:d cost:8", "SELECT s.strategy, s.date, 0.001::DOUBLE + coalesce(0.001::DOUBLE + 0.001::DOUBLE * turnover, 0.0015::DOUBLE) AS cost FROM strat s")
def _(m):
    return m.strategy_returns().withColumn("cost", returns.trading_cost(F.col("turnover")))


@case("n07_two_way_cost", "strategy date:d trade_cost:8", "SELECT strategy, date, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY date) = 1 THEN 1 ELSE coalesce(turnover, 0) END * 0.001::DOUBLE * 2 AS trade_cost FROM strat")
def _(m):
    return returns.two_way_cost(m.strategy_returns())


add_cte("ord", """SELECT b.strategy, b.date, b.ticker, b.weight * 1e6 AS trade_value, p.close / 600 AS price, p.close * p.volume AS daily_value, b.volatility_20d / sqrt(252) AS volatility FROM books b ASOF JOIN prices p ON p.ticker = b.ticker AND p.date <= b.date""")
add_cte("ordc", "SELECT *, greatest(trade_value * 0.0005::DOUBLE, 1.0) / trade_value AS commission, CASE WHEN price > 100 THEN 2 WHEN price > 50 THEN 5 WHEN price > 20 THEN 10 ELSE 20 END / 10000.0::DOUBLE AS spread, least(0.1::DOUBLE * sqrt(trade_value / daily_value) * volatility, 0.05) AS impact FROM ord")


@case("n08_order_costs", "strategy date:d ticker commission:8 spread:8 impact:8 total:8 total_bps:4", "SELECT *, commission + spread + impact AS total, (commission + spread + impact) * 10000 AS total_bps FROM ordc")
def _(m):
    q = m.books().join(_quoted(m, ["close", "volume"]), ["ticker", "date"])
    orders = q.select("strategy", "date", "ticker", (F.col("weight") * 1e6).alias("trade_value"), (F.col("close") / 600).alias("price"), (F.col("close") * F.col("volume")).alias("daily_value"), (F.col("volatility_20d") / F.sqrt(F.lit(252.0))).alias("volatility"))
    return returns.order_costs(orders)


@case("n09_net_of_turnover", "strategy date:d net_return:8", "SELECT strategy, date, portfolio_return - turnover * 0.0015::DOUBLE AS net_return FROM strat WHERE turnover IS NOT NULL")
def _(m):
    return returns.net_of_turnover(m.strategy_returns().where("turnover IS NOT NULL"), "portfolio_return")


_P24 = "(PARTITION BY strategy ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
_P30 = "(PARTITION BY strategy ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"
add_cte("scl0", f"""SELECT *, CASE WHEN count(gross_return) OVER {_P24} >= 12 AND stddev_pop(gross_return) OVER {_P24} * sqrt(12) > 0.05 THEN greatest(least(0.15 / (stddev_pop(gross_return) OVER {_P24} * sqrt(12)), 2), 0.25) ELSE 1 END AS vol_scale,
  avg(CASE WHEN gross_return > 0 THEN 1.0 ELSE 0.0 END) OVER {_P30} AS wr, coalesce(avg(CASE WHEN gross_return > 0 THEN gross_return END) OVER {_P30}, 0.02) AS gain, abs(coalesce(avg(CASE WHEN gross_return < 0 THEN gross_return END) OVER {_P30}, 0.02)) AS loss, count(*) OVER {_P30} AS seen,
  CASE WHEN CASE WHEN market_volatility < 1 THEN market_volatility * 100 ELSE market_volatility END > 2.5 THEN 0.5 ELSE 1 END AS risk_off_scale FROM strat""")
add_cte("scl", "SELECT *, CASE WHEN seen >= 24 AND loss > 0 THEN greatest(least((wr - (1 - wr) / (gain / loss)) * 0.25, 0.5), 0.25) ELSE 1 END AS kelly_scale FROM scl0")


def _scaled(m):
    rows = m.strategy_returns()
    return rows.select(
        "*",
        returns.vol_target_scale().alias("vol_scale"),
        returns.kelly_scale(min_periods=24).alias("kelly_scale"),
        returns.risk_off_scale(threshold=2.5).alias("risk_off_scale"),
    )


@case("n10_vol_target", "strategy date:d vol_scale:6", "SELECT * FROM scl")
def _(m):
    return _scaled(m)


@case("n11_kelly_scale", "strategy date:d kelly_scale:6", "SELECT * FROM scl")
def _(m):
    return _scaled(m)


@case("n12_risk_off", "strategy date:d risk_off_scale:2", "SELECT * FROM scl")
def _(m):
    return _scaled(m)


@case("n13_combined_scale", "strategy date:d position_scale:6 scaled_return:6", "SELECT *, gross_return * position_scale AS scaled_return FROM (SELECT *, greatest(least(vol_scale * kelly_scale * risk_off_scale, 1.5), 0.5) AS position_scale FROM scl)")
def _(m):
    rows = _scaled(m).withColumn("position_scale", returns.combined_scale(F.col("vol_scale"), F.col("kelly_scale"), F.col("risk_off_scale")))
    return rows.withColumn("scaled_return", F.col("gross_return") * F.col("position_scale"))


@case("d11_position_scale_summary", "strategy avg_scale:6 min_scale:6 max_scale:6", "SELECT strategy, avg(p) AS avg_scale, min(p) AS min_scale, max(p) AS max_scale FROM (SELECT strategy, greatest(least(vol_scale * kelly_scale * risk_off_scale, 1.5), 0.5) AS p FROM scl) GROUP BY 1")
def _(m):
    p = returns.combined_scale(F.col("vol_scale"), F.col("kelly_scale"), F.col("risk_off_scale"))
    return _scaled(m).groupBy("strategy").agg(F.avg(p).alias("avg_scale"), F.min(p).alias("min_scale"), F.max(p).alias("max_scale"))


@case("n14_benchmark_excess", "strategy date:d spy_return:8 excess:6", "SELECT p.strategy, p.date, spy_return, raw_return - spy_return AS excess FROM pret p JOIN spyret s ON s.date = p.date")
def _(m):
    spy = returns.benchmark_return(m.plan(), m.bench())
    raw = returns.weighted_return(returns.holding_returns(m.books(), m.plan(), m.prices()))
    return raw.join(F.broadcast(spy), "date").withColumn("excess", F.col("raw_return") - F.col("spy_return"))


add_cte("sess", """SELECT b.strategy, b.date, b.ticker, b.weight, p1.adj_close AS ep, CASE WHEN p2.date - x.exit_date <= 7 THEN p2.adj_close END AS xp0, l.adj_close AS latest FROM books b
  JOIN (SELECT date, next_date AS entry_date, CAST(next_date + INTERVAL 30 DAY AS DATE) AS exit_date FROM cal) x ON x.date = b.date ASOF JOIN prices p1 ON p1.ticker = b.ticker AND p1.date >= x.entry_date ASOF LEFT JOIN prices p2 ON p2.ticker = b.ticker AND p2.date >= x.exit_date
  JOIN (SELECT ticker, arg_max(adj_close, date) AS adj_close FROM prices GROUP BY 1) l ON l.ticker = b.ticker WHERE p1.date - x.entry_date <= 7""")


@case("n15_reconcile_sessions", "session_id portfolio_return:6 n_priced:i", "SELECT strategy || '-' || strftime(date, '%Y%m%d') AS session_id, sum(weight * (coalesce(xp0, latest) / ep - 1)) / sum(weight) AS portfolio_return, count(*) AS n_priced FROM sess GROUP BY 1")
def _(m):
    session = F.concat_ws("-", "strategy", F.date_format("date", "yyyyMMdd")).alias("session_id")
    return returns.reconcile(m.books().select(session, "date", "ticker", "weight"), m.prices())


@case("n16_mark_to_market", "strategy date:d value:2", """SELECT s.strategy, p.date, sum(target * p.close) AS value FROM shares s JOIN bookdates d ON d.strategy = s.strategy AND d.date = s.date JOIN prices p ON p.ticker = s.ticker AND p.date >= s.date AND (p.date < d.nxt OR d.nxt IS NULL) GROUP BY 1, 2""")
def _(m):
    held = _first_shares(m)[2].select("strategy", "date", "ticker", F.col("target").alias("shares"))
    return returns.mark_to_market(held, m.prices(), keys=["strategy"])
