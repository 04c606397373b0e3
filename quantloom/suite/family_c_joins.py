"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import panel, returns, universe, weights
from quantloom.operators.asof import asof_backward, asof_forward, sample_at, snapshot_for, trading_calendar
from quantloom.suite.oracle import add_cte
from quantloom.suite.registry import case


@case("c01_asof_fundamentals", "ticker date:d pe_ratio:6 roe:6 known_on:d", """SELECT r.ticker, r.date, pe_ratio, roe, f.date AS known_on FROM (SELECT ticker, date FROM px) r
  ASOF LEFT JOIN fund f ON f.ticker = r.ticker AND f.date <= r.date""")
def _(m):
    return asof_backward(m.month_table().select("ticker", "date"), m.fundamentals(), ["pe_ratio", "roe"], at="known_on")


@case("c02_universe_snapshot", "date:d snapshot_date:d", """SELECT d.date, coalesce(u.snapshot_date, (SELECT min(snapshot_date) FROM uni)) AS snapshot_date FROM (SELECT DISTINCT date FROM prices) d
  ASOF LEFT JOIN (SELECT DISTINCT snapshot_date FROM uni) u ON u.snapshot_date <= d.date""")
def _(m):
    return snapshot_for(m.prices(), m.universe())


@case("c03_price_on_or_after", "ticker date:d px:2 found_on:d", """SELECT r.ticker, r.date, CASE WHEN p.date - r.date <= 7 THEN adj_close END AS px, CASE WHEN p.date - r.date <= 7 THEN p.date END AS found_on
  FROM (SELECT ticker, CAST(date + INTERVAL 1 DAY AS DATE) AS date FROM prices) r ASOF LEFT JOIN prices p ON p.ticker = r.ticker AND p.date >= r.date""")
def _(m):
    p = m.prices()
    asked = p.select("ticker", F.date_add("date", 1).alias("date"))
    return asof_forward(asked, p.select("ticker", "date", F.col("adj_close").alias("px")), ["px"], at="found_on", tolerance_days=7)


@case("c04_last_price_in_window", "ticker entry_date:d exit_date:d last_price:2", """SELECT DISTINCT s.ticker, entry_date, exit_date, CASE WHEN p.date > entry_date THEN close END AS last_price
  FROM (SELECT ticker, entry_date, exit_date FROM books JOIN plan USING (date)) s ASOF LEFT JOIN prices p ON p.ticker = s.ticker AND p.date <= s.exit_date""")
def _(m):
    spans = m.books().join(F.broadcast(m.plan()), "date").select("ticker", "entry_date", "exit_date").distinct()
    return returns.last_in_window(spans, m.prices(), "entry_date", "exit_date")


@case("c05_stock_benchmark_returns", "ticker date:d ret:6 spy_ret:6", "SELECT ticker, date, ret, spy_ret FROM rets LEFT JOIN brets USING (date)")
def _(m):
    return panel.benchmark_joined(m.prices(), m.bench())


@case("c06_next_trading_day", "date:d next_date:d", """SELECT d.date, (SELECT min(c.date) FROM cal c WHERE c.date > d.date) AS next_date FROM
  (SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1) d""")
def _(m):
    days = m.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return returns.next_trading_day(days, m.prices())


@case("c07_predictions_realised", "ticker date:d score:8 future_return:6", "SELECT s.ticker, s.date, s.score, t.future_return FROM scores s LEFT JOIN (SELECT DISTINCT ticker, date, future_return FROM px) t ON t.ticker = s.ticker AND t.date = s.date")
def _(m):
    actual = m.month_table().select("ticker", "date", "future_return").dropDuplicates(["ticker", "date"])
    return m.scores().select("ticker", "date", "score").join(actual, ["ticker", "date"], "left")


add_cte("known", "SELECT ticker, sector FROM meta WHERE market_cap IS NOT NULL")


@case("c08_left_join_default", "ticker date:d beta:6 sector", "SELECT s.ticker, s.date, coalesce(b.beta, 1.0) AS beta, coalesce(k.sector, 'Unknown') AS sector FROM scores s LEFT JOIN betas b ON b.ticker = s.ticker AND b.date = s.date LEFT JOIN known k ON k.ticker = s.ticker")
def _(m):
    beta = panel.trailing_beta(m.prices(), m.bench())
    known = m.meta().where("market_cap IS NOT NULL").select("ticker", "sector")
    rows = m.scores().select("ticker", "date").join(beta, ["ticker", "date"], "left").join(known, "ticker", "left")
    return rows.fillna(1.0, ["beta"]).fillna("Unknown", ["sector"])


@case("c09_sector_lookup", "ticker date:d sector", "SELECT p.ticker, date, sector FROM prices p LEFT JOIN meta g ON g.ticker = p.ticker")
def _(m):
    return m.prices().select("ticker", "date").join(m.meta().select("ticker", "sector"), "ticker", "left")


@case("c10_rebalance_asof", "ticker date:d bar_date:d adj_close:2", """SELECT d.ticker, d.date, p.date AS bar_date, adj_close FROM (SELECT t.ticker, e.date FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN mends e) d
  ASOF JOIN prices p ON p.ticker = d.ticker AND p.date <= d.date""")
def _(m):
    return sample_at(m.prices().select("ticker", "date", "adj_close"), m.month_ends())


@case("c10_rebalance_asof_fresh", "ticker date:d bar_date:d", """SELECT d.ticker, d.date, p.date AS bar_date FROM (SELECT t.ticker, e.date FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN mends e) d
  ASOF JOIN prices p ON p.ticker = d.ticker AND p.date <= d.date WHERE d.date - p.date <= 10""")
def _(m):
    return sample_at(m.prices().select("ticker", "date"), m.month_ends(), max_staleness=10)


@case("c11_holdings_change", "strategy date:d entered:i exited:i", "SELECT * FROM hchange")
def _(m):
    return weights.holdings_change(m.books(), F.lit(10))


@case("c12_weight_alignment", "strategy date:d ticker weight_now:6 weight_before:6", "SELECT * FROM bookdiff WHERE date IS NOT NULL")
def _(m):
    b = m.books()
    return weights.align_weights(b, weights.carried_forward(b), ["strategy", "date"])


@case("c13_picks_entry_exit", "strategy ticker date:d entry_price:2 exit_price:2", "SELECT * FROM held WHERE entry_price IS NOT NULL AND exit_price IS NOT NULL")
def _(m):
    return returns.priced(m.books(), m.plan(), m.prices()).where("entry_price IS NOT NULL AND exit_price IS NOT NULL")


@case("c14_peers", "ticker peer score:i place:i", """SELECT * FROM (SELECT a.ticker, b.ticker AS peer, 100 + CASE WHEN a.industry = b.industry THEN 50 ELSE 0 END + CASE WHEN greatest(a.market_cap, b.market_cap) / least(a.market_cap, b.market_cap) <= 2 AND a.market_cap IS NOT NULL AND b.market_cap IS NOT NULL THEN 30
  WHEN greatest(a.market_cap, b.market_cap) / least(a.market_cap, b.market_cap) <= 5 AND a.market_cap IS NOT NULL AND b.market_cap IS NOT NULL THEN 10 ELSE 0 END AS score, row_number() OVER (PARTITION BY a.ticker ORDER BY score DESC, b.ticker) AS place
  FROM meta a JOIN meta b ON a.sector = b.sector AND a.ticker <> b.ticker) WHERE place <= 3""")
def _(m):
    return universe.peers(m.meta())


@case("c17_priced_only", "ticker date:d pe_ratio:6", "SELECT ticker, date, pe_ratio FROM fund WHERE ticker IN (SELECT ticker FROM prices WHERE date >= DATE '2001-06-01')")
def _(m):
    return m.fundamentals().join(m.prices().where("date >= '2001-06-01'").select("ticker").distinct(), "ticker", "left_semi")


@case("c18_exact_date_only", "ticker date:d return_6m:6", "SELECT x.ticker, x.date, return_6m FROM px x JOIN prices p ON p.ticker = x.ticker AND p.date = x.date")
def _(m):
    return m.month_table().join(m.prices().select("ticker", "date"), ["ticker", "date"], "left_semi")
