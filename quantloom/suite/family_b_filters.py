"""B: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar
from quantloom.operators import panel, universe
from quantloom.sources.tables import BENCHMARK_TICKERS
from quantloom.suite.oracle import add_cte
from quantloom.suite.registry import case

_W = "(PARTITION BY ticker ORDER BY date)"


@case("b01_clean_ticker", "ticker", """SELECT upper(trim(t)) AS ticker FROM (SELECT '  ' || lower(ticker) || ' ' AS t FROM meta UNION ALL SELECT company_name FROM meta UNION ALL SELECT '   ' FROM meta)
  WHERE length(trim(t)) BETWEEN 1 AND 10""")
def _(m):
    meta = m.meta()
    raw = meta.select(F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")).alias("ticker")).unionByName(
        meta.select(F.col("company_name").alias("ticker"))).unionByName(meta.select(F.lit("   ").alias("ticker")))
    return universe.clean_tickers(raw)


# share classes written with a dot or a dash, by nation
add_cte("classes", "SELECT ticker || CASE WHEN industry < 'NATION_15' THEN '.B' ELSE '-B' END AS ticker, 'X' || substr(ticker, 2) AS alias FROM meta")
add_cte("variants", """SELECT ticker, ticker AS variant FROM classes UNION SELECT ticker, replace(ticker, '.', '-') FROM classes
  UNION SELECT ticker, replace(ticker, '-', '.') FROM classes UNION SELECT ticker, alias FROM classes""")


def _classes(m):
    tail = F.when(F.col("industry") < "NATION_15", ".B").otherwise("-B")
    return m.meta().select(F.concat("ticker", tail).alias("ticker"), F.concat(F.lit("X"), F.substring("ticker", 2, 20)).alias("alias"))


@case("b02_ticker_variants", "ticker variant", "SELECT * FROM variants")
def _(m):
    c = _classes(m)
    return universe.with_variants(c.select("ticker"), c)


@case("b03_canonical_alias", "ticker company_name", "SELECT coalesce(x.main, g.ticker) AS ticker, company_name FROM meta g LEFT JOIN (SELECT ticker AS alias, min(ticker) OVER (PARTITION BY industry) AS main FROM meta WHERE sector = 'ASIA') x ON x.alias = g.ticker")
def _(m):
    meta = m.meta()
    asia = meta.where("sector = 'ASIA'")
    table = asia.select(F.col("ticker").alias("alias"), "industry").join(asia.groupBy("industry").agg(F.min("ticker").alias("main")), "industry")
    return universe.canonical(meta, table)


add_cte("renames", """SELECT date, min(added) AS added, min(removed) AS removed, CASE month(date) WHEN 1 THEN 'Ticker change after spin-off' WHEN 4 THEN 'Company RENAMED' ELSE 'Market cap' END AS reason
  FROM changes GROUP BY date""")


def _renames(m):
    reason = F.when(F.month("date") == 1, "Ticker change after spin-off").when(F.month("date") == 4, "Company RENAMED").otherwise("Market cap")
    one = m.membership_changes().groupBy("date").agg(F.min("added").alias("added"), F.min("removed").alias("removed"))
    return one.withColumn("reason", reason)


@case("b04_alias_table", "ticker alias", """SELECT added AS ticker, removed AS alias FROM renames WHERE reason <> 'Market cap' AND added IS NOT NULL AND removed IS NOT NULL
  UNION SELECT removed, added FROM renames WHERE reason <> 'Market cap' AND added IS NOT NULL AND removed IS NOT NULL""")
def _(m):
    return universe.alias_table(_renames(m))


@case("b05_available_columns", "ticker date:d return_6m:6 volatility_20d:6 pe_ratio:6", "SELECT ticker, date, return_6m, volatility_20d, 0.0 AS pe_ratio FROM px")
def _(m):
    wanted = ["ticker", "date", "return_6m", "volatility_20d", "pe_ratio"]
    rows = m.month_table()
    return panel.require(panel.require(rows, wanted), wanted, fill=True)


# Columns that must not reach a model.
LEAKS = ["target_binary", "target_excess", "future_return", "future_return_2m", "future_return_rank", "spy_return"]


@case("b06_drop_leak_columns", "ticker date:d return_6m:6 n_columns:i", "SELECT ticker, date, return_6m, 0 AS n_columns FROM px")
def _(m):
    rows = m.month_table().drop(*LEAKS)
    return rows.withColumn("n_columns", F.lit(len(set(LEAKS) & set(rows.columns))))


@case("b07_drop_or_fill_missing", "mode ticker date:d return_12m:6 future_return:6", """SELECT 'train' AS mode, ticker, date, return_12m, future_return FROM px WHERE return_12m IS NOT NULL AND future_return IS NOT NULL
  UNION ALL SELECT 'live', ticker, date, coalesce(return_12m, 0), coalesce(future_return, 0) FROM px""")
def _(m):
    rows = m.month_table().select("ticker", "date", "return_12m", "future_return")
    train = rows.dropna(subset=["return_12m", "future_return"]).withColumn("mode", F.lit("train"))
    return train.unionByName(rows.fillna(0.0, ["return_12m", "future_return"]).withColumn("mode", F.lit("live")))


@case("b08_minimum_history", "ticker date:d has_252:i has_100:i has_60:i has_30:i", f"""SELECT ticker, date, CAST(n >= 252 AS INT) AS has_252, CAST(n >= 100 AS INT) AS has_100,
  CAST(n >= 60 AS INT) AS has_60, CAST(n >= 30 AS INT) AS has_30 FROM (SELECT ticker, date, row_number() OVER {_W} AS n FROM prices)""")
def _(m):
    n = m.prices().select("ticker", "date", F.row_number().over(by_bar()).alias("n"))
    return n.select("ticker", "date", *[(F.col("n") >= k).cast("int").alias(f"has_{k}") for k in (252, 100, 60, 30)])


add_cte("snapof", "SELECT d.date, coalesce(u.snapshot_date, (SELECT min(snapshot_date) FROM uni)) AS snapshot_date FROM (SELECT DISTINCT date FROM px) d ASOF LEFT JOIN (SELECT DISTINCT snapshot_date FROM uni) u ON u.snapshot_date <= d.date")


@case("b09_universe_filter", "ticker date:d return_6m:6", "SELECT p.ticker, p.date, return_6m FROM px p JOIN snapof s ON s.date = p.date JOIN uni u ON u.snapshot_date = s.snapshot_date AND u.ticker = p.ticker")
def _(m):
    return universe.members_only(m.month_table().select("ticker", "date", "return_6m"), m.universe())


@case("b13_exchange", "c_custkey:i exchange", """SELECT c_custkey, exchange FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'NASDAQ' WHEN 'AUTOMOBILE' THEN 'NYSE' WHEN 'MACHINERY' THEN 'AMEX' ELSE upper(c_mktsegment) END AS exchange FROM customer)
  WHERE exchange IN ('NASDAQ', 'NYSE', 'AMEX')""")
def _(m):
    seg = F.col("c_mktsegment")
    code = F.when(seg == "BUILDING", "nms").when(seg == "AUTOMOBILE", "NYQ").when(seg == "MACHINERY", "ase").otherwise(seg)
    return m.table("customer").select("c_custkey", universe.exchange_name(code).alias("exchange")).where(F.col("exchange").isin(list(universe.EXCHANGES)))


@case("b14_liquidity", "ticker date:d volume:i market_cap:2", "SELECT p.ticker, date, volume * 20000 AS volume, market_cap FROM prices p JOIN meta g ON g.ticker = p.ticker WHERE market_cap >= 1e9 AND volume * 20000 >= 500000")
def _(m):
    rows = m.prices().select("ticker", "date", (F.col("volume") * 20000).alias("volume")).join(m.meta().select("ticker", "market_cap"), "ticker")
    return universe.liquid(rows)


add_cte("lastdays", "SELECT date FROM (SELECT DISTINCT date FROM rets) ORDER BY date DESC LIMIT 252")
add_cte("enough", """SELECT k.ticker, d.date, coalesce(r.ret, 0) AS ret FROM (SELECT ticker FROM rets WHERE date IN (SELECT date FROM lastdays) AND ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 252 * 0.2) k
  CROSS JOIN lastdays d LEFT JOIN rets r ON r.ticker = k.ticker AND r.date = d.date""")


@case("b15_enough_returns", "ticker date:d ret:6", "SELECT * FROM enough")
def _(m):
    return universe.enough_returns(m.returns(), missing_share=0.8)


@case("b16_exclude_benchmarks", "ticker n:i", "SELECT ticker, count(*) AS n FROM prices GROUP BY 1")
def _(m):
    both = m.prices().select("ticker").unionByName(m.bench().select("ticker"))
    return both.where(~F.col("ticker").isin(BENCHMARK_TICKERS)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


_top50 = "SELECT ticker, market_cap FROM meta ORDER BY market_cap DESC NULLS LAST, ticker LIMIT 50"


@case("b17_named_universe", "name ticker market_cap:2", f"SELECT 'EUROPE' AS name, ticker, market_cap FROM meta WHERE sector = 'EUROPE' UNION ALL SELECT 'top_50', * FROM ({_top50}) UNION ALL SELECT 'NOSUCH', * FROM ({_top50})")
def _(m):
    meta = m.meta()
    parts = [universe.named_universe(meta, n).select(F.lit(n).alias("name"), "ticker", "market_cap") for n in ("EUROPE", "top_50", "NOSUCH")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
