"""A: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.functions.columns import by_bar
from quantloom.operators import panel
from quantloom.plans.derived import ticker_of
from quantloom.session import reliable, scratch
from quantloom.sources import tables
from quantloom.suite.oracle import add_cte, w
from quantloom.suite.registry import case

_P = "ticker date:d open:2 high:2 low:2 close:2 adj_close:2 volume:i"
_FUND = "pe_ratio pb_ratio ps_ratio roe roa debt_to_equity profit_margin revenue_growth earnings_growth dividend_yield".split()


@case("a01_scan_prices", _P, "SELECT * FROM prices WHERE date >= DATE '1997-01-01' AND date <= DATE '1999-12-31'")
def _(m):
    return tables.scan(m.prices(), start="1997-01-01", end="1999-12-31").orderBy("ticker", "date")


@case("a02_scan_fundamentals", "ticker date:d " + " ".join(f"{c}:6" for c in _FUND), "SELECT * FROM fund WHERE date >= DATE '1998-01-01'")
def _(m):
    return tables.scan(m.fundamentals(), start="1998-01-01")


@case("a03_scan_meta", "ticker company_name sector industry market_cap:2", "SELECT * FROM meta WHERE sector = 'ASIA'")
def _(m):
    return tables.scan(m.meta(), sector="ASIA")


@case("a04_scan_benchmarks", "ticker date:d close:4 adj_close:4", "SELECT * FROM bench WHERE ticker = 'SPY' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def _(m):
    return tables.scan(m.bench(), ticker="SPY", start="1996-01-01", end="2000-12-31")


@case("a05_scan_features", "ticker date:d return_1m:6 return_6m:6 volatility_20d:6 volume_zscore:6",
      "SELECT * FROM px WHERE date BETWEEN DATE '1998-06-01' AND DATE '2000-05-31'")
def _(m):
    return tables.scan(m.month_rows(), start="1998-06-01", end="2000-05-31")


@case("a06_list_universe", "mode ticker", """SELECT 'day' AS mode, ticker FROM prices WHERE date = DATE '1998-03-02' GROUP BY ticker
  UNION ALL SELECT 'all', ticker FROM meta""")
def _(m):
    day = tables.list_universe(m.prices(), m.meta(), "1998-03-02").withColumn("mode", F.lit("day"))
    return day.unionByName(tables.list_universe(m.prices(), m.meta()).withColumn("mode", F.lit("all")))


@case("a07_table_stats", "table_name n_rows:i n_tickers:i first_date:d last_date:d", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, {d} FROM {t}"
    for n, t, d in [("prices", "prices", "min(date) AS first_date, max(date) AS last_date"), ("benchmarks", "bench", "min(date), max(date)"),
                    ("fundamentals", "fund", "min(date), max(date)"), ("meta", "meta", "NULL::DATE, NULL::DATE")]))
def _(m):
    return tables.table_stats({"prices": m.prices(), "benchmarks": m.bench(), "fundamentals": m.fundamentals(), "meta": m.meta()})


@case("a08_append_ignore_duplicates", "ticker date:d close:2 volume:i", """SELECT ticker, date, close, volume FROM prices WHERE date <= DATE '1999-06-30'
  UNION ALL SELECT ticker, date, arg_min(close, batch), arg_min(volume, batch) FROM (
    SELECT ticker, date, close + 1 AS close, volume, 0 AS batch FROM prices WHERE date >= DATE '1999-01-01'
    UNION ALL SELECT ticker, date, close + 2, volume, 1 FROM prices) WHERE date > DATE '1999-06-30' GROUP BY 1, 2""")
def _(m):
    p = m.prices().select("ticker", "date", "close", "volume")
    target = tables.scan(p, end="1999-06-30")
    first = tables.scan(p, start="1999-01-01").withColumn("close", F.col("close") + 1).withColumn("batch", F.lit(0))
    again = p.withColumn("close", F.col("close") + 2).withColumn("batch", F.lit(1))
    path = scratch(m.spark, "prices")
    tables.append(target.withColumn("batch", F.lit(-1)).withColumn("year", F.year("date")), path, "year")
    tables.merge(first.unionByName(again).withColumn("year", F.year("date")), path, ["ticker", "date"], "year", [F.col("batch")])
    return m.spark.read.parquet(path)


@case("a09_append_benchmarks", "ticker date:d close:4", """SELECT ticker, date, close FROM bench WHERE date <= DATE '1999-06-30'
  UNION ALL SELECT ticker, date, close + 1 FROM bench WHERE date > DATE '1999-06-30'""")
def _(m):
    b = m.bench().select("ticker", "date", "close")
    target = tables.scan(b, end="1999-06-30")
    path = scratch(m.spark, "benchmarks")
    tables.append(target.withColumn("year", F.year("date")), path, "year")
    tables.merge(b.withColumn("close", F.col("close") + 1).withColumn("year", F.year("date")), path, ["ticker", "date"], "year", [F.col("close")])
    return m.spark.read.parquet(path)


@case("a10_upsert_fundamentals", "ticker date:d pe_ratio:6 roe:6", """SELECT ticker, date, pe_ratio, roe FROM fund WHERE date < DATE '1999-01-01'
  UNION ALL SELECT ticker, date, pe_ratio * 2, roe + 1 FROM fund WHERE date >= DATE '1999-01-01'""")
def _(m):
    f = m.fundamentals().select("ticker", "date", "pe_ratio", "roe")
    newer = tables.scan(f, start="1999-01-01").select("ticker", "date", (F.col("pe_ratio") * 2).alias("pe_ratio"), (F.col("roe") + 1).alias("roe"))
    path = scratch(m.spark, "fundamentals")
    tables.append(f.withColumn("year", F.year("date")), path, "year")
    tables.merge(newer.withColumn("year", F.year("date")), path, ["ticker", "date"], "year", [F.col("date")], replace=True)
    return m.spark.read.parquet(path)


@case("a11_overwrite_meta", "ticker sector market_cap:2", "SELECT ticker, sector, coalesce(market_cap, 0) AS market_cap FROM meta")
def _(m):
    path = scratch(m.spark, "meta")
    tables.overwrite(m.meta(), path)
    reliable(tables.read(m.spark, path).fillna(0.0, ["market_cap"]).select("ticker", "sector", "market_cap"))
    tables.overwrite(m.meta().fillna(0.0, ["market_cap"]), path)
    return tables.read(m.spark, path)


add_cte("preds", """SELECT ticker, date AS prediction_date, CAST(date + INTERVAL 30 DAY AS DATE) AS target_date, score AS probability,
  (score - 0.5) / 10 AS predicted_return, future_return AS actual_return, CASE WHEN future_return IS NOT NULL THEN CAST((score > 0.5) = (future_return > 0) AS INTEGER) END AS was_correct FROM scores""")


def _predictions(m):
    s = m.scores()
    right = ((F.col("score") > 0.5) == (F.col("future_return") > 0)).cast("int")
    return s.select("ticker", F.col("date").alias("prediction_date"), F.date_add("date", 30).alias("target_date"), F.col("score").alias("probability"),
                    ((F.col("score") - 0.5) / 10).alias("predicted_return"), F.col("future_return").alias("actual_return"),
                    right.alias("was_correct"), F.lit("rank-1").alias("model_version"))


@case("a12_append_predictions", "ticker prediction_date:d target_date:d probability:8 predicted_return:8 actual_return:6 hit:i model_version",
      "SELECT *, coalesce(was_correct, -1) AS hit, 'rank-1' AS model_version FROM preds")
def _(m):
    p = _predictions(m)
    path = scratch(m.spark, "predictions")
    tables.append(p.where("prediction_date < '2000-01-01'"), path, "prediction_date")
    tables.append(p.where("prediction_date >= '2000-01-01'"), path, "prediction_date")
    return tables.read(m.spark, path).withColumn("hit", F.coalesce("was_correct", F.lit(-1)))


# The five groups used as column groups of the wide table.
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@case("a13_wide_to_long", "ticker date:d adj_close:4 volume:i", """SELECT sector AS ticker, date, avg(adj_close) AS adj_close, sum(volume) AS volume
  FROM prices JOIN meta USING (ticker) GROUP BY 1, 2""")
def _(m):
    rows = m.prices().join(m.meta().select("ticker", "sector"), "ticker")
    wide = rows.groupBy("date").agg(*[
        agg(F.when(F.col("sector") == r, F.col(c))).alias(f"{r}_{t}")
        for r in _REGIONS for agg, c, t in [(F.avg, "adj_close", "Adj Close"), (F.sum, "volume", "Volume")]])
    return tables.wide_to_long(wide, _REGIONS, {"Adj Close": "adj_close", "Volume": "volume"})


@case("a14_vendor_record", "ticker date:d " + " ".join(f"{c}:6" for c in _FUND) + " company_name sector industry market_cap:2",
      "SELECT ticker, date, " + ", ".join(f"nullif({c}, 0) AS {c}" for c in _FUND) + ", company_name, sector, industry, market_cap FROM fund JOIN meta USING (ticker)")
def _(m):
    rows = m.fundamentals().join(m.meta(), "ticker")
    back = {v: k for k, v in tables.VENDOR_FIELDS.items()}
    record = F.to_json(F.struct(F.col("ticker").alias("symbol"), F.col("company_name").alias("longName"), "sector", "industry",
                                F.col("market_cap").alias("marketCap"), *[F.col(c).alias(back[c]) for c in _FUND]))
    return tables.parse_vendor(rows.select("date", record.alias("record")))


@case("a15_read_universe", "snapshot_date:d ticker", "SELECT * FROM uni")
def _(m):
    path = scratch(m.spark, "universe")
    tables.write_universe(m.universe(), path)
    return tables.read_universe(m.spark, path, multi_line=False)[0]


@case("a16_write_universe", "kind snapshot_date ticker", """SELECT 'member' AS kind, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, ticker FROM uni
  UNION ALL SELECT 'removed', '', ticker FROM (SELECT DISTINCT ticker FROM uni) x WHERE ticker NOT IN (SELECT ticker FROM uni WHERE snapshot_date = (SELECT max(snapshot_date) FROM uni))""")
def _(m):
    members = reliable(m.universe())
    path = scratch(m.spark, "universe")
    tables.write_universe(members, path)
    back = m.spark.read.schema(schemas.UNIVERSE_DOCUMENT).json(path).select(F.explode("universe_by_date").alias("snapshot_date", "t"))
    rows = back.select(F.lit("member").alias("kind"), "snapshot_date", F.explode("t").alias("ticker"))
    newest = members.join(F.broadcast(members.agg(F.max("snapshot_date").alias("snapshot_date"))), "snapshot_date", "left_semi")
    gone = members.select("ticker").distinct().join(newest, "ticker", "left_anti")
    return rows.unionByName(gone.select(F.lit("removed").alias("kind"), F.lit("").alias("snapshot_date"), "ticker"))


@case("a17_csv_sinks", "sink key name value:4", """SELECT 'folds' AS sink, strategy || '/' || date AS key, 'portfolio_return' AS name, portfolio_return AS value FROM strat
  UNION ALL SELECT 'years', strategy || '/' || year(date), 'total', sum(portfolio_return) FROM strat GROUP BY 2
  UNION ALL SELECT 'backtest', strategy || '/' || date, 'excess_return', excess_return FROM strat
  UNION ALL SELECT 'picks', strategy || '/' || date || '/' || ticker, 'weight', weight FROM books
  UNION ALL SELECT 'screen', date || '/' || ticker, 'score', score FROM scores WHERE score IS NOT NULL""")
def _(m):
    """The five CSV sinks, each written, read back with its schema and told as long rows."""
    root = scratch(m.spark, "csv")
    series = m.strategy_returns()
    sinks = {
        "folds": (series.select("strategy", "date", "portfolio_return"), ["strategy", "date"]),
        "years": (series.groupBy("strategy", F.year("date").alias("year")).agg(F.sum("portfolio_return").alias("total")), ["strategy", "year"]),
        "backtest": (series.select("strategy", "date", "excess_return"), ["strategy", "date"]),
        "picks": (m.books().select("strategy", "date", "ticker", "weight"), ["strategy", "date", "ticker"]),
        "screen": (m.scores().where("score IS NOT NULL").select("date", "ticker", "score"), ["date", "ticker"]),
    }
    out = None
    for sink, (rows, keys) in sinks.items():
        tables.write_csv(rows, f"{root}/{sink}")
        back = tables.read_csv(m.spark, f"{root}/{sink}", rows.schema)
        name = back.columns[-1]
        part = back.select(F.lit(sink).alias("sink"), F.concat_ws("/", *keys).alias("key"), F.lit(name).alias("name"), F.col(name).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _log_sessions(m):
    """One session per rebalance date and strategy; ids sort by date."""
    root = scratch(m.spark, "sessions")
    picks = m.books().select(F.concat_ws("-", F.date_format("date", "yyyyMMdd"), "strategy").alias("session_id"), "date", "ticker", "weight", "score")
    meta = picks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_picks"), F.max("date").alias("date"))
    tables.log_session(picks, meta, root)
    return root


@case("a18_session_log", "session_id date:d ticker weight:6", "SELECT strftime(date, '%Y%m%d') || '-' || strategy AS session_id, date, ticker, weight FROM books")
def _(m):
    root = _log_sessions(m)
    return m.spark.read.parquet(f"{root}/picks").withColumn("session_id", F.col("session_id").cast("string"))


@case("a19_latest_session", "session_id ticker weight:6 n_sessions:i", """SELECT strftime(date, '%Y%m%d') || '-' || strategy AS session_id, ticker, weight, (SELECT count(*) FROM bookdates) AS n_sessions
  FROM books WHERE strftime(date, '%Y%m%d') || '-' || strategy = (SELECT max(strftime(date, '%Y%m%d') || '-' || strategy) FROM books)""")
def _(m):
    root = _log_sessions(m)
    count = tables.list_sessions(m.spark, root).agg(F.count(F.lit(1)).alias("n_sessions"))
    picks = tables.load_session(m.spark, root)
    return picks.withColumn("session_id", F.col("session_id").cast("string")).crossJoin(F.broadcast(count))


@case("a20_load_summaries", "strategy year:i total:6 months:i", "SELECT strategy, year, sum(portfolio_return) AS total, count(*) AS months FROM strat GROUP BY 1, 2")
def _(m):
    path = scratch(m.spark, "summaries")
    summary = m.strategy_returns().groupBy("strategy", "year").agg(F.sum("portfolio_return").alias("total"), F.count(F.lit(1)).alias("months"))
    summary.write.partitionBy("year").json(path)
    return tables.load_reports(m.spark, path, "strategy string, total double, months long, year int")


@case("a21_interval_bars", "interval ticker:i bar_start:t open:4 high:4 low:4 close:4 volume:i", " UNION ALL ".join(
    f"""SELECT '{name}' AS interval, user_id AS ticker, date_trunc('{unit}', ts) AS bar_start, arg_min(value, (ts, event_id, value)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id, value)) AS close, count(*) AS volume FROM events
  WHERE ts >= (SELECT max(ts) - INTERVAL 365 DAY FROM events) GROUP BY 2, 3""" for name, unit in [("1h", "hour"), ("1d", "day")]))
def _(m):
    ev = m.table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.col("value").alias("price"))
    cut = ev.agg((F.max("ts") - F.expr("interval 365 days")).alias("cut"))
    ev = ev.crossJoin(F.broadcast(cut)).where("ts >= cut")
    hour = tables.interval_bars(ev, "1 hour", key="user_id").withColumn("interval", F.lit("1h"))
    return hour.unionByName(tables.interval_bars(ev, "1 day", key="user_id").withColumn("interval", F.lit("1d")))


@case("a22_source_priority", "ticker date:d pe_ratio:6 source_priority:i", """SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date,
  coalesce(a.pe_ratio, b.pe_ratio) AS pe_ratio, CASE WHEN a.pe_ratio IS NULL THEN 1 ELSE 0 END AS source_priority FROM
  (SELECT ticker, date, pe_ratio FROM fund WHERE pe_ratio > 25) a FULL JOIN (SELECT ticker, date, ev_to_ebitda * 2 AS pe_ratio FROM fund) b ON a.ticker = b.ticker AND a.date = b.date""")
def _(m):
    f = m.fundamentals()
    main = f.select("ticker", "date", F.when(F.col("pe_ratio") > 25, F.col("pe_ratio")).alias("pe_ratio"))
    backup = f.select("ticker", "date", (F.col("ev_to_ebitda") * 2).alias("pe_ratio"))
    return tables.first_valid([main, backup], ["ticker", "date"], F.col("pe_ratio").isNotNull())


@case("a23_scan_with_warmup", "ticker date:d sma_50:4", f"""SELECT ticker, date, sma_50 FROM (SELECT ticker, date, avg(adj_close) OVER {w(50)} AS sma_50 FROM prices
  WHERE date >= DATE '1999-01-01' - 365 AND date <= DATE '1999-12-31') WHERE date >= DATE '1999-01-01'""")
def _(m):
    from quantloom.functions.columns import trailing

    rows = tables.with_warmup(m.prices(), "1999-01-01", "1999-12-31")
    return tables.trim(rows.select("ticker", "date", F.avg("adj_close").over(trailing(50)).alias("sma_50")), "1999-01-01")


@case("a24_latest_quotes", _P, """SELECT p.* FROM prices p JOIN (SELECT ticker, max(date) AS date FROM prices GROUP BY 1) l ON l.ticker = p.ticker AND l.date = p.date
  WHERE p.ticker IN (SELECT ticker FROM meta WHERE market_cap > 0)""")
def _(m):
    wanted = m.meta().where("market_cap > 0").select("ticker").unionByName(m.spark.range(1).select(F.lit("NOSUCH").alias("ticker")))
    return tables.latest_quotes(m.prices(), wanted)
