"""Equity tables derived by Spark from the star-schema test tables.

Every table is a plain DataFrame query over the given Parquet files, so the work of
any query built on them grows with those files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar, ratio
from quantloom.operators import labels, news, panel, regime, returns, scores, technical, weights
from quantloom.operators.asof import asof_backward, beside, sample_at, trading_calendar
from quantloom.operators.xsection import pct_rank
from quantloom.plans import monthly
from quantloom.session import reliable

# Book sizes of the three demonstration strategies.
BOOKS = {"top05": 5, "top10": 10, "top20": 20}

#: Columns of the written analyses: the verdicts, the scores behind them, and what the thesis levels start from.
VERDICT = [
    *("ticker", "date", "regime", "close", "sma_20", "sma_50", "volatility_annual"),
    *[f"{name}_score" for name in scores.SCORES],
    *("composite_score", "signal", "trend_direction", "data_confidence", "key_strengths", "key_risks"),
]


def ticker_of(key: str) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 9, "0"))


_OPEN: dict[tuple[str, str], "Market"] = {}


class Market:
    """Lazily built views over one data folder."""

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> "Market":
        """One instance per application and folder, so that the written month-end and
        score tables are built once and then shared, like any stored feature table."""
        return _OPEN.setdefault((spark.sparkContext.applicationId, folder.rstrip("/")), cls(spark, folder))

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- inputs -----------------------------------------------------------------

    def prices(self) -> DataFrame:
        """Daily bars: one per supplier and ship day. Lines are combined map-side, so a
        supplier with a large share of all lines does not become a large task."""
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        bars = (
            self.table("lineitem")
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
            .agg(
                F.min(order)["l_extendedprice"].alias("open"),
                F.max("l_extendedprice").alias("high"),
                F.min("l_extendedprice").alias("low"),
                F.max(order)["l_extendedprice"].alias("close"),
                F.sum("l_quantity").cast("long").alias("volume"),
            )
        )
        return bars.select(
            ticker_of("l_suppkey").alias("ticker"), "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume"
        )

    def bench(self) -> DataFrame:
        day = F.to_date("l_shipdate").alias("date")
        level = self.table("lineitem").groupBy(day).agg(F.avg("l_extendedprice").alias("close"))
        return level.select(F.lit("SPY").alias("ticker"), "date", "close", F.col("close").alias("adj_close"))

    def meta(self) -> DataFrame:
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select(
            ticker_of("s_suppkey").alias("ticker"),
            F.col("s_name").alias("company_name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 1e7).alias("market_cap"),
        )

    def fundamentals(self) -> DataFrame:
        """Quarterly ratios, dated at quarter end."""
        revenue = F.col("l_extendedprice")
        q = (
            self.table("lineitem")
            .groupBy("l_suppkey", F.trunc("l_shipdate", "quarter").alias("q"))
            .agg(
                F.avg("l_extendedprice").alias("ap"),
                F.avg("l_quantity").alias("aq"),
                F.avg("l_discount").alias("ad"),
                F.avg("l_tax").alias("at"),
                F.count(F.lit(1)).alias("n"),
                F.sum(revenue).alias("rev"),
                F.sum(revenue * F.col("l_discount")).alias("earn"),
                F.sum(revenue * (F.col("l_discount") - 0.05)).alias("fcf"),
            )
        )
        w = Window.partitionBy("l_suppkey").orderBy("q")
        n = F.col("n")
        r = lambda c: F.round(c + 1.371e-8, 6)  # noqa: E731  (off exact ties)
        return q.select(
            ticker_of("l_suppkey").alias("ticker"),
            F.date_sub(F.add_months("q", 3), 1).alias("date"),
            F.when(n % 7 != 0, r(F.col("ap") / 2000)).alias("pe_ratio"),
            F.when(n % 9 != 0, r(F.col("ap") / 40000)).alias("peg_ratio"),
            r(F.col("aq") / 10).alias("pb_ratio"),
            r(F.col("aq") / 15).alias("ps_ratio"),
            r(F.col("ap") / 4000).alias("ev_to_ebitda"),
            r(F.col("ad") * 3).alias("roe"),
            r(F.col("ad")).alias("roa"),
            r(F.col("at") * 25).alias("debt_to_equity"),
            F.when(n % 8 != 0, r(F.col("ad") * 2)).alias("profit_margin"),
            r(F.col("ad") * 2.5).alias("operating_margin"),
            r(F.col("ad") * 8).alias("gross_margin"),
            r(n / 10).alias("current_ratio"),
            r(n / 15).alias("quick_ratio"),
            r(ratio("rev", F.lag("rev").over(w)) - 1).alias("revenue_growth"),
            r(ratio("earn", F.lag("earn").over(w)) - 1).alias("earnings_growth"),
            F.when(n % 13 == 0, 0.0).otherwise(r(F.col("at"))).alias("dividend_yield"),
            F.when(n % 11 != 0, r(F.col("at") * 12)).alias("payout_ratio"),
            F.when(n % 10 != 0, F.round(F.col("fcf") * 1000, 0).cast("long")).alias("free_cash_flow"),
        )

    def universe(self) -> DataFrame:
        """Quarterly membership: at least 18 bars in the quarter before the snapshot."""
        q = F.add_months(F.trunc("date", "quarter"), 3).alias("snapshot_date")
        return self.prices().groupBy("ticker", q).agg(F.count(F.lit(1)).alias("n")).where("n >= 18").select("snapshot_date", "ticker")

    def membership_changes(self) -> DataFrame:
        """Additions and removals between consecutive snapshots."""
        members = self.universe()
        marks = members.select("snapshot_date").distinct()
        follow = marks.withColumn("nxt", F.lead("snapshot_date").over(Window.orderBy("snapshot_date"))).where("nxt IS NOT NULL")
        before = members.join(F.broadcast(follow), "snapshot_date").select(F.col("nxt").alias("date"), "ticker", F.lit(1).alias("was"))
        after = members.join(F.broadcast(follow.select(F.col("nxt").alias("snapshot_date"))), "snapshot_date").select(
            F.col("snapshot_date").alias("date"), "ticker", F.lit(1).alias("now")
        )
        both = before.join(after, ["date", "ticker"], "full_outer")
        return both.where("was IS NULL OR now IS NULL").select(
            "date",
            F.when(F.col("was").isNull(), F.col("ticker")).alias("added"),
            F.when(F.col("now").isNull(), F.col("ticker")).alias("removed"),
            F.lit("bars per quarter").alias("reason"),
        )

    def news(self) -> DataFrame:
        """Scored articles, one per document: the first line is the headline, longer texts
        count with more confidence."""
        n = self.table("supplier").agg(F.count(F.lit(1)).alias("n_suppliers"))
        rows = self.table("documents").join(self.table("labels"), "doc_id", "left").crossJoin(F.broadcast(n))
        confidence = F.col("n_chars") / (F.col("n_chars") + 2000.0)
        label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
        out = rows.select(
            "doc_id",
            F.concat(F.lit("S"), F.lpad((F.col("doc_id") % F.col("n_suppliers") + 1).cast("string"), 9, "0")).alias("ticker"),
            # spread over three years of the price history
            (F.lit("1997-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(doc_id * 7919 % 26280 as int))")).alias("published_at"),
            F.substring_index("text", "\n", 1).alias("title"),
            "text",
            label.alias("label"),
            confidence.alias("confidence"),
            ((F.col("doc_id") % 10) / 10.0).alias("relevance"),
        )
        signed = F.when(F.col("label") == "positive", F.col("confidence")).when(F.col("label") == "negative", -F.col("confidence")).otherwise(0.0)
        return out.withColumn("sentiment", signed)

    # -- stages -----------------------------------------------------------------

    def returns(self) -> DataFrame:
        return panel.daily_returns(self.prices())

    def bars(self) -> DataFrame:
        return panel.bar_features(self.prices())

    def month_ends(self) -> DataFrame:
        return monthly.month_ends(self.prices())

    def calendar(self) -> DataFrame:
        return trading_calendar(self.prices())

    @cached_property
    def _bar_table(self) -> DataFrame:
        return reliable(self.prices())

    @cached_property
    def _bench_table(self) -> DataFrame:
        return reliable(self.bench())

    def _bars_and_bench(self) -> tuple[DataFrame, DataFrame]:
        """The written bars and benchmark if a plan has them already, so that lines are combined once."""
        known = vars(self)
        return (self._bar_table if "_bar_table" in known else self.prices()), (self._bench_table if "_bench_table" in known else self.bench())

    def month_rows(self) -> DataFrame:
        return monthly.month_end_features(*self._bars_and_bench(), self.meta())

    @cached_property
    def _month_table(self) -> DataFrame:
        return reliable(self.month_rows())

    def month_table(self) -> DataFrame:
        """The month-end rows as a written table, for plans that meet them several times."""
        return self._month_table

    def scores(self) -> DataFrame:
        """Month-end percentile rank of the six-month return: the stand-in for a model score."""
        return self._scores

    @cached_property
    def _scores(self) -> DataFrame:
        # the written month-end rows if a plan has them already, so that bars are built once
        rows = (self.month_table() if "_month_table" in vars(self) else self.month_rows()).select(
            "ticker", "date", "sector", "return_6m", "volatility_20d", "market_volatility", "future_return", "target_excess"
        )
        return reliable(pct_rank(reliable(rows), ["date"], {"return_6m": "score"}))

    def scored_targets(self) -> DataFrame:
        """Scores beside the binary target, for model quality measures."""
        rows = labels.residual_return(labels.smooth_return(self.month_table()))
        rows = labels.binary_target(pct_rank(rows, ["date"], {"future_return_resid": "future_return_resid_rank"}))
        rows = rows.select("ticker", "date", "target_binary", "future_return_resid").where("target_binary IS NOT NULL")
        return rows.join(self.scores().select("ticker", "date", "score"), ["ticker", "date"]).where("score IS NOT NULL").withColumn("year", F.year("date"))

    def books(self) -> DataFrame:
        """Inverse-volatility weighted top-n books of the three strategies."""
        return self._books

    @cached_property
    def _books(self) -> DataFrame:
        ranked = weights.top_n(self.scores(), max(BOOKS.values()), position="place")
        sizes = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(n).alias("slots")) for k, n in BOOKS.items()])
        rows = ranked.withColumn("b", F.explode(sizes)).where("place <= b.slots").select("b.strategy", "b.slots", *ranked.columns)
        return reliable(weights.inverse_vol(rows, keys=["strategy", "date"]))

    def plan(self) -> DataFrame:
        return returns.schedule(self.scores().select("date"), self.calendar())

    def strategy_returns(self) -> DataFrame:
        """Monthly return series of the strategies. The raw returns of the test data are
        log-damped (0.1·ln(1+r)) so that compounded series stay readable."""
        return self._strategy_returns

    @cached_property
    def _strategy_returns(self) -> DataFrame:
        books = self.books()
        plan = self.plan()
        held = returns.holding_returns(books, plan, self.prices())
        raw = returns.weighted_return(held)
        spy = returns.benchmark_return(plan, self.bench())
        change = weights.holdings_change(
            books, F.element_at(F.create_map(*[F.lit(x) for kv in BOOKS.items() for x in kv]), F.col("strategy"))
        )
        vol = self.scores().groupBy("date").agg(F.max("market_volatility").alias("market_volatility"))
        rows = raw.join(F.broadcast(spy), "date").join(F.broadcast(vol), "date").join(
            change.select("strategy", "date", "turnover"), ["strategy", "date"], "left"
        )
        damp = lambda c: F.round(0.1 * F.log(1 + F.col(c)), 6)
        cost = returns.trading_cost(F.col("turnover"))
        series = rows.select(
            "strategy",
            "date",
            F.year("date").alias("year"),
            F.round(damp("raw_return") - cost, 6).alias("gross_return"),
            F.round(damp("raw_return") - 0.04 - cost, 6).alias("portfolio_return"),
            damp("spy_return").alias("spy_return"),
            "turnover",
            "market_volatility",
        )
        return reliable(series.withColumn("excess_return", F.round(F.col("portfolio_return") - F.col("spy_return"), 6)))

    def sector_series(self) -> DataFrame:
        """Daily return series per sector with the benchmark's, damped like the monthly ones."""
        rows = panel.benchmark_joined(self.prices(), self.bench()).join(self.meta().select("ticker", "sector"), "ticker")
        out = rows.groupBy(F.col("sector").alias("strategy"), "date").agg(F.avg("ret").alias("_a"), F.max("spy_ret").alias("_b"))
        out = out.where("_a IS NOT NULL AND _b IS NOT NULL")
        damp = lambda c, shift: F.round(0.02 * F.log(1 + F.col(c)) - shift, 8)
        return out.select("strategy", "date", damp("_a", 0.006).alias("r"), damp("_b", 0.005).alias("b"))

    # -- screening --------------------------------------------------------------

    def macro(self) -> DataFrame:
        """Regime inputs per benchmark date, from a damped benchmark (the test data's own
        volatility is far above any market's)."""
        bench = self._bars_and_bench()[1]
        damped = bench.withColumn("close", 100 * F.pow(F.col("close") / 50000, F.lit(0.08)))
        vix = panel.benchmark_features(bench).select("date", F.round(F.col("market_volatility") * 100 / 12, 6).alias("vix"))
        inputs = regime.regime_inputs(damped, vix)
        rows = inputs.select(
            "date", "vix", F.round(F.col("spy_trend") * 8, 6).alias("spy_trend"), F.round("spy_volatility", 6).alias("spy_volatility")
        )
        return rows.withColumn("regime", regime.six_state())

    def screen_rows(self) -> DataFrame:
        return self._screen_rows

    @cached_property
    def _screen_rows(self) -> DataFrame:
        """One analysis row per (ticker, month end). Levels, momentum and risk share one exchange and sort of the
        bars; the smoothed block, which sorts by blocks, has its own. Both are sampled at month ends
        first, so their join meets a twentieth of the bars. Bars and benchmark are written
        once for all blocks, the scores and the regimes. Every block is dealt out by ticker and joined ``beside`` the others, so
        the wide rows never move; fundamentals, model and company are looked up for bare (ticker, month end) pairs."""
        prices, bench = self._bar_table, self._bench_table
        ends = reliable(monthly.month_ends(prices))
        key = ["ticker", "date"]
        bars = scores.momentum_inputs(technical.level_indicators(prices), along=True)
        rows = sample_at(technical.history_risk(bars, bench, along=True), ends).join(F.broadcast(self.macro()), "date")
        smooth = technical.smoothed_indicators(prices).drop("close")
        rows = beside(rows, sample_at(smooth, ends).drop("bar_date"))
        rows = beside(rows, news.as_of(self.news(), ends), "left")
        model = self.scores().select(
            *key,
            F.col("score").alias("direction_prob"),
            ((F.col("score") - 0.5) * 12).alias("predicted_return"),
            F.abs((F.col("score") - 0.5) * 2).alias("model_confidence"),
        )
        fund = self.fundamentals()
        fields = [c for c in fund.columns if c not in key]
        asked = prices.select("ticker").distinct().crossJoin(F.broadcast(ends.select("date")))
        known = beside(asof_backward(asked, fund, fields, at="fundamentals_date"), model, "left")
        known = known.fillna({"direction_prob": 0.5, "predicted_return": 0.0, "model_confidence": 0.0})
        rows = beside(rows, known.join(self.meta(), "ticker", "left"), "left")
        return reliable(rows)

    def analyses(self) -> DataFrame:
        """Verdicts of the screening rows with the scores and levels they are made of."""
        return self._analyses

    @cached_property
    def _analyses(self) -> DataFrame:
        return reliable(scores.analyse(self.screen_rows()).select(*VERDICT))
