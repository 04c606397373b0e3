"""News sentiment. A ticker may own a large share of all articles, so recency ranks are
built from hourly counts and ranks inside the hour, and everything else is a plain
aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.xsection import top_per_group

DECAY = 0.1


def explode_feed(feed: DataFrame) -> DataFrame:
    """Vendor articles with a ticker list to ticker-level items, labelled at ±0.15."""
    s = F.col("t.ticker_sentiment_score")
    label = F.when(s > 0.15, "positive").when(s < -0.15, "negative").otherwise("neutral")
    return feed.withColumn("t", F.explode("ticker_sentiment")).select(
        "doc_id",
        F.col("t.ticker").alias("ticker"),
        "published_at",
        "title",
        s.alias("sentiment"),
        label.alias("label"),
        F.abs(s).alias("confidence"),
        F.col("t.relevance_score").alias("relevance"),
    )


def class_scores(df: DataFrame, label: str = "label", score: str = "confidence") -> DataFrame:
    """Class label and probability to a signed value and class masses."""
    lab, c = F.lower(F.col(label)), F.col(score)
    up, down = lab == "positive", lab == "negative"
    return df.select(
        "*",
        F.when(up, c).when(down, -c).otherwise(0.0).alias("signed"),
        F.when(up, c).otherwise(0.0).alias("mass_positive"),
        F.when(down, c).otherwise(0.0).alias("mass_negative"),
        F.when(up | down, 1.0 - c).otherwise(c).alias("mass_neutral"),
    )


def recency_rank(items: DataFrame, tie: str = "doc_id", key: str = "ticker", ts: str = "published_at") -> DataFrame:
    """0-based rank of each article of its ticker, newest first, and the ticker's count."""
    rows = items.withColumn("_hour", F.date_trunc("hour", ts))
    hours = rows.groupBy(key, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy(key).orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, 0)
    offsets = hours.select(
        key, "_hour", (F.sum("_n").over(newer) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("n_items")
    )
    inside = Window.partitionBy(key, "_hour").orderBy(F.desc(ts), tie)
    ranked = rows.withColumn("_k", F.row_number().over(inside) - 1).join(offsets, [key, "_hour"])
    return ranked.withColumn("recency", F.col("_before") + F.col("_k")).drop("_hour", "_k", "_before")


def aggregate(items: DataFrame, by_relevance: bool = False, key: str = "ticker", tie: str = "doc_id") -> DataFrame:
    """Weighted sentiment, ratios, headline, trend and confidence per ticker."""
    ranked = recency_rank(items, tie, key)
    weight = F.exp(-DECAY * F.col("recency"))
    if by_relevance:
        weight = weight * (1 + F.coalesce("relevance", F.lit(0.5)))
    rows = ranked.withColumn("_w", weight)
    newer = F.col("recency") < F.floor(F.col("n_items") / 2)
    share = lambda name: F.avg((F.col("label") == name).cast("double")).alias(f"{name}_ratio")
    mean_confidence = F.sum(F.col("_w") * F.col("confidence")) / F.sum("_w") if by_relevance else F.avg("confidence")
    out = rows.groupBy(key).agg(
        (F.sum(F.col("_w") * F.col("sentiment")) / F.sum("_w")).alias("sentiment_score"),
        share("positive"),
        share("negative"),
        share("neutral"),
        F.count(F.lit(1)).alias("article_count"),
        F.max_by("title", F.struct("published_at", -F.col(tie))).alias("latest_headline"),
        mean_confidence.alias("confidence"),
        F.avg(F.when(newer, F.col("sentiment"))).alias("_new"),
        F.avg(F.when(~newer, F.col("sentiment"))).alias("_old"),
    )
    gap = F.round(F.col("_new") - F.col("_old"), 9)
    trend = (
        F.when((F.col("article_count") >= 4) & (gap > 0.1), "improving")
        .when((F.col("article_count") >= 4) & (gap < -0.1), "deteriorating")
        .otherwise("stable")
    )
    return out.withColumn("trend", trend).drop("_new", "_old")


def as_of(items: DataFrame, ends: DataFrame, days_back: int = 365, tie: str = "doc_id") -> DataFrame:
    """Sentiment per ticker and date of ``ends`` from the articles of the ``days_back`` days up to it.

    An article is dealt to the month ends it can count for by month number (an equal
    join with the calendar), so no article dated after a row reaches it.
    """
    months = F.sequence(F.trunc("published_at", "MM"), F.add_months(F.trunc("published_at", "MM"), days_back // 28 + 1), F.expr("interval 1 month"))
    calendar = ends.select(F.col("date"), F.trunc("date", "MM").alias("_month")).distinct()
    day = F.col("published_at").cast("date")
    seen = items.withColumn("_month", F.explode(months)).join(F.broadcast(calendar), "_month").where((day <= F.col("date")) & (day > F.date_sub("date", days_back)))
    keyed = seen.withColumn("_key", F.struct("ticker", "date")).drop("ticker", "date", "_month")
    out = aggregate(keyed, key="_key", tie=tie)
    return out.select("_key.ticker", "_key.date", *[c for c in out.columns if c != "_key"])


def with_default(universe: DataFrame, sentiment: DataFrame, key: str = "ticker") -> DataFrame:
    """Neutral sentiment for tickers without news."""
    fields = {
        "sentiment_score": 0.0,
        "positive_ratio": 0.33,
        "negative_ratio": 0.33,
        "neutral_ratio": 0.34,
        "article_count": 0,
        "confidence": 0.0,
        "trend": "stable",
    }
    return universe.select(key).distinct().join(sentiment, key, "left").fillna(fields)


def recent_items(items: DataFrame, as_of: DataFrame, days_back: int = 7, cap: int = 50, names: DataFrame | None = None) -> DataFrame:
    """The newest ``cap`` articles per ticker of the last days. With ``names`` an article
    counts when its text mentions the ticker or the company; items are keyed by ticker
    already, so this is a filter on the joined row."""
    rows = items.crossJoin(F.broadcast(as_of.select(F.max("as_of").alias("_now"))))
    rows = rows.where((F.col("published_at") > F.col("_now") - F.make_dt_interval(F.lit(days_back))) & (F.col("published_at") <= F.col("_now")))
    if names is not None:
        rows = rows.join(names.select("ticker", "company_name"), "ticker").where(
            F.lower("text").contains(F.lower("ticker")) | F.lower("text").contains(F.lower("company_name"))
        )
    return top_per_group(rows.drop("_now"), ["ticker"], [F.desc("published_at"), F.col("doc_id")], cap)
