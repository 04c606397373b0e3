"""Portfolio construction: selections and weights per (strategy, date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import clip, ratio
from quantloom.operators.xsection import top_per_group

DATE = ("date",)


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def top_n(scores: DataFrame, n: int, score: str = "score", keys: Sequence[str] = DATE, largest: bool = True, position: str | None = None) -> DataFrame:
    """Best (or worst) n names per date, ties broken by ticker."""
    first = F.col(score).desc_nulls_last() if largest else F.col(score).asc_nulls_last()
    return top_per_group(scores, keys, [first, F.col("ticker")], n, position)


def equal_weight(picks: DataFrame, keys: Sequence[str] = DATE) -> DataFrame:
    return picks.withColumn("weight", 1.0 / F.count(F.lit(1)).over(_over(keys)))


def inverse_vol(picks: DataFrame, vol: str = "volatility_20d", keys: Sequence[str] = DATE, floor: float = 0.10) -> DataFrame:
    """Weights ∝ 1/volatility; missing volatility takes the group median, low ones the floor.
    Works on selected names, so a group has at most top-n rows."""
    w = _over(keys)
    filled = F.coalesce(F.col(vol), F.median(vol).over(w))
    out = picks.withColumn("_inv", 1.0 / clip(filled, floor))
    return out.withColumn("weight", F.col("_inv") / F.sum("_inv").over(w)).drop("_inv")


def _stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group aggregates joined back (whole cross-sections, so no group window)."""
    from quantloom.operators.xsection import group_stats

    return group_stats(df, list(keys), stats)


def continuous_weights(scores: DataFrame, cap: float = 0.05, score: str = "score", keys: Sequence[str] = DATE) -> DataFrame:
    """Long-short weights from population z-scores: gross 2, clipped to ±cap, each side
    then scaled to 1 (which may lift a weight above the cap again)."""
    z = _stats(scores, keys, _m=F.avg(score), _s=F.stddev_pop(score))
    z = z.withColumn("_z", F.coalesce(F.when(F.col("_s") > 0, (F.col(score) - F.col("_m")) / F.col("_s")), F.lit(0.0)))
    g = _stats(z, keys, _gross=F.sum(F.abs("_z")))
    g = g.withColumn("_w", F.when(F.col("_gross") > 0, clip(F.col("_z") / F.col("_gross") * 2, -cap, cap)).otherwise(0.0))
    out = scale_sides(g, "_w", keys)
    return out.drop("_m", "_s", "_z", "_gross", "_w")


def scale_sides(df: DataFrame, raw: str, keys: Sequence[str] = DATE) -> DataFrame:
    """Longs sum to 1 and shorts to -1."""
    s = _stats(df, keys, _long=F.sum(F.when(F.col(raw) > 0, F.col(raw))), _short=F.sum(F.when(F.col(raw) < 0, -F.col(raw))))
    w = (
        F.when((F.col(raw) > 0) & (F.col("_long") > 0), F.col(raw) / F.col("_long"))
        .when((F.col(raw) < 0) & (F.col("_short") > 0), F.col(raw) / F.col("_short"))
        .otherwise(F.col(raw))
    )
    return s.withColumn("weight", w).drop("_long", "_short")


def align_weights(current: DataFrame, prior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both weight vectors on the union of tickers, 0 where absent."""
    a = current.select(*keys, "ticker", F.col("weight").alias("weight_now"))
    b = prior.select(*keys, "ticker", F.col("weight").alias("weight_before"))
    return a.join(b, [*keys, "ticker"], "full_outer").fillna(0.0, ["weight_now", "weight_before"])


def carried_forward(weights: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Each date's weights keyed by the following rebalance date of the strategy."""
    dates = weights.select(*keys, "date").distinct()
    follow = dates.withColumn("_next", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))
    moved = weights.join(follow, [*keys, "date"]).where("_next IS NOT NULL")
    return moved.drop("date").withColumnRenamed("_next", "date")


def weight_turnover(weights: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """½ Σ |Δw| between consecutive rebalances; the first one is 0."""
    both = align_weights(weights, carried_forward(weights, keys), [*keys, "date"])
    first = weights.groupBy(*keys).agg(F.min("date").alias("_first"))
    turn = both.groupBy(*keys, "date").agg((F.sum(F.abs(F.col("weight_now") - F.col("weight_before"))) / 2).alias("turnover"))
    return (
        turn.join(first, list(keys))
        .withColumn("turnover", F.when(F.col("date") == F.col("_first"), 0.0).otherwise(F.col("turnover")))
        .drop("_first")
    )


def holdings_change(weights: DataFrame, slots: str | Column, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Names entered and left since the previous rebalance, and changed / (2·slots).
    NULL turnover on the first rebalance."""
    size = F.col(slots) if isinstance(slots, str) else slots
    both = align_weights(weights, carried_forward(weights, keys), [*keys, "date"])
    first = weights.groupBy(*keys).agg(F.min("date").alias("_first"))
    out = both.groupBy(*keys, "date").agg(
        F.count_if(F.expr("weight_before = 0 AND weight_now <> 0")).alias("entered"),
        F.count_if(F.expr("weight_now = 0 AND weight_before <> 0")).alias("exited"),
    )
    out = out.join(first, list(keys)).where("date > _first").drop("_first")
    return out.withColumn("turnover", (F.col("entered") + F.col("exited")) / (2.0 * size))


def limit_turnover(current: DataFrame, prior: DataFrame, keys: Sequence[str], step: float = 0.05, dust: float = 0.001) -> DataFrame:
    """One turnover-limited move from prior to current weights."""
    both = align_weights(current, prior, keys)
    moved = both.withColumn("_w", F.col("weight_before") + clip(F.col("weight_now") - F.col("weight_before"), -step, step))
    return scale_sides(moved.where(F.abs("_w") > dust), "_w", keys).drop("_w")


def beta_tilt(picks: DataFrame, target: float = 0.0, keys: Sequence[str] = DATE, slope: float = 0.3, band: float = 0.05) -> DataFrame:
    """Tilt weights away from high beta unless the book is within the band already."""
    rows = picks.withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    s = _stats(rows, keys, _book=F.sum(F.col("weight") * F.col("beta")), _mb=F.avg("beta"))
    s = s.withColumn("_adj", F.col("weight") * (1 - slope * (F.col("beta") - F.col("_mb"))))
    g = _stats(s, keys, _gross=F.sum(F.abs("_adj")))
    near = F.abs(F.col("_book") - target) < band
    return g.withColumn("weight_adj", F.when(near, F.col("weight")).otherwise(F.col("_adj") / F.col("_gross"))).drop(
        "_mb", "_adj", "_gross"
    ).withColumnRenamed("_book", "book_beta")


def sector_neutral(picks: DataFrame, score: str = "score", keys: Sequence[str] = DATE) -> DataFrame:
    """Equal budget per sector, shared by score inside; equal shares if scores sum to ≤ 0."""
    rows = picks.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    per_sector = rows.groupBy(*keys, "sector").agg(F.sum(score).alias("_total"), F.count(F.lit(1)).alias("_n"))
    counted = per_sector.withColumn("_sectors", F.count(F.lit(1)).over(_over(keys)))
    out = rows.join(counted, [*keys, "sector"])
    share = F.when(F.col("_total") > 0, F.col(score) / F.col("_total")).otherwise(1.0 / F.col("_n"))
    return out.withColumn("sector_weight", share / F.col("_sectors")).drop("_total", "_n", "_sectors")


def overlay_select(scores: DataFrame, index_list: DataFrame, n: int, forced: int, keys: Sequence[str] = DATE, min_score: float = 5.0) -> DataFrame:
    """Force the top index names (by index rank) with a sufficient score, leave the other
    index names out, fill up with the best of the rest. ``index_list``: ticker,
    index_rank, index_weight — a short fixed list, broadcast."""
    rows = scores.join(F.broadcast(index_list), "ticker", "left").withColumn("is_mega_cap", F.col("index_rank").isNotNull())
    mega = top_per_group(
        rows.where("is_mega_cap").where(F.col("score") >= min_score), keys, [F.col("index_rank"), F.col("ticker")], forced
    )
    used = mega.groupBy(*keys).agg(F.count(F.lit(1)).alias("_used"))
    rest = top_per_group(rows.where("NOT is_mega_cap"), keys, [F.desc("score"), F.col("ticker")], n, "_place")
    rest = rest.join(F.broadcast(used) if list(keys) == ["date"] else used, list(keys), "left")
    rest = rest.where(F.col("_place") <= n - F.coalesce("_used", F.lit(0))).drop("_place", "_used")
    return mega.unionByName(rest)


def overlay_weights(book: DataFrame, n: int, method: str = "hybrid", min_share: float = 0.20, keys: Sequence[str] = DATE) -> DataFrame:
    """Weights of an overlay book: equal, cap_weighted or hybrid (index names share a
    minimum bucket by score × index weight, the others share the rest by score)."""
    w = _over(keys)
    mega = F.col("is_mega_cap")
    n_mega = F.count_if(mega).over(w)
    if method == "equal":
        raw = F.lit(1.0)
    elif method == "cap_weighted":
        slots = F.lit(n) - n_mega
        raw = F.when(mega, F.col("index_weight")).otherwise(F.when(slots > 0, 1.0 / slots).otherwise(0.0))
    elif method == "hybrid":
        own = F.when(mega, F.col("score") * F.col("index_weight")).otherwise(F.col("score"))
        bucket = F.greatest(F.lit(min_share), n_mega / F.lit(float(n)))
        book = book.withColumn("_own", own)
        total = F.sum("_own").over(Window.partitionBy(*keys, "is_mega_cap"))
        raw = ratio("_own", total) * F.when(mega, bucket).otherwise(1.0 - bucket)
    else:
        raise ValueError(f"unknown weight method: {method}")
    out = book.withColumn("_raw", raw)
    return out.withColumn("weight", F.col("_raw") / F.sum("_raw").over(w)).drop("_raw", "_own")


def overlay_summary(book: DataFrame, keys: Sequence[str] = DATE) -> DataFrame:
    mega = F.col("is_mega_cap")
    return book.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_stocks"),
        F.count_if(mega).alias("mega_caps"),
        F.count_if(~mega).alias("other_picks"),
        F.sum(F.when(mega, F.col("weight")).otherwise(0.0)).alias("mega_cap_weight"),
        F.sum(F.when(~mega, F.col("weight")).otherwise(0.0)).alias("other_weight"),
    )


def conviction(scores: DataFrame, gamma: float = 2.0, score: str = "score", keys: Sequence[str] = DATE) -> DataFrame:
    """Min-max to [0, 1], centre, signed power, then standardise (population spread)."""
    r = _stats(scores, keys, _lo=F.min(score), _hi=F.max(score))
    width = F.col("_hi") - F.col("_lo")
    x = F.when(width > 1e-8, (F.col(score) - F.col("_lo")) / width).otherwise(0.5) - 0.5
    r = r.withColumn("_x", F.signum(x) * F.pow(F.abs(x), F.lit(gamma)))
    s = _stats(r, keys, _m=F.avg("_x"), _s=F.stddev_pop("_x"))
    return s.withColumn("conviction", (F.col("_x") - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_lo", "_hi", "_x", "_m", "_s")


def score_capped(scores: DataFrame, n: int, cap: float = 0.05, score: str = "score", keys: Sequence[str] = DATE) -> DataFrame:
    """Top n weighted by score share, capped and scaled back to 1."""
    picks = top_n(scores, n, score, keys)
    w = _over(keys)
    share = picks.withColumn("_w", clip(ratio(score, F.sum(score).over(w)), None, cap))
    return share.withColumn("weight", F.col("_w") / F.sum("_w").over(w)).drop("_w")


def alpha_tilt(scores: DataFrame, n: int, power: float = 2.0, cap: float = 0.05, score: str = "score", keys: Sequence[str] = DATE) -> DataFrame:
    """Top 2n by score, shares of shifted score to a power, capped, best n kept, scaled to 1."""
    picks = top_n(scores, 2 * n, score, keys)
    w = _over(keys)
    shifted = picks.withColumn("_a", F.pow(F.col(score) - F.min(score).over(w) + 0.01, F.lit(power)))
    capped = shifted.withColumn("_w", clip(F.col("_a") / F.sum("_a").over(w), None, cap))
    kept = top_per_group(capped, keys, [F.desc(score), F.col("ticker")], n)
    return kept.withColumn("weight", F.col("_w") / F.sum("_w").over(w)).drop("_a", "_w")


def long_short_book(longs: DataFrame, shorts: DataFrame) -> DataFrame:
    """Half the capital long, half short, as signed weights."""
    a = longs.withColumn("side", F.lit(1)).withColumn("signed_weight", 0.5 * F.col("weight"))
    b = shorts.withColumn("side", F.lit(-1)).withColumn("signed_weight", -0.5 * F.col("weight"))
    return a.unionByName(b)


def target_shares(targets: DataFrame, holdings: DataFrame, prices: DataFrame, value: float, keys: Sequence[str] = DATE) -> DataFrame:
    """Whole shares wanted at the given capital and the order against shares held. ``prices`` has one row per (date, ticker), for all books."""
    priced = targets.join(prices.select("date", "ticker", "price"), ["date", "ticker"]).where("price > 0")
    want = priced.select(*keys, "ticker", "price", F.floor(F.col("weight") * value / F.col("price")).cast("long").alias("target"))
    both = want.join(holdings.select(*keys, "ticker", "shares"), [*keys, "ticker"], "full_outer").fillna(0, ["target", "shares"])
    diff = F.col("target") - F.col("shares")
    return both.withColumn("order_shares", diff).withColumn(
        "action", F.when(diff > 0, "BUY").when(diff < 0, "SELL").otherwise("HOLD")
    )


def aligned_or_fallback(scores: DataFrame, returns: DataFrame, betas: DataFrame, least: int = 10, score: str = "score", keys: Sequence[str] = DATE) -> DataFrame:
    """Names with score, return history and beta. Dates with fewer than ``least`` of
    them fall back to the de-meaned score over its absolute sum."""
    common = scores.join(returns, [*keys, "ticker"]).join(betas, [*keys, "ticker"])
    s = _stats(common, keys, n_names=F.count(F.lit(1)), _m=F.avg(score))
    s = s.withColumn("_d", F.col(score) - F.col("_m"))
    g = _stats(s, keys, _abs=F.sum(F.abs("_d")))
    return g.select(
        *keys,
        "ticker",
        "n_names",
        (F.col("n_names") < least).cast("int").alias("is_fallback"),
        F.when(F.col("n_names") < least, ratio("_d", "_abs")).alias("fallback_weight"),
    )
