"""Factor exposures, residual returns, volatility and beta as of every rebalance date.

The look-backs of neighbouring rebalance dates overlap almost wholly. The calendar is cut into blocks of one look-back's
length, so a look-back is the end of one block and the beginning of the next. Centred moments run forwards and
backwards inside the blocks; a look-back merges two of them, whatever its length. A bar is visited once in either
direction, and what is repeated per look-back are two rows a ticker.

Compounded returns over the newest bars come from running sums of log growth, kept at the newest
and before the oldest bar of a piece; a total loss (growth of zero or less) is counted apart.

Defined results: a rebalance date that is no trading date takes the last one before it, one before all
trading dates has no rows; repeated and null rebalance dates count once and not at all; a ticker without ``least`` pairs in the
look-back has no row; days up to the first rebalance date have no residual.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.functions.columns import clip
from quantloom.operators.factors import STYLE_COEFFICIENTS
from quantloom.operators.xsection import join_calendar, numbered, rank_table, zscore
from quantloom.session import reliable, spread

_YEAR = math.sqrt(252)


class Pieces(NamedTuple):
    """days: (date, piece); parts: (piece, as_of). ``axis``: (date, block, closed, opened, all), each trading date with its block and the
    number of look-backs that end before it, begin before it and exist; ``spans``: (k, as_of, home), the look-backs numbered
    in date order with the block of their last date. All are bounded by the calendar."""

    days: DataFrame
    parts: DataFrame
    axis: DataFrame
    spans: DataFrame


def pieces(returns: DataFrame, as_of: DataFrame, lookback: int) -> Pieces:
    """Cut the trading calendar where a look-back of ``as_of`` (column date) begins or ends."""
    days = returns.select("date").where("date IS NOT NULL").distinct()
    marks = as_of.select("date").where("date IS NOT NULL").distinct()
    along = Window.partitionBy(F.lit(0)).orderBy("date", "mark")  # calendar rows only
    line = days.select("date", F.lit(0).alias("mark")).unionByName(marks.select("date", F.lit(1).alias("mark")))
    line = reliable(line.select("date", "mark", F.sum(1 - F.col("mark")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("t")))
    ends = line.where("mark = 1 AND t > 0").select(F.col("date").alias("as_of"), F.col("t").alias("last"), F.greatest(F.col("t") - lookback, F.lit(0)).alias("before"))
    cuts = ends.select(F.explode(F.array("last", "before")).alias("t")).distinct()
    steps = line.where("mark = 0").select("t", "date", F.lit(0).alias("cut")).unionByName(cuts.select("t", F.lit(None).cast("date").alias("date"), F.lit(1).alias("cut")))
    # a cut at t ends the piece that holds t
    seen = Window.partitionBy(F.lit(0)).orderBy("t", "cut").rowsBetween(Window.unboundedPreceding, 0)
    numbered = reliable(steps.select("t", "date", "cut", F.sum("cut").over(seen).alias("piece")))
    cut = numbered.where("cut = 1").select("t", "piece")
    spans = ends.join(cut.select(F.col("t").alias("last"), F.col("piece").alias("high")), "last").join(
        cut.select(F.col("t").alias("before"), F.col("piece").alias("low")), "before")
    # cut number p closes piece p - 1: the look-back holds the pieces from its opening cut to the one before its closing cut
    parts = spans.select("as_of", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("piece"))
    block = F.floor((F.col("t") - 1) / lookback)
    events = line.where("mark = 0").select("t", "date", F.lit(0).alias("at"), F.lit(0).alias("closes"), F.lit(0).alias("opens"))
    for c, closes in (("last", 1), ("before", 0)):
        events = events.unionByName(ends.select(F.col(c).alias("t"), F.lit(None).cast("date").alias("date"), F.lit(1).alias("at"), F.lit(closes).alias("closes"), F.lit(1 - closes).alias("opens")))
    so_far = Window.partitionBy(F.lit(0)).orderBy("t", "at").rowsBetween(Window.unboundedPreceding, 0)
    events = events.select("date", "at", block.alias("block"), F.sum("closes").over(so_far).alias("closed"), F.sum("opens").over(so_far).alias("opened"), F.sum("closes").over(Window.partitionBy(F.lit(0))).alias("all"))
    spans = ends.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("last", "as_of")).alias("k"), "as_of", F.floor((F.col("last") - 1) / lookback).alias("home"))
    return Pieces(numbered.where("cut = 0").select("date", "piece"), reliable(parts), reliable(events.where("at = 0").drop("at")), reliable(spans))


def _running_moments(name: str, w: WindowSpec) -> list[Column]:
    """Count, means, centred sums and total of the bars of a growing frame."""
    n = F.count(F.lit(1)).over(w).cast("double")
    parts = {"n": n, "mx": F.avg("ret").over(w), "my": F.avg("_y").over(w), "xx": F.var_pop("ret").over(w) * n, "xy": F.covar_pop("ret", "_y").over(w) * n, "total": F.sum(F.abs("ret")).over(w)}
    return [c.alias(f"{name}_{k}") for k, c in parts.items()]


def lookback_moments(rows: DataFrame, cut: Pieces, other: str = "spy_ret", recent: tuple[int, ...] = ()) -> DataFrame:
    """(ticker, as_of, n, xx, xy, total, grown_..): moments of ``ret`` against ``other`` in every look-back.

    rows: (ticker, date, ret, other) without nulls, one per ticker and date. For each b of ``recent``, ``log_b`` and ``lost_b`` are log
    growth and total losses of the bars from the oldest of the look-back up to the b-th newest, excluding the b newest;
    ``from_b`` and ``fell_b`` are those of the b newest. b may exceed the look-back's bars.
    """
    alive = F.col("ret") > -1
    bars = spread(join_calendar(rows.select("ticker", "date", "ret", F.col(other).alias("_y")), cut.axis, how="inner"))
    bars = bars.withColumn("_g", F.when(alive, F.log1p("ret")).otherwise(0.0)).withColumn("_d", F.when(alive, 0).otherwise(1))
    inside = Window.partitionBy("ticker", "block")
    bars = bars.select("*", *_running_moments("back", inside.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)))
    bars = bars.select("*", *_running_moments("fore", inside.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    # by (block, date), which is the date order, so that these windows share the sort of the blocks
    w = Window.partitionBy("ticker").orderBy("block", "date")
    grown = w.rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.select("*", F.row_number().over(w).alias("_i"), F.sum("_g").over(grown).alias("_l"), F.sum("_d").over(grown).alias("_z"),
                       F.coalesce(F.lead("closed").over(w), "all").alias("_next"), F.coalesce(F.lag("opened").over(w), F.lit(0)).alias("_prior"))
    tail = [F.coalesce(F.lag(c, b).over(w), F.lit(0)).cast(kind).alias(f"_{c[1]}{b}") for b in recent for c, kind in (("_l", "double"), ("_z", "long"))]
    bars = bars.select("*", *tail, (F.col("_l") - F.col("_g")).alias("_l_before"), (F.col("_z") - F.col("_d")).alias("_z_before"))
    # a bar is the newest of the look-backs that end from it up to the next bar, and the oldest of those that begin from the last bar up to it
    none = F.array().cast("array<long>")
    newest = F.when(F.col("_next") > F.col("closed"), F.sequence(F.col("closed") + 1, F.col("_next"), F.lit(1).cast("long"))).otherwise(none)
    oldest = F.when(F.col("opened") > F.col("_prior"), F.sequence(-F.col("_prior") - 1, -F.col("opened"), F.lit(-1).cast("long"))).otherwise(none)
    moments = ("n", "mx", "my", "xx", "xy", "total")
    ends = {"new": ["_i", "_l", "_z", "block", *[f"_{c}{b}" for b in recent for c in "lz"], *[f"fore_{c}" for c in moments]],
            "old": ["_i", "_l_before", "_z_before", "block", *[f"back_{c}" for c in moments]]}
    marked = bars.withColumn("_k", F.explode(F.concat(newest, oldest)))
    held = {"new": F.col("_k") > 0, "old": F.col("_k") < 0}
    seen = marked.groupBy("ticker", F.abs("_k").alias("k")).agg(*[F.max(F.when(held[e], F.col(c))).alias(f"{e}{c if c[0] == '_' else '_' + c}") for e, cs in ends.items() for c in cs])
    seen = join_calendar(seen.where("new_i >= old_i"), cut.spans, "k", "inner")
    fore, back = F.col("new_block") == F.col("home"), F.col("old_block") < F.col("home")
    a = {c: F.when(fore, F.col(f"new_fore_{c}")).otherwise(0.0) for c in moments}
    b_ = {c: F.when(back, F.col(f"old_back_{c}")).otherwise(0.0) for c in moments}
    seen = seen.select("*", *[x[c].alias(f"{name}_{c}") for name, x in (("a", a), ("b", b_)) for c in moments])
    # centred sums of two parts, so no large sums cancel
    dx, dy = F.col("b_mx") - F.col("a_mx"), F.col("b_my") - F.col("a_my")
    weight = F.col("a_n") * F.col("b_n") / (F.col("a_n") + F.col("b_n"))
    n = F.col("new_i") - F.col("old_i") + 1
    out = [n.cast("long").alias("n"), (F.col("a_xx") + F.col("b_xx") + dx * dx * weight).alias("xx"),
           (F.col("a_xy") + F.col("b_xy") + dx * dy * weight).alias("xy"), (F.col("a_total") + F.col("b_total")).alias("total")]
    old_l, old_z = F.col("old_l_before"), F.col("old_z_before")
    for b in recent:
        base_l, base_z = F.when(n > b, F.col(f"new_l{b}")).otherwise(old_l), F.when(n > b, F.col(f"new_z{b}")).otherwise(old_z)
        out += [(base_l - old_l).alias(f"log_{b}"), (base_z - old_z).alias(f"lost_{b}"),
                (F.col("new_l") - base_l).alias(f"from_{b}"), (F.col("new_z") - base_z).alias(f"fell_{b}")]
    return seen.select("ticker", "as_of", *out)


def _growth(log_sum: Column, losses: Column) -> Column:
    return F.when(losses > 0, -1.0).otherwise(F.expm1(log_sum))


def _with_market(returns: DataFrame, market: DataFrame) -> DataFrame:
    rows = returns.where("ret IS NOT NULL").select("ticker", "date", "ret")
    return join_calendar(rows, market.where("spy_ret IS NOT NULL").select("date", "spy_ret"), how="inner")


def _market_variance(market: DataFrame, cut: Pieces) -> DataFrame:
    days = join_calendar(market.select("date", "spy_ret"), cut.days, how="inner")
    return join_calendar(days, cut.parts, "piece", "inner").groupBy("as_of").agg(F.var_samp("spy_ret").alias("market_var"))


def _beta(enough: Column) -> Column:
    cov = F.col("xy") / (F.col("n") - 1)
    return F.when(enough & (F.col("market_var") > 0), clip(cov / F.col("market_var"), 0.2, 3.0)).otherwise(1.0)


def exposures_at(returns: DataFrame, market: DataFrame, sectors: DataFrame, as_of: DataFrame, lookback: int = 252, least: int = 60) -> DataFrame:
    """``factors.exposures`` for every date of ``as_of``, with the column as_of in front."""
    cut = pieces(returns, as_of, lookback)
    seen = lookback_moments(_with_market(returns, market), cut, recent=(5, 21, 252)).where(F.col("n") >= max(least, 2))
    rows = join_calendar(seen, _market_variance(market, cut), "as_of").join(sectors.select("ticker", "sector"), "ticker", "left")
    n, sd = F.col("n"), F.sqrt(F.col("xx") / (F.col("n") - 1))
    # bars 22 to 252 counted from the newest; all but the newest 21 where there are fewer
    month, year = F.col("log_21"), F.when(n >= 252, F.col("log_252")).otherwise(0.0)
    lost = F.col("lost_21") - F.when(n >= 252, F.col("lost_252")).otherwise(0)
    return rows.select(
        "ticker",
        "as_of",
        F.col("n").alias("n_obs"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        _beta(F.lit(True)).alias("beta"),
        F.when(n >= 63, _growth(month - year, lost)).otherwise(0.0).alias("momentum"),
        F.when(sd > 0, F.col("total") / n / (sd + 1e-8)).otherwise(0.0).alias("size"),
        (-_growth(F.col("from_21"), F.col("fell_21"))).alias("value"),
        (-sd * _YEAR).alias("low_vol"),
        (-_growth(F.col("from_5"), F.col("fell_5"))).alias("reversal"),
        (sd * _YEAR).alias("volatility"),
    )


def loadings_at(exposure: DataFrame) -> DataFrame:
    """Style exposures z-scored within their rebalance date, clipped to ±2."""
    return zscore(exposure, ["as_of"], {f: f"{f}_load" for f in STYLE_COEFFICIENTS}, limit=2.0)


def holding_days(returns: DataFrame, as_of: DataFrame) -> DataFrame:
    """(date, as_of): each trading date with the last rebalance date before it."""
    days = returns.select("date").where("date IS NOT NULL").distinct().select("date", F.lit(0).alias("mark"))
    marks = as_of.select("date").where("date IS NOT NULL").distinct().select("date", F.lit(1).alias("mark"))
    along = Window.partitionBy(F.lit(0)).orderBy("date", "mark").rowsBetween(Window.unboundedPreceding, 0)  # calendar rows only
    known = F.last(F.when(F.col("mark") == 1, F.col("date")), ignorenulls=True).over(along)
    return days.unionByName(marks).withColumn("as_of", known).where("mark = 0 AND as_of IS NOT NULL").select("date", "as_of")


def style_sides(exposure: DataFrame, share: float = 0.3) -> DataFrame:
    """(ticker, as_of, top_{f}, bottom_{f}): 1 where the ticker is among the ``int(share * rows)`` largest or smallest exposures to the
    factor on the date, ties by ticker; for a ticker with several rows the share of them.

    The values where the selections end are one row per (as_of, factor), bounded by the calendar, so exposures are compared
    where they are; only rows at a value that a selection cuts through are ordered.
    """
    keys = ["as_of", "factor"]
    styles = F.explode(F.create_map(*[x for f in STYLE_COEFFICIENTS for x in (F.lit(f), F.col(f))])).alias("factor", "x")
    long_ = exposure.select("ticker", "as_of", styles)
    table = rank_table(long_.select(*keys, F.col("x").alias("_v")), keys, "_v")
    quota, tied = F.floor(F.col("n_group") * F.lit(share)), F.col("n_tied")
    ahead = {"top": F.col("n_group") - F.col("n_below") - tied, "bottom": F.col("n_below")}
    whole = {s: F.when(a + tied <= quota, F.col("_v")) for s, a in ahead.items()}
    cut = {s: (a < quota) & (a + tied > quota) for s, a in ahead.items()}
    limits = table.groupBy(*keys).agg(
        F.min(whole["top"]).alias("_top_to"), F.max(whole["bottom"]).alias("_bottom_to"),
        *[F.max(F.when(c, F.col("_v"))).alias(f"_{s}_cut") for s, c in cut.items()], *[F.max(F.when(c, quota - ahead[s])).alias(f"_{s}_left") for s, c in cut.items()])
    rows = join_calendar(long_, reliable(limits), keys)
    at = {s: F.coalesce(F.col("x") == F.col(f"_{s}_cut"), F.lit(False)) for s in ahead}
    inside = {"top": F.col("x") >= F.col("_top_to"), "bottom": F.col("x") <= F.col("_bottom_to")}
    ordered = numbered(rows.where(at["top"] | at["bottom"]), [*keys, "x"], ["ticker"], "_p")
    rows = rows.where(~(at["top"] | at["bottom"])).withColumn("_p", F.lit(None).cast("long")).unionByName(ordered)
    chosen = {s: F.coalesce(inside[s], F.lit(False)) | (at[s] & F.coalesce(F.col("_p") <= F.col(f"_{s}_left"), F.lit(False))) for s in ahead}
    rows = rows.select("ticker", "as_of", "factor", *[c.cast("double").alias(s) for s, c in chosen.items()])
    return rows.groupBy("ticker", "as_of").agg(*[F.avg(F.when(F.col("factor") == f, F.col(s))).alias(f"{s}_{f}") for s in ahead for f in STYLE_COEFFICIENTS])


def _leg_sums() -> list[Column]:
    """Sums of returns and weights of both legs of every factor."""
    legs = [f"{s}_{f}" for s in ("top", "bottom") for f in STYLE_COEFFICIENTS]
    return [F.sum(x).alias(f"{kind}_{leg}") for leg in legs for kind, x in (("r", F.col("ret") * F.col(leg)), ("w", F.col(leg)))]


def _leg_returns(sums: DataFrame) -> DataFrame:
    """Per date and factor: mean of the top leg less mean of the bottom leg, from parts of ``_leg_sums``."""
    total = sums.groupBy("date").agg(*[F.sum(c).alias(c) for c in sums.columns if c[:2] in ("r_", "w_")])
    mean = lambda leg: F.when(F.col(f"w_{leg}") > 0, F.col(f"r_{leg}") / F.col(f"w_{leg}"))
    each = [F.struct(F.lit(f).alias("factor"), (mean(f"top_{f}") - mean(f"bottom_{f}")).alias("factor_return"), (F.col(f"w_top_{f}") + F.col(f"w_bottom_{f}")).alias("_w")) for f in STYLE_COEFFICIENTS]
    return total.select("date", F.inline(F.array(*each))).where("_w > 0").drop("_w")


def style_returns_at(returns: DataFrame, exposure: DataFrame, held: DataFrame, share: float = 0.3) -> DataFrame:
    """Per date and style factor: mean return of the top names less the bottom names of the rebalance date in force."""
    rows = join_calendar(returns.where("ret IS NOT NULL").select("ticker", "date", "ret"), held, how="inner")
    known = exposure.select("ticker", "as_of").join(style_sides(exposure, share), ["ticker", "as_of"])
    return _leg_returns(rows.join(known, ["ticker", "as_of"]).groupBy("date").agg(*_leg_sums()))


def residual_returns_at(returns: DataFrame, market: DataFrame, exposure: DataFrame, as_of: DataFrame) -> DataFrame:
    """Return less beta × market, sector excess and style parts, with exposures that were known before the day.

    Sector means and style legs are summed in one pass per (date, sector); that small table is written, so that its
    size is known where it meets the returns again.
    """
    held = reliable(holding_days(returns, as_of))
    days = join_calendar(returns.where("ret IS NOT NULL").select("ticker", "date", "ret"), held, how="inner")
    loads = loadings_at(exposure).select("ticker", "as_of", "sector", "beta", *[f"{f}_load" for f in STYLE_COEFFICIENTS])
    # a ticker with several rows: each meets its share of chosen rows, so that the weights add up to them
    known = exposure.select("ticker", "as_of", "sector").join(style_sides(exposure), ["ticker", "as_of"])
    summed = days.join(known, ["ticker", "as_of"])
    stats = reliable(summed.groupBy("date", "sector").agg(F.avg("ret").alias("sector_ret"), *_leg_sums()))
    wide = _leg_returns(stats).groupBy("date").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("factor_return"))).alias(f"{f}_ret") for f in STYLE_COEFFICIENTS])
    rows = days.join(loads, ["ticker", "as_of"]).join(stats.select("date", "sector", "sector_ret"), ["date", "sector"], "left")
    rows = join_calendar(join_calendar(rows, wide), market.select("date", "spy_ret"))
    value = F.col("ret") - F.col("beta") * F.col("spy_ret") - (F.col("sector_ret") - F.col("spy_ret"))
    for f, c in STYLE_COEFFICIENTS.items():
        value = value - F.col(f"{f}_load") * c * F.col(f"{f}_ret")
    return rows.select("ticker", "date", "as_of", "sector", "ret", value.alias("residual"))


def vol_beta_at(returns: DataFrame, market: DataFrame, as_of: DataFrame, vol_days: int = 60, beta_days: int = 252, least: int = 60) -> DataFrame:
    """``factors.latest_vol_beta`` for every date of ``as_of``."""
    short, long_ = pieces(returns, as_of, vol_days), pieces(returns, as_of, beta_days)
    plain = returns.where("ret IS NOT NULL").select("ticker", "date", "ret")
    vol = lookback_moments(plain.withColumn("_own", F.col("ret")), short, "_own")
    vol = vol.select("ticker", "as_of", F.when(F.col("n") > 1, F.sqrt(F.col("xx") / (F.col("n") - 1)) * _YEAR).alias("volatility"))
    seen = join_calendar(lookback_moments(_with_market(returns, market), long_), _market_variance(market, long_), "as_of")
    return seen.select("ticker", "as_of", _beta(F.col("n") > least).alias("beta")).join(vol, ["ticker", "as_of"], "full_outer")
