"""Ticker hygiene, aliases and point-in-time index membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.asof import snapshot_for
from quantloom.operators.xsection import join_calendar

# Phrases in a change log that mark a rename.
RENAME_PHRASES = ["ticker change", "symbol change", "renamed", "rebranded", "changed ticker", "ticker symbol change"]

# Exchange codes and their common names.
EXCHANGES = {
    "NASDAQ": ["NMS", "NGM", "NCM", "NASDAQ"],
    "NYSE": ["NYQ", "NYS", "NYSE"],
    "AMEX": ["ASE", "AMEX"],
}


def clean_tickers(df: DataFrame, column: str = "ticker", longest: int = 10) -> DataFrame:
    """Trimmed upper-case tickers of 1 to ``longest`` characters; others drop out."""
    out = df.withColumn(column, F.upper(F.trim(F.col(column))))
    return out.where(F.length(column).between(1, longest))


def with_variants(df: DataFrame, aliases: DataFrame | None = None, column: str = "ticker") -> DataFrame:
    """One row per form of the ticker: as is, dots as dashes, dashes as dots, aliases."""
    t = F.col(column)
    forms = F.array_distinct(F.array(t, F.replace(t, F.lit("."), F.lit("-")), F.replace(t, F.lit("-"), F.lit("."))))
    rows = df.withColumn("variant", F.explode(forms))
    if aliases is None:
        return rows
    named = df.join(aliases.select(F.col("ticker").alias(column), F.col("alias").alias("variant")), column)
    return rows.unionByName(named).distinct()


def canonical(df: DataFrame, aliases: DataFrame, column: str = "ticker") -> DataFrame:
    """Replace share-class aliases by their main ticker."""
    table = aliases.select(F.col("alias").alias(column), F.col("main").alias("_main"))
    return df.join(table, column, "left").withColumn(column, F.coalesce("_main", column)).drop("_main")


def alias_table(changes: DataFrame) -> DataFrame:
    """Aliases in both directions from rename entries, plus dot/dash forms."""
    told = F.lower(F.coalesce("reason", F.lit("")))
    renamed = F.lit(False)
    for phrase in RENAME_PHRASES:
        renamed = renamed | told.contains(phrase)
    pairs = changes.where(F.col("added").isNotNull() & F.col("removed").isNotNull() & renamed)
    both = pairs.select(F.col("added").alias("ticker"), F.col("removed").alias("alias")).unionByName(
        pairs.select(F.col("removed").alias("ticker"), F.col("added").alias("alias"))
    )
    forms = with_variants(both.select("ticker").distinct()).where("variant <> ticker")
    return both.unionByName(forms.select("ticker", F.col("variant").alias("alias"))).distinct()


def members_only(panel: DataFrame, snapshots: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows whose ticker, in any form, belongs to the universe as of their date.

    Each date first gets its snapshot (calendar-sized), then membership is a semi-join on
    (snapshot, ticker): no range join touches the panel.
    """
    dated = join_calendar(panel, snapshot_for(panel, snapshots), how="inner")
    known = with_variants(snapshots.select("snapshot_date", "ticker"), aliases)
    known = known.select("snapshot_date", F.col("variant").alias("_form")).distinct()
    direct = dated.withColumn("_form", F.col("ticker"))
    keep = with_variants(dated.select("ticker", "snapshot_date").distinct(), aliases).select(
        "ticker", "snapshot_date", F.col("variant").alias("_form")
    )
    hits = keep.join(known, ["snapshot_date", "_form"], "left_semi").select("ticker", "snapshot_date").distinct()
    return direct.drop("_form").join(hits, ["ticker", "snapshot_date"], "left_semi").drop("snapshot_date")


def rebuild_membership(current: DataFrame, changes: DataFrame, marks: DataFrame) -> DataFrame:
    """Members at each mark, from today's members and the log of later changes.

    For a ticker and a mark, the first change after the mark decides: a later addition
    means it was out, a later removal means it was in, no later change means as today.
    Changes are keyed by ticker; marks are a calendar (distinct dates).
    """
    events = changes.where("added IS NOT NULL").select(F.col("added").alias("ticker"), "date", F.lit(0).alias("before")).unionByName(
        changes.where("removed IS NOT NULL").select(F.col("removed").alias("ticker"), "date", F.lit(1).alias("before"))
    )
    # A ticker removed and added on one date was in before it.
    events = events.groupBy("ticker", "date").agg(F.max("before").alias("before"))
    w = Window.partitionBy("ticker").orderBy("date")
    spans = events.select(
        "ticker", F.lag("date").over(w).alias("valid_from"), F.col("date").alias("valid_to"), F.col("before").alias("member")
    )
    last = events.groupBy("ticker").agg(F.max("date").alias("valid_from"))
    today = current.select("ticker", F.lit(1).alias("member"))
    tail = last.join(today, "ticker", "full_outer").select(
        "ticker", "valid_from", F.lit(None).cast("date").alias("valid_to"), F.coalesce("member", F.lit(0)).alias("member")
    )
    periods = spans.unionByName(tail).where("member = 1").drop("member")
    at = marks.select(F.col("date").alias("snapshot_date"))
    inside = (F.col("valid_from").isNull() | (F.col("snapshot_date") >= F.col("valid_from"))) & (
        F.col("valid_to").isNull() | (F.col("snapshot_date") < F.col("valid_to"))
    )
    # marks and periods meet by month, an equal join
    ends = at.agg(F.min("snapshot_date").alias("_lo"), F.max("snapshot_date").alias("_hi"))
    spans = periods.crossJoin(F.broadcast(ends)).select(
        "*", F.greatest("_lo", F.coalesce("valid_from", "_lo")).alias("_from"), F.least("_hi", F.coalesce("valid_to", "_hi")).alias("_to")
    )
    months = F.sequence(F.trunc("_from", "MM"), F.trunc("_to", "MM"), F.expr("interval 1 month"))
    dealt = spans.where("_from <= _to").withColumn("_month", F.explode(months))
    calendar = at.withColumn("_month", F.trunc("snapshot_date", "MM"))
    return dealt.join(F.broadcast(calendar), "_month").where(inside).select("snapshot_date", "ticker")


def removed_for_good(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Tickers removed at some time that are not members now."""
    gone = changes.where("removed IS NOT NULL").select(F.col("removed").alias("ticker")).distinct()
    return gone.join(current.select("ticker"), "ticker", "left_anti")


def sizes_at(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """Universe size as of each date."""
    per_snapshot = snapshots.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n_members"))
    return snapshot_for(dates, snapshots).join(F.broadcast(per_snapshot), "snapshot_date").select("date", "snapshot_date", "n_members")


def first_last_difference(snapshots: DataFrame) -> DataFrame:
    """Names only in the first and only in the last snapshot."""
    ends = snapshots.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))
    tagged = snapshots.crossJoin(F.broadcast(ends))
    first = tagged.where("snapshot_date = lo").select("ticker")
    last = tagged.where("snapshot_date = hi").select("ticker")
    gone = first.join(last, "ticker", "left_anti").withColumn("change", F.lit("left"))
    return gone.unionByName(last.join(first, "ticker", "left_anti").withColumn("change", F.lit("joined")))


def exchange_name(code: Column) -> Column:
    out = None
    for name, codes in EXCHANGES.items():
        test = F.upper(code).isin(codes)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.upper(code))


def liquid(df: DataFrame, cap: float = 1e9, volume: float = 5e5) -> DataFrame:
    return df.where((F.col("market_cap") >= cap) & (F.col("volume") >= volume))


def named_universe(meta: DataFrame, name: str) -> DataFrame:
    """Members of a sector, or the largest 50 / 100; unknown names mean the largest 50.

    A sector name that matches nobody is unknown; that is decided inside the plan.
    """
    sizes = {"top_50": 50, "top_100": 100}
    if name in sizes:
        return meta.orderBy(F.desc_nulls_last("market_cap"), "ticker").limit(sizes[name])
    sector = meta.where(F.col("sector") == name)
    known = sector.limit(1).agg(F.count(F.lit(1)).alias("_known"))
    fallback = meta.orderBy(F.desc_nulls_last("market_cap"), "ticker").limit(50)
    fallback = fallback.crossJoin(F.broadcast(known)).where("_known = 0").drop("_known")
    return sector.unionByName(fallback)


def enough_returns(returns: DataFrame, lookback: int = 252, missing_share: float = 0.5) -> DataFrame:
    """Returns of the last ``lookback`` dates of names present on enough of them; absent
    days count as 0."""
    days = returns.select("date").distinct().orderBy(F.desc("date")).limit(lookback)
    recent = returns.join(F.broadcast(days), "date", "left_semi").where("ret IS NOT NULL")
    have = recent.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    kept = have.where(F.col("_n") >= lookback * (1 - missing_share)).select("ticker")
    grid = kept.join(F.broadcast(days))
    return grid.join(recent.select("ticker", "date", "ret"), ["ticker", "date"], "left").fillna(0.0, ["ret"])


def peers(meta: DataFrame, k: int = 3) -> DataFrame:
    """Closest k names per ticker inside its sector: +100 sector, +50 industry, +30 / +10
    for market caps within 2× / 5×.

    Pairs of a sector are never listed; see ``operators.peers``.
    """
    from quantloom.operators.peers import nearest_peers

    return nearest_peers(meta, k)
