"""As-of look-ups without range joins.

Requests and bars of one ticker are merged into one ordered series and filled, which
costs one shuffle by ticker and one sort. A range join would compare every request
with every bar of the ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import by_bar
from quantloom.operators.xsection import join_calendar


def _merged(requests: DataFrame, facts: DataFrame, on: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    carried = F.struct(F.col(ts).alias("_at"), *[F.col(v) for v in values])
    left = requests.select(*on, ts, F.struct(*requests.columns).alias("_req"))
    right = facts.select(*on, ts, carried.alias("_fact"))
    return left.unionByName(right, allowMissingColumns=True)


def _unpack(df: DataFrame, requests: DataFrame, values: Sequence[str], at: str | None) -> DataFrame:
    fields = [F.col(f"_req.{c}").alias(c) for c in requests.columns]
    fields += [F.col(f"_hit.{v}").alias(v) for v in values]
    if at:
        fields.append(F.col("_hit._at").alias(at))
    return df.where("_req IS NOT NULL").select(*fields)


def asof_backward(
    requests: DataFrame, facts: DataFrame, values: Sequence[str], on: Sequence[str] = ("ticker",), ts: str = "date", at: str | None = None
) -> DataFrame:
    """For each request the latest fact with ``fact.ts <= request.ts``."""
    merged = _merged(requests, facts, on, ts, values)
    w = Window.partitionBy(*on).orderBy(F.col(ts), F.col("_req").isNotNull())
    filled = merged.withColumn("_hit", F.last("_fact", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _unpack(filled, requests, values, at)


def asof_forward(
    requests: DataFrame,
    facts: DataFrame,
    values: Sequence[str],
    on: Sequence[str] = ("ticker",),
    ts: str = "date",
    at: str | None = None,
    tolerance_days: int | None = None,
) -> DataFrame:
    """For each request the first fact on or after it, within the tolerance.

    The series is read newest first, so the fill is a growing frame (linear), not an
    unbounded-following one (quadratic).
    """
    merged = _merged(requests, facts, on, ts, values)
    w = Window.partitionBy(*on).orderBy(F.col(ts).desc(), F.col("_req").isNotNull())
    hit = F.last("_fact", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    filled = merged.withColumn("_hit", hit)
    if tolerance_days is not None:
        near = F.datediff(F.col("_hit._at"), F.col(ts)) <= tolerance_days
        filled = filled.withColumn("_hit", F.when(near, F.col("_hit")))
    return _unpack(filled, requests, values, at)


def sample_at(series: DataFrame, dates: DataFrame, on: Sequence[str] = ("ticker",), max_staleness: int | None = None) -> DataFrame:
    """The last row of every series at each sampling date (one date per month).

    ``dates`` has one column ``date``. Every row is valid until the next row of its
    series; the months of that span are exploded and met with the sampling calendar by
    equality, so no range join and no extra shuffle beyond the series' own. Adds
    ``bar_date``; ``date`` becomes the sampling date.
    """
    w = by_bar(*on)
    ends = dates.select(F.col("date").alias("_sample"), F.trunc("date", "MM").alias("_month"))
    horizon = dates.agg(F.max("date").alias("_horizon"))
    spans = (
        series.withColumn("_next", F.lead("date").over(w))
        .crossJoin(F.broadcast(horizon))
        .withColumn("_until", F.coalesce("_next", F.date_add("_horizon", 1)))
        .where("date <= _horizon")
    )
    months = F.sequence(F.trunc("date", "MM"), F.trunc("_until", "MM"), F.expr("interval 1 month"))
    hits = join_calendar(spans.withColumn("_month", F.explode(months)), ends, "_month", "inner").where(
        "_sample >= date AND _sample < _until"
    )
    if max_staleness is not None:
        hits = hits.where(F.datediff("_sample", "date") <= max_staleness)
    rest = [c for c in series.columns if c != "date"]
    return hits.select(F.col("_sample").alias("date"), F.col("date").alias("bar_date"), *rest)


def beside(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join by (ticker, date) of tables with at most a row per ticker and sampling date.

    The planner sees the ticker as the only key and the date as a test on the pair: wide rows that are dealt out by
    ticker already stay where they are. A ticker meets its own few sampling dates only.
    """
    named = other.select(*[F.col(c).alias(f"_other_{c}") if c in ("ticker", "date") else F.col(c) for c in other.columns])
    same = (F.col("ticker") == F.col("_other_ticker")) & (F.datediff("date", "_other_date") == 0)
    return rows.join(named, same, how).drop("_other_ticker", "_other_date")


def trading_calendar(prices: DataFrame) -> DataFrame:
    """Distinct trading dates with the following one. The ordering window sees one row
    per trading day of the whole history, not the panel."""
    days = prices.select("date").distinct()
    return days.withColumn("next_date", F.lead("date").over(Window.orderBy("date")))


def snapshot_for(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each date the latest snapshot date not after it, else the earliest snapshot.

    Both inputs are calendars (one row per date), so the range join is between two
    bounded tables.
    """
    marks = snapshots.select(F.col("snapshot_date")).distinct()
    w = Window.orderBy("snapshot_date")
    spans = marks.select(
        "snapshot_date",
        F.when(F.row_number().over(w) == 1, F.lit("0001-01-01").cast("date")).otherwise(F.col("snapshot_date")).alias("_from"),
        F.lead("snapshot_date", 1).over(w).alias("_to"),
    )
    days = dates.select("date").distinct()
    return days.join(
        F.broadcast(spans), (F.col("date") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("date") < F.col("_to")))
    ).select("date", "snapshot_date")
