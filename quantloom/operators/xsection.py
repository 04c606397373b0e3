"""Cross-sectional operators: statistics, ranks and selections within a group.

A group here is usually one date, and one date can hold as many rows as there are
tickers. None of these operators puts a whole group into one task: statistics are
aggregated with map-side partial sums and joined back, ranks are counted per value
bucket and shifted by bucket offsets, and per-group selections use a row-number limit
which Spark applies before the shuffle as well (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import clip
from quantloom.session import reliable

BUCKETS_PER_OCTAVE = 64


def join_calendar(df: DataFrame, per_date: DataFrame, on: str | Sequence[str] = "date", how: str = "left") -> DataFrame:
    """Join a table with at most one row per date.

    Its size is bounded by the calendar (under 10^5 rows for two centuries of days),
    so broadcasting it is safe at any panel size and the panel itself does not move.
    """
    return df.join(F.broadcast(per_date), [on] if isinstance(on, str) else list(on), how)


def group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Attach per-group aggregates as columns; no keys means one group of all rows.

    The one-row and the per-date table have a proven bound and are broadcast. Any other
    table is joined plainly: the adaptive planner broadcasts it where its measured bytes
    allow, else it shuffles with skew splitting.
    """
    return attach_stats(df, [(keys, stats)])


def attach_stats(df: DataFrame, groups: Sequence[tuple[Sequence[str], Mapping[str, Column]]]) -> DataFrame:
    """Several groupings of the same rows, all aggregated from ``df`` itself."""
    out = df
    for keys, stats in groups:
        table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
        if not keys:
            out = out.crossJoin(F.broadcast(table))
        elif list(keys) == ["date"]:
            out = join_calendar(out, table)
        else:
            out = out.join(table, list(keys), "left")
    return out


def _bucket(v: Column) -> Column:
    """A fixed monotone map from double to integer: logarithmic, sign-aware."""
    magnitude = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE) + F.lit(1100 * BUCKETS_PER_OCTAVE)
    return F.when(v == 0, F.lit(0)).when(v > 0, magnitude).otherwise(-magnitude).cast("long")


def rank_table(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """One row per (group, distinct value): how many rows are below it, tie it, and exist.

    Columns: ``*by, value, n_below, n_tied, n_group``. Equal values are counted before
    the shuffle, so a value shared by a third of all rows is one row here. Cumulation
    runs within logarithmic value buckets and is completed with bucket offsets, so no
    task ever holds a whole group.
    """
    by = list(by)
    counts = (
        values.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n_tied"))
        .withColumn("_b", _bucket(F.col(value)))
    )
    ordered = Window.partitionBy(*by).orderBy("_b")
    # the rows of a bucket are counted where they are read: the counts by value are made and moved once only
    offsets = (
        values.where(F.col(value).isNotNull())
        .groupBy(*by, _bucket(F.col(value)).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_bn"))
        .select(
            *by,
            "_b",
            (F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn")).alias("_before"),
            F.sum("_bn").over(Window.partitionBy(*by)).alias("n_group"),
        )
    )
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_inside", F.sum("n_tied").over(inside) - F.col("n_tied"))
        .join(offsets, [*by, "_b"])
        .select(*by, value, (F.col("_before") + F.col("_inside")).alias("n_below"), "n_tied", "n_group")
    )


def average_rank() -> Column:
    """Rank with ties averaged, 1-based, from the columns of ``rank_table``."""
    return F.col("n_below") + (F.col("n_tied") + 1) / F.lit(2.0)


def pct_rank(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], key: Sequence[str] = ("ticker",)) -> DataFrame:
    """Percentile ranks (ties averaged, NULL kept out) of several columns.

    ``columns`` maps a value column to the name of its rank. ``by`` + ``key`` identify
    a row. Several columns are ranked in one long pass rather than in one shuffle each.
    """
    by, key = list(by), list(key)
    if len(columns) == 1:
        (source, target), = columns.items()
        table = rank_table(df.select(*by, F.col(source).alias("_v")), by, "_v")
        table = table.select(*by, "_v", (average_rank() / F.col("n_group")).alias(target))
        return df.withColumn("_v", F.col(source)).join(table, [*by, "_v"], "left").drop("_v")
    pairs = F.array(
        *[F.struct(F.lit(i).alias("f"), F.col(s).cast("double").alias("v")) for i, s in enumerate(columns)]
    )
    long = (
        df.select(*by, *key, F.explode(pairs).alias("p"))
        .select(*by, *key, F.col("p.f").alias("f"), F.col("p.v").alias("v"))
        .where("v IS NOT NULL")
    )
    table = rank_table(long, [*by, "f"], "v").select(
        *by, "f", "v", (average_rank() / F.col("n_group")).alias("pct")
    )
    wide = (
        long.join(table, [*by, "f", "v"])
        .groupBy(*by, *key)
        .agg(*[F.max(F.when(F.col("f") == i, F.col("pct"))).alias(t) for i, t in enumerate(columns.values())])
    )
    return df.join(wide, [*by, *key], "left")


def demean(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Value minus the group mean; NULL where a key is NULL."""
    stats = {f"_m_{c}": F.avg(c) for c in columns}
    out = group_stats(df, keys, stats)
    named = [(F.col(c) - F.col(f"_m_{c}")).alias(t) for c, t in columns.items()]
    return out.select("*", *named).drop(*stats)


def zscore(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    limit: float | None = None,
    population: bool = False,
    flat: float = 0.0,
) -> DataFrame:
    """Z-score within the group; ``flat`` where the spread is zero or undefined."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats: dict[str, Column] = {}
    for c in columns:
        stats[f"_m_{c}"] = F.avg(c)
        stats[f"_s_{c}"] = spread(c)
    out = group_stats(df, keys, stats)
    named = []
    for c, t in columns.items():
        z = (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")
        if limit is not None:
            z = clip(z, -limit, limit)
        named.append(F.when(F.col(f"_s_{c}") > 0, z).otherwise(F.lit(float(flat))).alias(t))
    return out.select("*", *named).drop(*stats)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, position: str | None = None) -> DataFrame:
    """First n rows of each group in a total order."""
    place = position or "_place"
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)
    return out if position else out.drop(place)


def range_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in stored range parts of ``order``, with the part's number as ``_part``: earlier parts hold smaller rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable(df.repartitionByRange(n, *order).select("*", F.spark_partition_id().alias("_part")))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Place (from 1) in ``order`` within ``keys``, for groups of any size.

    Rows are numbered inside range parts of (keys, order); what earlier parts hold of the
    same keys is one count per part, so a group may fill many parts.
    """
    keys = list(keys)
    parts = range_parts(df, [*keys, *order])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    carried = counts.select(*[F.col(c).alias(f"_of_{c}") for c in ("_part", *keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_part", *keys)])
    return local.join(carried, same).select(*df.columns, (F.col("_local") + F.col("_carried")).alias(out))


def extreme_share(
    df: DataFrame, by: Sequence[str], value: str, share: float, tie: Sequence[str], largest: bool = True
) -> DataFrame:
    """The ``int(share * rows)`` largest (or smallest) rows of each group.

    Whole tie groups inside the limit pass on counts alone; only the one tie group
    the limit cuts through is ordered by the tie columns, in range parts (``numbered``), so a
    value that most rows share is cut exactly without meeting in one task.
    """
    by = list(by)
    table = rank_table(df.select(*by, F.col(value).alias("_v")), by, "_v")
    ahead = (F.col("n_group") - F.col("n_below") - F.col("n_tied")) if largest else F.col("n_below")
    table = table.select(
        *by,
        "_v",
        "n_tied",
        ahead.alias("_ahead"),
        F.floor(F.col("n_group") * F.lit(share)).alias("_quota"),
    ).where("_ahead < _quota")
    hit = df.withColumn("_v", F.col(value)).join(table, [*by, "_v"])
    whole = hit.where("_ahead + n_tied <= _quota")
    cut = hit.where("_ahead + n_tied > _quota")
    cut = numbered(cut, [*by, "_v"], tie, "_p").where("_ahead + _p <= _quota").drop("_p")
    return whole.unionByName(cut).drop("_v", "n_tied", "_ahead", "_quota")
