"""Readers, writers and table maintenance as plain DataFrame transformations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.functions.columns import nonzero
from quantloom.session import reliable

# Benchmark symbols that are not stocks.
BENCHMARK_TICKERS = ["SPY", "QQQ", "IWM", "^VIX", "^GSPC"]


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan(
    table: DataFrame, ticker: str | None = None, start: str | None = None, end: str | None = None, sector: str | None = None, date: str = "date"
) -> DataFrame:
    """Optional equality and date-range predicates, left to push-down and partition pruning."""
    out = table
    if ticker is not None:
        out = out.where(F.col("ticker") == ticker)
    if sector is not None:
        out = out.where(F.col("sector") == sector)
    if start is not None:
        out = out.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col(date) <= F.lit(end).cast("date"))
    return out


def with_warmup(table: DataFrame, start: str, end: str, days: int = 365) -> DataFrame:
    """The asked range plus history for look-back windows; trim with ``trim`` afterwards."""
    return table.where(
        (F.col("date") >= F.date_sub(F.lit(start).cast("date"), days)) & (F.col("date") <= F.lit(end).cast("date"))
    )


def trim(table: DataFrame, start: str) -> DataFrame:
    return table.where(F.col("date") >= F.lit(start).cast("date"))


def list_universe(prices: DataFrame, meta: DataFrame, date: str | None = None) -> DataFrame:
    """Tickers with a price that day; without a date every known ticker."""
    if date is None:
        return meta.select("ticker").distinct()
    return prices.where(F.col("date") == F.lit(date).cast("date")).select("ticker").distinct()


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, distinct tickers and date range per table."""
    parts = []
    for name, df in tables.items():
        date = F.col("date") if "date" in df.columns else F.lit(None).cast("date")
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.countDistinct("ticker").alias("n_tickers"),
                F.min(date).alias("first_date"),
                F.max(date).alias("last_date"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order. A min over the ordered row struct
    combines map-side, so a key repeated in a large share of the batch stays cheap."""
    rest = [c for c in batch.columns if c not in keys]
    packed = batch.select(*keys, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest).alias("_row"))
    return packed.groupBy(*keys).agg(F.min("_row").alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in rest]).select(*batch.columns)


def new_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of a batch an insert-or-ignore would add."""
    return first_per_key(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table after insert-or-replace: new rows win (last in order), others stay."""
    last = first_per_key(new, keys, order)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def append(df: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> None:
    """Write with partition sizes balanced by the adaptive planner (splits large ones)."""
    out = df.hint("rebalance", *([partition] if partition else []))
    writer = out.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    append(df, path, partition, "overwrite")


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def touched(target: DataFrame, batch: DataFrame, partition: str, keys: Sequence[str]) -> DataFrame:
    """The target's rows that a batch can meet: its partitions, and its range of every other key.

    The partition values and the ranges come to the driver (one value per partition, one pair per key), so
    the scan is pruned to these partitions when it is planned and to matching row groups when it runs.
    """
    values = [r[0] for r in batch.select(partition).distinct().collect()]
    hit = target.where(F.col(partition).isin([v for v in values if v is not None]) | (F.col(partition).isNull() if None in values else F.lit(False)))
    ranged = [k for k in keys if k != partition]
    ends = batch.agg(*[f(k).alias(f"{n}_{k}") for k in ranged for n, f in (("lo", F.min), ("hi", F.max))]).first() if ranged else None
    for k in ranged:
        if ends[f"lo_{k}"] is not None:
            hit = hit.where(F.col(k).between(F.lit(ends[f"lo_{k}"]), F.lit(ends[f"hi_{k}"])))
    return hit


def merge(batch: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[Column], replace: bool = False) -> None:
    """Insert a batch into a partitioned table; rows of known keys are ignored, or replace the old ones.

    Of rows that repeat a key inside the batch the first in ``order`` counts. Ignoring reads keys of touched partitions only
    and adds files; replacing reads and rewrites touched partitions only. ``partition`` has to be a function of the keys.
    """
    spark = batch.sparkSession
    batch = reliable(first_per_key(batch, keys, order))
    target = spark.read.parquet(path)
    if replace:
        values = [r[0] for r in batch.select(partition).distinct().collect()]
        old = target.where(F.col(partition).isin(values)).select(*batch.columns)
        merged = old.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        overwrite_partitions(reliable(merged), path, partition)
        return
    known = touched(target, batch, partition, keys).select(*keys)
    append(batch.join(known, list(keys), "left_anti"), path, partition)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote, with the types it had; no pass over the files to infer them."""
    return spark.read.option("header", True).schema(schema).csv(path)


def wide_to_long(wide: DataFrame, names: Sequence[str], fields: Mapping[str, str], sep: str = "_") -> DataFrame:
    """Column groups ``<name><sep><field>`` to rows; fields renamed; rows without an
    adjusted close dropped; timestamps cut to days."""
    groups = F.array(
        *[F.struct(F.lit(n).alias("ticker"), *[F.col(f"{n}{sep}{f}").alias(t) for f, t in fields.items()]) for n in names]
    )
    rows = wide.select(F.to_date("date").alias("date"), F.explode(groups).alias("g")).select("date", "g.*")
    return rows.dropna(subset=["adj_close"])


# Vendor field -> column of the fundamentals table.
VENDOR_FIELDS = {
    "trailingPE": "pe_ratio",
    "priceToBook": "pb_ratio",
    "priceToSalesTrailing12Months": "ps_ratio",
    "returnOnEquity": "roe",
    "returnOnAssets": "roa",
    "debtToEquity": "debt_to_equity",
    "profitMargins": "profit_margin",
    "revenueGrowth": "revenue_growth",
    "earningsGrowth": "earnings_growth",
    "dividendYield": "dividend_yield",
}


def parse_vendor(records: DataFrame, column: str = "record") -> DataFrame:
    """Vendor JSON to typed fundamentals and meta fields; zero and empty become NULL."""
    r = records.withColumn("_r", F.from_json(column, schemas.VENDOR_RECORD))
    text = lambda c: F.when(F.length(F.col(f"_r.{c}")) > 0, F.col(f"_r.{c}"))
    return r.select(
        F.col("_r.symbol").alias("ticker"),
        *[c for c in records.columns if c not in (column, "ticker")],
        *[nonzero(f"_r.{v}").alias(n) for v, n in VENDOR_FIELDS.items()],
        text("longName").alias("company_name"),
        text("sector").alias("sector"),
        text("industry").alias("industry"),
        nonzero("_r.marketCap").alias("market_cap"),
    )


def read_universe(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Membership (snapshot_date, ticker) and aliases (ticker, alias) of universe documents."""
    doc = spark.read.schema(schemas.UNIVERSE_DOCUMENT).option("multiLine", multi_line).json(path)
    members = doc.select(F.explode("universe_by_date").alias("d", "tickers")).select(
        F.to_date("d").alias("snapshot_date"), F.explode("tickers").alias("ticker")
    )
    aliases = doc.select(F.explode("ticker_aliases").alias("ticker", "a")).select("ticker", F.explode("a").alias("alias"))
    return members, aliases


def universe_records(members: DataFrame) -> DataFrame:
    """Membership as universe-document records, one member each, so that no snapshot is
    gathered into a single row however many names it has."""
    day = F.date_format("snapshot_date", "yyyy-MM-dd")
    return members.select(F.create_map(day, F.array("ticker")).alias("universe_by_date"))


def write_universe(members: DataFrame, path: str) -> None:
    universe_records(members).write.mode("overwrite").json(path)


def interval_bars(ticks: DataFrame, interval: str, key: str = "ticker", ts: str = "ts", price: str = "price", size: str | None = None, tie: str = "event_id") -> DataFrame:
    """OHLCV bars of any interval. One aggregation with map-side combine; the same plan
    runs on a stream."""
    order = F.struct(ts, tie, price)
    volume = F.sum(size) if size else F.count(F.lit(1))
    bars = ticks.groupBy(key, F.window(ts, interval).alias("w")).agg(
        F.min(order)[price].alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max(order)[price].alias("close"),
        volume.alias("volume"),
    )
    return bars.select(F.col(key).alias("ticker"), F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def first_valid(sources: Sequence[DataFrame], keys: Sequence[str], valid: Column) -> DataFrame:
    """Merge sources in priority order: per key the first source with a valid record."""
    merged = None
    for i, s in enumerate(sources):
        part = s.where(valid).withColumn("source_priority", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    return first_per_key(merged, keys, [F.col("source_priority")])


def latest_quotes(prices: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Newest row per ticker, for a ticker list when given; unknown tickers drop out."""
    rows = prices if wanted is None else prices.join(wanted.select("ticker").distinct(), "ticker", "left_semi")
    rest = [c for c in rows.columns if c not in ("ticker", "date")]
    top = rows.groupBy("ticker").agg(F.max(F.struct("date", *rest)).alias("r"))
    return top.select("ticker", "r.*")


def log_session(picks: DataFrame, metadata: DataFrame, root: str) -> None:
    """Picks and one metadata row of a session, keyed by session_id."""
    append(picks, f"{root}/picks", "session_id")
    metadata.write.mode("append").parquet(f"{root}/sessions")


def load_session(spark: SparkSession, root: str, session_id: str | None = None) -> DataFrame:
    """Picks of a session, the newest one by default."""
    picks = spark.read.parquet(f"{root}/picks")
    if session_id is not None:
        return picks.where(F.col("session_id") == session_id)
    newest = list_sessions(spark, root).agg(F.max("session_id").alias("session_id"))
    return picks.join(F.broadcast(newest), "session_id", "left_semi")


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/sessions").select("session_id").distinct().orderBy(F.desc("session_id"))


def load_reports(spark: SparkSession, pattern: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(pattern)
