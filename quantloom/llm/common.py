"""Shared pieces of the text operators: stored tables, stamped rows, range-ordered running values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.session import scratch

#: Words of the near-duplicate, mixing and toxicity operators: runs of anything but ASCII white space.
#: Fixed value of the contracts.
BLANKS = r"[\x20\x09-\x0D]+"
#: Separators of the decontamination words (fixed value): ASCII that is neither digit nor letter a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Cuts lineage, keeps column pruning, and survives lost executors. Ids drawn with
    ``monotonically_increasing_id`` are stored before anything refers to them, so a
    recomputed task cannot change them.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamped(docs: DataFrame, name: str, *derived: Column) -> DataFrame:
    """Rows with an integer ``_rid``, the untouched input row as ``_row``, and derived columns.

    ``_rid`` tells repeated rows and repeated or null ids apart; ``_row`` keeps extra
    columns, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return stored(docs.select(F.monotonically_increasing_id().alias("_rid"), row, *derived), name)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_sorted(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Store the rows in range partitions of ``order`` with their partition number as ``_part``.

    All rows of a lower ``_part`` come before those of a higher one, so running values need
    a window per part and one carried value per part. Put a unique column last in
    ``order``: a frequent key is then cut across parts.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order)
    return stored(ranged.select("*", F.spark_partition_id().alias("_part")), name)


def running_sum(df: DataFrame, name: str, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` over ``order`` within ``keys``, for groups of any size.

    One range shuffle. A window adds up inside a part; what earlier parts hold of the same
    keys is one row per (part, keys), so a group that fills many parts is never gathered.
    """
    parts = range_sorted(df, name, *keys, *order)
    sums = parts.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    here = [F.col(c).alias(f"_of_{c}") for c in ("_part", *keys)]
    carried = sums.select(*here, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_local", F.sum(value).over(inside))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_part", *keys)])
    return local.join(carried, on).select(*df.columns, (F.col("_local") + F.col("_carried")).alias(out))
