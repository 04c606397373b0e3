"""Merges read and rewrite the partitions that a batch touches, nothing else."""

import os

from pyspark.sql import functions as F

from quantloom.sources import tables

SCHEMA = "ticker string, year int, close double"


def files(path) -> dict:
    return {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def stocked(spark, path):
    rows = [(f"T{i}", y, float(i)) for y in (1999, 2000, 2001) for i in range(20)]
    tables.append(spark.createDataFrame(rows, SCHEMA), path, "year")
    return rows


def test_ignoring_merge_adds_files_only(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = stocked(spark, path)
    before = files(path)
    batch = spark.createDataFrame([("T1", 2001, -1.0), ("N1", 2001, 5.0), ("N1", 2001, 4.0), ("N2", 2002, 6.0)], SCHEMA)
    tables.merge(batch, path, ["ticker", "year"], "year", [F.col("close")])
    after = files(path)
    assert all(after[name] == stamp for name, stamp in before.items())
    got = sorted((r.ticker, r.year, r.close) for r in spark.read.parquet(path).collect())
    assert got == sorted([*rows, ("N1", 2001, 4.0), ("N2", 2002, 6.0)])


def test_replacing_merge_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = stocked(spark, path)
    before = files(path)
    batch = spark.createDataFrame([("T1", 2001, -1.0), ("N2", 2002, 6.0)], SCHEMA)
    tables.merge(batch, path, ["ticker", "year"], "year", [F.col("close")], replace=True)
    after = files(path)
    assert all(after.get(name) == stamp for name, stamp in before.items() if "year=2001" not in name)
    got = {(r.ticker, r.year): r.close for r in spark.read.parquet(path).collect()}
    assert got == {**{(t, y): c for t, y, c in rows}, ("T1", 2001): -1.0, ("N2", 2002): 6.0}
    tables.merge(batch.limit(0), path, ["ticker", "year"], "year", [F.col("close")], replace=True)
    tables.merge(batch.limit(0), path, ["ticker", "year"], "year", [F.col("close")])
    assert {(r.ticker, r.year): r.close for r in spark.read.parquet(path).collect()} == got


def test_scan_is_pruned_to_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "prices")
    stocked(spark, path)
    batch = spark.createDataFrame([("T3", 2000, 1.0), ("T5", 2000, 1.0)], SCHEMA)
    hit = tables.touched(spark.read.parquet(path), batch, "year", ["ticker", "year"])
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2000" in plan and "GreaterThanOrEqual(ticker,T3)" in plan
    assert sorted(r.ticker for r in hit.collect()) == ["T3", "T4", "T5"]
