"""Peer discovery without listing all pairs of a sector.

A peer's score depends on the pair only through (same industry?) and the band of the
market-cap ratio (≤ 2, ≤ 5, beyond or unknown). Names are put on a logarithmic cap grid:
cells wholly within a band contribute their first names by ticker once per cell, and only
the few cells at the rim of the band are tested name by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.xsection import top_per_group


def nearest_peers(meta: DataFrame, k: int = 3) -> DataFrame:
    """The k best peers of each ticker, score descending, ties by ticker.

    Score tiers are nested sets (sector ⊃ cap within 5× ⊃ within 2×, the same per
    industry), so the first k+1 names by ticker of every tier contain the answer: one of
    them may be the name itself, and a slot taken by a better tier is no loss.
    """
    base = meta.select("ticker", "sector", "industry", "market_cap").where("sector IS NOT NULL")
    parts = []
    for keys, bonus in ((["sector"], 0), (["sector", "industry"], 50)):
        rows = base.where(" AND ".join(f"{c} IS NOT NULL" for c in keys))
        first = top_per_group(rows, keys, [F.col("ticker")], k + 1).select(*keys, F.col("ticker").alias("peer"))
        parts.append(rows.select("ticker", *keys).join(first, keys).select("ticker", "peer", F.lit(100 + bonus).alias("score")))
        for ratio, extra in ((5.0, 10), (2.0, 30)):
            parts.append(_band(rows, keys, ratio, k).withColumn("score", F.lit(100 + bonus + extra)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.where("peer <> ticker").groupBy("ticker", "peer").agg(F.max("score").alias("score"))
    return top_per_group(best, ["ticker"], [F.desc("score"), F.col("peer")], k, "place")


CELLS_PER_OCTAVE = 32


def _band(rows: DataFrame, keys: list[str], ratio: float, k: int) -> DataFrame:
    """First k+1 names by ticker with a cap within the ratio, per name."""
    capped = rows.where("market_cap > 0").withColumn("_cell", F.floor(F.log2("market_cap") * CELLS_PER_OCTAVE))
    cell_top = top_per_group(capped, [*keys, "_cell"], [F.col("ticker")], k + 1)
    # Names of one cell share nearly the same range: look up per (group, cell), not per name.
    cells = capped.select(*keys, "_cell").distinct()
    span = int(CELLS_PER_OCTAVE * BAND_LOG2[ratio]) + 1
    inner = cells.withColumn("_near", F.explode(F.sequence(F.col("_cell") - (span - 2), F.col("_cell") + (span - 2))))
    tops = cell_top.select(*keys, F.col("_cell").alias("_near"), F.col("ticker").alias("peer"))
    near = top_per_group(inner.join(tops, [*keys, "_near"]), [*keys, "_cell"], [F.col("peer")], k + 1)
    whole = capped.select("ticker", *keys, "_cell").join(near.select(*keys, "_cell", "peer"), [*keys, "_cell"])
    # Cells at the rim: test the ratio name by name.
    rim = capped.select("ticker", *keys, F.col("market_cap").alias("_cap"), "_cell").withColumn(
        "_near",
        F.explode(
            F.array(*[F.col("_cell") + s * d for s in (-1, 1) for d in range(span - 1, span + 2)])
        ),
    )
    other = capped.select(*keys, F.col("_cell").alias("_near"), F.col("ticker").alias("peer"), F.col("market_cap").alias("_pc"))
    ok = F.greatest("_cap", "_pc") / F.least("_cap", "_pc") <= ratio
    edge = top_per_group(rim.join(other, [*keys, "_near"]).where(ok), ["ticker"], [F.col("peer")], k + 1)
    return whole.select("ticker", "peer").unionByName(edge.select("ticker", "peer"))


# Binary logarithms of the two cap ratios.
BAND_LOG2 = {2.0: 1.0, 5.0: 2.321928094887362}
