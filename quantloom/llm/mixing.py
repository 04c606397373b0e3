"""Operator 9, mixing sources to target weights by Pareto order sampling.

A source's words are to be repeated ``rate = target / size`` times. ``floor(rate)`` copies of
each document are certain; the rest of the rate is an inclusion chance, and the documents
for it are chosen in the order of ``(u / (1 - u)) / (p / (1 - p))``: random odds over
inclusion odds. The order's front is taken until its words fill the rest of the target, so
the sample has a fixed size, in words. An optional ``weight`` column makes chances unequal
inside a source; without it they differ between sources only.

``u`` comes from the MD5 of seed and doc_id, so reruns and recomputed tasks agree.

Where rows move: sources are summed map-side. Targets are found on the table of sources by
filling up to the limits round by round, one aggregate per round. The order within a source is a
range-partitioned running sum (``running_sum``), in which a source that holds a third of
all rows spreads over as many parts as its share; no source is gathered.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its
own and comes last; sources of size 0 have target 0. Ties in the order are broken by doc_id,
then size. Repeated rows with one doc_id share the random number. An empty table gives an
empty result. Extra columns stay in ``_row``. A document is taken in whole copies, at most
``ceil(limit)`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import BLANKS, running_sum, stored

LIMIT = 3.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(squeezed, BLANKS, "")).cast("long")


def source_targets(sources: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, weight) with ``target``: shares by weight, at most ``limit`` times a size.

    Rounds: what limited sources leave is shared among the others by weight, until no share is
    above its limit. Each round is one aggregate of the table of sources; a round limits at
    least one more source or is the last.
    """
    ceiling = F.col("source_size") * F.lit(limit)
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > ceiling
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(over, ceiling)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        new = (float(row.total) - float(row.held or 0.0)) / float(row.free) if row.free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), ceiling).cast("double"))


def _weighted_sources(sized: DataFrame) -> DataFrame:
    """Sources by code point, null last, with weights 1, 2, 3, repeating."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.select("*", F.col("source").isNull().alias("last"), F.lit(1).alias("one"), F.coalesce("source", F.lit("")).alias("name"), F.lit(0).alias("all"))
    ranked = running_sum(sums, "mix-source-rank", ["all"], ["last", "name"], "one", "rank")
    return stored(ranked.select("source", "source_size", ((F.col("rank") - 1) % 3 + 1).cast("double").alias("weight")), "mix-sources")


def mix(docs: DataFrame, limit: float = LIMIT, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """Rows of ``docs`` (needs doc_id, text, source) without text, with size, source_size, target, copies, taken.

    ``weight`` names a positive column that multiplies a document's rate within its source.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    load = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("_rid"), row, F.col("source"), F.col("doc_id"), word_count(F.col("text")).alias("size"), load.alias("load")), "mix-rows")
    targets = stored(source_targets(_weighted_sources(rows), limit), "mix-targets")
    loads = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("load")).alias("source_load"))
    plan = stored(targets.join(loads, targets["source"].eqNullSafe(loads["source"])).select(
        targets["source"].alias("of"), "source_size", "target", "source_load"), "mix-plan")
    rate = F.when(F.col("source_load") > 0, F.least(F.col("target") * F.col("load") / F.col("source_load"), F.lit(limit))).otherwise(F.lit(0.0))
    rated = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).drop("of").withColumn("rate", F.round(rate, 9))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("chance", F.col("rate") - F.col("whole"))
    digest = F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    odds = (u / (1.0 - u)) / (F.col("chance") / (1.0 - F.col("chance")))
    drawn = rated.where("chance > 0 and size > 0").select(
        "_rid", "source", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "size", odds.alias("odds"), (F.col("chance") * F.col("size")).alias("due"))
    # what is left of a source's target after certain copies
    due = stored(rated.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("left")), "mix-left")
    ordered = running_sum(drawn, "mix-order", ["source"], ["odds", "id", "size", "_rid"], "size", "reached")
    picked = ordered.join(due.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where(
        "reached - size / 2.0 <= left").select("_rid", F.lit(1).alias("extra"))
    out = rated.join(picked, "_rid", "left").withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long"))
    return out.select("_row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "source", "text"))
    return mixed.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, sum(size)::DOUBLE AS s FROM sized GROUP BY source),
weighed AS (SELECT source, s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sums),
fill(step, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, (SELECT (sum(s) - coalesce(sum(3.0 * s) FILTER (w * level > 3.0 * s), 0)) / sum(w) FILTER (NOT w * level > 3.0 * s) FROM weighed)
  FROM fill WHERE step <= (SELECT count(*) FROM weighed) AND EXISTS (SELECT 1 FROM weighed WHERE NOT w * level > 3.0 * s)),
aim AS (SELECT source, s, least(w * (SELECT max(level) FROM fill), 3.0 * s)::DOUBLE AS target FROM weighed),
rated AS (
  SELECT doc_id, z.source, size, s, target, round(least(CASE WHEN s > 0 THEN target / s ELSE 0 END, 3.0), 9) AS rate,
         (('0x' || substr(md5('mix-1/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized z JOIN aim a ON z.source IS NOT DISTINCT FROM a.source),
split AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS chance FROM rated),
due AS (SELECT source, max(target) - sum(whole * size) AS rest FROM split GROUP BY source),
drawn AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (chance / (1 - chance)), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS reached
  FROM split WHERE chance > 0 AND size > 0),
extra AS (SELECT d.doc_id, d.size FROM drawn d JOIN due e ON d.source IS NOT DISTINCT FROM e.source WHERE reached - d.size / 2.0 <= rest)
SELECT s.doc_id, s.size, s.s::BIGINT AS source_size, s.target,
       CAST((s.whole + CASE WHEN x.size IS NULL THEN 0 ELSE 1 END) * s.size AS BIGINT) AS taken
FROM split s LEFT JOIN extra x ON s.doc_id = x.doc_id
"""
