"""Operator 5, Merkle fixity audit of archived records.

A page is a WARC response record; its bytes are hashed. Records are ordered by page_id and laid into archive files
of ``FANOUT`` squared ids. Leaves stand for page ids, a node of level k for the ids of one
multiple of ``FANOUT`` to the k; its hash covers its children's ids and hashes in order, and
it knows the offset range in its file. Two replicas are compared from the root: only children of nodes
that differ are read at the next level, down to the pages that were changed, lost or added.

Where rows move: records are hashed where they are read, so no page travels; a leaf is combined map-side, a level
is an aggregate of at most ``FANOUT`` children a node, and levels shrink by that factor. Levels are written tables.
Comparing joins a level's nodes with the few parents that differ.

Defined results: a leaf of several records (repeated page_id) covers their number and the sums of their hash
words, whatever their order, so a page_id that a third of all rows share is one row after
the map side. A null page_id is one leaf, reported as null. Null url or html counts as empty. Equal replicas, empty ones
too, give no row; an empty replica against one with records gives each page. Extra columns are not part of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stored

FANOUT = 32
#: Stands for the null page_id.
NO_ID = -(2**62)


def record(url: Column, html: Column) -> Column:
    """The page as a WARC/1.0 response record. Header lines are fixed values of the format."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(node, hash, file, start, length) of each page id; needs page_id, url, html."""
    bytes_ = record(F.col("url"), F.col("html"))
    hashed = pages.select(F.coalesce("page_id", F.lit(NO_ID)).cast("long").alias("node"), F.sha2(bytes_, 256).alias("digest"), F.octet_length(bytes_).cast("long").alias("length"))
    words = [F.sum(F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    summed = hashed.groupBy("node").agg(F.count("*").alias("records"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *words), 256).alias("hash"), F.sum("length").alias("length"))
    # a file holds FANOUT squared ids at most, one row each
    file = F.floor(F.col("node") / (FANOUT * FANOUT)).alias("file")
    before = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return summed.select("node", "hash", "length", file).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(pages: DataFrame, name: str) -> list[DataFrame]:
    """Levels from the leaves to the root, each (node, parent, hash, file, start, length)."""
    levels = [stored(leaves(pages).withColumn("parent", F.floor(F.col("node") / FANOUT)), f"{name}-leaves")]
    while True:
        low, high = levels[-1].agg(F.min("node"), F.max("node")).first()
        if low is None or low == high or (low >= -1 and high <= 0):
            return levels
        child = F.concat_ws(":", F.col("node").cast("string"), "hash")
        ordered = F.array_sort(F.collect_list(F.struct("node", child.alias("text"))))  # FANOUT children at most
        end = F.max(F.col("start") + F.col("length"))
        nodes = levels[-1].groupBy(F.col("parent").alias("node")).agg(
            F.sha2(F.array_join(ordered["text"], ","), 256).alias("hash"), F.min("file").alias("file"), F.min("start").alias("start"), (end - F.min("start")).alias("length"))
        levels.append(stored(nodes.withColumn("parent", F.floor(F.col("node") / FANOUT)), f"{name}-{len(levels)}"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, kind, file, start, length) of pages whose records differ.

    ``kind`` is changed, missing (from the replica) or added (to it); file, start and length are the primary's
    archive range of the page, null for added pages.
    """
    ours, theirs = tree(primary, "primary"), tree(replica, "replica")
    height = max(len(ours), len(theirs))
    suspects = None
    # a replica of fewer levels has no nodes at the upper ones: start where both have
    for level in reversed(range(min(len(ours), len(theirs)))):
        a, b = ours[level], theirs[level]
        if suspects is not None:
            a, b = (x.join(suspects.withColumnRenamed("node", "parent"), "parent", "left_semi") for x in (a, b))
        other = b.select(F.col("node").alias("_node"), F.col("hash").alias("_hash"))
        pairs = a.join(other, F.col("node") == F.col("_node"), "full_outer").where(~F.col("hash").eqNullSafe(F.col("_hash")))
        pairs = pairs.withColumn("node", F.coalesce("node", "_node"))
        if level:
            suspects = stored(pairs.select("node"), f"suspects-{height}-{level}")
    kind = F.when(F.col("hash").isNull(), "added").when(F.col("_hash").isNull(), "missing").otherwise("changed")
    page = F.when(F.col("node") != NO_ID, F.col("node"))
    return pairs.select(page.alias("page_id"), kind.alias("kind"), "file", "start", "length")


def worn(pages: DataFrame) -> DataFrame:
    """A replica with faults for the query: ids of 97 n + 5 lose their last character, 97 n + 11 are lost,
    97 n + 23 come a second time under the id -1 - id."""
    rest = F.pmod(F.col("page_id"), F.lit(97))
    html = F.coalesce("html", F.lit(""))
    cut = F.when(rest == 5, F.substring(html, F.lit(1), F.length(html) - 1)).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(rest != 11, F.lit(True))).select("page_id", "url", cut.alias("html"))
    return kept.unionAll(pages.where(rest == 23).select(-1 - F.col("page_id"), "url", "html"))


def op5(pages: DataFrame) -> DataFrame:
    table = pages.select("page_id", "url", "html")
    return audit(table, worn(table))


OP5_SQL = r"""
WITH sized AS (
  SELECT page_id, page_id // 1024 AS file, page_id % 97 AS rest, length(coalesce(html, '')) AS chars,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS length FROM pages),
laid AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
SELECT page_id, CASE WHEN rest = 5 THEN 'changed' ELSE 'missing' END AS kind, file::BIGINT AS file, start::BIGINT AS start, length::BIGINT AS length FROM laid WHERE rest = 11 OR (rest = 5 AND chars > 0)
UNION ALL SELECT -1 - page_id, 'added', NULL, NULL, NULL FROM laid WHERE rest = 23
"""
