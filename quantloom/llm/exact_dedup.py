"""Operator 1, exact dedup by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes. Distinct blocks are compared in full,
sorted, and given integer names. Adjacent names are then paired, distinct pairs are sorted
and named, and so on until every document is down to one name. Two documents finish at the
same level with the same name exactly when their bytes are equal: each naming is one-to-one,
and an odd last name is paired with "nothing", which no real name equals.

Where rows move: block bytes are shuffled once, after map-side removal of repeats, to be
named. Names travel back to the documents under a 128-bit block key; that the key is
one-to-one on the blocks at hand is checked on the named table (a second seed is taken if
it were not), so no result rests on a hash. Everything after level 0 is integers, and the
rows halve from level to level. Documents whose naming has ended leave the recursion.

Defined results: null text counts as empty; an empty text is one empty block. Of rows with
equal text the largest doc_id stays (null ids come last), of repeated rows with that doc_id
one, whichever was read first. An empty table gives an empty result. Extra columns are kept
by ``exact_groups`` in ``_row`` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stamped, stored

BLOCK_BYTES = 4096
#: Stands for the missing right half of an odd pair; names are never negative.
NOTHING = -1


def _named(distinct: DataFrame, columns: list[str], kept: list[Column], name: str) -> DataFrame:
    """Integer names for distinct rows, in sorted order inside each partition."""
    ordered = distinct.sortWithinPartitions(*columns)
    return stored(ordered.select(*kept, F.monotonically_increasing_id().alias("name")), name)


def _block_names(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rid, pos, name, n) of every block, and the names' own table."""
    octets = F.coalesce(F.col("_row.text"), F.lit("")).cast("binary")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("octets") / block_bytes) - 1, F.lit(0)).cast("int"))
    blocks = F.transform(cuts, lambda i: F.substring(F.col("octets"), i * block_bytes + 1, F.lit(block_bytes)))
    cut = rows.select("_rid", octets.alias("octets")).select("_rid", blocks.alias("blocks"))
    listed = cut.select("_rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    seed = 0
    while True:
        key = [F.xxhash64(F.lit(2 * seed + i), "block").alias(f"k{i}") for i in (0, 1)]
        names = _named(listed.select("block").distinct(), ["block"], key, "block-names")
        if names.groupBy("k0", "k1").count().where("count > 1").isEmpty():
            break
        seed += 1
    keyed = listed.select("_rid", "pos", "n", *key)
    return keyed.join(names, ["k0", "k1"]).select("_rid", "pos", "n", "name"), names


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_rid, level, name): equal (level, name) exactly for equal texts. ``rows`` are stamped."""
    level, done = 0, []
    current = stored(_block_names(rows, block_bytes)[0], "names-0")
    most = current.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(current.where("n = 1").select("_rid", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        open_ = current.where("n > 1")
        half = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name")))
        pairs = open_.groupBy("_rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            half(0).alias("a"), F.coalesce(half(1), F.lit(NOTHING)).alias("b"), F.ceil(F.max("n") / 2).cast("int").alias("n"))
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], [F.col("a"), F.col("b")], f"pair-names-{level}")
        level, most = level + 1, -(-most // 2)
        current = stored(pairs.join(names, ["a", "b"]).select("_rid", "pos", "n", "name"), f"names-{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` (needs doc_id, text) as ``_row`` with keep_id, group_size, kept, text_sha256.

    Group sizes and the staying row are combined map-side; only groups of two or more are
    joined back, from a stored table, so that a group holding a third of all rows is split
    by the adaptive skew join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stamped(docs, "exact-rows", F.sha2(text, 256).alias("text_sha256"))
    named = identities(rows, block_bytes)
    ids = rows.select("_rid", F.col("_row.doc_id").alias("doc_id"))
    tagged = stored(named.join(ids, "_rid"), "exact-identities")
    best = F.max(F.struct("doc_id", (-F.col("_rid")).alias("first")))
    groups = tagged.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select("level", "name", F.col("best.doc_id").alias("keep_id"), (-F.col("best.first")).alias("keep_rid"), "group_size"), "exact-groups")
    marked = tagged.join(groups, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    marks = marked.select(
        "_rid",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
    )
    return rows.join(marks, "_rid")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per text, columns as given."""
    return exact_groups(docs).where("kept").select("_row.*")


def op1(docs: DataFrame) -> DataFrame:
    found = exact_groups(docs.select("doc_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
