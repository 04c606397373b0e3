"""Operator 13, a prefix trie of conversations in balanced parentheses, built in shards.

**Nodes.** Every (role, text) becomes a digest; a prefix is named by its depth and four running sums of hashes of
(depth, digest), 128 bits in all, so prefixes need no ordered gathering. A node belongs to its smallest member; one conversation's own nodes
are a run of depths down to its last turn, hung on a node of a smaller conversation. (conv_id, depth) names a node.

**Compact tree.** Nodes where a conversation ends or another one is hung on keep their place; runs of nodes between them,
which have the same members, are edges. There are at most two kept nodes for each conversation, whatever its length.

**Shards.** Nodes with more than the square root of all turns as members are the spine: at most the square root of all turns of
them. The subtrees below are whole in one shard, none with more members than that root, so both are bounded. A shard is a
forest of subtrees in balanced parentheses (``Parentheses``): the excess in blocks with their minima gives ``findclose``, which
delimits a subtree; ranks of ``()`` count its leaves; cumulative edge savings, read at both ends, give its savings. Totals of the shards' subtrees are
summed per spine node and the shared spine is encoded the same way, with these totals as weights.

Defined results: a null role or text is empty; null turns come first; rows that tie in turn are ordered by role, then by SHA-256 of role and text.
Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A table
without conversations gives no node, not even a root. Very long texts are digested where they are read; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import stored
from quantloom.llm.streams import grouped, joined_sha256, running_sums, stream

NAME = ["depth", "p1", "p2", "p3", "p4"]
#: Least bound of a subtree's members, least number of nodes encoded together, and parentheses in a block of the excess.
MEMBERS, TOGETHER, BLOCK = 1024, 4096, 256


# -- balanced parentheses -----------------------------------------------------------------


class Parentheses:
    """A forest as a sequence of +1 (open) and -1 (close)."""

    def __init__(self, parent: list[int]) -> None:
        """``parent`` per node, -1 for roots. ``order`` lists the nodes as they open."""
        below: list[list[int]] = [[] for _ in parent]
        stack = []
        for node, up in enumerate(parent):
            (below[up] if up >= 0 else stack).append(node)
        order, signs = [], []
        while stack:
            node = stack.pop()
            if node < 0:
                signs.append(-1)
                continue
            order.append(node)
            signs.append(1)
            stack.append(-1)
            stack.extend(below[node])
        self.order = np.array(order, np.int64)
        self.signs = np.array(signs, np.int8)
        self.excess = np.cumsum(self.signs, dtype=np.int64)
        self.opens = np.flatnonzero(self.signs == 1)
        self._least = np.minimum.reduceat(self.excess, np.arange(0, len(signs), BLOCK)) if signs else self.excess

    def findclose(self, at: int) -> int:
        """Place of the parenthesis that closes the one opened at ``at``: the first later place of lower excess."""
        goal = self.excess[at] - 1
        first = at // BLOCK
        inside = self.excess[at + 1 : (first + 1) * BLOCK]
        hit = np.flatnonzero(inside <= goal)
        if len(hit):
            return at + 1 + int(hit[0])
        block = first + 1 + int(np.argmax(self._least[first + 1 :] <= goal))
        return block * BLOCK + int(np.argmax(self.excess[block * BLOCK : (block + 1) * BLOCK] <= goal))

    def closes(self) -> np.ndarray:
        near = np.flatnonzero(np.append(self.signs[1:], 0)[self.opens] == -1)  # leaves close at once
        out = np.empty(len(self.opens), np.int64)
        out[near] = self.opens[near] + 1
        far = np.setdiff1d(np.arange(len(self.opens)), near, assume_unique=True)
        out[far] = [self.findclose(int(self.opens[i])) for i in far]
        return out

    def totals(self, edge: np.ndarray, more_leaves: np.ndarray, more_saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node: leaves of its subtree, and the savings of the edges strictly below it.

        ``more_*`` is what hangs on a node outside this forest. A pair ``()`` is a leaf where nothing hangs on it.
        """
        size = len(self.signs)
        leaf, saved = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        pair = np.append(self.signs[1:], 0)[self.opens] == -1
        leaf[self.opens + 1] = np.where(pair & (more_leaves[self.order] == 0), 1, more_leaves[self.order])
        saved[self.opens + 1] = edge[self.order] + more_saved[self.order]
        leaf, saved = np.cumsum(leaf), np.cumsum(saved)
        closed = self.closes() + 1
        leaves, below = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
        leaves[self.order] = leaf[closed] - leaf[self.opens]
        below[self.order] = saved[closed] - saved[self.opens] - edge[self.order]
        return leaves, below


def _encoded(nodes: list[tuple]) -> Iterator[tuple]:
    """Totals of a forest's nodes (owner, depth, upper owner, upper depth, edge, more leaves, more saved)."""
    place = {node[:2]: i for i, node in enumerate(nodes)}
    tree = Parentheses([place.get(node[2:4], -1) for node in nodes])
    edge, more_leaves, more_saved = (np.array([node[k] for node in nodes], np.int64) for k in (4, 5, 6))
    leaves, below = tree.totals(edge, more_leaves, more_saved)
    for node, n, saved in zip(nodes, leaves.tolist(), below.tolist()):
        yield (*node[:2], n, saved)


_TREE = ["conv_id", "depth", "up_id", "up_depth", "edge", "more_leaves", "more_saved"]
_TOTALS = T.StructType([T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "n_leaves", "below")])


def encode_shards(nodes: DataFrame, shard: list[str]) -> DataFrame:
    """Totals of compact nodes. Subtrees of a shard key are whole; whole subtrees are encoded together up to ``TOGETHER`` nodes."""
    width = len(shard)

    def encode(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, key = [], None
        for row in rows:
            if row[:width] != key and len(held) >= TOGETHER:
                yield from _encoded(held)
                held = []
            key = row[:width]
            held.append(row[width:])
        if held:
            yield from _encoded(held)

    return stream(grouped(nodes.select(*shard, *_TREE), shard, ["conv_id", "depth"]), encode, _TOTALS)


# -- rows, names and nodes ------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, bytes): every row's place in its conversation, its digest and its text's size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("rid"), F.lit(1).alias("one"),
    )
    placed = running_sums(narrow, "trie-order", ["conv_id"], ["turn", "role", "key", "rid"], {"place": "one"})
    return stored(placed.select("conv_id", "place", "key", "bytes"), "trie-turns")


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of the trie: each conversation's head is taken from the one of its group of five.

    Turns: (conv_id, depth, key, bytes). Conversations: (conv_id, length).
    """
    own = rows.groupBy("conv_id").agg(F.max("place").alias("own"))
    head = (F.crc32(F.col("conv_id").cast("string")) % 9).alias("head")
    convs = own.select("conv_id", "own", head, (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"))
    lent = own.select(F.col("conv_id").alias("donor"), F.col("own").alias("lent"))
    taken = F.least("head", F.coalesce("lent", F.lit(0)))
    convs = stored(convs.join(lent, "donor", "left").select("conv_id", "own", "head", "donor", taken.alias("taken")), "trie-convs")
    heads = rows.where("place <= 8").select(F.col("conv_id").alias("donor"), "place", "key", "bytes")
    heads = heads.join(convs.select("donor", "conv_id", "head"), "donor").where("place <= head").select("conv_id", F.col("place").alias("depth"), "key", "bytes")
    tails = rows.join(convs.select("conv_id", "head", "taken"), "conv_id").where("place > head")
    tails = tails.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "key", "bytes")
    length = (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")
    return heads.unionByName(tails), convs.select("conv_id", length)


def prefixes(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, p1..p4, bytes, upto, ends): the name of every prefix, and its bytes down to there."""
    half = F.lit(0xFFFFFFFF)
    hashes = [F.xxhash64(F.lit(seed), "depth", "key") for seed in (1, 2)]
    parts = [p for h in hashes for p in (h.bitwiseAND(half), F.shiftrightunsigned(h, 32))]
    rows = rebuilt.select("conv_id", "depth", "bytes", *[p.alias(f"h{i}") for i, p in enumerate(parts, 1)])
    summed = running_sums(rows, "trie-sums", ["conv_id"], ["depth"], {**{f"p{i}": f"h{i}" for i in (1, 2, 3, 4)}, "upto": "bytes"})
    summed = summed.join(lengths, "conv_id").withColumn("ends", (F.col("depth") == F.col("length")).cast("long"))
    return stored(summed.select("conv_id", *NAME, "bytes", "upto", "ends"), "trie-prefixes")


def _named(df: DataFrame, owner: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in NAME], F.col("conv_id").alias(owner))


def _same_name() -> list[Column]:
    return [F.col(c) == F.col(f"_{c}") for c in NAME]


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes with their measures (see the contract's columns in ``op13``)."""
    rebuilt, lengths = rebuild(turns(conversations))
    paths = prefixes(rebuilt, lengths)
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("ends")).where("conv_id IS NOT NULL")
    zeros = [F.lit(0).cast("long").alias(c) for c in (*NAME, "bytes", "upto")]
    measured = paths.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("ends"), F.min("bytes").alias("bytes"), F.min("upto").alias("upto"))
    nodes = stored(measured.unionByName(whole.select(*zeros, "*")), "trie-nodes")
    limit = max(MEMBERS, isqrt(paths.count()))

    # where each conversation's own nodes begin, and the node of a smaller one that they hang on
    runs = nodes.groupBy("conv_id").agg(F.min("depth").alias("begin"), F.max("depth").alias("length"))
    outer = runs.where("begin > 1").select("conv_id", (F.col("begin") - 1).alias("depth")).join(paths.select("conv_id", *NAME, "upto"), ["conv_id", "depth"])
    owners = _named(nodes, "up_id")
    hung = outer.join(owners, _same_name()).select("conv_id", "up_id", F.col("depth").alias("up_depth"), "upto")
    least = whole.first()  # one row: the root's owner, or none
    above = F.lit(least and least.conv_id).cast("long").alias("up_id")
    top = runs.where("begin = 1")
    hung = stored(hung.unionByName(top.select("conv_id", above, F.lit(0).cast("long").alias("up_depth"), F.lit(0).cast("long").alias("upto"))), "trie-hung")

    compact = stored(_compact(nodes, runs, hung, whole), "trie-compact")
    totals = _totals(paths, nodes, compact, limit)
    return _unfolded(paths, nodes, lengths, compact, totals)


def _compact(nodes: DataFrame, runs: DataFrame, hung: DataFrame, whole: DataFrame) -> DataFrame:
    """Kept nodes with the kept node above them, the saving of the edge between and their number of children."""
    ending = nodes.where("ends > 0").select("conv_id", "depth", F.lit(0).alias("hung"))
    bearing = hung.select(F.col("up_id").alias("conv_id"), F.col("up_depth").alias("depth"), F.lit(1).alias("hung"))
    root = whole.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).alias("hung"))
    kept = ending.unionByName(bearing).unionByName(root).groupBy("conv_id", "depth").agg(F.sum("hung").alias("hung"))
    kept = kept.join(nodes.select("conv_id", "depth", "n_convs", "ends", "upto"), ["conv_id", "depth"]).join(runs.select("conv_id", "length"), "conv_id")
    along = Window.partitionBy("conv_id").orderBy("depth")
    kept = kept.select("*", F.lag("depth").over(along).alias("last_depth"), F.lag("upto").over(along).alias("last_upto"))
    met = kept.join(hung.select("conv_id", "up_id", F.col("up_depth").alias("hung_depth"), F.col("upto").alias("hung_upto")), "conv_id", "left")
    inner = F.col("last_depth").isNotNull()
    before = F.coalesce("last_upto", "hung_upto", F.lit(0))
    return met.select(
        "conv_id", "depth", F.when(inner, F.col("conv_id")).otherwise(F.col("up_id")).alias("up_id"), F.coalesce("last_depth", "hung_depth").alias("up_depth"),
        ((F.col("n_convs") - 1) * (F.col("upto") - before)).alias("edge"), "n_convs", "ends", "upto",
        (F.col("hung") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
    )


def _totals(paths: DataFrame, nodes: DataFrame, compact: DataFrame, limit: int) -> DataFrame:
    """(conv_id, depth, n_leaves, below) of every kept node: shards first, then the spine with what hangs on it."""
    zero = F.lit(0).cast("long")
    spine_names = F.broadcast(_named(nodes.where((F.col("n_convs") > limit) & (F.col("depth") > 0)), "_owner"))  # at most √turns rows
    shared = paths.join(spine_names, _same_name()).groupBy("conv_id").agg(F.max("depth").alias("shared"))
    owners = nodes.select("conv_id").distinct().join(shared, "conv_id", "left").select("conv_id", (F.coalesce("shared", zero) + 1).alias("depth"))
    shards = owners.join(paths.select("conv_id", *NAME), ["conv_id", "depth"]).select("conv_id", *[F.col(c).alias(f"s_{c}") for c in NAME])
    on_spine = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    light = compact.where(~on_spine).join(shards, "conv_id").withColumn("more_leaves", zero).withColumn("more_saved", zero)
    below = stored(encode_shards(light, [f"s_{c}" for c in NAME]), "trie-shards")

    spine = compact.where(on_spine)
    tops = compact.where(~on_spine).join(spine.select(F.col("conv_id").alias("up_id"), F.col("depth").alias("up_depth")), ["up_id", "up_depth"])
    hanging = tops.join(below, ["conv_id", "depth"]).groupBy("up_id", "up_depth").agg(F.sum("n_leaves").alias("more_leaves"), F.sum(F.col("edge") + F.col("below")).alias("more_saved"))
    hanging = hanging.select(F.col("up_id").alias("conv_id"), F.col("up_depth").alias("depth"), "more_leaves", "more_saved")
    spine = spine.join(hanging, ["conv_id", "depth"], "left").fillna(0, ["more_leaves", "more_saved"]).withColumn("s_depth", zero)
    return below.unionByName(encode_shards(spine, ["s_depth"]))


def _unfolded(paths: DataFrame, nodes: DataFrame, lengths: DataFrame, compact: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per node: edges are opened into the nodes they stand for."""
    last = paths.where("ends = 1").select(*NAME, F.col("conv_id").alias("member"))
    empty = lengths.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NAME], F.col("conv_id").alias("member"))
    last = last.unionByName(empty)
    owners = _named(nodes, "conv_id")
    listed = last.join(owners, _same_name()).select("conv_id", "depth", "member", F.col("member").cast("string").alias("text"))
    ended = joined_sha256(listed, ["conv_id", "depth"], ["member"], "text", ",", "ends_sha256")

    kept = compact.join(totals, ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left")
    first = F.coalesce(F.col("up_depth") + 1, F.col("depth"))
    edge_rows = kept.select("*", F.explode(F.sequence(first, F.col("depth"))).alias("here"), first.alias("first")).select(
        "conv_id", F.col("here").alias("depth"), (F.col("here") == F.col("depth")).alias("kept"), (F.col("here") == F.col("first")).alias("starts"), "up_id",
        F.col("n_children").alias("kept_children"), "n_leaves", "below", F.col("upto").alias("bottom"), "ends_sha256",
    )
    rows = nodes.select("conv_id", "depth", "n_convs", "bytes", "upto").join(edge_rows, ["conv_id", "depth"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        "conv_id", "depth", F.when(F.col("starts"), F.col("up_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("kept"), F.col("kept_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("bottom") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
        F.when(F.col("kept"), F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )


def op13(conversations: DataFrame) -> DataFrame:
    return trie(conversations)
