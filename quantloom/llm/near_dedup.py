"""Operator 6, near-dedup with fast similarity sketching.

Sketch: a document's shingles are thrown into ``COORDINATES`` bins round by round. In round
``i`` of the first half each shingle is hashed to one bin with the value (i, hash); in the
second half round ``T + i`` puts every shingle into bin ``i``, so no bin stays empty. A bin keeps its least value, and
rounds stop once all bins are full. Two sketches agree in a share of bins that is concentrated around the
similarity as if the bins were drawn independently.

Bands of ``ROWS`` bins make buckets. At similarity 0.8 a pair shares no bucket with a chance of
(1 - 0.8^5)^32 = 3e-6. Before exact work a pair must agree in ``LEAST_EQUAL`` of 160 bins, five
standard deviations below the expected 128.

Linking without listing pairs: documents with equal shingle sets become one class. Buckets
with equal members are looked at once. Members of a bucket are compared inside one task, in blocks of
bounded size (a large bucket gives a task for each pair of its blocks): a union-find over the block takes the
first member's links first, and only pairs that are still apart, that share no bucket of an earlier
band (told by the full band hashes) and that pass the sketch bound are compared on their full shingle sets. A task gives
back its links as a forest, fewer rows than it has members. Nothing is capped.

Components come from alternating large-star and small-star steps on the links, on written tables.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with
nothing; their component is their own id. A text of fewer words than a shingle has one shingle, all its words. Rows
with one doc_id and equal text are one document. Null ids: a component's id is the least
that is not null; a row with a null id is kept only where its component has no other id. An empty table gives
an empty result. Extra columns pass through ``near_dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
LEAST_EQUAL = 103
#: Members and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Words of a shingle, and the similarity in percent, unless told otherwise.
WORDS, PERCENT = 5, 80
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """64-bit shingle sets of texts; remembers word hashes up to a bound."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > 500_000:
                self.known.clear()
            value = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def shingles(self, octets: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes. bytes.lower() folds A-Z, bytes.split() cuts at ASCII white space."""
        found = (octets or b"").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        ids = np.fromiter(map(self._hash, found), np.uint64, len(found))
        width = min(self.words, len(ids))
        value = np.full(len(ids) - width + 1, width, np.uint64)
        for i in range(width):
            value = _mix(value ^ ids[i : len(ids) - width + 1 + i]) + _U(i)
        return np.unique(value)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bin values of a set that is not empty."""
    t = COORDINATES
    best = np.full(t, _EMPTY)
    at_once = max(1, 4096 // len(shingles))
    first = 0
    while first < 2 * t:
        count = min(at_once, (t if first < t else 2 * t) - first)
        rounds = np.arange(first, first + count, dtype=np.uint64)[:, None]
        drawn = _mix(shingles[None, :] ^ _mix(rounds * _U(0x9E3779B97F4A7C15) + _U(1)))
        value = (rounds << _U(48)) | (drawn >> _U(16))
        if first < t:
            bins = ((drawn & _U(0xFFFF)) * _U(t)) >> _U(16)
            np.minimum.at(best, bins.ravel().astype(np.int64), value.ravel())
        else:
            bins = np.arange(first - t, first - t + count)
            best[bins] = np.minimum(best[bins], value.min(1))
        if best.max() < _EMPTY:
            break
        first += count
    return best


def _bands(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS)
    value = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        value = _mix(value ^ rows[:, i]) + _U(i)
    return value.view(np.int64)


def sketched(text: Column, words: int) -> Column:
    """Struct (n, k0, k1, signs, bands): set size, 128-bit set key, low byte of each bin, band hashes."""
    kind = "n long, k0 long, k1 long, signs binary, bands array<long>"
    shinglers: list[Shingler] = []

    @F.arrow_udf(kind)
    def make(texts: pa.Array) -> pa.Array:
        if not shinglers:
            shinglers.append(Shingler(words))
        n, key, signs, bands = [], [], [], []
        for octets in texts.cast(pa.binary()).to_pylist():
            found = shinglers[0].shingles(octets)
            n.append(len(found))
            if len(found):
                best = sketch(found)
                key.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                signs.append((best & _U(0xFF)).astype(np.uint8).tobytes())
                bands.append(_bands(best))
            else:
                key.append(np.zeros(2, np.int64))
                signs.append(b"")
                bands.append(np.empty(0, np.int64))
        keys = np.array(key, np.int64).reshape(-1, 2)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands])]), pa.int32())
        listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*bands, np.empty(0, np.int64)]), pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(signs, pa.binary()), listed], ["n", "k0", "k1", "signs", "bands"])

    return make(text)


def _tasks(classes: DataFrame) -> DataFrame:
    """(g0, g1, g2, bucket, band, side, cid, ...): the members of buckets, dealt to tasks of bounded size."""
    banded = classes.select("cid", "n", F.posexplode("bands").alias("band", "hash")).select(
        "cid", "n", "band", F.xxhash64("band", "hash").alias("bucket"))
    buckets = banded.groupBy("band", "bucket").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("cid")).alias("content"), F.sum("n").alias("load")).where("members > 1")
    # of buckets with the same members, the one of the first band
    same = buckets.groupBy("members", "content").agg(F.min(F.struct("band", "bucket", "load")).alias("first"))
    same = stored(same.select("first.*", "members"), "near-buckets")
    small = (F.col("members") <= BLOCK_ROWS) & (F.col("load") <= BLOCK_SHINGLES)
    packs = max(1, -(-(same.where(small).agg(F.sum("load")).first()[0] or 0) // BLOCK_SHINGLES))
    wide = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int")
    same = same.withColumn("blocks", F.when(small, 1).otherwise(F.greatest(wide, F.lit(2))))
    member = banded.select("cid", "bucket").join(same, "bucket")
    own = F.pmod(F.xxhash64("cid", "bucket"), F.col("blocks")).cast("int")
    member = member.select("cid", "bucket", "band", "blocks", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    return member.select(
        "cid", "bucket", "band",
        F.when(alone, F.lit(0)).otherwise(F.col("bucket")).alias("g0"),
        F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.least("own", "other").cast("long")).alias("g1"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("own", "other")).alias("g2"),
        # within a pair of two blocks only pairs across are compared
        F.when(F.col("own") == F.col("other"), F.lit(0)).when(F.col("own") < F.col("other"), F.lit(1)).otherwise(F.lit(2)).alias("side"))


def _linker(words: int, percent: int):
    """Function from the members of some buckets to links that connect them as far as they are similar."""

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def bucket(ids, sizes, signs, sides, earlier, shingles, links) -> None:
        m = len(ids)
        parent = np.arange(m)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def look(i: int, j: int) -> None:
            a, b = root(i), root(j)
            if a != b and similar(shingles(i), shingles(j)):
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))

        def candidates(rows: np.ndarray) -> np.ndarray:
            equal = signs[rows][:, None, :] == signs[None, :, :]
            fit = equal.sum(2) >= LEAST_EQUAL
            small, large = np.minimum(sizes[rows][:, None], sizes), np.maximum(sizes[rows][:, None], sizes)
            fit &= 100 * small >= percent * large
            fit &= (sides[rows][:, None] == 0) | (sides[rows][:, None] != sides)
            return fit

        for j in np.flatnonzero(candidates(np.array([0]))[0]):
            if j:
                look(0, int(j))
        step = max(1, (1 << 25) // (m * COORDINATES))
        for low in range(0, m, step):
            rows = np.arange(low, min(low + step, m))
            roots = np.array([root(i) for i in range(m)])
            fit = candidates(rows) & (roots[rows][:, None] != roots) & (np.arange(m) > rows[:, None])
            for i, j in zip(*np.nonzero(fit), strict=True):
                # a pair that shares an earlier bucket was compared there
                if not (earlier[low + i] == earlier[j]).any():
                    look(low + int(i), int(j))

    def link(members: pa.Table) -> pa.Table:
        shingler, links, cache = Shingler(words), [], {}
        cid = members["cid"].to_numpy()
        bucket_of, band_of = members["bucket"].to_numpy(), members["band"].to_numpy()
        size, side = members["n"].to_numpy(), members["side"].to_numpy()
        sign = np.frombuffer(b"".join(members["signs"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        hashes = np.array(members["bands"].to_pylist(), np.int64).reshape(-1, BANDS)
        texts = members["octets"].combine_chunks()
        order = np.lexsort((cid, bucket_of))
        for rows in np.split(order, np.flatnonzero(np.diff(bucket_of[order])) + 1):
            def shingles(i: int, rows=rows) -> np.ndarray:
                key = cid[rows[i]]
                if key not in cache:
                    cache[key] = shingler.shingles(texts[int(rows[i])].as_py())
                return cache[key]

            if len(rows) > 1:
                bucket(cid[rows], size[rows], sign[rows], side[rows], hashes[rows, : band_of[rows[0]]], shingles, links)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return link


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the component's least node."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.where("a <> b").select(high, low).distinct(), "links")
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "large-star-least")
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "large-star")
        least = stored(large.groupBy("a").agg(F.min("b").alias("least")), "small-star-least")
        moved = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = stored(moved.unionAll(least.select("a", F.col("least").alias("b"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id, kept), a row for each row of ``docs`` (needs doc_id, text).

    ``root`` names the component whatever its ids are; null without shingles."""
    text_hash = F.xxhash64("text").alias("text_hash")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_hash, sketched(F.col("text"), words).alias("s"))
    rows = stored(rows.select("rid", "doc_id", "text_hash", "s.*"), "near-rows")
    first = F.min(F.struct("rid", "doc_id", "text_hash")).alias("rep")
    classes = rows.where("n > 0").groupBy("k0", "k1").agg(
        first, F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("signs").alias("signs"), F.first("bands").alias("bands"))
    classes = stored(classes.select(F.col("rep.rid").alias("cid"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"), "least_id", "k0", "k1", "n", "signs", "bands"), "near-classes")
    dealt = stored(_tasks(classes), "near-tasks")
    asked = classes.join(dealt.select("cid").distinct(), "cid").select(
        "cid", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n", "signs", "bands")
    texts = docs.select("doc_id", text_hash, F.col("text").cast("binary").alias("octets"))
    found = texts.join(asked, texts["doc_id"].eqNullSafe(asked["id"]) & (texts["text_hash"] == asked["hash"])).select("cid", "n", "signs", "bands", "octets")
    # rows that repeat a class's text are one; combined before they move
    found = found.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "signs", "bands", "octets")])
    members = dealt.join(found, "cid")
    links = stored(members.groupBy("g0", "g1", "g2").applyInArrow(_linker(words, percent), "a long, b long"), "near-links")
    named = components(links)
    owned = classes.select("cid", "least_id", "k0", "k1").join(named, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    ids = stored(owned.groupBy("root").agg(F.min("least_id").alias("component_id")), "near-components")
    by_key = stored(owned.join(ids, "root").select("k0", "k1", "root", "component_id"), "near-keys")
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "k0", "k1").join(by_key.withColumn("some", F.lit(1)), ["k0", "k1"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "root", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, columns as given: of each group the one of least doc_id (null ids last, then least text
    hash), and all without shingles. Rows that repeat both doc_id and text are one document and stay together."""
    named = stored(groups(docs, words, percent).select("root", "doc_id", "text_hash"), "near-named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    one = named.where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    kept = one.unionByName(named.where("root IS NULL").drop("root")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_hash"))
    return row.join(stored(kept, "near-kept"), same, "left_semi").select("_row.*")


def op6(docs: DataFrame) -> DataFrame:
    return groups(docs.select("doc_id", "text"), words=2).select("doc_id", "n_shingles", "component_id", "kept")
