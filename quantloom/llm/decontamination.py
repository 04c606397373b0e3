"""Operator 3, benchmark decontamination over a distributed positional inverted index.

Index: one row per document with its postings (term, place) in term order, for the terms that
the benchmark uses; no other list can ever be read. It is written once in shards of documents
as they are read, so nothing is shuffled. Spark then counts in how many documents each term
stands. Search: a benchmark window takes the list of its rarest term, less that term's
offset, and intersects it with the offset-adjusted list of the next rarest term, and so on
to the most frequent one. What is left are the exact phrase's places. With ``slop`` above 0 a
term may stand that many words off its place: proximity matches. Intersection runs shard by
shard on sorted lists in NumPy, in batches of bounded size.

The benchmark is a stated query set and is taken in blocks of at most ``block_words`` words; one
block's terms and windows travel with the function, whatever the benchmark's size.

Defined results: null text has no words. An item without words has no windows; one of fewer
words than the window is one window. Repeated item ids count as one item; a null item id
is the item "null". Repeated rows are judged alike. No cap on documents, lists or matches. An
empty benchmark leaves every document clean. Extra columns stay in ``_row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

SIZE = 10
BLOCK_WORDS = 500_000
#: Candidate places handled at once.
CHUNK = 1 << 18
#: Words are runs of 0-9, a-z and non-ASCII (fixed values of the contract); all else becomes a blank.
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(octets: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased."""
    return (octets or b"").translate(_FOLD).split()


@dataclass
class Queries:
    """A block of benchmark windows; terms and items as numbers."""

    vocabulary: dict[bytes, int]
    items: list[str]
    terms: np.ndarray  # windows x SIZE, padded with the first term
    offsets: np.ndarray  # windows x SIZE, padded with the first offset
    lengths: np.ndarray
    item_of: np.ndarray

    def by_rarity(self, documents: np.ndarray) -> Queries:
        """Terms of each window from the rarest to the most frequent. Padding repeats the rarest."""
        counts = documents[self.terms]
        inside = np.arange(self.terms.shape[1]) < self.lengths[:, None]
        order = np.argsort(np.where(inside, counts, np.iinfo(np.int64).max), axis=1, kind="stable")
        terms, offsets = (np.take_along_axis(x, order, 1) for x in (self.terms, self.offsets))
        terms, offsets = np.where(inside, terms, terms[:, :1]), np.where(inside, offsets, offsets[:, :1])
        return Queries(self.vocabulary, self.items, terms, offsets, self.lengths, self.item_of)


def _block(items: list[tuple[str, list[bytes]]], size: int) -> Queries:
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    seen: set = set()
    rows, lengths, owners = [], [], []
    for name, found in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in found]
        for start in range(max(1, len(ids) - size + 1)):
            window = ids[start : start + size]
            if (key := (name, *window)) not in seen:
                seen.add(key)
                rows.append(window + [window[0]] * (size - len(window)))
                lengths.append(len(window))
                owners.append(number[name])
    length = np.array(lengths, np.int64)
    offsets = np.tile(np.arange(size, dtype=np.int64), (len(rows), 1))
    offsets[offsets >= length[:, None]] = 0
    return Queries(vocabulary, names, np.array(rows, np.int64).reshape(-1, size), offsets, length, np.array(owners, np.int64))


def blocks(benchmark: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS) -> Iterator[Queries]:
    """The benchmark's windows, block by block; the driver holds one block."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("octets"))
    held: list = []
    total = 0
    for row in rows.toLocalIterator():
        found = words(row.octets)
        if held and total + len(found) > block_words:
            yield _block(held, size)
            held, total = [], 0
        if found:
            held.append((row.item, found))
            total += len(found)
    if held:
        yield _block(held, size)


def postings(text: Column, vocabulary: dict[bytes, int]) -> Column:
    """Struct (n_words, terms, places): the vocabulary's terms in a text, by term and place."""

    @F.arrow_udf("n_words int, terms array<int>, places array<int>")
    def index(texts: pa.Array) -> pa.Array:
        get = vocabulary.get
        counts, terms, places = [], [], []
        for octets in texts.cast(pa.binary()).to_pylist():
            found = words(octets)
            ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
            order = np.flatnonzero(ids >= 0)
            order = order[np.argsort(ids[order], kind="stable")]
            counts.append(len(found))
            terms.append(ids[order])
            places.append(order.astype(np.int32))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.empty(0, np.int32)]), pa.int32())) for x in (terms, places)]
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), *lists], ["n_words", "terms", "places"])

    return index(text)


def document_counts(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term of the block stands (a bounded table: one row per term)."""
    rows = index.select(F.explode(F.array_distinct("post.terms")).alias("term")).groupBy("term").count().collect()
    out = np.zeros(terms, np.int64)
    for term, n in rows:
        out[term] = n
    return out


def intersect(queries: Queries, terms: np.ndarray, places: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, starts) that occur among postings of one shard; ``places`` count through the shard."""
    if not len(terms) or not len(queries.terms):
        return
    span = int(places.max()) + 2 * (slop + queries.terms.shape[1]) + 1
    lists = np.sort(terms.astype(np.int64) * span + places)
    first = np.searchsorted(lists, queries.terms[:, 0] * span)
    n = np.searchsorted(lists, (queries.terms[:, 0] + 1) * span) - first
    ends = np.cumsum(n)
    for low in range(0, int(ends[-1]), CHUNK):
        at = np.arange(low, min(low + CHUNK, int(ends[-1])))
        window = np.searchsorted(ends, at, side="right")
        spot = lists[first[window] + at - (ends[window] - n[window])]
        start = spot - queries.terms[window, 0] * span - queries.offsets[window, 0]
        for k in range(1, queries.terms.shape[1]):
            wanted = queries.terms[window, k] * span + start + queries.offsets[window, k]
            near = np.searchsorted(lists, wanted - slop)
            fits = lists[np.minimum(near, len(lists) - 1)]
            kept = (near < len(lists)) & (fits <= wanted + slop) & (fits >= wanted - slop)
            window, start = window[kept], start[kept]
        if len(window):
            yield window, start


def matches(post: Column, queries: Queries, slop: int = 0) -> Column:
    """Struct (spans, items): disjoint [low, high) word ranges of the matches, and the items matched."""
    kind = "spans array<struct<low:int,high:int>>, items array<string>"

    @F.arrow_udf(kind)
    def search(found: pa.Array) -> pa.Array:
        sizes = found.field("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = found.field("terms")
        counts = np.diff(np.asarray(lists.offsets))
        # documents stand apart, so that no match reaches from one into the next
        base = np.concatenate([[0], np.cumsum(sizes + 2 * (queries.terms.shape[1] + slop) + 2)]) + queries.terms.shape[1] + slop
        terms = np.asarray(lists.flatten())
        places = np.asarray(found.field("places").flatten()).astype(np.int64) + np.repeat(base[:-1], counts)
        spans: list[list] = [[] for _ in sizes]
        items: list[list] = [[] for _ in sizes]
        pairs, edges = set(), []
        for window, start in intersect(queries, terms, places, slop):
            doc = np.searchsorted(base, start + slop, side="right") - 1
            pairs.update(zip(*np.unique(np.stack([doc, queries.item_of[window]]), axis=1).tolist(), strict=True))
            edges.append(np.unique(np.stack([start, start + queries.lengths[window], doc]), axis=1))
        if edges:
            low, high, doc = np.unique(np.concatenate(edges, axis=1), axis=1)
            reach = np.maximum.accumulate(high)
            opens = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
            closes = np.concatenate([opens[1:], [len(low)]]) - 1
            for a, b in zip(opens, closes, strict=True):
                d = int(doc[a])
                spans[d].append({"low": max(0, int(low[a] - base[d])), "high": min(int(sizes[d]), int(reach[b] - base[d]))})
            for d, item in sorted(pairs):
                items[d].append(queries.items[item])
        shape = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(spans, shape), pa.array(items, pa.list_(pa.string()))], ["spans", "items"])

    return search(post)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct(
        (a["total"] + F.greatest(s["high"] - F.greatest(s["low"], a["reach"]), F.lit(0))).alias("total"), F.greatest(a["reach"], s["high"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["total"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = 0, block_words: int = BLOCK_WORDS, along: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (needs text) as ``_row`` with n_words, n_hit, n_items, items, spans.

    ``_row`` is written with the index; ``along`` limits it to these columns. With ``slop`` the items are
    those with a proximity match, and spans are the places the phrases would take.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in along or docs.columns]).alias("_row")
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), row, F.col("text").alias("_text"))
    each = blocks(benchmark, size, block_words)
    first = next(each, None) or _block([], size)
    if next(each, None) is None:
        return _judged(_searched(rows, first, slop))
    # several blocks are put together by row, so rows get fixed ids first
    return _in_blocks(stored(rows, "decontamination-rows"), benchmark, size, slop, block_words)


def _searched(rows: DataFrame, queries: Queries, slop: int) -> DataFrame:
    index = stored(rows.select("_rid", "_row", postings(F.col("_text"), queries.vocabulary).alias("post")), "postings")
    ranked = queries.by_rarity(document_counts(index, len(queries.vocabulary))) if len(queries.terms) else queries
    found = index.select("_rid", "_row", F.col("post.n_words").cast("long").alias("n_words"), matches(F.col("post"), ranked, slop).alias("found"))
    return found.select("_rid", "_row", "n_words", "found.spans", "found.items")


def _in_blocks(rows: DataFrame, benchmark: DataFrame, size: int, slop: int, block_words: int) -> DataFrame:
    slim = rows.select("_rid", F.struct("_rid").alias("_row"), "_text")
    parts = None
    for queries in blocks(benchmark, size, block_words):
        part = stored(_searched(slim, queries, slop).select("_rid", "n_words", "spans", "items"), "block-matches")
        parts = part if parts is None else parts.unionAll(part)
    whole = parts.groupBy("_rid").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return _judged(rows.join(whole, "_rid"))


def _judged(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct("items"))
    return found.select("_row", "n_words", _covered(F.col("spans")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a benchmark passage, columns as given."""
    return contamination(docs, benchmark).where("n_hit = 0").select("_row.*")


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark, along=["doc_id"])
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM starts),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM cut, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.s, p.n, x.item FROM places p JOIN windows x ON p.n = x.n AND array_to_string(p.w[p.s:p.s + p.n - 1], ' ') = x.g),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT c.doc_id, len(c.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
