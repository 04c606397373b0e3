"""Exact and near dedup against brute force, with the defined edge cases."""

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, near_dedup
from tests.llm.conftest import prose


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_groups_edge_cases(make_docs):
    long = prose(1, 5000)
    rows = [
        (1, "a", "en", "s"), (2, "a", "en", "s"), (2, "a", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (None, "a", None, None),
        (5, long, "en", "s"), (6, long, "en", "s"), (7, long[:-1] + "!", "en", "s"), (8, "!" + long[1:], "en", "s"), (9, long[: 4096 * 2], "en", "s"),
        (10, long[: 4096 * 2] + "x", "en", "s"), (11, "é" * 3000, "fr", "s"), (12, "é" * 3000, "fr", "s"), (None, "only null id", "en", "s")]
    found = exact_dedup.exact_groups(make_docs(rows))
    got = _rows(found.select(F.col("_row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256", F.col("_row.name").alias("extra")), "doc_id", "keep_id", "group_size", "kept", "text_sha256", "extra")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            stays = i == keep and first
            first = first and not stays
            want.append((i, keep, len(ids), stays, digest, "x"))
    assert got == sorted(want, key=repr)


def test_exact_small_blocks_and_empty_table(make_docs):
    """Many levels: blocks of 3 bytes, texts that share all blocks but not their order."""
    texts = ["abcabcabc", "abcabcabcd", "abcabc", "defabcabc", "abcdefabc", "abcabcabc", "abc" * 40, "abc" * 41, "abc" * 40]
    docs = make_docs([(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs, block_bytes=3).select("_row.doc_id", "keep_id").collect()}
    assert got == {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(texts))


def _components(texts: dict, k: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def _edited(text: str, edits: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    words = text.split()
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"e{rng.integers(10**6)}"
    return " ".join(words)


def test_near_groups_against_all_pairs(make_docs, monkeypatch):
    """Chains of copies with growing edits, in buckets that are cut into several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    base = prose(5, 300)
    texts = {i: _edited(base, i % 25, i) for i in range(60)}
    texts |= {100 + i: prose(100 + i, 120) for i in range(30)}
    texts |= {200: None, 201: "", 202: " \t\n", 203: "one", 204: "ONE", 205: "one two", 206: "ONE\u00a0two", 207: base.upper(), 208: prose(9, 20000), 209: prose(9, 20000) + " end"}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()] + [(207, base.upper(), "en", "s")])
    got = near_dedup.groups(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = _components(texts, 2)
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_pair_with_equal_low_bytes_in_an_earlier_band():
    """Two similar members agree in the low bytes of band 0 but share no bucket there; a third member comes first in their bucket of band 3."""
    texts = [prose(1, 200), prose(2, 200), prose(2, 200) + " end"]
    signs = np.random.default_rng(1).integers(0, 256, (3, near_dedup.COORDINATES)).astype(np.uint8)
    signs[2] = signs[1]
    bands = np.arange(3 * near_dedup.BANDS).reshape(3, -1)
    bands[:, 3] = 7
    members = pa.table({
        "cid": [10, 11, 12], "bucket": [5, 5, 5], "band": [3, 3, 3], "side": [0, 0, 0], "n": [196, 196, 197],
        "signs": [x.tobytes() for x in signs], "bands": bands.tolist(), "octets": [t.encode() for t in texts]})
    links = near_dedup._linker(5, 80)
    assert links(members).to_pylist() == [{"a": 11, "b": 12}]
    # a pair that shares the bucket of band 0 was compared there
    bands[2, 0] = bands[1, 0]
    assert links(members.set_column(6, "bands", pa.array(bands.tolist()))).num_rows == 0


def test_near_dedup_keeps_columns_and_null_ids(make_docs):
    text = prose(3, 200)
    docs = make_docs([(None, text, "en", "s"), (7, text + " more", "en", "s"), (None, prose(4, 50), "en", "s"), (None, None, "en", "s"), (8, None, None, None)])
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, text + " more"), (None, prose(4, 50)), (None, None), (8, None)], key=repr)
    assert near_dedup.near_dedup(make_docs([])).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(make_docs):
    base, other = prose(1, 200), prose(2, 200)
    rows = [(None, base, None, None), (None, base + " end", None, None), (7, other, None, None), (7, other + " end", None, None), (None, other + " more", None, None), (9, None, None, None), (9, "", None, None)]
    kept = near_dedup.near_dedup(make_docs(rows)).collect()
    near_base = [r for r in kept if r.text and r.text.startswith(base)]
    near_other = [r for r in kept if r.text and r.text.startswith(other)]
    assert len(near_base) == 1 and len(near_other) == 1 and near_other[0].doc_id == 7
    assert sorted((r.doc_id, r.text or "") for r in kept if not r.text) == [(9, ""), (9, "")]


def test_sketch_agreement_follows_similarity():
    """Agreement of sketches is near the true similarity, for sets smaller and larger than the sketch."""
    rng = np.random.default_rng(1)
    for size in (12, 150, 3000):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64)
            cut = size // 10
            a, b = np.unique(pool[:size]), np.unique(pool[cut : size + cut])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_sketch_fills_every_bin():
    for n in (1, 2, 7, 5000):
        values = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        best = near_dedup.sketch(np.unique(values))
        assert best.max() < np.iinfo(np.uint64).max and len(best) == near_dedup.COORDINATES


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299), (299, 300)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {299: 299, 300: 299}
