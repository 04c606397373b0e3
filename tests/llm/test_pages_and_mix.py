"""URL filters and mixing against brute force, with the defined edge cases; the pipeline's stages."""

import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm import mixing, queries, url_filter
from tests.llm.conftest import prose


def _judge(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, default))
    return host, path, best[1], best[2]


def test_url_rules_against_brute_force(spark):
    rules = [*url_filter.RULES, ("a.example.com", "/en/x", "block"), ("a.example.com", "/en/xy/", "allow"), ("a.example.com", "/en/xy/z", "block"), ("org", "", "block"), ("b.org", "/q", "allow"), ("b", "", "block"), ("com", "/\U0010ffff", "block")]
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a.example.com", "b.a.example.com", "xexample.com", "m.net", "net", "b.org", "c.b.org", "org", ".com", "com.", "exam ple.com", "exämple.com", "b\x01c.org", "org\x01b", "example.com\x01", ".".join("abcdefghij" * 12) + ".org"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/en/xy/", "/en/xy/zzz", "/es/1", "/fr/?q=/en/", "/q#/en/", "?/en/", "/EN/", "/en/\nx", "/en/\U0010ffffx", "/en/\U0010ffff\U0010ffff", "/\x01", "/en/" + "x" * 30_000]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no url", "://", "http://", "x://y://com/", "http://com/", "http://com/"]
    pages = spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, _row string")
    judged = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r.page_id: tuple(r)[1:] for r in judged.select("_row.page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {i: _judge(u, rules) for i, u in enumerate(urls)}
    assert url_filter.op7(pages.limit(0)).count() == 0


def test_equally_long_rules_and_two_verdicts(spark):
    rules = [("b.org", "/", "allow"), ("org", "/xy", "block"), ("x.net", "/a", "block"), ("x.net", "/a", "allow")]
    urls = ["http://b.org/xyz", "http://x.net/abc"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("_row.page_id").collect()
    # of equally long rules the longer path's text sorts last; of two verdicts "allow" sorts first
    assert [(r.rule, r.verdict) for r in judged] == [("org/xy", "block"), ("x.net/a", "allow")]


def test_mix_meets_targets(make_docs):
    rows = [(i, prose(i, 1 + i % 50), "en", f"s{i % 7 if i % 3 else 0}") for i in range(600)]
    rows += [(700, None, None, "s1"), (701, "", None, None), (702, "null source here", None, None), (703, prose(1, 4000), None, "s2"), (703, prose(1, 4000), None, "s2"), (704, " \t ", None, "only blanks"), (None, "a b c", None, "s1")]
    docs = make_docs(rows)
    out = mixing.op9(docs).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.op9(docs.repartition(5)).collect()))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    aim = {s: 3.0 * sizes[s] if s in capped else weights[s] * level for s in sizes}
    source_of = {i: s for i, _, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.target == pytest.approx(aim[source_of[r.doc_id]]) and r.source_size == sizes[source_of[r.doc_id]]
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[source_of[r.doc_id]] += r.taken
    largest = {s: max(len((t or "").split()) for _, t, _, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - aim[s]) <= largest[s] for s in sizes)
    assert mixing.op9(make_docs([])).count() == 0


def test_mix_weights_make_unequal_chances(make_docs):
    docs = make_docs([(i, prose(i, 20), "en", "a" if i % 2 else "b") for i in range(2000)]).withColumn("w", F.when(F.col("doc_id") < 1000, 3.0).otherwise(1.0))
    out = mixing.mix(docs, weight="w").groupBy((F.col("_row.doc_id") < 1000).alias("heavy")).agg(F.sum("taken").alias("n")).collect()
    n = {r.heavy: r.n for r in out}
    assert 2.0 < n[True] / n[False] < 4.0


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.stored(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] < left[0]
    assert docs.select("text").distinct().count() == docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert mixed.count() == left[-1]


def test_pipeline_runs_on_odd_rows_and_on_empty_tables(spark, make_docs, tmp_path):
    import corpus_pipeline

    insult = "you are a stupid worthless idiot and I will hurt you"
    rows = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, f"{prose(900 + i, 30)} {insult} {prose(950 + i, 20)}", "en", "s0") for i in range(40)]
    rows += [(200, rows[3][1], "en", "s1"), (201, rows[4][1] + " tail", "en", "s1"), (202, None, None, None), (203, "", None, "s1"), (None, prose(77, 60), None, "s2"), (204, "huge " * 300_000, None, "s2")]
    rows += [(205, rows[5][1], "en", "s1")] * 2
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(40), *range(100, 140)]], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("b0", " ".join(rows[6][1].split()[20:40])), ("b1", None)], "item_id string, text string")
    for name, n in (("full", None), ("none", 0)):
        folder = str(tmp_path / name)
        for table, df in (("documents", make_docs(rows)), ("labels", labels), ("benchmark", items)):
            (df if n is None else df.limit(n)).write.parquet(f"{folder}/{table}.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        if n == 0:
            assert out == []
            continue
        left = {r.doc_id: r for r in out}
        assert 6 not in left  # holds a benchmark passage
        assert 3 not in left and 200 in left  # of equal texts the largest id stays
        assert len({4, 201} & set(left)) == 1 and 4 in left  # of near copies the smallest
        assert {203, 204, None} <= set(left) and 202 not in left  # null counts as empty
        sizes = {i: len((t or "").split()) for i, t, *_ in rows}
        assert all(r.size == sizes[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size for r in out)
