"""License scans and fixity audits against brute force and planted faults."""

import pytest
from pyspark.sql import functions as F

from quantloom.llm import fixity, license_scan
from quantloom.llm.decontamination import words
from tests.llm.conftest import prose


def _held(text: str, notices: dict, share: float = 0.8) -> dict:
    """Best containment of each template in the windows of its class."""
    w = words((text or "").encode())
    spots = {i: tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = {}
    for name, notice in notices.items():
        t = words(notice.encode())
        own = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        step = 4
        while step < len(t) - 1:
            step *= 2
        for start in range(0, max(1, len(w)), step):
            inside = {g for i, g in spots.items() if start <= i and i + 5 <= start + 2 * step}
            got = len(inside & own) / len(own)
            if got >= share:
                out[name] = max(out.get(name, 0), got)
    return out


def test_scan_against_brute_force(spark, make_docs):
    notices = license_scan.NOTICES
    texts = [prose(i, 40) for i in range(5)]
    for shift in range(0, 40, 3):
        texts += [f"{prose(shift, shift)} {n} {prose(shift + 1, 30)}" for n in notices.values()]
    words_ = notices["BSD-3-Clause"].split()
    texts += [" ".join(words_[:k]) for k in (5, 12, 15, 17, 18, 20)] + [" ".join(words_[:9] + ["x"] + words_[9:])]
    texts += [notices["MIT"] * 50, "released UNDER the\nmit   license", None, "", "four words only here", " ".join(notices.values()), prose(1, 30000) + " " + notices["GPL-3.0"]]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s")])
    found = license_scan.scan(docs, license_scan.notice_table(spark))
    got = {(r.doc_id, r.license): r.containment for r in found.select("_row.doc_id", "license", "containment").collect()}
    assert got == {(i, n): c for i, t in enumerate(texts) for n, c in _held(t, notices).items()}
    assert license_scan.op2(docs.limit(0)).count() == 0
    assert license_scan.scan(docs, license_scan.notice_table(spark).limit(0)).count() == 0


def test_short_template_is_refused(spark, make_docs):
    with pytest.raises(ValueError):
        license_scan.scan(make_docs([(1, "x", None, None)]), spark.createDataFrame([("a", "MIT License")], "license string, text string"))


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit("clash")).withColumn("hash", F.lit(1))


def test_audit_finds_planted_faults(spark):
    rows = [(i, f"http://h/{i}", prose(i, 20)) for i in range(-40, 3000, 7)] + [(5, None, None), (5, "u", "a"), (5, "u", "a"), (None, "u", "n"), (10**9, "far", "x")]
    faults = {i: "changed" for i in (-40, 205, 5)} | {2999 - 2999 % 7: "missing"} | {1: "added", 7 * 10**9: "added", None: "changed"}
    faults = {k: v for k, v in faults.items() if v == "added" or k in {r[0] for r in rows}}
    replica = []
    for i, url, html in rows:
        kind = faults.get(i)
        if kind != "missing":
            replica.append((i, url, (html or "") + "!" if kind == "changed" else html))
    replica += [(i, "new", "new") for i, kind in faults.items() if kind == "added"]
    found = fixity.audit(_pages(spark, rows), _pages(spark, replica).repartition(7))
    assert {r.page_id: r.kind for r in found.collect()} == faults
    assert found.where("kind <> 'added' AND page_id IS NOT NULL AND (start < 0 OR length <= 0)").count() == 0


def test_audit_edge_cases(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, None, None)]
    same = _pages(spark, rows)
    assert fixity.audit(same, same.orderBy(F.desc("page_id"))).count() == 0
    assert [(r.page_id, r.kind) for r in fixity.audit(same, _pages(spark, rows[1:])).collect()] == [(1, "changed")]
    empty = same.limit(0)
    assert sorted((r.page_id, r.kind) for r in fixity.audit(same, empty).collect()) == [(1, "missing"), (2, "missing")]
    assert sorted((r.page_id, r.kind) for r in fixity.audit(empty, same).collect()) == [(1, "added"), (2, "added")]
    assert fixity.audit(empty, empty).count() == 0


def test_record_bytes(spark):
    row = spark.createDataFrame([("http://x/", "é")], "url string, html string").select(fixity.record(F.col("url"), F.col("html")).alias("r")).first()
    assert row.r == "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n"
