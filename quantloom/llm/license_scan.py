"""Operator 2, license scans: MinHash bands over overlapping text windows, then exact containment.

A template of n words belongs to the class of windows of 2S words every S words, S the least power of
two (from 4) with S >= n - 1, so every place of a template lies whole in some window. Five-word shingles of a
text that occur in no template of a class cannot count towards a containment there; they are
dropped by a lookup of their hash in the (bounded) template table before anything moves.
The rest of a window is sketched with ``BANDS`` min-hashes, one to a band. A window that holds 80% of a
template agrees with it in a band with a chance of at least 0.8 n / 2S > 0.2, so it is found with
1 - 0.8^32 > 0.999 at least. A found window is verified exactly: distinct template shingles in
it, word by word, over the template's own.

Only shingles that stand in a template are shuffled, by document and window; no key is shared between documents, so a
notice that a third of all documents carry makes no hot group. Templates are a stated query set: up to
``MOST_TEMPLATES`` of ``MOST_WORDS`` words are taken at once, more in further blocks.

Defined results: words are runs of 0-9, A-Z (lower-cased) and non-ASCII characters. Null and
empty texts, and texts of fewer than five words, hold no template. A template of fewer than five words is refused.
One row per document row and template found; repeated rows are reported each. An empty table gives an empty result.
Extra columns stay in ``_row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import NOT_WORD, lower_ascii, stored

SHINGLE = 5
BANDS = 32
SHARE = 0.8
MOST_TEMPLATES, MOST_WORDS = 1000, 4096
#: Usual one-line notices of public licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: Column) -> Column:
    lowered = lower_ascii(text)
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), NOT_WORD), lambda w: w != "")


def _shingle_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(SHINGLE)])


def template_shingles(templates: DataFrame) -> DataFrame:
    """(license, step, n, hash, shingle): distinct shingles of each template (columns license, text)."""
    cut = templates.select("license", _words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    power = F.ceil(F.log2((F.size("words") - 1).cast("double")))
    places = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    listed = cut.select("license", F.greatest(F.pow(F.lit(2.0), power), F.lit(4.0)).cast("int").alias("step"), "words", F.explode(places).alias("at"))
    listed = listed.select("license", "step", _shingle_hash(F.col("words"), F.col("at")).alias("hash"), F.slice("words", F.col("at") + 1, SHINGLE).alias("shingle")).distinct()
    return listed.join(listed.groupBy("license").agg(F.count("*").alias("n")), "license")


def _bands(hash_: Column) -> list[Column]:
    return [F.min(F.xxhash64(hash_, F.lit(band))).alias(f"b{band}") for band in range(BANDS)]


def _banded(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per band of each sketch."""
    sketches = rows.groupBy(*keys).agg(*_bands(F.col("hash")))
    return sketches.select(*keys, F.posexplode(F.array(*[F.col(f"b{band}") for band in range(BANDS)])).alias("band", "value"))


def scan(docs: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """(_row, license, containment, n_windows, first_word) of every document and template held.

    ``docs`` needs text; ``_row`` holds its other columns. ``templates`` has license, text.
    """
    spark = docs.sparkSession
    # at most MOST_TEMPLATES times MOST_WORDS rows go to every executor
    if templates.where(F.size(_words(F.col("text"))) > MOST_WORDS).count():
        raise ValueError(f"a template has more than {MOST_WORDS} words")
    shingles = stored(template_shingles(templates), "license-shingles")
    if shingles.groupBy("license").count().count() < templates.select("license").distinct().count():
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    names = [r[0] for r in shingles.select("license").distinct().orderBy("license").collect()]
    found = None
    for at in range(0, len(names), MOST_TEMPLATES):
        block = shingles.where(F.col("license").isin(names[at : at + MOST_TEMPLATES]))
        part = _scan_block(docs, block, share)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return _scan_block(docs, shingles, share)
    return found


def _scan_block(docs: DataFrame, shingles: DataFrame, share: float) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    texts = docs.select(F.monotonically_increasing_id().alias("_rid"), row, _words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    spots = texts.select("_rid", "_row", "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - (SHINGLE - 1))).alias("at", "word"))
    spots = spots.select("_rid", "_row", "words", "at", _shingle_hash(F.col("words"), F.col("at")).alias("hash"))
    wanted = shingles.select("step", "hash", "shingle").distinct()
    hits = spots.join(F.broadcast(wanted), "hash").where(F.slice("words", F.col("at") + 1, SHINGLE) == F.col("shingle"))
    # a shingle lies in window i if it ends inside the 2 * step words from i * step
    first = F.floor(F.col("at") / F.col("step"))
    windows = F.filter(F.array(first - 1, first), lambda i: (i >= 0) & (F.col("at") + SHINGLE <= i * F.col("step") + 2 * F.col("step")))
    placed = stored(hits.select("_rid", "_row", "at", "hash", "step", F.explode(windows).alias("window")), "license-hits")
    sketched = _banded(placed.select("_rid", "step", "window", "hash"), "_rid", "step", "window")
    asked = _banded(shingles, "license", "step")
    candidates = sketched.join(F.broadcast(asked), ["step", "band", "value"]).select("_rid", "step", "window", "license").distinct()
    exact = placed.join(candidates, ["_rid", "step", "window"]).join(F.broadcast(shingles.select("license", "step", "hash", "n")), ["license", "step", "hash"])
    held = exact.groupBy("_rid", "license", "step", "window").agg(
        (F.count_distinct("hash") / F.max("n")).alias("containment"), F.min("at").alias("at"), F.first("_row").alias("_row")).where(F.col("containment") >= share)
    best = held.groupBy("_rid", "license").agg(
        F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("at").cast("long").alias("first_word"), F.first("_row").alias("_row"))
    return best.select("_row", "license", "containment", "n_windows", "first_word")


def notice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license string, text string")


def op2(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), notice_table(docs.sparkSession))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "license", "containment", "n_windows", "first_word")


_CUT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH notices(license, text) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in NOTICES.items())}),
cut AS (SELECT license, {_CUT} AS w FROM notices),
classed AS (SELECT license, w, greatest(4, CAST(pow(2, ceil(log2(len(w) - 1))) AS INT)) AS step FROM cut),
listed AS (SELECT DISTINCT license, step, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS s FROM classed)),
sized AS (SELECT *, count(*) OVER (PARTITION BY license) AS n FROM listed),
docs AS (SELECT doc_id, {_CUT} AS w FROM documents),
spots AS (SELECT doc_id, s - 1 AS spot, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS s FROM docs)),
hits AS (SELECT DISTINCT doc_id, spot, license, step, n, g, unnest([spot // step - 1, spot // step]) AS i FROM spots JOIN sized USING (g)),
held AS (SELECT doc_id, license, i, count(DISTINCT g) / any_value(n)::DOUBLE AS containment, min(spot) AS spot FROM hits
  WHERE i >= 0 AND spot + 5 <= i * step + 2 * step GROUP BY ALL HAVING count(DISTINCT g) / any_value(n)::DOUBLE >= 0.8)
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows, min(spot)::BIGINT AS first_word FROM held GROUP BY 1, 2
"""
