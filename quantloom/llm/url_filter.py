"""Operator 7, URL filters as a sort-merge range join.

A rule's and a url's host is reversed label by label, so "this host and its subdomains" is
a prefix. A url is probed once for each of its host's suffixes (``com``, ``example.com``,
``www.example.com``) under the key ``<reversed suffix> 0xFE <path>``; a rule holds for the
keys that start with ``<reversed rule host> 0xFE <rule path>``, which is the interval
``[key, key 0xFF)``: keys are bytes, and neither byte occurs in UTF-8, so no host or path can imitate a border. Two such intervals are disjoint or nested, so a sweep in key
order needs a stack only: an opening rule is pushed, a closing one uncovers the rule
around it. The state after each border (the innermost open rule) is worked out on the
rules, and a sorted sweep over borders and probes takes the last border before each probe.

The sweep runs in range partitions of the key; a frequent key is cut by the row id, and
the last border of earlier parts is carried over as one row per part. Rules are split by
key, not gathered: the enclosing rule of a rule is found by probing its own key's prefixes.

Defined results: host is what stands after the first ``://`` up to ``/ ? #`` or the end, A-Z
lower-cased; the path goes on to ``? #`` or the end. A null url or one without ``://`` has
empty host and path. Port and user part are left in the host as they are. A url that no
rule fits gets ``default`` (allow) and a null rule. The longest rule wins, counted in
characters of host and path; of equally long ones the text that sorts last, of one rule with
two verdicts the verdict that sorts first. Repeated rows
are judged alike; an empty table gives an empty result; extra columns stay in ``_row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import lower_ascii, range_sorted, stored

#: Fixed values of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
BORDER, LAST = bytearray(b"\xfe"), bytearray(b"\xff")


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    after = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return host, path


def _key(host: Column, path: Column) -> Column:
    return F.concat(host.cast("binary"), F.lit(BORDER), path.cast("binary"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """One row per distinct rule (host, path): its key and what it says."""
    text = F.concat("host", "path")
    keyed = rules.select(
        _key(reversed_host(lower_ascii(F.col("host"))), F.col("path")).alias("key"),
        F.struct(F.length(text).alias("length"), text.alias("rule"), F.col("verdict")).alias("said"))
    return stored(keyed.groupBy("key").agg(F.min("said").alias("said")), "url-rules")


def _borders(keyed: DataFrame) -> DataFrame:
    """(key, top): from this key on, ``top`` is the innermost open rule, null for none."""
    starts = keyed.select("key", "said")
    # the rule around a rule: the longest proper prefix of its key that is a rule's key
    lengths = F.sequence(F.lit(1), F.length("key") - 1)
    prefixes = keyed.where(F.length("key") > 1).select(
        F.col("key").alias("inner"), F.explode(F.transform(lengths, lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key"))
    around = prefixes.join(keyed, "key").groupBy("inner").agg(F.max(F.struct(F.length("key"), "said")).alias("outer"))
    ends = keyed.join(around, keyed["key"] == around["inner"], "left").select(F.concat("key", F.lit(LAST)).alias("key"), F.col("outer.said").alias("said"))
    return starts.unionAll(ends)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Rows of ``pages`` (needs url) as ``_row`` with host, path, rule, verdict.

    ``rules`` has host, path, verdict. The page columns travel in ``_row``: pass what is
    needed only (``op7`` passes page_id and url, so no HTML is read).
    """
    host, path = host_and_path(F.col("_row.url"))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row")
    rows = stored(
        pages.select(F.monotonically_increasing_id().alias("_rid"), row).select("*", host.alias("host"), path.alias("path")), "url-rows")
    labels = F.split("host", r"\.", -1)
    # suffix i of the host, reversed: the first i reversed labels
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.reverse(labels), F.lit(1), i), "."))
    probes = rows.where("host <> ''").select("_rid", F.explode(suffixes).alias("suffix"), "path").select(
        _key(F.col("suffix"), F.col("path")).alias("key"), F.col("_rid").alias("at"), F.lit(False).alias("border"),
        F.lit(None).cast("struct<length:int,rule:string,verdict:string>").alias("top"))
    keyed = _rule_keys(rules)
    borders = _borders(keyed).select("key", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("border"), F.col("said").alias("top"))
    swept = range_sorted(borders.unionAll(probes), "url-sweep", "key", "at")
    state = F.when(F.col("border"), F.struct("top"))
    last = swept.where("border").groupBy("_part").agg(F.max_by(F.struct("top"), "key").alias("state"))
    spread = swept.select("_part").distinct().join(last, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    carried = spread.select("_part", F.last("state", True).over(before).alias("carried"))
    # -1 sorts a border before the probes of the same key
    inside = Window.partitionBy("_part").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    open_ = swept.withColumn("state", F.last(state, True).over(inside)).where("not border").join(carried, "_part")
    top = F.coalesce("state", "carried")["top"]
    best = open_.select(F.col("at").alias("_rid"), top.alias("top")).where("top is not null").groupBy("_rid").agg(
        F.max(F.struct(F.col("top.length"), F.col("top.rule"), F.col("top.verdict"))).alias("top"))
    return rows.join(best, "_rid", "left").select(
        "_row", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession) -> DataFrame:
    """The contract's rules as literals."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule)]) for rule in RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op7(pages: DataFrame) -> DataFrame:
    judged = judge(pages.select("page_id", "url"), rule_table(pages.sparkSession))
    return judged.select(F.col("_row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1, 's'), '') AS path FROM cut),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.rverdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rank
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fit WHERE rank = 1
"""
