"""U and R: universe history, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import universe
from quantloom.operators.weights import top_n
from quantloom.suite.registry import case


def _current(m):
    u = m.universe()
    return u.join(F.broadcast(u.agg(F.max("snapshot_date").alias("snapshot_date"))), "snapshot_date", "left_semi")


@case("u01_rebuild_membership", "snapshot_date:d ticker", "SELECT * FROM uni")
def _(m):
    marks = m.universe().select(F.col("snapshot_date").alias("date")).distinct()
    return universe.rebuild_membership(_current(m), m.membership_changes(), marks)


@case("u02_removed_for_good", "ticker", "SELECT DISTINCT removed AS ticker FROM changes WHERE removed IS NOT NULL AND removed NOT IN (SELECT ticker FROM uni WHERE snapshot_date = (SELECT max(snapshot_date) FROM uni))")
def _(m):
    return universe.removed_for_good(m.membership_changes(), _current(m))


@case("u03_sizes_at", "date:d snapshot_date:d n_members:i", """SELECT d.date, u.snapshot_date, n_members FROM (SELECT d.date, coalesce(s.snapshot_date, (SELECT min(snapshot_date) FROM uni)) AS snapshot_date FROM mends d
  ASOF LEFT JOIN (SELECT DISTINCT snapshot_date FROM uni) s ON s.snapshot_date <= d.date) d JOIN (SELECT snapshot_date, count(*) AS n_members FROM uni GROUP BY 1) u USING (snapshot_date)""")
def _(m):
    return universe.sizes_at(m.universe(), m.month_ends())


@case("u04_first_last_difference", "ticker change", """SELECT ticker, 'left' AS change FROM (SELECT ticker FROM uni WHERE snapshot_date = (SELECT min(snapshot_date) FROM uni) EXCEPT SELECT ticker FROM uni WHERE snapshot_date = (SELECT max(snapshot_date) FROM uni))
  UNION ALL SELECT ticker, 'joined' FROM (SELECT ticker FROM uni WHERE snapshot_date = (SELECT max(snapshot_date) FROM uni) EXCEPT SELECT ticker FROM uni WHERE snapshot_date = (SELECT min(snapshot_date) FROM uni))""")
def _(m):
    return universe.first_last_difference(m.universe())


@case("r01_multi_key_sort", "date:d ticker close:2", "SELECT date, ticker, close FROM prices ORDER BY date, ticker")
def _(m):
    return m.prices().orderBy("date", "ticker")


@case("r02_top_k", "scope ticker date:d score:8", """SELECT 'all' AS scope, ticker, date, score FROM (SELECT * FROM scores ORDER BY score DESC NULLS LAST, date, ticker LIMIT 25) UNION ALL
  SELECT 'sector', ticker, date, score FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC NULLS LAST, ticker) AS k FROM scores) WHERE k <= 2""")
def _(m):
    s = m.scores()
    overall = s.orderBy(F.desc_nulls_last("score"), "date", "ticker").limit(25).withColumn("scope", F.lit("all"))
    return overall.unionByName(top_n(s, 2, keys=["date", "sector"]).withColumn("scope", F.lit("sector")))


@case("r03_union", "ticker date:d close:4", "SELECT ticker, date, close FROM prices UNION ALL SELECT ticker, date, close FROM bench")
def _(m):
    return m.prices().select("ticker", "date", "close").unionByName(m.bench().select("ticker", "date", "close"))


@case("r04_intersect", "date:d", "SELECT date FROM prices INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders")
def _(m):
    return m.prices().select("date").intersect(m.table("orders").select(F.to_date("o_orderdate").alias("date")))


@case("r05_except", "ticker", "SELECT ticker FROM meta EXCEPT SELECT ticker FROM uni WHERE snapshot_date = (SELECT max(snapshot_date) FROM uni)")
def _(m):
    return m.meta().select("ticker").subtract(_current(m).select("ticker"))
