"""Registered queries with their output contract and oracle text.

The contract lists every output column once, as ``name:kind``; it drives the final
projection on both sides. Kinds: a digit = double rounded to that many places, ``i`` =
bigint, ``d`` = date as ISO text, ``t`` = timestamp as text, nothing = as is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.plans.derived import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _columns(contract: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2]) for c in contract.split()]


def _nudge(kind: str) -> float:
    """A fraction of the last kept place, added on both sides: means of prices often end
    exactly on a rounding tie, which engines break differently."""
    return 0.01371 * 10.0 ** -int(kind)


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind.isdigit():
        return (F.round(c.cast("double") + _nudge(kind), int(kind)) + F.lit(0.0)).alias(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    return c


def _sql_column(name: str, kind: str) -> str:
    if kind.isdigit():
        return f"round(CAST({name} AS DOUBLE) + {_nudge(kind)!r}::DOUBLE, {kind}) + 0.0::DOUBLE AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    return name


def case(name: str, contract: str, sql: str | None = None):
    """Register a query. Without ``sql`` only its rows are checked."""
    columns = _columns(contract)

    def wrap(build: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Market.at(spark, folder)).select(*[_spark_column(n, k) for n, k in columns])

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            head = ", ".join(_sql_column(n, k) for n, k in columns)
            ORACLE[name] = f"SELECT {head} FROM ({sql})"
        return build

    return wrap
