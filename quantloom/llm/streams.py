"""Running sums over groups of any size, and digests of ordered groups streamed through a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from hashlib import sha256
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import range_sorted

#: Rows a streaming function hands on at once.
ROWS_OUT = 4096


def running_sums(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Inclusive running sums ``{new column: value column}`` over ``order`` within ``keys``.

    One range shuffle by (keys, order), whose last column should be unique. A window adds up inside a
    range part; what earlier parts hold of the same keys is one row per (part, keys), so a group may fill many parts.
    """
    parts = range_sorted(df, name, *keys, *order)
    held = parts.groupBy("_part", *keys).agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        *[F.col(c).alias(f"_of_{c}") for c in ("_part", *keys)],
        *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_carried_{out}") for out in sums],
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(v).over(inside).alias(f"_local_{out}") for out, v in sums.items()])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_part", *keys)])
    return local.join(carried, on).select(*df.columns, *[(F.col(f"_local_{out}") + F.col(f"_carried_{out}")).alias(out) for out in sums])


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a batch in memory at a time."""
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)


def fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def stream(ordered: DataFrame, each, schema: T.StructType) -> DataFrame:
    """``each(rows) -> rows`` over the tuples of every partition, in order and with bounded memory."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(lambda batches: batched(each(records(batches)), arrow), schema)


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of equal keys together and in order, so that a task can stream over them."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def joined_sha256(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, separator: str, out: str) -> DataFrame:
    """Per key the SHA-256 (lowercase hex) of its ``piece`` strings in order, joined by ``separator``.

    SHA-256 reads its input in order, so a group passes one task; it is streamed, never held.
    """
    width = len(keys)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = state = None
        for row in rows:
            if state is None or row[:width] != key:
                if state is not None:
                    yield (*key, state.hexdigest())
                key, state = row[:width], sha256()
            else:
                state.update(separator.encode())
            state.update(row[width].encode())
        if state is not None:
            yield (*key, state.hexdigest())

    ordered = grouped(df.select(*keys, *order, piece), keys, order).select(*keys, piece)
    return stream(ordered, digests, T.StructType([*fields(df, keys), T.StructField(out, T.StringType())]))
