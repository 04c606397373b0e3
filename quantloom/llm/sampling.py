"""A bounded sample of labelled rows for fitting, and the held-out mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the drawn numbers' scale for each power of two.
STEPS = 16


def held_out(doc_id: Column) -> Column:
    """True for the quarter that no model may learn from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn_number(key: Column) -> Column:
    """A number from 0 to 2^63 - 1, the same for the same key."""
    return F.xxhash64(F.lit("sample"), key).bitwiseAND(F.lit(2**63 - 1))


def _step(key: Column) -> Column:
    return F.floor(F.log2(drawn_number(key).cast("double") + 1) * STEPS).cast("int")


def sample_cut(rows: DataFrame, label: str, key: str, per_label: int) -> list[tuple]:
    """(label, step): the rows of a label whose drawn number is below the step are ``per_label`` or a little fewer.

    Rows are counted by label and logarithmic step (about 1,000 steps a label), combined
    map-side, so a label of any size costs the same to shuffle and no label meets in one task.
    """
    steps = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), _step(F.col(key)).alias("step")).count()
    cuts: dict = {}
    taken: dict = {}
    for value, step, n in sorted(steps.collect(), key=lambda r: r.step):
        taken[value] = taken.get(value, 0) + n
        if taken[value] <= per_label or value not in cuts:  # one step at least
            cuts[value] = step
    return sorted(cuts.items())


def in_sample(label: Column, key: Column, cuts: list[tuple]) -> Column:
    kept = F.lit(False)
    for value, most in cuts:
        kept = kept | ((label == F.lit(value)) & (_step(key) <= F.lit(most)))
    return F.coalesce(kept, F.lit(False))
