"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of
``quantloom.llm``. ``run`` writes each stage's rows to the shared folder and reads them again,
so a lost executor costs its tasks only. All stages but the last return the columns of ``docs``.

Edge cases are those of the operators: null and empty texts are clean, are one group of equal texts,
and are no near copies of each other; an empty table passes through; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from quantloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows that score 0.3 or more go. The grammar is learned from the given documents' labels."""
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, grammar)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: five-word shingles, similarity 0.8 or more; the smallest doc_id of a group stays."""
    return near_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: how often each document is taken so that sources meet their targets."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text"))
    return mixed.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The learned toxicity score and the near-duplicate components have no SQL text; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
