import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(c, T.StringType()) for c in ("_row", "_rid", "name", "level", "rank", "size", "label", "step", "kept", "key")]])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with clashing extra columns from (doc_id, text, lang, source)."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * 10) for i, t, lang, s in rows], DOCS)

    return make


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
