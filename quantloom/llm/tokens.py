"""Operator 10, token counts: batch encoding inside an Arrow function that returns lengths only.

Texts are cut at safe places into pieces of about ``piece_bytes``; pieces go to the tokenizer
in batches of about ``batch_bytes``, so neither one long text nor many short ones decide how
much is encoded at once. Ids never leave the function: a text's count is the sum over its
pieces. Nothing is shuffled.

A safe place is a single blank (U+0020) between two characters that are not white space.
For a sentencepiece model the blank is dropped, since the model puts its own blank before
each piece; its pieces carry blanks in front only, so no merge crosses the place (checked
when the model is loaded; other models are encoded uncut). For a ``tokenizers`` file the
blank stays in front of the following piece, where the pre-tokenizers of the given files cut.
A text without a safe place is encoded in one piece.

Defined results: null counts as empty, 0 tokens. Begin, end and added special tokens are not
counted; their strings inside a text are handled as the library does by default. No cap, no
truncation. Repeated rows are counted each. An empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
PIECE_BYTES = 1 << 16
BATCH_BYTES = 1 << 20
LIMIT = 4096
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def file_of(name: str) -> str:
    """A path as it is, or the installed public tokenizer file of that name."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoder(name: str):
    """(function from a list of texts to their token counts, may be cut, blank dropped at cuts)."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file_of(name))
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        in_front = all("▁" not in p.lstrip("▁") for p in pieces)
        exact = in_front and len(model.encode("a b")) == len(model.encode("a")) + len(model.encode("b"))
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), exact, True
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(file_of(name))
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]), True, False


def cut(text: str, size: int, drop_blank: bool) -> list[str]:
    """The text in pieces of ``size`` characters or a little more, cut at safe places."""
    out, start = [], 0
    while len(text) - start > size and (at := _SAFE.search(text, start + size)):
        out.append(text[start : at.start()])
        start = at.end() if drop_blank else at.start()
    return [*out, text[start:]]


def count_tokens(texts: list[str | None], name: str, piece_bytes: int = PIECE_BYTES, batch_bytes: int = BATCH_BYTES) -> list[int]:
    count, may_cut, drop = _encoder(name)
    totals = [0] * len(texts)
    owners: list[int] = []
    batch: list[str] = []
    held = 0

    def flush() -> None:
        for owner, n in zip(owners, count(batch), strict=True):
            totals[owner] += n
        owners.clear()
        batch.clear()

    for i, text in enumerate(texts):
        for piece in cut(text, piece_bytes, drop) if text and may_cut else [text or ""]:
            owners.append(i)
            batch.append(piece)
            held += len(piece)
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return totals


def n_tokens(text: Column, name: str = MODEL) -> Column:
    @F.arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), name), pa.int64())

    return counts(text)


def op10(docs: DataFrame) -> DataFrame:
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
