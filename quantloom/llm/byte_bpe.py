"""Operator 11, byte-level BPE encoding and decoding over Arrow batches.

A rank file lists byte strings with ranks. The ``tokenizers`` library works on strings, so every
byte has a character (``byte_chars``) and every rank becomes a vocabulary entry in these
characters. Its merge list is recovered from the ranks: an entry's two halves are what merging its own
bytes in rank order leaves before the last step. No other pair can meet in an entry's place while
ranks decide the order, so the library's merges and those of the rank rule agree (tests compare with
``tiktoken`` over random bytes, scripts and all code points).

**Encoding.** A text is cut at safe blanks (``tokens.cut``) into chunks, a chunk by the public pattern
into pieces, each merged separately. Pieces of up to ``CACHED_CHARS`` are looked up in a worker's
tables of at most ``CACHED_PIECES`` entries, a newer and an older half: when the newer one is full it becomes the older
one, and pieces met again move back, so frequent ones stay. The library's model merges the others. A piece's ids are
kept packed, so a chunk's ids are one join of bytes. ``encode`` gives ids with the byte offset at which each token starts.

**Decoding.** ``decode`` reverses the byte table: an id gives characters, these give bytes (an Arrow take), bytes are joined before
anything is read as UTF-8, so characters split over tokens come back whole. ``char_starts`` tells
the character in which each token starts; a token inside a character points to that character.

Nothing is shuffled; a text of any length is encoded whole, one chunk at a time.

Defined results: null text counts as empty in ``op11`` (0 tokens, both hashes of nothing) and stays
null in ``encode``; special strings are ordinary text. ``decode`` gives null for null, nothing for an empty
list, U+FFFD for an id (or null) outside the table, and U+FFFD for bytes that are no UTF-8 in ``text`` only. Repeated rows
are encoded each; an empty table gives an empty result; extra columns pass through ``with_tokens``.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.tokens import PIECE_BYTES, cut, file_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces held by a worker; a packed entry takes about 200 bytes.
CACHED_PIECES = 1 << 18
CACHED_CHARS = 64
#: Blocks before Armenian are full since Unicode 7; only later ones can be disputed.
_LATER_SCRIPTS = re.compile("[\u0530-\U0010ffff]").search
_UNKNOWN = "�".encode()


def byte_chars() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts of ``token`` when its bytes are merged in rank order; None where merging ends before."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks) + 256), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= len(ranks) + 256:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _joined(parts: pa.Array, between):
    return pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), pa.scalar(between, parts.type))[0].as_py()


def _members(spans, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for start, end in spans:
        out[start:end] = True
    return out


def disputed_characters() -> str:
    """Ranges (for a character class) of characters that the pattern's classes hold in ``regex`` but not in the library, or the other way round.

    The two carry tables of different Unicode versions; the library's agree with those of the rank rule (tested).
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    everything, n = "".join(map(chr, codes)), len(codes)
    differ = np.zeros(n, bool)
    for kind in (r"\p{L}+", r"\p{N}+", r"\s+"):
        outside = pre_tokenizers.Split(Regex(kind), "removed").pre_tokenize_str(everything)
        inside = (m.span() for m in regex.finditer(kind, everything))
        differ |= _members((span for _, span in outside), n) == _members(inside, n)
    edges = np.flatnonzero(np.diff(differ.astype(np.int8), prepend=0, append=0))
    ranges = "".join(f"\\U{codes[a]:08x}-\\U{codes[z - 1]:08x}" for a, z in zip(edges[::2], edges[1::2]))
    return ranges or "\\U0010ffff"


class _Pieces(dict):
    """The packed ids of pieces: a newer table, and an older one from which pieces that are met again move back."""

    def __init__(self, merge) -> None:
        self._merge, self._spelling, self._older = merge, "".join(byte_chars()), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self._older.get(piece)
        if packed is None:
            word = piece.encode().decode("latin-1").translate(self._spelling)
            packed = array("i", [token.id for token in self._merge(word)]).tobytes()
            if len(piece) > CACHED_CHARS:
                return packed
        if len(self) >= CACHED_PIECES // 2:
            self._older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class ByteBpe:
    """One rank file: ``ids`` of a text, ``bytes_of`` ids."""

    def __init__(self, name: str = RANKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Regex, models, pre_tokenizers

        ranks = read_ranks(file_of(name))
        chars = byte_chars()
        spelled = {token: "".join(chars[b] for b in token) for token in ranks}
        by_rank = sorted((token for token in ranks if len(token) > 1), key=ranks.__getitem__)
        merges = [(spelled[pair[0]], spelled[pair[1]]) for token in by_rank if (pair := halves(token, ranks))]
        vocabulary = {spelled[token]: rank for token, rank in ranks.items()}
        # an entry that equals a whole piece is taken at once, as the rank rule does
        self._known = _Pieces(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True).tokenize)
        self._match = regex.compile(public_tokenizers.PATTERN).findall
        self._split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated").pre_tokenize_str
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = [_UNKNOWN] * (max(ranks.values()) + 1)
        for word, rank in vocabulary.items():
            self.token_bytes[rank] = bytes(back[c] for c in word)
        self._bytes = pa.array([*self.token_bytes, _UNKNOWN], pa.large_binary())
        self._numbers = pa.array([str(i) for i in range(len(self.token_bytes))], pa.large_string())

    @cached_property
    def _disputed(self):
        return re.compile(f"[{disputed_characters()}]").search

    def pieces(self, chunk: str) -> list[str]:
        """The pattern's matches; the library matches itself where ``regex`` knows other characters than it."""
        if _LATER_SCRIPTS(chunk) and self._disputed(chunk):
            return [piece for piece, _ in self._split(chunk)]
        return self._match(chunk)

    def _encoded(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._known.__getitem__, pieces)), np.int32)

    def chunks(self, text: str, size: int = PIECE_BYTES) -> Iterator[np.ndarray]:
        """Ids of a text, chunk after chunk; joined they are the ids of the whole text."""
        for chunk in cut(text, size, False) if text else []:
            yield self._encoded(self.pieces(chunk))

    def ids(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in chunk.tolist()]

    def bytes_of(self, ids) -> bytes:
        """The bytes of a list or an array of ids, joined; U+FFFD for an id (or None) outside the table."""
        at = ids if isinstance(ids, np.ndarray) else np.array([-1 if i is None else i for i in ids], np.int64)
        outside = (at < 0) | (at >= len(self.token_bytes))
        return _joined(self._bytes.take(pa.array(np.where(outside, len(self.token_bytes), at) if outside.any() else at)), b"")

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids of the table as decimal numbers, joined by commas."""
        return _joined(self._numbers.take(pa.array(ids)), ",").encode()

    def starts(self, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            out.append(at)
            at += len(self.token_bytes[i])
        return out

    def char_starts(self, ids) -> list[int]:
        """The index of the character that holds each token's first byte."""
        out, begun = [], 0
        for i in ids:
            token = self.token_bytes[i] if i is not None and 0 <= i < len(self.token_bytes) else _UNKNOWN
            inside = bool(token) and token[0] & 0xC0 == 0x80
            out.append(max(begun - 1, 0) if inside else begun)
            begun += sum(b & 0xC0 != 0x80 for b in token)
        return out


@lru_cache(maxsize=2)
def loaded(name: str) -> ByteBpe:
    return ByteBpe(name)


_ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])
_DECODED = pa.struct([("bytes", pa.binary()), ("text", pa.string()), ("char_starts", pa.list_(pa.int64()))])
_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(text: Column, name: str = RANKS) -> Column:
    """struct(ids array<int>, starts array<bigint>): token ids and the byte offset of each."""

    @F.arrow_udf("struct<ids:array<int>,starts:array<bigint>>")
    def encoded(texts: pa.Array) -> pa.Array:
        bpe, out = loaded(name), []
        for text in texts:
            ids = None if not text.is_valid else bpe.ids(text.as_py())
            out.append(None if ids is None else {"ids": ids, "starts": bpe.starts(ids)})
        return pa.array(out, _ENCODED)

    return encoded(text)


def decode(ids: Column, name: str = RANKS) -> Column:
    """struct(bytes binary, text string, char_starts array<bigint>) of an array of ids."""

    @F.arrow_udf("struct<bytes:binary,text:string,char_starts:array<bigint>>")
    def decoded(rows: pa.Array) -> pa.Array:
        bpe, out = loaded(name), []
        for row in rows:
            value = None
            if row.is_valid:
                given = row.as_py()
                whole = bpe.bytes_of(given)
                value = {"bytes": whole, "text": whole.decode("utf-8", "replace"), "char_starts": bpe.char_starts(given)}
            out.append(value)
        return pa.array(out, _DECODED)

    return decoded(ids)


def with_tokens(docs: DataFrame, text: str = "text", out: str = "tokens", name: str = RANKS) -> DataFrame:
    """The rows with ``out`` as a struct of ids and byte offsets."""
    return docs.withColumn(out, encode(F.col(text), name))


def _round_trip(text: str, bpe: ByteBpe) -> dict:
    """Token count and digests of a text's ids and of what they decode to, one chunk in memory at a time."""
    n, listed, back = 0, sha256(), sha256()
    for ids in bpe.chunks(text):
        listed.update((b"," if n else b"") + bpe.listed(ids))
        back.update(bpe.bytes_of(ids))
        n += len(ids)
    return {"n_tokens": n, "ids_sha256": listed.hexdigest(), "decoded_sha256": back.hexdigest()}


def round_trip(text: Column, name: str = RANKS) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256); ids stay inside the function."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        bpe = loaded(name)
        return pa.array([_round_trip(t.as_py() or "", bpe) for t in texts], _DIGEST)

    return digests(text)


def op11(docs: DataFrame) -> DataFrame:
    read = docs.select("doc_id", round_trip(F.col("text")).alias("_read"))
    return read.select("doc_id", "_read.n_tokens", "_read.ids_sha256", "_read.decoded_sha256")
