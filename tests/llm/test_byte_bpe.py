import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quantloom.llm import byte_bpe


@pytest.fixture(scope="module")
def exact():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(5)
    letters = "aeinrst 'äéßЖщ漢字かな한글🙂👩‍👩‍👧\n\t  \u0085\x1c0149²½Ⅷ.,!<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(40)) for _ in range(100)]
    disputed = [c for c in (0x10EE7, 0x16EA7, 0x18DA7, 0x1B127, 0x3F767)]
    texts += [f"a{chr(c)}a {chr(c)}1{chr(c)}.{chr(c)} " for c in disputed]
    return [*texts, "", " ", "   ", "x   ", "  y", "<|endoftext|>", "it's we'll 'S", "a" * 5000, " " * 3000, "é" * 2000, "one two " * 30_000]


def test_ids_equal_the_rank_rule(exact):
    bpe = byte_bpe.loaded(byte_bpe.RANKS)
    for text in odd_texts():
        assert bpe.ids(text) == exact.encode_ordinary(text), text[:60]


def test_every_entry_is_reached_from_its_own_bytes(exact):
    bpe = byte_bpe.loaded(byte_bpe.RANKS)
    for rank in range(0, len(bpe.token_bytes), 7):
        assert bpe.token_bytes[rank] == exact.decode_single_token_bytes(rank)


def test_chunks_do_not_change_ids():
    bpe = byte_bpe.loaded(byte_bpe.RANKS)
    for text in odd_texts():
        assert [i for c in bpe.chunks(text, 16) for i in c] == bpe.ids(text)


def test_a_full_table_is_emptied_without_change(exact, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 50)
    bpe = byte_bpe.ByteBpe()
    for text in odd_texts()[:80]:
        assert bpe.ids(text) == exact.encode_ordinary(text)
    assert len(bpe._known) <= 200


def test_frequent_pieces_stay_in_a_full_table(exact, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 64)
    bpe, merged = byte_bpe.ByteBpe(), []
    merge = bpe._known._merge
    bpe._known._merge = lambda word: merged.append(word) or merge(word)
    for k in range(400):
        text = f" frequent {'abcdefghij'[k % 10]}{'xyzuvwklmn'[k // 10 % 10]}{'opqrst'[k // 100]}"
        assert bpe.ids(text) == exact.encode_ordinary(text)
    assert merged.count("Ġfrequent") == 1 and len(merged) == 402 - 1
    assert len(bpe._known) + len(bpe._known._older) <= 64


def test_odd_ids_among_many(exact):
    bpe = byte_bpe.loaded(byte_bpe.RANKS)
    ids = bpe.ids("zero \x00 and ÿ and \n漢")
    whole = exact.decode_bytes(ids)
    assert bpe.bytes_of(ids) == whole and bpe.bytes_of([*ids, -1, None, 10**6]) == whole + "\ufffd".encode() * 3
    assert b"".join(bpe.listed(c) for c in bpe.chunks("zero \x00 and ÿ and \n漢")) == ",".join(map(str, ids)).encode()


def test_op11_on_odd_rows(spark, make_docs, exact):
    texts = [*odd_texts(), None, "twice", "twice"]
    rows = byte_bpe.op11(make_docs([(i, t, "en", None) for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        ids = exact.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(text.encode()).hexdigest()
    assert byte_bpe.op11(make_docs([])).collect() == []


def test_encode_and_decode_as_columns(spark, make_docs, exact):
    texts = ["naïve 🙂 words", "漢字かな", None, ""]
    read = byte_bpe.with_tokens(make_docs([(i, t, None, None) for i, t in enumerate(texts)]))
    rows = read.withColumn("back", byte_bpe.decode(F.col("tokens.ids"))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        if text is None:
            assert row.tokens is None and row.back is None
            continue
        assert row.back.text == text and bytes(row.back.bytes) == text.encode()
        _, starts = exact.decode_with_offsets(row.tokens.ids)
        assert row.back.char_starts == starts
        assert row.tokens.starts == [sum(len(exact.decode_single_token_bytes(i)) for i in row.tokens.ids[:k]) for k in range(len(row.tokens.ids))]
    assert rows[0].name == "x"  # extra columns stay


def test_decoding_ids_that_are_no_text(spark):
    given = spark.createDataFrame([(1, [10**6, None]), (2, byte_bpe.loaded(byte_bpe.RANKS).ids("🙂")[:1]), (3, None), (4, [])], "k int, ids array<int>")
    rows = {r.k: r.v for r in given.select("k", byte_bpe.decode(F.col("ids")).alias("v")).collect()}
    assert rows[1].text == "��" and rows[2].text == "�" and rows[3] is None and rows[4].text == ""
