"""Decontamination, language, toxicity, tokens: brute force, planted cases and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontamination, language, sampling, tokens, toxicity
from tests.llm.conftest import prose


def _brute(text, items, size=10):
    doc = decontamination.words((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        w = decontamination.words((item or "").encode())
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else []:
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[s : s + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
    return len(doc), len(hit), len(names)


def test_decontamination_against_brute_force(spark, make_docs):
    rng = random.Random(3)
    items = [(i, prose(50 + i, rng.randrange(8, 40), 60)) for i in range(12)] + [(90, "one two three"), (91, "the the the the the the the the the the the the"), (92, None), (93, "--- !!"), (90, "four five"), (None, "six seven eight")]
    texts = [prose(i, 60, 60) for i in range(10)]
    texts += [f"Start, {items[i][1].upper()}! end" for i in range(8)] + ["say One, two; THREE now", "the " * 30, None, "", "ünï 1 2", "six seven eight nine " * 3, items[2][1] + " " + items[3][1] + " " + items[2][1]]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s")])
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("_row", F.lit(1))
    named = [("null" if i is None else i, t) for i, t in items]
    want = sorted((i, *_brute(t, named)) for i, t in [*enumerate(texts), (5, texts[5])])
    for block in (10**6, 40):
        found = decontamination.contamination(docs, benchmark, block_words=block)
        assert sorted(map(tuple, found.select("_row.doc_id", "n_words", "n_hit", "n_items").collect())) == want
    clean = decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [w[0] for w in want if not w[2]]
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0


def test_proximity_matches(spark, make_docs):
    item = "a b c d e f g h i j"
    docs = make_docs([(0, "x a b c d Q e f g h i j x", None, None), (1, item, None, None), (2, "j i h g f e d c b a", None, None)])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = {r.doc_id: r.n_items for r in decontamination.contamination(docs, benchmark, slop=1).select("_row.doc_id", "n_items").collect()}
    exact = {r.doc_id: r.n_items for r in decontamination.contamination(docs, benchmark).select("_row.doc_id", "n_items").collect()}
    assert near == {0: 1, 1: 1, 2: 0} and exact == {0: 0, 1: 1, 2: 0}


SYLLABLES = {"xx": "ka to mi ru se no".split(), "yy": "brz kht vlg mst prt".split()}


def _language_rows(n):
    rng = random.Random(8)
    word = lambda lang: "".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(5, 200))), lang, "s") for i, lang in ((i, ("xx", "yy")[i % 2]) for i in range(n))]


def test_language_held_out_accuracy(make_docs):
    rows = _language_rows(200)
    odd = [(1000, None, None, "s"), (1001, "", "xx", "s"), (1002, "12 %% 34", "yy", "s"), (1003, "katomi " * 20000, None, "s"), (None, rows[0][1], "xx", "s"), (0, rows[0][1], "xx", "s")]
    out = {}
    for r in language.op4(make_docs(rows + odd)).collect():
        out.setdefault(r.doc_id, r)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "xx"
    held = [(out[i].lang_pred, lang) for i, _, lang, _ in rows if out[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_without_labels(make_docs):
    assert [(r.lang_pred, r.score) for r in language.op4(make_docs([(1, "text", None, None)])).collect()] == [("und", 0.0)]
    assert language.op4(make_docs([])).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    cuts = sampling.sample_cut(rows, "label", "doc_id", 300)
    sizes = dict(rows.where(sampling.in_sample(F.col("label"), F.col("doc_id"), cuts)).groupBy("label").count().collect())
    assert all(200 <= n <= 300 for n in sizes.values())


def test_toxicity_learns_insults_and_leaves_clean_documents(spark, make_docs):
    rng = random.Random(4)
    insults = ["blorg", "snarf", "grobax", "grobtum", "grobery"]
    rows, labels = [], []
    for i in range(400):
        words = prose(i, rng.randrange(20, 80)).translate(str.maketrans("0123456789", "abcdefghij")).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    odd = [(900, None, None, None), (901, "", None, None), (902, "w1 w2 " * 20000 + "blorg snarf", None, None), (None, "blorg grobnew", None, None)]
    labels += [(0, 0, 1), (1, 1, None), (5000, 0, 1), (None, 0, 1)]
    docs, table = make_docs(rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.op8(docs, table).collect()}
    held = [i for i in range(400) if out[i].held_out]
    assert len(held) > 50 and all(out[i].predicted == (i % 4 == 0) for i in held)
    assert out[900].predicted == out[901].predicted == 0 and out[902].predicted == 1 and out[None].predicted == 1
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, table))
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() == 300
    bare = toxicity.op8(docs, table.limit(0))
    assert bare.where("predicted = 1").count() == 0 and toxicity.op8(docs.limit(0), table).count() == 0


@pytest.mark.parametrize("edits", [0, 2])
def test_toxicity_lexicon_with_a_copied_toxic_text(spark, make_docs, edits):
    """A toxic text that holds every insult and makes up a third of the toxic labels, copied or nearly copied."""
    rng = random.Random(7)
    letters = str.maketrans("0123456789", "abcdefghij")
    insults = ["blorg", "snarf", "quimt", "trask"]
    rows = []
    for i in range(1200):
        words = prose(i, 60).translate(letters).split()
        if i % 4 == 0:
            for insult in rng.sample(insults, 2):
                words.insert(rng.randrange(len(words)), insult)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    base = " ".join(f"beside{c}" for c in "abcdefghijklmnopqrst").split() + prose(1, 150).translate(letters).split()
    for k, insult in enumerate(insults):
        base.insert(9 * k + 3, insult)
    for i in range(1200, 1350):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = "w" + "".join(rng.choices("abcdefghij", k=4))
        rows.append((i, " ".join(words), 1))
    docs = make_docs([(i, t, "en", "s") for i, t, _ in rows])
    grammar = toxicity.train(docs, spark.createDataFrame([(i, 1, toxic) for i, _, toxic in rows], "doc_id long, quality int, toxic int"))
    sure, suspect = grammar.lexicon[toxicity.INSULT], grammar.lexicon[toxicity.SUSPECT]
    assert set(insults) <= set(sure)
    # words that stand beside an insult in the copies only
    assert not [w for w in (*sure, *suspect) if w.lstrip("^").startswith("besi")]


def test_toxicity_evidence_does_not_need_a_share_of_the_sample(spark, make_docs):
    """An insult in 11 of 1,126 toxic texts is learned: 11 of 11 is no chance, however large the sample is."""
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [prose(i, 12).translate(letters) for i in range(3000)]
    for i in range(0, 3000, 2):
        texts[i] += f" {prose(i + 1, 1).translate(letters)} {'blorg' if i >= 26 else 'snarf'} end"
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    learned = labels.where("doc_id < 26 AND toxic = 1").where(~sampling.held_out(F.col("doc_id"))).count()
    assert learned == 11
    assert {"blorg", "snarf"} <= set(toxicity.train(docs, labels).lexicon[toxicity.INSULT])


def test_grammar_scopes():
    reader = toxicity.Reader(toxicity.Grammar({toxicity.INSULT: ("idiot",)}))
    marks = lambda text: dict(reader.marks(text))
    assert marks("that idiot again") == {"plain": 1}
    assert marks("you idiot") == {"aimed": 1} and marks("idiot, all of you") == {"aimed": 1}
    assert marks("not an idiot") == {"negated": 1} and marks("not so. idiot") == {"plain": 1}
    assert marks("he said that idiot left") == {"reported": 1}
    assert marks("i will kill you") == {"aimed_threat": 1} and marks("idiotic") == {} and marks(None) == {}


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(name):
    pytest.importorskip("public_tokenizers")
    texts = [None, "", " ", "a", "  two  blanks ", "line\nnew\tline ", "<s> </s> <|endoftext|> <unk>", "ünïcode 東京 🙂", "tail ", prose(1, 3000), "x" * 5000, "no blanks " * 900 + " ", "a  b   c " * 500, "it's they'll 1234 " * 400]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokens.file_of(name))
        want = [len(model.encode(t or "")) for t in texts]
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokens.file_of(name))
        want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for piece, batch in ((1 << 16, 1 << 20), (50, 200), (7, 10)):
        assert tokens.count_tokens(texts, name, piece, batch) == want


def test_token_query(make_docs):
    pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r for r in tokens.op10(make_docs([(1, None, None, None), (2, "é b", None, None), (3, "w " * 9000, None, None), (3, "w " * 9000, None, None)])).collect()}
    assert (got[1].n_bytes, got[1].n_tokens) == (0, 0) and got[2].n_bytes == 4 and got[3].over_limit
    assert tokens.op10(make_docs([])).count() == 0
