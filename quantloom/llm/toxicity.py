"""Operator 8, toxicity with a weighted finite-state pattern grammar.

Words are read as symbols (insult, suspect, threat, target, negation, report, other) by
an automaton over a lexicon. Six small transducers, composed into one table, follow the
symbols through a clause: negation and reported speech have a scope of a few words, a
target word lights up near insults and threats. The composed machine emits marks: an insult
that is plain, aimed, negated or reported, a threat that is aimed or not. A text's score is a
logistic function of its marks, so a clause counts, not the lone word.

Learned from labels: the insult lexicon (words and word beginnings) and the weights of the marks.
Both come from a bounded sample of labelled rows (``per_label`` documents a label). Evidence
for the lexicon is counted by Spark over the sample; the driver gets, per sampled toxic
text, the few candidates that pass. Copies and near copies of a text (``near_dedup.groups``) are one
text there, so a copied text neither adds to an entry's evidence nor takes from it. Evidence needs a few
different words before the entry, so that words which merely stand beside an insult in a repeated passage
stay out, and a surplus of toxic texts that chance does not explain. Entries that some
other documents hold too are read as suspect, a weaker symbol, and taken only as far as they
explain toxic documents without a sure insult. The
weights start from the grammar's own values and move as far as the labels say.
Cue words (negation, report, target, threat) are parameters with short defaults.

Scoring reads every whole text once in an Arrow function: the lexicon automaton runs over the text, and
only clauses with a match are parsed. Nothing is shuffled.

Defined results: null and empty texts have no marks and get the base score. Labels that are
null or have no document are ignored; repeated labels of a document count as one, toxic if
any is. Without a label of both kinds nothing is known: the grammar scores with its own
weights and an empty lexicon. Repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored
from quantloom.llm.near_dedup import groups
from quantloom.llm.sampling import drawn_number, held_out, in_sample, sample_cut

PER_LABEL = 2500
THRESHOLD = 0.3
#: A lexicon entry stands in so many sampled toxic texts, after so many different words, at least. Were all
#: words and beginnings spread without regard to the label, so many would be expected to pass by chance, at most.
LEAST_DOCS, LEAST_PLACES, BY_CHANCE = 3, 3, 0.5
#: Share of toxic texts among those with the entry: sure insults, and suspect words.
SURE, SUSPECT_FROM = 0.95, 0.4
BEGINNINGS = (4, 5, 6, 7)
MOST_ENTRIES = 1000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, SUSPECT = range(8)
MARKS = ("plain", "aimed", "negated", "reported", "threat", "aimed_threat", "suspect")
#: The grammar's own weights of a mark's first occurrence and of each further one, and the bias.
OWN_WEIGHTS, BIAS = np.array([4.0, 5.0, 1.0, 1.5, 3.0, 5.0, 1.0] + 7 * [1.0]), -4.0
#: Words that a negation, a report and a target reach.
NEGATION_SCOPE, REPORT_SCOPE, TARGET_SCOPE = 2, 8, 4
CUES = {
    THREAT: "kill hurt destroy töten verletzen tuer détruire matar destruir".split(),
    TARGET: "you your yourself dich dir du euch toi vous ti usted ustedes".split(),
    NEGATION: "not never nicht kein keine jamais nunca tampoco".split(),
    REPORT: "said wrote called quoted sagte schrieb nannte disait écrivit dijo escribió".split(),
}
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass
class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, tag)``; tag 0 says nothing."""

    states: int
    step: object


def _scope(opener: int, words: int) -> Transducer:
    """Tag 1 for ``words`` symbols after an opener; a clause end closes the scope."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == END:
            return 0, 0
        if symbol == opener:
            return words, 0
        return max(0, state - 1), int(state > 0)

    return Transducer(words + 1, step)


def _spot(symbol_: int) -> Transducer:
    return Transducer(1, lambda state, symbol: (0, int(symbol == symbol_)))


def compose(parts: list[Transducer], symbols: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """One machine that runs all parts at once: next state and tag bits by (state, symbol)."""
    sizes = [p.states for p in parts]
    total = int(np.prod(sizes))
    nexts, tags = np.zeros((total, symbols), np.int32), np.zeros((total, symbols), np.int32)
    for state in range(total):
        split = np.unravel_index(state, sizes)
        for symbol in range(symbols):
            moves = [p.step(int(s), symbol) for p, s in zip(parts, split, strict=True)]
            nexts[state, symbol] = np.ravel_multi_index([m[0] for m in moves], sizes)
            tags[state, symbol] = sum(m[1] << i for i, m in enumerate(moves))
    return nexts, tags


@lru_cache(maxsize=1)
def _machine() -> tuple[list, list]:
    nexts, tags = compose([_spot(INSULT), _spot(THREAT), _scope(TARGET, TARGET_SCOPE), _scope(NEGATION, NEGATION_SCOPE), _scope(REPORT, REPORT_SCOPE), _spot(SUSPECT)])
    return nexts.tolist(), tags.tolist()


def clause_marks(symbols: list[int]) -> Counter:
    """Marks of one clause. A target after the hit counts as well: the clause is read both ways."""
    nexts, tags = _machine()
    marks: Counter = Counter()
    backwards = []
    state = 0
    for symbol in reversed(symbols):
        backwards.append(tags[state][symbol])
        state = nexts[state][symbol]
    state = 0
    for symbol, behind in zip(symbols, reversed(backwards), strict=True):
        tag = tags[state][symbol]
        state = nexts[state][symbol]
        aimed = (tag | behind) >> 2 & 1
        if tag & 1:
            marks["reported" if tag >> 4 & 1 else "negated" if tag >> 3 & 1 else "aimed" if aimed else "plain"] += 1
        elif tag & 2 and not tag >> 3 & 1:
            marks["aimed_threat" if aimed else "threat"] += 1
        elif tag & 32 and not tag >> 3 & 1:
            marks["suspect"] += 1
    return marks


@dataclass
class Grammar:
    """``lexicon``: entries by symbol; an entry that starts with ``^`` is a word beginning."""

    lexicon: dict = field(default_factory=dict)
    cues: dict = field(default_factory=lambda: {k: tuple(v) for k, v in CUES.items()})
    weights: np.ndarray = field(default_factory=lambda: OWN_WEIGHTS.copy())
    bias: float = BIAS


class Reader:
    """A grammar's automaton, built once in a worker."""

    def __init__(self, grammar: Grammar) -> None:
        self.symbol = {w: s for s, words in grammar.cues.items() for w in words}
        self.beginnings: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for hit in grammar.cues[THREAT]:
            self.automaton.add_word(hit, len(hit))
        for symbol in (SUSPECT, INSULT):  # the surer reading holds
            for entry in grammar.lexicon.get(symbol, ()):
                (self.beginnings if entry[0] == "^" else self.symbol)[entry.lstrip("^")] = symbol
                self.automaton.add_word(entry.lstrip("^"), len(entry.lstrip("^")))
        self.lengths = sorted({len(b) for b in self.beginnings}, reverse=True)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def read(self, word: str) -> int:
        """A sure insult by word or beginning, else the word's symbol, else the longest beginning's."""
        whole = self.symbol.get(word, OTHER)
        if whole not in (OTHER, SUSPECT):
            return whole
        begun = [self.beginnings[word[:n]] for n in self.lengths if word[:n] in self.beginnings]
        return INSULT if INSULT in begun else whole or (begun[0] if begun else OTHER)

    def marks(self, text: str | None) -> Counter:
        """Marks of the whole text."""
        total: Counter = Counter()
        if not text or self.empty:
            return total
        low = text.lower()
        done = 0  # up to here clauses have been parsed
        for last, length in self.automaton.iter(low):
            first = last - length + 1
            if first < done or first and low[first - 1].isalpha():
                continue
            start = done
            for end in _CLAUSE_END.finditer(low, done, first):
                start = end.end()
            closing = _CLAUSE_END.search(low, last + 1)
            done = closing.end() if closing else len(low)
            total.update(clause_marks([self.read(w) for w in _WORD.findall(low, start, done)]))
        return total


def _counts(reader: Reader, texts: list[str | None]) -> np.ndarray:
    found = [reader.marks(t) for t in texts]
    return np.array([[m[k] for k in MARKS] for m in found], float).reshape(-1, len(MARKS))


def _inputs(counts: np.ndarray) -> np.ndarray:
    """A mark's first occurrence and its repetitions weigh differently."""
    return np.hstack([np.minimum(counts, 1.0), np.clip(counts - 1.0, 0.0, 4.0)])


def logit(grammar: Grammar, counts: np.ndarray) -> np.ndarray:
    return _inputs(counts) @ grammar.weights + grammar.bias


def fit_weights(grammar: Grammar, counts: np.ndarray, toxic: np.ndarray, share: float, pull: float = 0.002, steps: int = 1500) -> Grammar:
    """Logistic regression on the marks, pulled towards the grammar's own weights.

    ``share``: of toxic labels among all; the sample's rows are weighted to it.
    """
    x = _inputs(counts)
    w, b = grammar.weights.copy(), grammar.bias
    rate = toxic.mean()
    balance = np.where(toxic > 0, share / rate, (1 - share) / (1 - rate))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - toxic) * balance
        w -= 1.0 * (x.T @ g / len(x) + pull * (w - OWN_WEIGHTS))
        b -= 1.0 * (g.mean() + pull * (b - BIAS))
    return Grammar(grammar.lexicon, grammar.cues, np.maximum(w, 0.0), float(b))


def labelled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, toxic, text) of the bounded sample that may be learned from."""
    known = _known(labels)
    cuts = sample_cut(known, "toxic", "doc_id", per_label)
    few = known.where(in_sample(F.col("toxic"), F.col("doc_id"), cuts)).orderBy(drawn_number(F.col("doc_id")), "doc_id").limit(2 * per_label)
    # at most 2 * per_label ids and labels: a bounded table
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _evidence(sample: DataFrame) -> DataFrame:
    """(own, toxic, feature, before): words and word beginnings of a sampled text, copies counted once, with one word that stands before."""
    words = sample.select("own", "toxic", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "").alias("words"))
    spots = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get(F.col("words"), i - 1).alias("before")))
    listed = words.select("own", "toxic", F.explode(spots).alias("spot")).select("own", "toxic", "spot.word", "spot.before")
    longer = [F.when(F.length("word") > n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in BEGINNINGS]
    features = F.array_compact(F.array(F.when(F.length("word") > 2, F.col("word")), *longer))
    spread = listed.select("own", "toxic", "before", F.explode(features).alias("feature"))
    return spread.groupBy("own", "toxic", "feature").agg(F.coalesce(F.min("before"), F.lit("")).alias("before"))


def _one_per_text(sample: DataFrame) -> DataFrame:
    """The sample with ``own``, the same for copies and near copies of one label."""
    parts = []
    for toxic in (0, 1):
        part = sample.where(F.col("toxic") == toxic)
        own = groups(part.select("doc_id", "text")).groupBy("doc_id").agg(F.min("component_id").alias("own"))
        parts.append(part.join(own, "doc_id"))
    return stored(parts[0].unionByName(parts[1]), "toxicity-sample")


def _surplus(a: Column, b: Column, share: float, tried: int) -> Column:
    """Whether ``a`` toxic texts beside ``b`` others are more than chance gives, by the Chernoff bound of the
    binomial tail; ``share`` of all texts are toxic, and ``tried`` features are put to the test."""
    part = a / (a + b)
    apart = a * F.log(part / share) + F.when(b > 0, b * F.log((1 - part) / (1 - share))).otherwise(0.0)
    return (part > share) & (apart >= math.log(tried / BY_CHANCE))


def choose(found: dict, likely: dict[str, float]) -> tuple[list[str], list[str]]:
    """(sure, suspect) features. Sure ones are taken all; suspect ones as far as they explain
    toxic texts that hold no sure one, the one that explains most coming first."""
    sure = sorted((f for f in likely if likely[f] >= SURE), key=lambda f: (-likely[f], f))[:MOST_ENTRIES]
    taken = set(sure)
    docs_of: dict[str, set] = {}
    for doc, features in found.items():
        if taken.isdisjoint(features):
            for f in features:
                docs_of.setdefault(f, set()).add(doc)
    suspect: list[str] = []
    while docs_of and len(suspect) < MOST_ENTRIES:
        # of equal ones the likelier, then the more exact
        best = max(docs_of, key=lambda f: (len(docs_of[f]), likely[f], f[0] != "^", len(f), f))
        covered = docs_of.pop(best)
        if len(covered) < LEAST_DOCS:
            break
        suspect.append(best)
        docs_of = {f: rest for f, d in docs_of.items() if (rest := d - covered)}
    return sure, suspect


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Grammar:
    known = {r.toxic: r["count"] for r in _known(labels).groupBy("toxic").count().collect()}
    sample = stored(labelled(docs, labels, per_label), "toxicity-labelled")
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Grammar()
    sample = _one_per_text(sample)
    texts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count_distinct("own").alias("n")).collect()}
    evidence = _evidence(sample)
    toxic = F.when(F.col("toxic") == 1, 1)
    # the chance that a text with the feature is toxic, at the labels' own frequencies
    a, b = F.col("a") * (known[1] / totals[1]), F.col("b") * (known[0] / totals[0])
    counted = evidence.groupBy("feature").agg(
        F.count(toxic).alias("a"), (F.count("*") - F.count(toxic)).alias("b"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("places"))
    counted = stored(counted.where(F.col("a") + F.col("b") >= LEAST_DOCS), "toxicity-evidence")
    surplus = _surplus(F.col("a"), F.col("b"), texts[1] / (texts[0] + texts[1]), max(1, counted.count()))
    passing = counted.where((F.col("a") >= LEAST_DOCS) & (F.col("places") >= LEAST_PLACES) & surplus)
    passing = passing.select("feature", (a / (a + b)).alias("likely")).where(F.col("likely") >= SUSPECT_FROM)
    rows = evidence.where("toxic = 1").join(passing, "feature").groupBy("own").agg(F.collect_list(F.struct("feature", "likely")).alias("found")).collect()
    likely = {x.feature: x.likely for r in rows for x in r.found}
    sure, suspect = choose({r.own: [x.feature for x in r.found] for r in rows}, likely)
    grammar = Grammar({INSULT: tuple(sure), SUSPECT: tuple(suspect)})
    marked = sample.select("toxic", marks(F.col("text"), grammar).alias("marks")).collect()
    share = known[1] / (known[0] + known[1])
    return fit_weights(grammar, np.array([r.marks for r in marked], float), np.array([r.toxic for r in marked], float), share)


def marks(text: Column, grammar: Grammar) -> Column:
    """Array of the counts of MARKS in each whole text."""
    readers: list[Reader] = []

    @F.arrow_udf("array<double>")
    def count(texts: pa.Array) -> pa.Array:
        if not readers:
            readers.append(Reader(grammar))
        return pa.array(_counts(readers[0], texts.to_pylist()).tolist(), pa.list_(pa.float64()))

    return count(text)


def toxicity(text: Column, grammar: Grammar) -> Column:
    """Score from 0 to 1 of each whole text."""
    readers: list[Reader] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not readers:
            readers.append(Reader(grammar))
        z = logit(grammar, _counts(readers[0], texts.to_pylist()))
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return score(text)


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, columns as given."""
    # struct first: a column of docs may be called anything
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return row.withColumn("_score", toxicity(F.col("_row.text"), grammar)).where(F.col("_score") < threshold).select("_row.*")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    grammar = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), grammar).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
