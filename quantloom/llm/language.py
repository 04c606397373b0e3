"""Operator 4, language ID with a byte convolutional network.

Network: bytes (A-Z folded) are embedded, filters of widths 2, 3 and 4 slide over a window of
256 bytes, each filter's maximum goes through a softmax layer. It is trained in NumPy with Adam on
a bounded sample of labelled rows (``per_lang`` documents of each language, ``WINDOWS`` windows
of each, both parameters). Every window of every whole text is then scored in Arrow batches
of bounded size; a text's languages are its windows' mean log-probabilities, by bytes.
Scoring shuffles nothing; the weights (a few KB) travel with the function.

Defined results: ``und`` with score 0 for null text and text without a letter (empty text
too), and for every text where there is nothing to learn from. Rows without lang are
predicted but not learned from; a null doc_id counts as not held out. Repeated rows are
predicted alike. Very long texts are scored in blocks of windows. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.sampling import drawn_number, held_out, in_sample, sample_cut

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DEPTH = 6
PER_LANG = 1200
WINDOWS = 3
EPOCHS = 10
#: Windows scored at once.
BLOCK = 256
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # 256 x DEPTH; byte 0 is padding and stays 0
    conv: np.ndarray  # (4 * DEPTH) x filters; narrow filters have zeros behind
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray


def _conv_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS), DEPTH, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask.reshape(max(WIDTHS) * DEPTH, -1)


def _features(net: ByteNet, windows: np.ndarray):
    """Embedded patches, and each filter's maximum over the window with its place."""
    span = max(WIDTHS)
    n, length = windows.shape
    embedded = net.embed[np.pad(windows, ((0, 0), (0, span - 1)))].reshape(n, -1)
    patches = np.lib.stride_tricks.sliding_window_view(embedded, span * DEPTH, axis=1)[:, ::DEPTH]
    patches = np.ascontiguousarray(patches).reshape(n * length, span * DEPTH)
    acts = (patches @ net.conv).reshape(n, length, -1)
    return patches, acts


def log_probs(net: ByteNet, windows: np.ndarray) -> np.ndarray:
    _, acts = _features(net, windows)
    top = np.maximum(acts.max(1) + net.bias, 0)
    z = top @ net.out + net.out_bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Train on windows (n x WINDOW bytes) with integer labels."""
    rng = np.random.default_rng(seed)
    k, m = len(langs), len(WIDTHS) * FILTERS
    mask = _conv_mask()
    net = ByteNet(
        langs, rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(m, np.float32), rng.normal(0, 0.2, (m, k)).astype(np.float32), np.zeros(k, np.float32))
    net.embed[0] = 0
    params = [net.embed, net.conv, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for chosen in np.array_split(order, max(1, len(order) // 64)):
            x, y = windows[chosen], labels[chosen]
            n, length = x.shape
            patches, acts = _features(net, x)
            place = acts.argmax(1)
            best = np.take_along_axis(acts, place[:, None], 1)[:, 0] + net.bias
            top = np.maximum(best, 0)
            z = top @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            d_top = (p @ net.out.T) * (best > 0)
            rows = (np.arange(n)[:, None] * length + place).ravel()  # the patch each maximum came from
            d = d_top.ravel()[:, None]
            filters = np.tile(np.arange(m), n)
            d_conv = np.zeros_like(net.conv.T)
            np.add.at(d_conv, filters, patches[rows] * d)
            d_patch = (net.conv.T[filters] * d).reshape(-1, max(WIDTHS), DEPTH)
            padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
            spots = (np.arange(n)[:, None] * padded.shape[1] + place).ravel()[:, None] + np.arange(max(WIDTHS))
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, padded.ravel()[spots].ravel(), d_patch.reshape(-1, DEPTH))
            d_embed[0] = 0
            step += 1
            for q, g, (a, b) in zip(params, (d_embed, d_conv.T * mask, d_top.sum(0), top.T @ p, p.sum(0)), moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.004 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def _windows(octets: bytes) -> np.ndarray:
    raw = _FOLD[np.frombuffer(octets, np.uint8)]
    return np.pad(raw, (0, -len(raw) % WINDOW)).reshape(-1, WINDOW)


def predict(net: ByteNet, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text."""
    sums = np.zeros((len(texts), len(net.langs)))
    sizes = np.ones(len(texts))
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def flush() -> None:
        x, who = np.concatenate(held), np.concatenate(owners)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            weight = np.count_nonzero(part, axis=1)[:, None]
            np.add.at(sums, who[at : at + BLOCK], log_probs(net, part) * weight)
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        if text:
            octets = text.encode()
            sizes[i] = len(octets)
            for at in range(0, len(octets), BLOCK * WINDOW):
                held.append(_windows(octets[at : at + BLOCK * WINDOW]))
                owners.append(np.full(len(held[-1]), i))
                if sum(map(len, held)) >= BLOCK:
                    flush()
    if held:
        flush()
    mean = sums / sizes[:, None]
    odds = np.exp(mean - mean.max(1, keepdims=True))
    odds /= odds.sum(1, keepdims=True)
    return [net.langs[j] for j in odds.argmax(1)], odds.max(1).tolist()


def train(docs: DataFrame, per_lang: int = PER_LANG, windows: int = WINDOWS) -> ByteNet | None:
    """Learn from text and lang of the rows that are not held out; None where there are none."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    cuts = sample_cut(known, "lang", "doc_id", per_lang)
    if not cuts:
        return None
    octets = F.col("text").cast("binary")
    spare = F.greatest(F.length(octets) - WINDOW, F.lit(0)) + 1
    taken = [F.substring(octets, F.pmod(F.xxhash64(F.col("doc_id"), F.lit(i)), spare).cast("int") + 1, F.lit(WINDOW)) for i in range(windows)]
    drawn = drawn_number(F.col("doc_id"))
    few = known.where(in_sample(F.col("lang"), F.col("doc_id"), cuts)).select("lang", drawn.alias("drawn"), F.array(*taken).alias("taken"))
    rows = few.orderBy("drawn", "lang", "taken").limit(per_lang * len(cuts)).collect()
    langs = [lang for lang, _ in cuts]
    pairs = [(bytes(w), langs.index(r.lang)) for r in rows for w in dict.fromkeys(map(bytes, r.taken)) if w]
    x = np.stack([_windows(w)[0] for w, _ in pairs])
    return fit(x, np.array([y for _, y in pairs]), langs)


def language(text: Column, net: ByteNet | None) -> Column:
    """Struct (lang_pred, score) of each text."""
    unknown = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return unknown

    @F.arrow_udf("lang_pred string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        langs, scores = predict(net, texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), guess(text)).otherwise(unknown)


def op4(docs: DataFrame) -> DataFrame:
    net = train(docs.select("doc_id", "text", "lang"))
    guessed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), net).alias("guess"))
    return guessed.select("doc_id", "held_out", "guess.lang_pred", "guess.score")
