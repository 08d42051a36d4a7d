"""Language ID (operator 1): error-correcting output codes over n-gram classifiers.

Every language is a codeword of +1 / -1 bits (Dietterich and Bakiri, 1995). For each bit a binary
classifier on hashed 1- to 3-grams of letters, a naive-Bayes log-odds counted over all training
texts, says on which side a text lies. The nearest codeword is found by loss-weighted decoding
(Escalera, Pujol and Radeva, 2010): the logistic loss of each bit counts by how well that bit was
told on calibration texts of the language. A text whose bits lie further from the codeword than
the code corrects, or between two codewords, is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import columns_of, kind_of, per_process, sent, ship, short_batches

ship(__name__)

BUCKETS_LOG2 = 16
CHARS = 1_000_000  # characters handled at once
UNDETERMINED = "und"


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(languages, bits) of +1 / -1: every split of up to 6 languages; beyond, of 200 seeded
    random codes the one whose closest codewords are furthest apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [[1 if not i or not (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng, best, found = np.random.default_rng(seed), -1, None
    size = max(31, math.ceil(10 * math.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, size))
        apart = int(((size - code.astype(int) @ code.T.astype(int)) // 2 + size * np.eye(n, dtype=int)).min())
        if apart > best and (abs(code.sum(axis=0)) < n).all():
            best, found = apart, code
    return found


def distance_of(code: np.ndarray) -> int:
    """The least Hamming distance between two codewords."""
    n, size = code.shape
    apart = (size - code.astype(int) @ code.T.astype(int)) // 2
    return int(apart[~np.eye(n, dtype=bool)].min()) if n > 1 else size


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Grams:
    doc: np.ndarray  # number of the text each normalised character belongs to
    letters: np.ndarray  # letters in each text
    hashed: list[tuple[np.ndarray, np.ndarray]]  # by length: (places in doc, buckets)


def grams_of(texts: list[str]) -> Grams:
    """1- to 3-grams of lower-cased letters; what lies between letters counts as one space."""
    is_letter = per_process("letters", letter_table)
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    raw = "".join(lowered).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    letter = is_letter[codes]
    doc = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    doc, letter = doc[keep], letter[keep]
    now = np.where(letter, codes[keep], 32).astype(np.uint64)
    hashed, mixed = [], np.zeros(len(now), np.uint64)
    inside = letter.copy()
    for back in range(3):
        before = np.full(len(now), 32, np.uint64)
        same = np.zeros(len(now), bool)
        same[back:] = doc[back:] == doc[: len(doc) - back]
        before[back:] = now[: len(now) - back]
        before[~same] = 32
        mixed = (mixed + before + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if back:
            inside = np.ones(len(now), bool)  # a gram may begin or end with the space
        bucket = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS_LOG2)
        places = np.flatnonzero(inside)
        hashed.append((places, bucket[places].astype(np.int64)))
    return Grams(doc, letters, hashed)


def pieces(text: str) -> list[str]:
    """A long text in parts of CHARS characters; grams across a cut count their parts only."""
    return [text[i : i + CHARS] for i in range(0, len(text), CHARS)] or [""]


def count_grams(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """(languages, buckets): gram counts of all texts of ``docs`` (text, lang)."""
    place = {lang: i for i, lang in enumerate(languages)}
    buckets = 1 << BUCKETS_LOG2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place) * buckets, np.int64)
        for batch in short_batches(batches, "text", CHARS):
            for text, lang in zip(*columns_of(batch, "text", "lang"), strict=True):
                for part in pieces(text or ""):
                    found = grams_of([part])
                    for _, bucket in found.hashed:
                        at = place[lang] * buckets
                        total[at : at + buckets] += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"]
        )

    cells = docs.select("text", "lang").mapInArrow(count, "cell long, n long")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(place) * buckets)
    counts[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return counts.reshape(len(place), buckets)


def bit_weights(counts: np.ndarray, code: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """(buckets, bits) log-odds of a gram between the two sides of each bit.

    A side's gram distribution is the mean of its languages', so a frequent language does not
    drown a rare one.
    """
    share = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1])
    out = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        up, down = code[:, j] > 0, code[:, j] < 0
        if up.any() and down.any():
            out[:, j] = np.log(share[up].mean(axis=0)) - np.log(share[down].mean(axis=0))
    return out


def margins(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, margins) of each text: mean log-odds of its grams, times the root of their number
    up to 256."""
    sums = np.zeros((len(texts), weights.shape[1]))
    total, letters = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    start = 0
    while start < len(parts):
        end = size = start
        size = 0
        while end < len(parts) and (end == start or size + len(parts[end][1]) <= CHARS):
            size += len(parts[end][1])
            end += 1
        owner = np.array([i for i, _ in parts[start:end]])
        found = grams_of([p for _, p in parts[start:end]])
        np.add.at(letters, owner, found.letters)
        for places, bucket in found.hashed:
            if not len(places):
                continue
            doc = found.doc[places]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            np.add.at(sums, owner[doc[first]], np.add.reduceat(weights[bucket], first, axis=0))
            np.add.at(total, owner[doc[first]], np.diff([*first, len(doc)]))
        start = end
    n = np.maximum(total, 1)[:, None]
    return letters, sums / n * np.sqrt(np.minimum(n, 256))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # (languages, bits), rows sum to the number of bits


def logistic_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit by Newton steps, lightly penalised."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def train(
    docs: DataFrame, fold: Column, calibration_rows: int = 1500
) -> Model:
    """The model from ``docs`` (text, lang), all of them for the counts.

    Slopes and trust of the bits are fitted on a sample taken by hash among the rows where
    ``fold`` is true: about ``calibration_rows`` of each language.
    """
    known = docs.filter(F.col("lang").isNotNull())
    amounts = {
        r["lang"]: r["n"]
        for r in known.groupBy("lang").agg(F.count(F.when(fold, 1)).alias("n")).collect()
    }
    languages = sorted(amounts)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, *[np.zeros((0, 0))] * 4)
    weights = bit_weights(count_grams(known, languages), code)
    share = F.lit(0.0)
    for lang, n in amounts.items():
        share = F.when(F.col("lang") == lang, min(1.0, calibration_rows / max(n, 1))).otherwise(share)
    lot = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(fold & (lot < share)).select("text", "lang")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches, "text", CHARS):
            texts, langs = columns_of(batch, "text", "lang")
            letters, found = margins([t or "" for t in texts], weights)
            data = [pa.array(langs, pa.string()), pa.array(letters), pa.array(found.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(data, names=["lang", "letters", "margin"])

    got = sample.mapInArrow(measure, "lang string, letters long, margin array<double>")
    rows = got.filter("letters > 0").collect()
    truth = np.array([languages.index(r["lang"]) for r in rows], int)
    x = np.array([r["margin"] for r in rows]).reshape(-1, code.shape[1])
    slope, offset = np.ones(code.shape[1]), np.zeros(code.shape[1])
    trust = np.ones(code.shape)
    if len(rows) and len(languages) > 1:
        side = code[truth]
        for j in range(code.shape[1]):
            slope[j], offset[j] = logistic_line(x[:, j], (side[:, j] > 0).astype(float))
        right = (x * slope + offset) * side > 0
        for i in range(len(languages)):
            told = right[truth == i]
            trust[i] = (told.sum(axis=0) + 1) / (len(told) + 2)
        trust *= code.shape[1] / trust.sum(axis=1, keepdims=True)
    return Model(languages, code, weights, slope, offset, trust)


def decode(model: Model, x: np.ndarray, margin: float = 0.9) -> list[list]:
    """For each row of margins: best and second language, score, bit errors and ambiguity.

    The score is the best language's share when every language counts by the exponential of minus
    its weighted loss; a text is ambiguous below ``margin``, or with more bit errors than the code
    corrects.
    """
    f = x * model.slope + model.offset
    loss = np.logaddexp(0, -f[:, None, :] * model.code[None]) * model.trust[None]
    far = loss.sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")
    share = np.exp(far.min(axis=1, keepdims=True) - far)
    share /= share.sum(axis=1, keepdims=True)
    best = order[:, 0]
    second = order[:, 1] if order.shape[1] > 1 else best
    score = share[np.arange(len(x)), best]
    errors = (f * model.code[best] <= 0).sum(axis=1) if order.shape[1] > 1 else np.zeros(len(x), int)
    unsure = (score < margin) | (errors > (distance_of(model.code) - 1) // 2)
    return [best, second, score, errors, unsure]


def predict_language(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, lang_pred, score, second, bit_errors, ambiguous) of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
    was learned. Only the text is read.
    """
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    kind = source.schema[id_column].dataType.simpleString()
    received = sent(source.sparkSession, model)
    names = [id_column, "lang_pred", "score", "second", "bit_errors", "ambiguous"]
    kinds = [pa.string(), pa.float64(), pa.string(), pa.int32(), pa.bool_()]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model,) = received()
        for batch in short_batches(batches, "text", CHARS):
            ids, texts = columns_of(batch, id_column, "text")
            data = [ids, [UNDETERMINED] * len(ids), [0.0] * len(ids), [None] * len(ids)]
            data += [[0] * len(ids), [True] * len(ids)]
            if model.languages:
                letters, x = margins([t or "" for t in texts], model.weights)
                rows = zip(*(c.tolist() for c in decode(model, x)), strict=True)
                for i, (best, second, score, errors, unsure) in enumerate(rows):
                    if letters[i]:
                        data[1][i], data[3][i] = model.languages[best], model.languages[second]
                        data[2][i], data[4][i], data[5][i] = score, errors, unsure
            typed = zip(data, [kind_of(batch, id_column), *kinds], strict=True)
            arrays = [pa.array(c, k) for c, k in typed]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(
        predict,
        f"`{id_column}` {kind}, lang_pred string, score double, second string, bit_errors int, ambiguous boolean",
    )
