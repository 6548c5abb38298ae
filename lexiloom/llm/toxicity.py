"""Toxicity by cumulative-link ordinal regression.

Words are runs of letters, lower-cased; the sparse features of a text are how
often each of a few hundred words or word beginnings occurs.  They are chosen
by the log odds of occurring in toxic training texts, smoothed and divided by
their standard error.  One weight per feature is shared by all thresholds:

    P(grade <= k) = sigmoid(threshold_k - w . x)

The labels only mark toxic texts.  How severe a toxic training text is, is
taken from how far it spreads: grade 2 where more of its sentences than the
toxic texts' median hold a selected word, else grade 1.  That share is no
feature: the model sees counts and rates of words, not where they stand.
Scores are expected grades.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .quality import bounded
from .storage import bounded_batches, materialize

MAX_TRAINING_ROWS = 20_000
FEATURES = 512
LEAST_TEXTS = 5
BEGINNINGS = (4, 5, 6, 7, 8, 10)  # bytes
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (words and their beginnings) with their rows, the number of words of each row, and where each begins."""
    n = len(offsets) - 1
    data = data.copy()
    high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[high] += 0x20  # Latin capitals with accents
    blanked = np.where(_LETTERS[data], data, 32).astype(np.uint8)
    starts, ends, row = ta.words(blanked, offsets)
    hashes, rows, begins = [ta.word_hashes(blanked, starts, ends)], [row], [starts]
    for size in BEGINNINGS:
        long = ends - starts > size
        hashes.append(ta.word_hashes(blanked, starts[long], starts[long] + size) ^ np.uint64(0xABCD))
        rows.append(row[long])
        begins.append(starts[long])
    words = np.bincount(row, minlength=n).astype(float) if len(row) else np.zeros(n)
    return np.concatenate(hashes), np.concatenate(rows), words, np.concatenate(begins)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = ta.utf8(texts)
    for low, high in ta.chunks(offsets):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def _batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for low, high, data, offsets in _chunks(texts):
        yield low, high, *_tokens(data, offsets)[:3]


def _vocabulary(training: DataFrame, features: int) -> np.ndarray:
    """Hashes of the words that mark toxic texts most clearly, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            seen, toxic = [], []
            for low, _, h, row, _ in _batches(batch.column(0)):
                h, row = ta.distinct(h, row)
                seen.append(h)
                toxic.append(y[low + row])
            if seen:
                keys, inverse = np.unique(np.concatenate(seen), return_inverse=True)
                flags = np.concatenate(toxic)
                n = np.bincount(inverse, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.bincount(inverse, flags, len(keys)).astype(np.int64))], ["h", "n", "toxic"]
                )

    counts = training.select("text", "y").mapInArrow(run, "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    total = training.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    toxic, clean = float(total["t"]), float(total["n"] - total["t"])
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (F.lit(toxic + 1) - a)) - F.log(b / (F.lit(clean + 1) - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    best = counts.where(F.col("t") >= LEAST_TEXTS).select("h", z.alias("z")).where("z > 2").orderBy(F.desc("z"), "h").limit(features)
    return np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64))


def _spread(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each text's sentences with words that hold a selected word."""
    n = len(offsets) - 1
    sentence = np.r_[0, np.cumsum(_END[data])]
    h, row, _, starts = _tokens(data, offsets)
    key = row * (int(sentence[-1]) + 2) + sentence[starts]
    hit = np.isin(h, vocabulary)
    count = lambda k: np.bincount(np.unique(k) // (int(sentence[-1]) + 2), minlength=n)
    return count(key[hit]) / np.maximum(count(key), 1)


def _counts(vocabulary: np.ndarray, n: int, h: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log(1 + count) of each selected word, and of their occurrences per thousand words."""
    out = np.zeros((n, len(vocabulary) + 1))
    if len(vocabulary) and len(h):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        np.add.at(out, (row[hit], at[hit]), 1.0)
    out[:, -1] = 1000 * out[:, :-1].sum(1) / np.maximum(words, 1)
    return np.log1p(out)


@dataclass
class Ordinal:
    """Shared weights and rising thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade = k) of each row."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.einsum("nd,d->n", x, self.weights)[:, None], -40, 40)))
        below = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        return np.diff(below, axis=1)

    def severity(self, x: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return expected(self.probabilities(x))


def expected(p: np.ndarray) -> np.ndarray:
    return (p * np.arange(p.shape[1])).sum(1)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, *, ridge: float = 1e-3, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least mean negative log likelihood plus a ridge (Adam, full batch)."""
    k = int(grade.max())
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k + 1))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    base = np.log(share / (1 - share))
    # Thresholds are the first one plus positive steps, so they stay in order.
    free = np.concatenate([np.zeros(x.shape[1]), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    n, d = x.shape
    at, column = np.nonzero(x)
    value = x[at, column]
    for t in range(1, steps + 1):
        gaps = np.exp(np.clip(free[d + 1 :], -20, 20))
        cuts = free[d] + np.r_[0.0, np.cumsum(gaps)]
        eta = np.bincount(at, value * free[column], n)
        padded = np.r_[-np.inf, cuts, np.inf]
        upper = 1 / (1 + np.exp(-np.clip(padded[grade + 1] - eta, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(padded[grade] - eta, -40, 40)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_cut = np.array([dl[grade == j + 1].sum() - du[grade == j].sum() for j in range(k)]) / len(grade)
        g = np.concatenate([np.bincount(column, value * (du - dl)[at], d) / n + ridge * free[:d], [g_cut.sum()], [g_cut[j:].sum() * gaps[j - 1] for j in range(1, k)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return free[:d], free[d] + np.r_[0.0, np.cumsum(np.exp(np.clip(free[d + 1 :], -20, 20)))]


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS, features: int = FEATURES) -> Ordinal | None:
    """Fit on labelled documents that aren't held out (crc32 of the id as text
    divisible by 5 is held out); of more than ``max_rows``, on a sample by the
    hash of the id of about that size.  Null labels are left out.  Without two
    toxic and two other training texts there is no model (None)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    keep = max(1, -(-known.count() // max_rows))
    if keep > 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(keep)) == 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Repeated ids may bring more rows than the sample has; the bound of those holds for the rows.
    training = materialize(bounded(texts.join(known, "doc_id").select("doc_id", "text", "y"), 2 * max_rows), "toxicity-training")
    total = training.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    if not total["n"] or min(total["t"], total["n"] - total["t"]) < 2:
        return None
    vocabulary = _vocabulary(training, features)
    width = len(vocabulary) + 2  # counts, their rate, and the spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in _chunks(batch.column(1)):
                h, row, words, _ = _tokens(data, offsets)
                x = np.hstack([_counts(vocabulary, high - low, h, row, words), _spread(vocabulary, data, offsets)[:, None]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"]
                )

    found = training.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x binary").orderBy("doc_id", "x").toArrow()
    y = found.column("y").to_numpy()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(y), width).astype(float)
    x, spread, toxic = x[:, :-1], x[:, -1], y == 1
    grade = np.where(toxic, 1 + (spread > np.median(spread[toxic])), 0)
    if grade.max() < 2:
        grade = np.where(toxic, 1, 0)
    weights, thresholds = fit_ordinal(x, grade)
    return Ordinal(vocabulary, weights, thresholds)


def score(docs: DataFrame, model: Ordinal | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every row.

    ``severity``: expected grade; ``grade``: the likeliest (the lower of
    equals); ``toxic``: 1 where P(grade > 0) is at least ``threshold``.  Null
    texts count as empty; without a model all are 0.  Repeated rows each have a
    row; other columns don't count; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, h, row, words in _batches(batch.column(1)):
                n = high - low
                if model is None:
                    p = np.tile([1.0, 0.0], (n, 1))
                else:
                    p = model.probabilities(_counts(model.vocabulary, n, h, row, words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, n),
                        pa.array(expected(p)),
                        pa.array(p.argmax(1).astype(np.int32)),
                        pa.array((1 - p[:, 0] >= threshold).astype(np.int32)),
                    ],
                    ["doc_id", "severity", "grade", "toxic"],
                )

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return narrow.mapInArrow(run, "doc_id long, severity double, grade int, toxic int")
