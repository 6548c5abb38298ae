"""Quality classifier: a regularised quadratic discriminant on document statistics.

Statistics of a whole text (sizes, shares of character kinds, repetition) are
transformed to be closer to normal.  Each class has its mean and a covariance
that is shrunk towards the pooled one and towards a multiple of the unit
matrix.  Scores come from the difference of the log densities: squared
Mahalanobis distances by triangular solves with Cholesky factors that are
computed once, and the factors' log determinants.  A slope and an intercept,
fitted on the training rows, turn the difference into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import bounded_batches, materialize

NAMES = (
    "words", "word_bytes", "distinct_words", "repeated_neighbours", "repeated_runs", "top_word",
    "upper", "symbols", "marks", "digits", "bare_symbols", "symbol_ends", "stops", "lines", "wide",
)
EPSILON = 1e-3
_UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text: rows x ``len(NAMES)``; texts without words are zero counts."""
    n = len(offsets) - 1
    starts, ends, row = ta.words(data, offsets)
    hashes = ta.word_hashes(data, starts, ends)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def count(where: np.ndarray) -> np.ndarray:
        return np.bincount(where, minlength=n).astype(float)

    words = count(row)
    size = per_row(~ta.BLANK[data])
    some = np.maximum(words, 1)
    chars = np.maximum(size, 1)
    _, at = ta.distinct(hashes, row)
    distinct = count(at)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    top = np.zeros(n)
    if len(first):
        np.maximum.at(top, r[first], np.diff(np.r_[first, len(h)]))
    runs, run_row = ta.shingles(hashes, row, n, 3)
    n_runs = np.maximum(count(run_row), 1)
    same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    own = symbols[ends] - symbols[starts]
    letters = np.maximum(per_row(_LETTER[data]), 1)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log(x / of + EPSILON)

    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out = np.stack(
        [
            np.log1p(words),
            np.log(size / some + 1),
            share(distinct, some),
            share(count(row[1:][same]), some),
            share(n_runs - np.maximum(count(ta.distinct(runs, run_row)[1]), 1), n_runs),
            share(top, some),
            share(per_row(_UPPER[data]), letters),
            share(per_row(_SYMBOL[data]), chars),
            share(per_row(_MARK[data]), chars),
            share(per_row(_DIGIT[data]), chars),
            share(count(row[own == ends - starts]), some),
            share(count(row[_SYMBOL[last] | _MARK[last]]), some),
            share(per_row(data == 46), some),
            share(per_row(data == 10), some),
            share(per_row(data >= 128), chars),
        ],
        axis=1,
    )
    return out


def _forward(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Solutions z of factor z = row for all rows, by forward substitution.

    Sums over rows go through einsum, here and below: the threads of a BLAS
    library can hang in a process that shares its cores with Spark's.
    """
    z = np.empty_like(rows)
    for k in range(len(factor)):
        z[:, k] = (rows[:, k] - np.einsum("nj,j->n", z[:, :k], factor[k, :k])) / factor[k, k]
    return z


@dataclass
class Discriminant:
    """Means, Cholesky factors and their log determinants of classes 0 and 1, and the calibration."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    slope: float = 1.0
    intercept: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, *, to_pooled: float = 0.3, to_unit: float = 0.05) -> Discriminant:
        """Covariances (1 - a) S_k + a S_pooled, then (1 - b) of that + b * mean variance * unit.

        ``x`` must have rows of both classes.
        """
        scatter = []
        for k in (0, 1):
            z = x[y == k] - x[y == k].mean(0)
            scatter.append(np.einsum("ni,nj->ij", z, z) / len(z))
        pooled = sum(s * (y == k).mean() for k, s in enumerate(scatter))
        means, factors, offsets = [], [], []
        for k in (0, 1):
            cov = (1 - to_pooled) * scatter[k] + to_pooled * pooled
            cov = (1 - to_unit) * cov + to_unit * (np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            means.append(x[y == k].mean(0))
            factors.append(factor)
            offsets.append(float(np.log(np.diag(factor)).sum()))
        model = Discriminant(means, factors, offsets)
        model._calibrate(model.difference(x), y)
        return model

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            logs.append(-0.5 * (_forward(factor, x - mean) ** 2).sum(1) - offset)
        return logs[1] - logs[0]

    def _calibrate(self, d: np.ndarray, y: np.ndarray) -> None:
        """Logistic slope and intercept of the squashed difference, by Newton steps."""
        z = np.stack([np.arcsinh(d), np.ones(len(d))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z[:, 0] * w[0] + w[1], -30, 30)))
            gradient = np.einsum("nk,n->k", z, y - p) - 1e-3 * w
            step = np.linalg.solve(np.einsum("nj,nk,n->jk", z, z, p * (1 - p)) + 1e-3 * np.eye(2), gradient)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.intercept = float(w[0]), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.intercept, -30, 30)))


MAX_TRAINING_ROWS = 100_000
GATHERED = 2 * MAX_TRAINING_ROWS  # rows that reach the driver for a fit; repeated ids may bring more


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` (the statistics as 64-bit floats) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return narrow.mapInArrow(run, "doc_id long, x binary")


def _matrix(texts: pa.Array) -> np.ndarray:
    data, offsets = ta.utf8(texts)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in ta.chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def held_out(id_column: F.Column) -> F.Column:
    """Whether a document is kept out of training: crc32 of its id as text is divisible by 5."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def training_sample(labels: DataFrame, *, label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``doc_id, y`` of labelled documents that aren't held out.

    Of more than ``max_rows`` of them, a sample by the hash of the id of about
    that size.  Null labels are left out.  The sample is broadcast to what it is
    joined with where its counted rows are within twice the bound (repeated ids
    may exceed it).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id")))
    rows = known.count()
    keep = max(1, -(-rows // max_rows))
    if keep > 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(keep)) == 0)
        rows = known.count()
    return F.broadcast(known) if rows <= 2 * max_rows else known


def train(rows: DataFrame, sample: DataFrame) -> Discriminant | None:
    """Fit on the rows of :func:`features` that a :func:`training_sample`
    labels.  Without two rows of either class there is no model (None).

    Where repeated ids leave more than ``GATHERED`` rows, equal ones count once
    and, of more still, a sample by their hash of about that size is taken.
    """
    found = bounded(rows.join(sample, "doc_id").select("doc_id", "x", "y"), GATHERED).select("x", "y").toArrow()
    y = found.column("y").to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float64).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T, y))  # sums in one order whatever the order of arrival
    return Discriminant.fit(x[order], y[order])


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` if there are at most ``most``; else without equal rows and, of more still, a sample by hash."""
    if rows.count() <= most:
        return rows
    once = rows.dropDuplicates()
    keep = -(-once.count() // most)
    return once.where(F.pmod(F.xxhash64(*once.columns), F.lit(keep)) == 0) if keep > 1 else once


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """``doc_id, score`` of rows of :func:`features`; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def _scores(model: Discriminant | None, x: np.ndarray) -> np.ndarray:
    return model.score(x) if model is not None and len(x) else np.full(len(x), 0.5)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    The statistics of all texts are written once and read twice, for the
    training rows and for the scores.  Null, empty and very long texts are
    scored like others; repeated rows each have a row; other columns don't
    count; an empty table gives an empty result.
    """
    rows = materialize(features(docs), "quality-features")
    scored = score(rows, train(rows, training_sample(labels)))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is ``threshold`` or more, with all columns.

    Only the statistics of the bounded training sample are gathered; the rows
    themselves are filtered where they are, without a shuffle.
    """
    sample = training_sample(labels)
    labelled = docs.join(sample.select("doc_id"), "doc_id", "left_semi")
    model = train(materialize(features(labelled, text_col=text_col), "quality-labelled"), sample)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, _matrix(batch.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
