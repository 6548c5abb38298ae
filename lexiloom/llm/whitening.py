"""Whitening of embeddings by matrix-free block subspace iteration.

1. Entries become whole numbers, floor(scale * c), and a vector is packed into
   the narrowest integers that hold it.  Each distinct vector counts once in
   the fit; a shuffle of packed vectors, pre-aggregated, finds them.
2. Each Spark pass computes Y = X^T (X Q) / n over the centred rows X for a
   block Q of orthonormal columns.  A task holds one matrix of the block's size;
   tasks' sums are added up by a few tasks before they reach the driver, so
   neither rows nor the d x d covariance are ever gathered.
3. On the driver, Rayleigh-Ritz on Q^T Y gives values and vectors, whose
   residuals come from the same Y.  The next block is the orthonormal factor of
   Y by QR.
4. The passes end when the residuals of all k components certify them.  Where
   the spectrum is so flat that the Ritz values predict more than ``PATIENCE``
   passes to come, the block is doubled; at the whole dimension one pass is
   exact, so the passes always end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

BLOCK = 16  # columns of the first block, or four for each component
PATIENCE = 8  # passes to come that a block may take
CERTAIN = 1e-13  # residual of an exact component, as a part of the greatest eigenvalue
NEARLY = 1e-11  # certified too, once rounding keeps it from falling
PASSES = 500
FAN_IN, GATHERED = 32, 64 << 20  # rows and bytes of sums that reach the driver
ROWS = 4096  # multiplied at a time
SEED = 11


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: the items' size, then the items, as narrow as a row's entries allow."""
    out: list[bytes] = [b""] * len(x)
    top = np.maximum(x.max(1), -(x.min(1) + 1)) if x.shape[1] else np.zeros(len(x), np.int64)
    for size, low, high in ((2, -1, 1 << 15), (4, 1 << 15, 1 << 31), (8, 1 << 31, None)):
        at = np.flatnonzero((top >= low) & (top < high) if high else top >= low)
        raw, width = x[at].astype(f"<i{size}").tobytes(), x.shape[1] * size
        head = bytes([size])
        for k, row in enumerate(at.tolist()):
            out[row] = head + raw[k * width : (k + 1) * width]
    return out


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Packed rows of one dimension as 64-bit whole numbers."""
    if not len(column):  # has no offsets
        return np.zeros((0, dim), np.int64)
    column = column.cast(pa.large_binary())  # has an offset of its own
    _, o, data = column.buffers()
    o = np.frombuffer(o, np.int64, len(column) + 1, column.offset * 8)
    out, sizes = np.zeros((len(column), dim), np.int64), np.diff(o) - 1
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for size in (2, 4, 8):
        at = np.flatnonzero(sizes == size * dim)
        if dim and len(at):
            grid = data[(o[at] + 1)[:, None] + np.arange(size * dim)]
            out[at] = grid.reshape(-1).view(f"<i{size}").reshape(len(at), dim)
    return out


def quantise(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, dim, x``: packed whole numbers floor(scale * c) of vectors without null or non-finite entries.

    What doesn't fit into a long becomes the nearest double that does.
    """
    edge = float(2**63 - 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets, items = column.offsets.to_numpy(), column.values
            values = items.fill_null(float("nan")).to_numpy() if len(items) else np.zeros(0)
            there, sizes = column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets)
            packed: list[bytes | None] = [None] * batch.num_rows
            for dim in np.unique(sizes[there]).tolist():
                at = np.flatnonzero(there & (sizes == dim))
                for low in range(0, len(at), ROWS):
                    rows = at[low : low + ROWS]
                    x = values[offsets[rows][:, None] + np.arange(dim)]
                    good = np.isfinite(x).all(1)
                    with np.errstate(over="ignore"):
                        whole = np.clip(np.floor(scale * x[good]), -edge, edge).astype(np.int64)
                    for row, raw in zip(rows[good].tolist(), _pack(whole)):
                        packed[row] = raw
            keep = pa.array([p is not None for p in packed])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary())], ["id", "dim", "x"])
            yield out.filter(keep)

    kind = vectors.schema[id_col].dataType.simpleString()
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, f"id {kind}, dim int, x binary").withColumnRenamed("id", id_col)


def _passed(fit: DataFrame, dim: int, width: int, kind: str, work: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Arrays of ``width`` items (sums of ``work`` over the rows, a slice at a time) of few groups of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, slot = np.zeros(width, kind), TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                sums += work(_unpack(batch.column(0).slice(low, ROWS), dim))
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, kind)
        for batch in batches:
            for raw in batch.column(1):
                sums += np.frombuffer(raw.as_py(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["slot", "sums"])

    schema = "slot int, sums binary"
    few = max(1, min(FAN_IN, GATHERED // max(1, 8 * width)))
    rows = fit.select("x").mapInArrow(run, schema).repartition(few, "slot").mapInArrow(add, schema)
    return [np.frombuffer(r["sums"], kind) for r in rows.collect()]


@dataclass
class Whitening:
    """``n`` distinct vectors with the exact ``sums`` of each dimension; unit
    ``vectors`` (columns) of the covariance with their ``values``, by falling
    value, and its ``trace``.  ``dim`` is None where there was nothing to fit."""

    n: int
    dim: int | None
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, quantised: DataFrame, id_col: str = "vec_id") -> DataFrame:
        """``id_col, deviation, whitened`` (array) of rows of :func:`quantise`; both are null for vectors of another length."""
        n, dim, mean = self.n, self.dim, self.mean
        turn = self.vectors / np.sqrt(self.values)
        wrapped = np.array([s % 2**64 for s in self.sums], np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    own = dims[low : low + ROWS] == dim
                    x = _unpack(part.column(2).filter(pa.array(own)), dim)
                    deviations: list[int | None] = [None] * len(own)
                    shares: list[list[float] | None] = [None] * len(own)
                    for row, d, w in zip(np.flatnonzero(own).tolist(), _deviations(x, n, wrapped, self.sums), np.einsum("nd,dk->nk", x - mean, turn).tolist()):
                        deviations[row], shares[row] = d, w
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations, pa.int64()), pa.array(shares, pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

        kind = quantised.schema[id_col].dataType.simpleString()
        out = quantised.select(F.col(id_col).alias("id"), "dim", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")
        return out.withColumnRenamed("id", id_col)


def _deviations(x: np.ndarray, n: int, wrapped: np.ndarray, sums: list[int]) -> list[int | None]:
    """Exact sums of (n*x - S)^2; null beyond a long.

    Unsigned arithmetic modulo 2**64 is exact for results that fit, which their
    size in doubles tells; next to the limit, Python's whole numbers decide.
    """
    away = x.astype(np.uint64) * np.uint64(n % 2**64) - wrapped
    exact = (away * away).sum(1, dtype=np.uint64)
    about = ((n * x.astype(np.float64) - np.array(sums, float)) ** 2).sum(1)
    out: list[int | None] = [int(e) if a < 2**63 * (1 - 1e-6) else None for e, a in zip(exact, about)]
    for row in np.flatnonzero((about >= 2**63 * (1 - 1e-6)) & (about < 2**63 * (1 + 1e-6))).tolist():
        whole = sum((n * v - s) ** 2 for v, s in zip(x[row].tolist(), sums))
        out[row] = whole if whole < 2**63 else None
    return out


def fit(quantised: DataFrame, components: int = 4) -> Whitening:
    """Components of the covariance of the distinct vectors of :func:`quantise`, which should be a written table.

    Vectors of the most frequent length are fitted (of the greatest of several).
    There are as many components as positive eigenvalues, ``components`` at most.
    """
    common = quantised.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None or not common["dim"]:
        return Whitening(0, None, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0, 0.0)
    dim = int(common["dim"])
    rows = materialize(quantised.where(F.col("dim") == dim).select("x").distinct(), "whitening-fit")
    n = rows.count()

    def halves(x: np.ndarray) -> np.ndarray:
        """Sums of upper and lower halves of the numbers, so that none overflows."""
        return np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    parts = _passed(rows, dim, 2 * dim, "<i8", halves)
    sums = [sum(int(p[j]) for p in parts) * 2**32 + sum(int(p[dim + j]) for p in parts) for j in range(dim)]
    mean = np.array([s / n for s in sums])
    block = min(dim, max(BLOCK, 4 * components))
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    last, trace, k = math.inf, 0.0, min(components, dim)
    for step in range(1, PASSES + 1):

        def multiply(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            centred = x - mean
            return np.append(np.einsum("nd,nb->db", centred, np.einsum("nd,db->nb", centred, q)).ravel(), (centred * centred).sum())

        total = np.sum(_passed(rows, dim, dim * q.shape[1] + 1, "<f8", multiply), axis=0) / n
        y, trace = total[:-1].reshape(dim, -1), float(total[-1])
        if trace <= 0:
            return Whitening(n, dim, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, step, 0.0)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        worst = float(np.sqrt(((image[:, :k] - ritz[:, :k] * values[:k]) ** 2).sum(0)).max() / values[0])
        if worst <= CERTAIN or (worst <= NEARLY and worst > last / 2):
            there = int((values[:k] > dim * 1e-15 * values[0]).sum())
            found = Whitening(n, dim, sums, ritz[:, :there], values[:there], trace, step, worst)
            found.identity_error = _identity_error(rows, found)
            return found
        last = worst
        speed = max(values[-1], 0.0) / values[k - 1] if values[k - 1] > 0 else 1.0
        if q.shape[1] < dim and worst * speed**PATIENCE > CERTAIN:
            more = min(dim, 2 * q.shape[1]) - q.shape[1]
            image, last = np.hstack([image, rng.standard_normal((dim, more)) * math.sqrt(trace / dim)]), math.inf
        q = np.linalg.qr(image)[0]
    raise ArithmeticError(f"a residual of {worst:.2g} after {PASSES} passes")


def _identity_error(rows: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    mean, turn, dim = found.mean, found.vectors / np.sqrt(found.values), found.dim
    k = turn.shape[1]

    def squares(x: np.ndarray) -> np.ndarray:
        w = np.einsum("nd,dk->nk", x - mean, turn)
        return np.concatenate([w.sum(0), np.einsum("nk,nl->kl", w, w).ravel()])

    total = np.sum(_passed(rows, dim, k + k * k, "<f8", squares), axis=0) / found.n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])  # the mean is 0 but for rounding
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, *, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector without null or non-finite entries and each component:
    ``id_col, component, n, deviation, whitened, explained, identity_error``.

    ``n``: distinct whole-number vectors that were fitted; ``deviation``: exact
    sum over dimensions of (n*x - S)^2, null where it is beyond a long;
    ``whitened``: the centred vector on the component over the root of its
    eigenvalue; ``explained``: the eigenvalue's part of the trace;
    ``identity_error``: one value for all rows.

    Repeated rows give repeated results, but count once in the fit.  Null ids
    are kept.  Vectors of another length than most are not fitted; they have
    their rows, with a null deviation and null values.  Where all vectors are
    equal or empty there is no component and so no row, as for an empty table.
    """
    quantised = materialize(quantise(vectors, scale, id_col, vector_col), "whitening-rows")
    found = fit(quantised, components)
    k = len(found.values)
    if not k:
        return quantised.where(F.lit(False)).select(
            id_col, *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))
        )
    parts = [F.struct(F.lit(j + 1).alias("component"), F.get("whitened", F.lit(j)).alias("value"), F.lit(float(found.values[j] / found.trace)).alias("explained")) for j in range(k)]
    rows = found.apply(quantised, id_col).withColumn("part", F.explode(F.array(*parts)))
    return rows.select(
        id_col, F.col("part.component"), F.lit(found.n).cast("long").alias("n"), "deviation", F.col("part.value").alias("whitened"), F.col("part.explained"), F.lit(found.identity_error).alias("identity_error")
    )
