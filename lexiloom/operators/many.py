"""Many elastic-net logistic regressions fitted side by side.

A learning curve or a search needs the same table fitted many times: on several
shares of the rows, without each fold in turn, with several penalties.  Rows
say which models they train by a fold and a rank, models keep their matrices
on the driver, and one Spark job a step adds up the gradients of all models
that haven't converged, so rows are indexed and read once a step and not once a
model.  Steps are proximal gradients with momentum, which restarts where it
leads away.  The curvature of the log loss is at most half of the features'
second moments; where those fit, one pass sums them up, and each step solves
the penalised quadratic that they bound.  How much of the bound is needed is
seen from the last two gradients of a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import counts, hash_rank
from .topics import _partitions, _summed

ROWS = 1024  # multiplied at a time
GROUP = 64 << 20  # bytes of the sums that a task holds; more models are fitted in groups
LEAST = 128  # rows of a task, unless there are fewer in all
POWER = 8  # passes that find the greatest curvature
FULL = 512  # features up to which all second moments are kept
SWEEPS = 30  # over the coordinates, of a step at most


@dataclass(frozen=True)
class Task:
    """A model of the rows outside ``fold`` (None: of all) up to ``share``."""

    C: float
    l1_ratio: float
    fold: int | None = None
    share: float = 1.0


@dataclass
class Linear:
    """Coefficients (classes x features, of features divided by ``scale``) and intercepts; -inf for absent classes."""

    task: Task
    coefficients: np.ndarray
    intercepts: np.ndarray
    scale: np.ndarray
    rows: int
    steps: int = 0


def deal(rows: DataFrame, key: str, features: str, label: str, *, folds: int = 5, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """``key, x, y, fold, need`` and the classes in order.

    Rows of a class are dealt into folds in turn, by hash.  ``need[f]`` is the
    share up to which a model without fold f doesn't train on the row: what
    precedes it among the class's rows outside f, as a part of them.  Both
    follow from the row's rank and the class's size, so rows are ranked once.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(key, F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("_c"))
    sizes = counts(known, "_c").withColumnRenamed("n", "_n")  # one row per class
    found = {r["_c"]: r["_n"] for r in sizes.collect()}
    names = sorted(found)
    ranked = hash_rank(known, key, "_c", seed, "_r").join(F.broadcast(sizes), "_c")
    before = F.col("_r") - 1

    def need(f: Column) -> Column:
        return F.try_divide(before - F.floor((before - 1 - f + folds) / folds), F.col("_n") - F.floor((F.col("_n") - 1 - f + folds) / folds))

    y = F.array_position(F.array(*(F.lit(c) for c in names)), F.col("_c")) - 1 if names else F.lit(0)
    shares = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.coalesce(need(f), F.lit(0.0)))
    dealt = ranked.select(key, "x", y.cast("int").alias("y"), F.pmod(before, F.lit(folds)).cast("int").alias("fold"), shares.alias("need"))
    return dealt.coalesce(max(1, sum(found.values()) // LEAST)), names  # no tasks for a handful of rows


class Batch:
    """Rows of an Arrow batch as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.y, self.fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        self.need = batch.column("need").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def trains(self, task: Task) -> np.ndarray:
        if task.fold is None:
            return np.ones(len(self.y), bool)
        return (self.fold != task.fold) & (self.need[:, task.fold] < task.share)


def _sums(dealt: DataFrame, partitions: int, widths: list[int], work: Callable[[Batch, list[np.ndarray]], None]) -> list[np.ndarray]:
    """Arrays, one a model, that ``work`` added to over all rows; added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(w) for w in widths]
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                work(Batch(batch.slice(low, ROWS)), out)
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"model": pa.array(range(len(out)), pa.int32()), "slot": pa.array([slot] * len(out), pa.int32()), "sums": pa.array([a.tobytes() for a in out], pa.binary())}
        )

    found = _summed(dealt.select("x", "y", "fold", "need").mapInArrow(run, "model int, slot int, sums binary"), partitions)
    return [found.get(m, np.zeros(w)) for m, w in enumerate(widths)]


def _soft(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_many(dealt: DataFrame, classes: int, tasks: list[Task], *, tolerance: float = 1e-4, max_iter: int = 10_000) -> list[Linear]:
    """Models of all ``tasks`` on a table of :func:`deal`, which should be cached.

    Each minimises its mean weighted log loss plus (l1_ratio * |B| + (1 -
    l1_ratio) / 2 * B^2) / (C * rows), with classes weighted alike and features
    divided by their population deviation over its own rows (by 1 where that is
    0).  A model is done when no coefficient moves by more than ``tolerance`` of
    the greatest.
    """
    first = dealt.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first["d"]
    most = max(1, GROUP // (8 * (d + 1) * max(classes, 2, d + 1 if d <= FULL else 0)))
    partitions, out = _partitions(dealt), []
    for low in range(0, len(tasks), most):
        out += _fit_group(dealt, partitions, d, classes, tasks[low : low + most], tolerance, max_iter)
    return out


def _fit_group(dealt: DataFrame, partitions: int, d: int, k: int, tasks: list[Task], tolerance: float, max_iter: int) -> list[Linear]:
    context = dealt.sparkSession.sparkContext

    def moments(rows: Batch, out: list[np.ndarray]) -> None:
        for m, task in enumerate(tasks):
            at = rows.trains(task)
            x = rows.x[at]
            out[m] += np.concatenate([np.bincount(rows.y[at], minlength=k), x.sum(0), (x * x).sum(0)])

    models, weights = [], []
    for task, s in zip(tasks, _sums(dealt, partitions, [k + 2 * d] * len(tasks), moments)):
        n = s[:k].sum()
        mean = s[k : k + d] / max(n, 1)
        deviation = np.sqrt(np.maximum(s[k + d :] / max(n, 1) - mean**2, 0))
        there = s[:k] > 0
        weights.append(np.where(there, n / (max(there.sum(), 1) * np.maximum(s[:k], 1)), 0.0))
        models.append(Linear(task, np.zeros((k, d)), np.where(there, 0.0, -np.inf), np.where(deviation > 1e-12 * np.sqrt(s[k + d :] / max(n, 1) + 1e-300), deviation, 1.0), int(n)))

    solve, bounded = _full_steps(dealt, partitions, d, models, weights) if d <= FULL else _plain_steps(dealt, partitions, d, models, weights)
    state = [np.zeros((k, d + 1)) for _ in tasks]
    ahead, pace = [s.copy() for s in state], np.ones(len(tasks))
    before: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    part = np.ones(len(tasks))  # of the bound
    active = [m for m, model in enumerate(models) if model.rows and (np.isfinite(model.intercepts).sum() > 1)]
    for step in range(1, max_iter + 1):
        if not active:
            break
        # All models' matrices side by side: (features + 1) x (models * classes).
        stacked = np.hstack([np.vstack([(ahead[m][:, :d] / models[m].scale).T, ahead[m][:, d] + np.where(np.isfinite(models[m].intercepts), 0.0, -1e30)]) for m in active])
        held, now = context.broadcast(stacked), list(active)

        def gradient(rows: Batch, out: list[np.ndarray], held=held, now=now) -> None:
            matrix, n = held.value, len(rows.y)
            error = _soft((np.einsum("nd,dk->nk", rows.x, matrix[:-1]) + matrix[-1]).reshape(n, len(now), k))
            error[np.arange(n)[:, None], np.arange(len(now)), rows.y[:, None]] -= 1.0
            for j, m in enumerate(now):
                error[:, j] *= (rows.trains(tasks[m]) * weights[m][rows.y])[:, None]
            sums = np.einsum("nd,nk->kd", rows.x, error.reshape(n, -1)).reshape(len(now), k, -1)
            for j in range(len(now)):
                out[j] += np.hstack([sums[j], error[:, j].sum(0)[:, None]]).ravel()

        slopes = []
        for m, s in zip(now, _sums(dealt, partitions, [k * (d + 1)] * len(now), gradient)):
            slope = s.reshape(k, d + 1) / models[m].rows
            slope[:, :d] /= models[m].scale
            slopes.append(slope)
        held.destroy()
        for m, slope in zip(now, slopes):
            if m in before:
                moved = ahead[m] - before[m][0]
                bound = (moved * bounded(m, moved)).sum()
                seen = ((slope - before[m][1]) * moved).sum() / bound if bound > 0 else 1.0
                part[m] = min(1.0, max(1.3 * seen, 0.8 * part[m], 0.02))
            before[m] = (ahead[m], slope)
        for m, new in zip(now, solve(now, [ahead[m] for m in now], slopes, part)):
            change = new - state[m]
            if ((ahead[m] - new) * change).sum() > 0:
                pace[m] = 1.0
            faster = (1 + math.sqrt(1 + 4 * pace[m] ** 2)) / 2
            ahead[m] = new + (pace[m] - 1) / faster * change
            pace[m], state[m], models[m].steps = faster, new, step
            if np.abs(change).max() <= tolerance * max(np.abs(new).max(), 1e-12):
                active.remove(m)
    for m, model in enumerate(models):
        there = np.isfinite(model.intercepts)
        model.coefficients = state[m][:, :d]
        model.intercepts = np.where(there, state[m][:, d] - (state[m][there, d].mean() if there.any() else 0.0), -np.inf)
    return models


def _full_steps(dealt: DataFrame, partitions: int, d: int, models: list[Linear], weights: list[np.ndarray]):
    """Steps that solve the quadratic of half the second moments with the penalty, coordinate by coordinate for all models at once."""

    def moments(rows: Batch, out: list[np.ndarray]) -> None:
        for m, model in enumerate(models):
            at = rows.trains(model.task)
            x = np.hstack([rows.x[at] / model.scale, np.ones((int(at.sum()), 1))])
            out[m] += np.einsum("nd,n,ne->de", x, weights[m][rows.y[at]], x).ravel()

    found = _sums(dealt, partitions, [(d + 1) ** 2] * len(models), moments)
    curvature = np.array([0.5 * s.reshape(d + 1, d + 1) / max(model.rows, 1) for s, model in zip(found, models)])
    diagonal = np.maximum(np.einsum("mdd->md", curvature), 1e-12)
    lasso = np.array([m.task.l1_ratio / (m.task.C * max(m.rows, 1)) for m in models])
    ridge = np.array([(1 - m.task.l1_ratio) / (m.task.C * max(m.rows, 1)) for m in models])

    def solve(now: list[int], ahead: list[np.ndarray], slopes: list[np.ndarray], part: np.ndarray) -> list[np.ndarray]:
        b, q, diag = np.array(ahead), curvature[now] * part[now][:, None, None], diagonal[now] * part[now][:, None]
        slope = np.array(slopes)  # of the quadratic, kept at b
        l1, l2 = lasso[now][:, None], ridge[now][:, None]
        for _ in range(SWEEPS):
            moved = 0.0
            for j in range(d + 1):
                h = diag[:, j, None]
                free = h * b[:, :, j] - slope[:, :, j]
                best = free / h if j == d else np.sign(free) * np.maximum(np.abs(free) - l1, 0) / (h + l2)
                change = best - b[:, :, j]
                b[:, :, j] = best
                slope += change[:, :, None] * q[:, j][:, None, :]
                moved = max(moved, float(np.abs(change).max()))
            if moved <= 1e-6 * max(float(np.abs(b).max()), 1e-12):
                break
        return list(b)

    return solve, lambda m, moved: np.einsum("kd,de->ke", moved, curvature[m])


def _plain_steps(dealt: DataFrame, partitions: int, d: int, models: list[Linear], weights: list[np.ndarray]):
    """Steps by the greatest eigenvalue of half the second moments, from powers that act on rows alone."""
    tasks = [m.task for m in models]
    ways = [np.full(d + 1, 1.0) / math.sqrt(d + 1) for _ in tasks]
    curvature = np.ones(len(tasks))
    for _ in range(POWER):

        def moved(rows: Batch, out: list[np.ndarray], ways=ways) -> None:
            for m, task in enumerate(tasks):
                at = rows.trains(task)
                x, scale = rows.x[at], models[m].scale
                along = np.einsum("nd,d->n", x, ways[m][:d] / scale) + ways[m][d]
                out[m] += np.append(np.einsum("nd,n->d", x, weights[m][rows.y[at]] * along) / scale, (weights[m][rows.y[at]] * along).sum())

        for m, s in enumerate(_sums(dealt, partitions, [d + 1] * len(tasks), moved)):
            size = math.sqrt(float((s * s).sum()))
            curvature[m] = max(size / max(models[m].rows, 1), 1e-12)
            ways[m] = s / size if size > 0 else ways[m]
    rate = 1 / (0.55 * curvature)

    def solve(now: list[int], ahead: list[np.ndarray], slopes: list[np.ndarray], part: np.ndarray) -> list[np.ndarray]:
        out = []
        for m, b, slope in zip(now, ahead, slopes):
            penalty, pace = 1 / (tasks[m].C * models[m].rows), rate[m] / part[m]
            new = b - pace * slope
            shrunk = np.sign(new[:, :d]) * np.maximum(np.abs(new[:, :d]) - pace * penalty * tasks[m].l1_ratio, 0)
            new[:, :d] = shrunk / (1 + pace * penalty * (1 - tasks[m].l1_ratio))
            out.append(new)
        return out

    return solve, lambda m, moved: moved / rate[m]


def confusions(dealt: DataFrame, classes: int, models: list[Linear]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (models x truth x prediction) over the rows that trained a model, and over its fold; one pass."""
    k = classes
    held = dealt.sparkSession.sparkContext.broadcast([((m.coefficients / m.scale).T, m.intercepts, m.task) for m in models])

    def tally(rows: Batch, out: list[np.ndarray]) -> None:
        for m, (matrix, intercepts, task) in enumerate(held.value):
            said = (np.einsum("nd,dk->nk", rows.x, matrix) + intercepts).argmax(1)
            trained, tested = rows.trains(task), rows.fold == task.fold
            cells = rows.y * k + said
            out[m] += np.concatenate([np.bincount(cells[trained], minlength=k * k), np.bincount(cells[tested], minlength=k * k)])

    found = np.array(_sums(dealt, _partitions(dealt), [2 * k * k] * len(models), tally)).reshape(len(models), 2, k, k)
    held.destroy()
    return found[:, 0], found[:, 1]


def macro_f1(table: np.ndarray) -> float:
    """Mean F1 of the classes that occur as truth or as prediction."""
    hits, there = np.diag(table), (table.sum(0) + table.sum(1)) > 0
    return float(np.mean(2 * hits[there] / (table.sum(0) + table.sum(1))[there])) if there.any() else float("nan")


def learning_curve(rows: DataFrame, key: str, features: str, label: str, params: dict, shares: list[float], *, folds: int = 5, seed: int = 42, **options) -> DataFrame:
    """``share, mean, std, train_mean, train_std`` of macro F1 over folds, for
    growing stratified parts of the training rows (the first by hash of each
    class); all shares and folds are fitted side by side."""
    dealt, names = deal(rows, key, features, label, folds=folds, seed=seed)
    dealt = dealt.persist()
    try:
        tasks = [Task(params["C"], params["l1_ratio"], f, s) for s in shares for f in range(folds)]
        models = fit_many(dealt, len(names), tasks, **options)
        trained, tested = confusions(dealt, len(names), models)
    finally:
        dealt.unpersist()
    cells = pd.DataFrame({"share": [t.share for t in tasks], "train": [macro_f1(c) for c in trained], "test": [macro_f1(c) for c in tested]})
    table = cells.groupby("share", sort=True).agg(mean=("test", "mean"), std=("test", "std"), train_mean=("train", "mean"), train_std=("train", "std")).reset_index()
    return rows.sparkSession.createDataFrame(table, "share double, mean double, std double, train_mean double, train_std double")
