"""Bayesian search of hyper-parameters on the driver; evaluations are Spark jobs."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

Space = dict[str, tuple[float, float]]
WHOLE = ("max_features", "min_samples_leaf")


def latin_hypercube(space: Space, n: int, seed: int) -> list[dict]:
    """``n`` points, one in each of ``n`` strata of every dimension; ``C`` by its logarithm, counts rounded."""
    rng = np.random.default_rng(seed)
    columns = {}
    for name, (low, high) in space.items():
        u = (rng.permutation(n) + rng.random(n)) / n
        if name == "C":
            a, b = math.log10(low), math.log10(high)
            columns[name] = 10 ** (a + u * (b - a))
        else:
            columns[name] = low + u * (high - low)
    return [{k: int(round(v[i])) if k in WHOLE else float(v[i]) for k, v in columns.items()} for i in range(n)]


class Surrogate:
    """Gaussian process with a Matern 5/2 kernel; the length scale of greatest likelihood on a grid."""

    def __init__(self, points: list[dict], scores: list[float]):
        known = [(p, s) for p, s in zip(points, scores) if math.isfinite(s)]
        if not known:
            raise ValueError("no finite score to fit the surrogate to")
        self.names = sorted(known[0][0])
        x = self._array([p for p, _ in known])
        y = np.array([s for _, s in known])
        self.low, self.span = x.min(0), np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
        self.mean, self.scale = y.mean(), y.std() or 1.0
        self.x, z = (x - self.low) / self.span, (y - y.mean()) / (y.std() or 1.0)
        best = -math.inf
        for length in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2):
            factor = np.linalg.cholesky(self._kernel(self.x, self.x, length) + 1e-6 * np.eye(len(z)))
            alpha = np.linalg.solve(factor.T, np.linalg.solve(factor, z))
            fit = -0.5 * z @ alpha - np.log(np.diag(factor)).sum()
            if fit > best:
                best, self.length, self.factor, self.alpha = fit, length, factor, alpha

    def _array(self, points: list[dict]) -> np.ndarray:
        return np.array([[float(p[k]) for k in self.names] for p in points])

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        d = math.sqrt(5) * np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) / length
        return (1 + d + d * d / 3) * np.exp(-d)

    def predict(self, points: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        k = self._kernel((self._array(points) - self.low) / self.span, self.x, self.length)
        v = np.linalg.solve(self.factor, k.T)
        return self.mean + self.scale * (k @ self.alpha), self.scale * np.sqrt(np.maximum(1 - (v * v).sum(0), 0))


@dataclass
class Search:
    """Initial hypercube, then points of greatest mean + 2 deviations (or of
    greatest deviation after ``jump`` evaluations without a better score).

    ``evaluate`` gives the score and its standard error of a point,
    ``evaluate_many`` those of several, which the hypercube's points are.
    ``checkpoint``: a folder that keeps the history of the search (a few
    kilobytes), under the hash of its settings and of ``data``, a mark of the
    data and feature names.  With ``spark`` it is any folder that Spark writes
    to, and outlives the driver.
    """

    space: Space
    evaluate: Callable[[dict], tuple[float, float]]
    n_initial: int = 20
    n_iterations: int = 50
    stop: int = 15
    jump: int = 5
    candidates: int = 10_000
    seed: int = 42
    checkpoint: str | None = None
    data: str = ""
    evaluate_many: Callable[[list[dict]], list[tuple[float, float]]] | None = None
    spark: SparkSession | None = None
    history: list[dict] = field(default_factory=list)
    no_better: int = 0
    since_jump: int = 0

    def run(self) -> list[dict]:
        self._load()
        points = latin_hypercube(self.space, self.n_initial, self.seed)
        left = points[len(self.history) :]
        if self.evaluate_many and left:
            for point, found in zip(left, self.evaluate_many(left)):
                self._record(point, 0, found, save=False)
            self._save()
        else:
            for point in left:  # kept as they come
                self._record(point, 0, self.evaluate(point))
        done = max([0, *(h["iteration"] for h in self.history)])
        for iteration in range(done + 1, self.n_iterations + 1):
            if self.no_better >= self.stop:
                break
            point = self._next(iteration)
            self._record(point, iteration, self.evaluate(point))
        return self.history

    def _next(self, iteration: int) -> dict:
        model = Surrogate([h["params"] for h in self.history], [h["score"] for h in self.history])
        pool = latin_hypercube(self.space, self.candidates, self.seed + iteration)
        mean, deviation = model.predict(pool)
        if self._due():
            self.since_jump = 0
            return pool[int(deviation.argmax())]
        return pool[int((mean + 2 * deviation).argmax())]

    def _due(self) -> bool:
        return self.jump > 0 and self.no_better >= self.jump and self.since_jump >= self.jump

    def _record(self, params: dict, iteration: int, found: tuple[float, float], save: bool = True) -> None:
        score, error = found
        if math.isnan(score):
            score, error = -math.inf, 0.0
        best = max([-math.inf, *(h["score"] for h in self.history)])
        self.history.append({"iteration": iteration, "params": params, "score": score, "se": error})
        if iteration:
            self.no_better = 0 if score > best else self.no_better + 1
            self.since_jump += 1
            if self._due():
                self.since_jump = 0
        if save:
            self._save()

    def best_within_error(self, parsimony: str, highest: bool) -> dict:
        """The most parsimonious candidate within one standard error of the best score."""
        finite = [h for h in self.history if math.isfinite(h["score"])]
        best = max(finite, key=lambda h: h["score"])
        near = [h for h in finite if h["score"] >= best["score"] - best["se"]]
        return (max if highest else min)(near, key=lambda h: h["params"][parsimony])["params"]

    def _path(self) -> str | None:
        if not self.checkpoint:
            return None
        config = json.dumps({"space": self.space, "n_initial": self.n_initial, "candidates": self.candidates, "seed": self.seed, "data": self.data}, sort_keys=True)
        return f"{self.checkpoint.rstrip('/')}/search-{hashlib.md5(config.encode()).hexdigest()}"

    def _save(self) -> None:
        path = self._path()
        if not path:
            return
        state = json.dumps({"history": self.history, "no_better": self.no_better, "since_jump": self.since_jump, "stop": self.stop, "jump": self.jump})
        if self.spark:  # a folder for each length: none is ever half replaced
            self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{len(self.history):06d}")
        else:
            os.makedirs(self.checkpoint, exist_ok=True)
            with open(f"{path}.json", "w") as file:
                file.write(state)

    def _load(self) -> None:
        path, state = self._path(), None
        if path and self.spark:
            from .stored import exists

            for n in range(self.n_initial + self.n_iterations, 0, -1):
                if exists(self.spark, f"{path}/{n:06d}/_SUCCESS"):
                    state = self.spark.read.text(f"{path}/{n:06d}").first()["value"]
                    break
        elif path and os.path.exists(f"{path}.json"):
            with open(f"{path}.json") as file:
                state = file.read()
        for k, v in json.loads(state).items() if state else ():
            setattr(self, k, v)
