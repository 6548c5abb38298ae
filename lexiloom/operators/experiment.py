"""A classification experiment from baseline to report, and the matrix of all of them."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forests, grouping, many, metrics
from .classify import SIDE_BY_SIDE, Classifier, cross_validate, permutation_importance
from .tuning import Search


class Experiment:
    """Train and test tables with ``key``, a feature array and a label.

    ``subsample``: stratified share of the training rows to use; ``names``: the
    features' names, for coefficients and importances.
    """

    def __init__(self, train: DataFrame, test: DataFrame, key: str, features: str, label: str, subsample: float = 1.0, seed: int = 42, names: list[str] | None = None):
        self.train = train if subsample >= 1 else grouping.stratified_subsample(train, key, label, subsample, seed)
        self.test, self.key, self.features, self.label, self.seed, self.names = test, key, features, label, seed, names
        self.history: list[dict] = []
        self.model: Classifier | None = None
        self.minutes: float | None = None
        self._importance: list[tuple[str, float]] = []

    def _fitted(self) -> Classifier:
        if self.model is None:
            raise ValueError("Must call fit() or tune() first")
        return self.model

    def baseline(self) -> DataFrame:
        """Macro metrics of labels drawn from the training shares."""
        drawn = grouping.random_baseline(self.train, self.test, self.key, self.label, self.seed)
        return metrics.macro(drawn, self.label, "drawn")

    def fit(self, params: dict, **options) -> Experiment:
        began = time.time()
        self.model = Classifier(params, seed=self.seed, **options).fit(self.train, self.features, self.label)
        self.minutes = (time.time() - began) / 60
        return self

    def tune(self, space: dict, parsimony: str, highest: bool, *, folds: int = 5, trees: int = 500, checkpoint: str | None = None, **search) -> Experiment:
        """Search by mean macro F1 over stratified folds, one-standard-error choice, then a fit on all training rows."""
        run, done = cross_validated_search(self.train, self.key, self.features, self.label, space, folds=folds, trees=trees, checkpoint=checkpoint, seed=self.seed, **search)
        self.history = run.run()
        done()
        return self.fit(run.best_within_error(parsimony, highest))

    def _pairs(self, rows: DataFrame) -> DataFrame:
        return self._fitted().add_predictions(rows.withColumn("truth", F.col(self.label).cast("string")))

    def evaluation(self) -> DataFrame:
        return metrics.report(self._pairs(self.test), "truth", "predicted")

    def scores(self) -> DataFrame:
        return metrics.macro(self._pairs(self.test), "truth", "predicted")

    def importance(self, positions: list[int], repeats: int = 5) -> DataFrame:
        found = permutation_importance(self._fitted(), self.test, self.key, positions, repeats)
        self._importance = [(self.names[r["feature"]] if self.names else f"feature_{r['feature']}", r["importance"]) for r in found.collect()]
        return found

    def report(self, top: int = 20) -> str:
        """Baseline, training time, search history, evaluation, coefficients or importances as text."""
        lines = ["baseline: " + ", ".join(f"{k} {v:.4f}" for k, v in self.baseline().first().asDict().items() if v is not None)]
        if self.minutes is not None:
            lines.append(f"training time: {self.minutes:.2f} minutes, parameters {self._fitted().params}")
        lines += [f"iteration {h['iteration']}: {h['score']:.4f} +- {h['se']:.4f} {h['params']}" for h in self.history]
        lines += [f"{r['label']:>14} precision {r['precision']:.4f} recall {r['recall']:.4f} f1 {r['f1']:.4f} support {r['support']}" for r in self.evaluation().collect()]
        if "C" in self._fitted().params:
            found = self._fitted().coefficients(self.test.sparkSession, self.names)
            best = found.orderBy(F.desc(F.abs("coefficient")), "feature", "label").limit(top)
            lines += [f"coefficient {r['feature']} {r['label']}: {r['coefficient']:.4f}" for r in best.collect()]
        lines += [f"importance {name}: {value:.4f}" for name, value in self._importance[:top]]
        return "\n".join(lines) + "\n"

    def save_report(self, path: str) -> None:
        """Write the report through Spark, so that any store can take it."""
        spark = self.test.sparkSession
        spark.createDataFrame([(self.report(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def save(self, path: str) -> None:
        """Model, settings, search history and importances; the tables stay where they are."""
        spark = self.test.sparkSession
        self._fitted().save(spark, f"{path}/classifier")
        state = {"key": self.key, "features": self.features, "label": self.label, "seed": self.seed, "names": self.names, "history": self.history, "minutes": self.minutes, "importance": self._importance}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/experiment")

    @staticmethod
    def load(path: str, train: DataFrame, test: DataFrame) -> Experiment:
        spark = test.sparkSession
        state = json.loads(spark.read.parquet(f"{path}/experiment").first()["state"])
        out = Experiment(train, test, state["key"], state["features"], state["label"], seed=state["seed"], names=state["names"])
        out.history, out.minutes, out._importance = state["history"], state["minutes"], [tuple(x) for x in state["importance"]]
        out.model = Classifier.load(spark, f"{path}/classifier")
        return out


def cross_validated_search(
    rows: DataFrame, key: str, features: str, label: str, space: dict, *, folds: int = 5, trees: int = 500, seed: int = 42, **search
) -> tuple[Search, Callable[[], object]]:
    """A search scored by the mean of macro F1 over stratified folds with its
    standard error, and a function that frees the cached folds.

    All models of all points that are known at a time, and of all folds, are
    fitted side by side; forests of tables that are too large to be sent to the
    tasks are fitted one by one.  Points that come again, as rounded counts do,
    keep their score, which a new fit would only repeat.
    """
    spark = rows.sparkSession
    dealt, names = many.deal(rows, key, features, label, folds=folds, seed=seed)
    dealt = dealt.persist()
    table = forests.small_table(dealt, len(names), key) if "max_features" in space else None

    known: dict[tuple, tuple[float, float]] = {}

    def evaluate_many(points: list[dict]) -> list[tuple[float, float]]:
        marks = [tuple(sorted(p.items())) for p in points]
        new = {m: p for m, p in zip(marks, points) if m not in known}
        known.update(zip(new, fit_many(list(new.values())) if new else []))
        return [known[m] for m in marks]

    def fit_many(points: list[dict]) -> list[tuple[float, float]]:
        if table is not None:
            fits = [forests.Fit(int(p["max_features"]), int(p["min_samples_leaf"]), trees, fold, seed) for p in points for fold in range(folds)]
            tables = forests.score_many(spark, table, fits)
        elif "C" in space:
            models = many.fit_many(dealt, len(names), [many.Task(p["C"], p["l1_ratio"], fold) for p in points for fold in range(folds)])
            tables = many.confusions(dealt, len(names), models)[1]
        else:
            return [_mean_and_error(cross_validate(dealt.withColumnRenamed("x", features), features, "y", p, folds, trees=trees, seed=seed)) for p in points]
        scores = np.array([many.macro_f1(t) for t in tables]).reshape(len(points), folds)
        return [_mean_and_error(s) for s in scores]

    run = Search(space, lambda p: evaluate_many([p])[0], evaluate_many=evaluate_many, spark=spark, seed=seed, data=grouping_mark(rows, key, features, label), **search)
    return run, dealt.unpersist


def _mean_and_error(scores) -> tuple[float, float]:
    return float(np.mean(scores)), float(np.std(scores, ddof=1) / math.sqrt(len(scores))) if len(scores) > 1 else 0.0


def grouping_mark(rows: DataFrame, *columns: str) -> str:
    """Hash of the data that a search is of, for its checkpoint."""
    from .stored import fingerprint

    return fingerprint({"columns": columns}, rows.select(*columns))


#: Feature sets and the classifiers that are tried on each.
PAIRS = (("fs", "lr"), ("topic", "lr"), ("style", "lr"), ("combined", "lr"), ("topic", "rf"), ("style", "rf"), ("combined", "rf"))


def run_matrix(
    train: dict[str, DataFrame], test: dict[str, DataFrame], key: str, labels: list[str], *, lr: dict | None = None, rf: dict | None = None, tune: dict | None = None, **options
) -> list[tuple[str, str, str, Experiment]]:
    """Every pair of ``PAIRS`` for every label column (granularity): ``(label, features, classifier, experiment)``.

    ``train``, ``test``: tables ``key, x, labels...`` by feature set; ``combined``
    is ``topic`` and ``style`` side by side, joined by key, where it isn't
    given.  ``tune``: arguments of :meth:`Experiment.tune` for forests; without
    it they take ``rf``.
    """

    def combined(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if "combined" in tables:
            return tables
        style = tables["style"].select(key, F.col("x").alias("_y"))
        return tables | {"combined": tables["topic"].join(style, key).withColumn("x", F.concat("x", "_y")).drop("_y")}

    train, test = combined(train), combined(test)

    def one(cell: tuple[str, str, str]) -> tuple[str, str, str, Experiment]:
        label, features, kind = cell
        e = Experiment(train[features], test[features], key, "x", label)
        if kind == "lr":
            e.fit(lr or {"C": 1.0, "l1_ratio": 0.5}, **{k: v for k, v in options.items() if k == "max_iter"})
        elif tune:
            e.tune(**tune)
        else:
            e.fit(rf or {"max_features": 8, "min_samples_leaf": 2}, **{k: v for k, v in options.items() if k == "trees"})
        return label, features, kind, e

    with ThreadPoolExecutor(SIDE_BY_SIDE // 2) as pool:
        return list(pool.map(one, [(label, *pair) for label in labels for pair in PAIRS]))


def matrix_table(spark: SparkSession, results: list[tuple[str, str, str, Experiment]]) -> DataFrame:
    """``label, features, classifier, macro_f1, kappa, baseline_f1``."""

    def row(cell: tuple[str, str, str, Experiment]) -> tuple:
        label, features, kind, e = cell
        s = e.scores().first()
        return label, features, kind, float(s["macro_f1"]), None if s["kappa"] is None else float(s["kappa"]), float(e.baseline().first()["macro_f1"])

    with ThreadPoolExecutor(SIDE_BY_SIDE // 2) as pool:
        rows = list(pool.map(row, results))
    return spark.createDataFrame(rows, "label string, features string, classifier string, macro_f1 double, kappa double, baseline_f1 double")
