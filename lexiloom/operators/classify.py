"""Classifiers on feature tables, with weights, coefficients and importances."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import deep, forests
from .ranking import rank_in_buckets


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"))
    weights = n.crossJoin(F.broadcast(total)).select(label, (F.col("_total") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


TOLERANCE = 1e-4  # of the logistic regression


class Classifier:
    """Elastic-net logistic regression (``C``, ``l1_ratio``) or a random forest
    (``max_features``, ``min_samples_leaf``), by the parameters given.

    Features are divided by their population standard deviation, not centred;
    classes are weighted alike; ties of predictions go to the first label.

    Forests have no limit of depth and exact splits, on tables that are small
    enough to be sent to the tasks at once (:mod:`.forests`) and on larger ones
    (:mod:`.deep`).
    """

    def __init__(self, params: dict, trees: int = 1000, seed: int = 42, max_iter: int = 10_000):
        if not ({"C", "l1_ratio"} <= params.keys() or {"max_features", "min_samples_leaf"} <= params.keys()):
            raise ValueError(f"no classifier has the parameters {sorted(params)}")
        self.params, self.trees, self.seed, self.max_iter = params, trees, seed, max_iter

    def fit(self, train: DataFrame, features: str, label: str) -> Classifier:
        rows = train.where(F.col(label).isNotNull() & F.col(features).isNotNull())
        self.features, self.label = features, label
        if "max_features" in self.params:
            return self._fit_forest(rows)
        n = rows.count()
        vectors = rows.select(F.col(label).cast("string").alias(label), array_to_vector(F.col(features)).alias("_raw")).cache()
        self.scaler = StandardScaler(inputCol="_raw", outputCol="_sample", withMean=False).fit(vectors)
        self.factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        self.indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(vectors)
        ready = self.indexer.transform(balanced(self._scaled(vectors), label)).select("_x", "_y", "weight").cache()
        model = LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="weight", family="multinomial", standardization=False, maxIter=self.max_iter, tol=TOLERANCE,
            regParam=1 / (self.params["C"] * n), elasticNetParam=self.params["l1_ratio"],
        )
        self.model = model.fit(ready)
        ready.unpersist()
        vectors.unpersist()
        return self

    def _fit_forest(self, rows: DataFrame) -> Classifier:
        labels = sorted(r[0] for r in rows.select(F.col(self.label).cast("string")).distinct().collect())  # classes are few
        y = F.array_position(F.array(*(F.lit(c) for c in labels)), F.col(self.label).cast("string")) - 1 if labels else F.lit(0)
        ready = rows.select(F.col(self.features).cast("array<double>").alias("x"), y.cast("int").alias("y"))
        self.labels = labels
        fit = forests.Fit(int(self.params["max_features"]), int(self.params["min_samples_leaf"]), self.trees, seed=self.seed)
        table = forests.small_table(ready, len(labels))
        if table is None:
            self.model = deep.DeepForest.fit(rows.sparkSession, ready, len(labels), fit)
        else:
            self.model = forests.ForestModel.fit(rows.sparkSession, table, fit)
        return self

    def _scaled(self, vectors: DataFrame) -> DataFrame:
        scaled = self.scaler.transform(vectors)
        return scaled.withColumn("_x", array_to_vector(F.transform(vector_to_array("_sample"), lambda v: v * self.factor)))

    def add_predictions(self, rows: DataFrame, name: str = "predicted") -> DataFrame:
        """``rows`` with the predicted label."""
        if isinstance(self.model, (forests.ForestModel, deep.DeepForest)):
            voted = self.model.add_votes(rows, self.features).withColumn("_votes", F.transform("_votes", lambda v: F.round(v, 9)))
            names = F.array(*(F.lit(x) for x in self.labels))
            return voted.withColumn(name, F.element_at(names, F.array_position("_votes", F.array_max("_votes")).cast("int"))).select(*rows.columns, name)
        whole = rows.select(F.struct("*").alias("_row"), array_to_vector(F.col(self.features)).alias("_raw"))
        names = F.array(*(F.lit(x) for x in self.indexer.labels))
        return self.model.transform(self._scaled(whole)).select("_row.*", F.element_at(names, F.col("prediction").cast("int") + 1).alias(name))

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """``key, predicted``."""
        return self.add_predictions(rows.select(key, self.features)).select(key, "predicted")

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted model and what it needs, in any folder that Spark writes to."""
        own = isinstance(self.model, (forests.ForestModel, deep.DeepForest))
        if own:
            self.model.save(f"{path}/forest")
        for name in () if own else ("model", "scaler", "indexer"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        state = {k: getattr(self, k) for k in ("params", "trees", "seed", "max_iter", "features", "label", "factor", "labels") if hasattr(self, k)}
        state["deep"] = isinstance(self.model, deep.DeepForest)
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        out = Classifier(state["params"], state["trees"], state["seed"], state["max_iter"])
        out.features, out.label = state["features"], state["label"]
        if "labels" in state:
            kind = deep.DeepForest if state.get("deep") else forests.ForestModel
            out.labels, out.model = state["labels"], kind.load(spark, f"{path}/forest")
            return out
        out.factor = state["factor"]
        kind = LogisticRegressionModel if "C" in out.params else RandomForestClassificationModel
        out.model, out.scaler, out.indexer = kind.load(f"{path}/model"), StandardScalerModel.load(f"{path}/scaler"), StringIndexerModel.load(f"{path}/indexer")
        return out

    def coefficients(self, spark, names: list[str] | None = None) -> DataFrame:
        """``feature, label, coefficient`` of a logistic regression."""
        matrix = self.model.coefficientMatrix.toArray()
        names = names or [f"feature_{k}" for k in range(matrix.shape[1])]
        rows = [(names[j], self.indexer.labels[i], float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
        return spark.createDataFrame(rows, "feature string, label string, coefficient double")


def permutation_importance(model: Classifier, rows: DataFrame, key: str, positions: list[int], repeats: int = 5) -> DataFrame:
    """``feature, importance``: loss of accuracy when a feature's values change rows, averaged over ``repeats``.

    Each repeat pairs rows of equal rank by two hashes of their keys, a random
    permutation.  All features and repeats are predicted in one pass: a row is
    copied for each of them with one value replaced, and only hits are summed.
    """
    truth = rows.select(key, model.features, F.col(model.label).cast("string").alias("_truth"))
    base = model.add_predictions(truth).agg(F.avg((F.col("predicted") == F.col("_truth")).cast("double")).alias("_base"))
    rounds = truth.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn("_h", F.xxhash64(key, "_round"))
    ranked = rank_in_buckets(rounds, ["_round"], F.shiftright("_h", 52), ["_h", key], "_at")
    own = ranked.where("_round = 0").select("_at", model.features, "_truth")
    other = ranked.where("_round > 0").select("_at", "_round", F.col(model.features).alias("_other"))
    cells = own.join(other, "_at").withColumn("feature", F.explode(F.array(*(F.lit(j) for j in positions))))
    changed = cells.select("feature", "_round", "_truth", _replaced(model.features).alias(model.features))
    hits = model.add_predictions(changed).groupBy("feature", "_round").agg(F.avg((F.col("predicted") == F.col("_truth")).cast("double")).alias("_a"))
    means = hits.groupBy("feature").agg(F.avg("_a").alias("_a")).crossJoin(F.broadcast(base))
    return means.select("feature", (F.col("_base") - F.col("_a")).alias("importance")).orderBy(F.desc("importance"), "feature")


def _replaced(features: str) -> Column:
    return F.transform(F.col(features), lambda v, i: F.when(i == F.col("feature"), F.element_at("_other", i + 1)).otherwise(v))


def _fold_score(dealt: DataFrame, fold: int, features: str, label: str, params: dict, **options) -> float:
    """Macro F1 of a fold (column ``fold``) by a model of the others."""
    from .metrics import macro

    train = dealt.where(F.col("fold") != fold)
    test = dealt.where(F.col("fold") == fold).withColumn("_truth", F.col(label).cast("string"))
    model = Classifier(params, **options).fit(train, features, label)
    return float(macro(model.add_predictions(test), "_truth", "predicted").first()["macro_f1"])


#: Fits that are under way at a time; their jobs share the cluster.
SIDE_BY_SIDE = 8


def cross_validate(dealt: DataFrame, features: str, label: str, params: dict, folds: int, **options) -> list[float]:
    """Macro F1 of each fold (column ``fold``) by a model of the others, fitted side by side."""
    with ThreadPoolExecutor(min(folds, SIDE_BY_SIDE)) as pool:
        return list(pool.map(lambda fold: _fold_score(dealt, fold, features, label, params, **options), range(folds)))
