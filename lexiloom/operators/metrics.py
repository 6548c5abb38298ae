"""Classification metrics from pairs of true and predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    return pairs.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame, truth: str, predicted: str, levels: DataFrame | None = None) -> DataFrame:
    """``label, tp, fp, fn, precision, recall, f1, support``; 0 where a denominator is 0.

    Labels are those that occur on either side, or those of ``levels``.
    """
    cells = confusion(pairs, truth, predicted)  # at most labels squared rows
    sides = cells.select("n", "truth", "predicted", F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("label"))
    hit, said = F.col("truth") == F.col("label"), F.col("predicted") == F.col("label")
    tally = sides.groupBy("label").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("tp", hit & said), ("fp", ~hit & said), ("fn", hit & ~said))))
    if levels is not None:
        tally = levels.toDF("label").join(tally, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tally.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def macro(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: macro F1, precision and recall, accuracy, Cohen's kappa."""
    scores = per_class(pairs, truth, predicted)
    total = F.sum("support")
    chance = F.sum((F.col("tp") + F.col("fp")) * F.col("support")) / (total * total)
    observed = F.sum("tp") / total
    return scores.agg(
        F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        observed.alias("accuracy"),
        F.try_divide(observed - chance, 1 - chance).alias("kappa"),
    )


def report(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class, ``macro avg`` and ``weighted avg``."""
    scores = per_class(pairs, truth, predicted)
    rows = scores.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    mean = scores.agg(*(F.avg(c).alias(c) for c in names), F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = scores.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    return rows.unionByName(mean).unionByName(weighted)
