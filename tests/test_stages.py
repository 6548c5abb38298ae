"""Selectors and topic models as stages of a Pipeline, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lexiloom.operators.selectors import TfidfSelector
from lexiloom.operators.stages import StructuralTopics, TopicsModel, VocabularyModel, VocabularySelector


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    words = [[f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)]]
    rows = [(d, " ".join(rng.choice(words[d % 2], 30)), f"c{d % 2}", f"artist{d % 10}") for d in range(60)] + [(100, None, "c0", "artist1"), (101, "unknown words", "c1", None)]
    return spark.createDataFrame(rows, "id long, text string, label string, artist string").cache()


def test_pipeline_is_saved_and_loaded(spark, docs, tmp_path):
    selector = VocabularySelector(keyCol="id", minArtists=3, k=20, orders=[1])
    stages = [selector, StructuralTopics(keyCol="id", covariateCol="label", topics=2, maxIter=30)]
    fitted = Pipeline(stages=stages).fit(docs)
    out = fitted.transform(docs)
    assert out.columns == [*docs.columns, "terms", "counts", "theta"] and out.count() == docs.count()
    rows = {r["id"]: r for r in out.collect()}
    sides = {d % 2: int(np.argmax(rows[d]["theta"])) for d in range(60)}
    assert set(sides.values()) == {0, 1} and all(int(np.argmax(rows[d]["theta"])) == sides[d % 2] for d in range(60))
    assert rows[100]["terms"] == [] == rows[101]["counts"] and abs(sum(rows[100]["theta"]) - 1) < 1e-9
    own = TfidfSelector("id", "text", "label", "artist", orders=(1,), min_artists=3, k=20).fit(docs)
    assert sorted(map(tuple, fitted.stages[0].vocabulary.collect())) == sorted(map(tuple, own.vocabulary.collect()))
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    back = PipelineModel.load(str(tmp_path / "fitted"))
    assert isinstance(back.stages[0], VocabularyModel) and isinstance(back.stages[1], TopicsModel)
    again = {r["id"]: r for r in back.transform(docs).collect()}
    assert all(again[i]["terms"] == r["terms"] and np.allclose(again[i]["theta"], r["theta"]) for i, r in rows.items())
    selector.write().overwrite().save(str(tmp_path / "selector"))
    loaded = VocabularySelector.load(str(tmp_path / "selector"))
    assert {p.name: v for p, v in loaded.extractParamMap().items()} == {p.name: v for p, v in selector.extractParamMap().items()}


def test_topics_feed_a_classifier(spark, docs):
    stages = [VocabularySelector(keyCol="id", method="log_odds", minArtists=2, fdr=0.3, orders=[1]), StructuralTopics(keyCol="id", topicNumbers=[2, 3, 4], maxIter=15)]
    shares = Pipeline(stages=stages).fit(docs).transform(docs).select("id", array_to_vector("theta").alias("features"), (F.col("label") == "c1").cast("double").alias("label"))
    model = LogisticRegression().fit(shares)
    assert model.transform(shares).where("prediction = label").count() >= 60


def test_unfitted_and_unknown(docs):
    for model in (VocabularyModel(), TopicsModel()):
        with pytest.raises(ValueError):
            model.transform(docs)
    with pytest.raises(ValueError):
        VocabularySelector(keyCol="id", method="other").fit(docs)
