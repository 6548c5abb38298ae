"""Vocabulary selection and topic models as stages of a ``pyspark.ml`` Pipeline.

Estimators have Params and are saved as all of Spark's are; models keep their
vocabulary or matrices beside their metadata, in any folder that Spark writes
to.  A model that was not fitted raises ``ValueError``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms, topics
from .selectors import LogOddsSelector, TfidfSelector
from .stored import written


class _Writer(MLWriter):
    def __init__(self, instance: _Kept):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_data(self.sparkSession, f"{path}/data")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.kind()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out._load_data(self.sparkSession, f"{path}/data")
        return out


class _Kept(Model, MLWritable, MLReadable):
    """A model that is more than its Params."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Columns(Params):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells documents apart", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "column of texts", TypeConverters.toString)
    orders = Param(Params._dummy(), "orders", "orders of the n-grams", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._setDefault(keyCol="doc_id", textCol="text", orders=[1, 2, 3])


class VocabularySelector(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """Learns a vocabulary by class tf-idf (``method`` tfidf) or by log odds (log_odds)."""

    labelCol = Param(Params._dummy(), "labelCol", "column of classes", TypeConverters.toString)
    artistCol = Param(Params._dummy(), "artistCol", "column of the groups that an n-gram must be spread over", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "tfidf or log_odds", TypeConverters.toString)
    minArtists = Param(Params._dummy(), "minArtists", "groups that an n-gram needs", TypeConverters.toInt)
    k = Param(Params._dummy(), "k", "n-grams of each order and class, by tf-idf", TypeConverters.toInt)
    fdr = Param(Params._dummy(), "fdr", "false discovery rate, by log odds", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, keyCol="doc_id", textCol="text", labelCol="label", artistCol="artist", method="tfidf", orders=(1, 2, 3), minArtists=20, k=100, fdr=0.001):
        super().__init__()
        self._set(**{n: list(v) if n == "orders" else v for n, v in {"orders": orders, **self._input_kwargs}.items()})
        self._setDefault(labelCol="label", artistCol="artist", method="tfidf", minArtists=20, k=100, fdr=0.001)

    def _fit(self, dataset: DataFrame) -> VocabularyModel:
        get = self.getOrDefault
        columns, options = [get(p) for p in ("keyCol", "textCol", "labelCol", "artistCol")], {"orders": tuple(get("orders")), "min_artists": get("minArtists")}
        if get("method") == "tfidf":
            selector = TfidfSelector(*columns, k=get("k"), **options)
        elif get("method") == "log_odds":
            selector = LogOddsSelector(*columns, fdr=get("fdr"), **options)
        else:
            raise ValueError(f"unknown method: {get('method')}")
        model = VocabularyModel()
        model.vocabulary = written(selector.fit(dataset).vocabulary, "vocabulary")
        return model._set(**{n: get(n) for n in ("keyCol", "textCol", "orders")})


class VocabularyModel(_Kept, _Columns):
    """Adds ``terms`` and ``counts``, the sorted positions of the vocabulary's terms
    in each document and how often they are there; both empty without any.
    Documents of one key have what all of its texts have together."""

    vocabulary: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("Must call fit() before transform()")
        key, text = self.getOrDefault("keyCol"), self.getOrDefault("textCol")
        counts = terms.transform(terms.ngram_counts(dataset, [key], text, self.getOrDefault("orders")), [key], self.vocabulary)
        docs = topics.as_documents(counts, key).select(F.col(key).alias("_key"), "terms", "counts")
        joined = dataset.join(docs, F.col(key).eqNullSafe(F.col("_key")), "left")
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
        return joined.select(*dataset.columns, none("terms", "int"), none("counts", "double"))

    def _save_data(self, spark: SparkSession, path: str) -> None:
        if self.vocabulary is None:
            raise ValueError("Must call fit() before save()")
        self.vocabulary.write.parquet(path)

    def _load_data(self, spark: SparkSession, path: str) -> None:
        self.vocabulary = spark.read.parquet(path)


class _Topics(Params):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells documents apart", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of topic shares", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(keyCol="doc_id", outputCol="theta")


class StructuralTopics(Estimator, _Topics, DefaultParamsWritable, DefaultParamsReadable):
    """Fits a structural topic model to ``terms`` and ``counts``; the number of
    topics is ``topics``, or what a search over ``topicNumbers`` chooses."""

    covariateCol = Param(Params._dummy(), "covariateCol", "column of the prevalence's levels; empty for none", TypeConverters.toString)
    topics = Param(Params._dummy(), "topics", "number of topics; 0 for a search", TypeConverters.toInt)
    topicNumbers = Param(Params._dummy(), "topicNumbers", "numbers of topics to search", TypeConverters.toListInt)
    maxIter = Param(Params._dummy(), "maxIter", "EM steps at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, keyCol="doc_id", covariateCol="", topics=0, topicNumbers=tuple(range(2, 21)), maxIter=500, seed=42, outputCol="theta"):
        super().__init__()
        self._set(**{n: list(v) if n == "topicNumbers" else v for n, v in self._input_kwargs.items()})
        self._setDefault(covariateCol="", topics=0, topicNumbers=list(range(2, 21)), maxIter=500, seed=42)

    def _fit(self, dataset: DataFrame) -> TopicsModel:
        get, level = self.getOrDefault, self.getOrDefault("covariateCol")
        x = F.array(F.lit(1.0))
        if level:
            levels = sorted(str(r[0]) for r in dataset.where(F.col(level).isNotNull()).select(level).distinct().collect())  # few by nature
            x = F.array(F.lit(1.0), *(F.coalesce((F.col(level).cast("string") == v).cast("double"), F.lit(0.0)) for v in levels[1:]))
        key = get("keyCol")
        docs = dataset.select(key, "terms", "counts", x.alias("x")).persist()
        try:
            size = (docs.agg(F.max(F.array_max("terms"))).first()[0] or 0) + 1
            number, options = get("topics"), {"seed": get("seed"), "iterations": get("maxIter")}
            if not number:
                number = topics.choose_topics(topics.search_topics(docs, key, size, get("topicNumbers"), **options))
            model = TopicsModel()
            model.fitted = topics.fit_structural(docs, key, size, number, **options)
        finally:
            docs.unpersist()
        return model._set(keyCol=key, outputCol=get("outputCol"))


class TopicsModel(_Kept, _Topics):
    """Adds the topic shares of documents with ``terms`` and ``counts``, at the mean of the training covariates."""

    fitted: topics.TopicModel | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise ValueError("Must call fit() before transform()")
        key, out = self.getOrDefault("keyCol"), self.getOrDefault("outputCol")
        x = F.array(*([F.lit(1.0)] * len(self.fitted.gamma))).alias("x")
        shares = self.fitted.transform(dataset.select(F.col(key).alias("_key"), "terms", "counts", x).dropDuplicates(["_key"]), "_key").withColumnRenamed("theta", out)
        return dataset.join(shares, F.col(key).eqNullSafe(F.col("_key")), "left").select(*dataset.columns, out)

    def _save_data(self, spark: SparkSession, path: str) -> None:
        if self.fitted is None:
            raise ValueError("Must call fit() before save()")
        self.fitted.save(spark, path)

    def _load_data(self, spark: SparkSession, path: str) -> None:
        self.fitted = topics.TopicModel.load(spark, path)
