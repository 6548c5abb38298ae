"""Vocabulary selectors with the surface of fit and transform.

Both take tables of documents with a text, a class and an artist (the group
that an n-gram must be spread over), learn a vocabulary, and count its terms in
any other documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .stored import stored


class _Selector:
    def __init__(self, key: str, text: str, label: str, artist: str, *, orders: tuple[int, ...], min_artists: int = 20, folder: str | None = None):
        """``folder``: keeps scores and vocabularies by their settings and the documents; any folder that Spark writes to."""
        self.key, self.text, self.label, self.artist = key, text, label, artist
        self.orders, self.min_artists, self.folder = tuple(orders), min_artists, folder
        self._vocabulary: DataFrame | None = None

    def _check(self, docs: DataFrame) -> None:
        for column in (self.key, self.text, self.label, self.artist):
            if column not in docs.columns:
                raise ValueError(f"the documents have no column {column!r}")

    def _kept(self, name: str, settings: dict, docs: DataFrame, build) -> DataFrame:
        if self.folder is None:
            return build()
        own = docs.select(self.key, self.text, self.label, self.artist)
        return stored(self.folder, f"{type(self).__name__}-{name}", settings, [own], build)

    @property
    def vocabulary(self) -> DataFrame:
        """``term_idx, order, ngram``."""
        if self._vocabulary is None:
            raise ValueError("Must call fit() before the vocabulary is known")
        return self._vocabulary

    def feature_names(self) -> list[str]:
        """The n-grams in the order of their positions; a vocabulary is of bounded size."""
        return [r["ngram"] for r in self.vocabulary.orderBy("term_idx").select("ngram").collect()]

    def transform(self, docs: DataFrame) -> DataFrame:
        """``key, term_idx, cnt`` of the vocabulary's terms; documents without any have no row."""
        if self._vocabulary is None:
            raise ValueError("Must call fit() before transform()")
        for column in (self.key, self.text):
            if column not in docs.columns:
                raise ValueError(f"the documents have no column {column!r}")
        return terms.transform(terms.ngram_counts(docs, [self.key], self.text, self.orders), [self.key], self.vocabulary)

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        return self.fit(docs).transform(docs)

    def fit(self, docs: DataFrame):
        raise NotImplementedError


class TfidfSelector(_Selector):
    """The ``k`` n-grams of greatest class tf-idf of each order and class, of those that enough artists use."""

    def __init__(self, key: str, text: str, label: str, artist: str, *, orders: tuple[int, ...] = (1, 2, 3), min_artists: int = 20, k: int = 100, folder: str | None = None):
        super().__init__(key, text, label, artist, orders=orders, min_artists=min_artists, folder=folder)
        self.k = k

    def fit(self, docs: DataFrame) -> TfidfSelector:
        self._check(docs)
        settings = {"orders": self.orders, "min_artists": self.min_artists, "k": self.k}

        def build() -> DataFrame:
            grams = terms.ngram_counts(docs, [self.key, self.label, self.artist], self.text, self.orders)
            return terms.select_features(grams, self.label, self.artist, min_artists=self.min_artists, k=self.k)

        self._vocabulary = self._kept("vocabulary", settings, docs, build)
        return self


class LogOddsSelector(_Selector):
    """The n-grams whose log odds in some class pass Benjamini-Hochberg control, over all orders and classes together."""

    def __init__(
        self, key: str, text: str, label: str, artist: str, *, orders: tuple[int, ...] = (1, 2, 3, 4), min_artists: int = 20, fdr: float = 0.001, prior: float = 1.0, stopwords: bool = True, boundary: bool = True, folder: str | None = None
    ):
        super().__init__(key, text, label, artist, orders=orders, min_artists=min_artists, folder=folder)
        self.fdr, self.prior, self.stopwords, self.boundary = fdr, prior, stopwords, boundary
        self.scores: DataFrame | None = None

    def fit(self, docs: DataFrame) -> LogOddsSelector:
        self._check(docs)
        settings = {"orders": self.orders, "min_artists": self.min_artists, "prior": self.prior, "stopwords": self.stopwords, "boundary": self.boundary}

        def build() -> DataFrame:
            rows = terms.ngram_rows(docs, [self.label, self.artist], self.text, self.orders)
            options = {"labels": terms.classes(docs, self.label), "prior": self.prior, "min_artists": self.min_artists, "stopwords": self.stopwords, "boundary": self.boundary}
            return terms.log_odds(rows, self.label, self.artist, **options)

        self.scores = self._kept("scores", settings, docs, build)
        return self.threshold(self.fdr)

    def threshold(self, fdr: float) -> LogOddsSelector:
        """Choose the vocabulary anew from the scores that are there, without counting again."""
        if self.scores is None:
            raise ValueError("Must call fit() before threshold()")
        self.fdr, self._vocabulary = fdr, terms.select_by_log_odds(self.scores, fdr)
        return self

    def save_scores(self, path: str) -> None:
        if self.scores is None:
            raise ValueError("Must call fit() before save_scores()")
        self.scores.write.mode("overwrite").parquet(path)

    def load_scores(self, spark: SparkSession, path: str) -> LogOddsSelector:
        """Scores of an earlier fit; the vocabulary follows from them."""
        self.scores = spark.read.parquet(path)
        return self.threshold(self.fdr)


def check_artists(docs: DataFrame, artist: str, genre_of: DataFrame) -> None:
    """Raise ``ValueError`` with up to five artists of ``docs`` that ``genre_of`` doesn't have."""
    missing = docs.where(F.col(artist).isNotNull()).select(artist).distinct().join(genre_of.select(artist), artist, "left_anti")
    names = [r[0] for r in missing.limit(5).collect()]
    if names:
        raise ValueError(f"artists without a genre: {names}")
