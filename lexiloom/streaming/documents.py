"""Text rules, counts and topic shares over a stream of documents.

What is kept of a micro-batch is written under its number, so a batch that is
run again replaces what it wrote before, and a query that starts again from its
checkpoint neither loses nor repeats anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.functions import text as T
from lexiloom.operators import topics


def stream(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def vocabulary_counts(docs: DataFrame, vocab: DataFrame, order: int = 1) -> DataFrame:
    """``doc_id, term_idx`` for each occurrence of a vocabulary term; a stream-static join, without state."""
    grams = docs.select("doc_id", F.explode(T.ngrams(T.tokens(F.col("text")), order)).alias("ngram"))
    return grams.join(vocab.select("ngram", "term_idx"), "ngram").select("doc_id", "term_idx")


def running_counts(docs: DataFrame) -> DataFrame:
    """Documents and words by language, for complete or update mode."""
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(T.tokens(F.col("text")))).alias("words"))


def keep_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch's rows in place of what the same number left before."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def keep_all(stream: DataFrame, rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps ``rows`` of each micro-batch under ``path``, until all that is there is read."""

    def one(batch: DataFrame, number: int) -> None:
        keep_batch(rows(batch), number, path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_counts(vocab: DataFrame, order: int = 1) -> Callable[[DataFrame], DataFrame]:
    """``doc_id, term_idx, cnt`` of a micro-batch over a fixed vocabulary."""
    return lambda batch: vocabulary_counts(batch, vocab, order).groupBy("doc_id", "term_idx").agg(F.count("*").alias("cnt"))


def kept_counts(spark: SparkSession, path: str) -> DataFrame:
    """The document-term table of all batches; a document in several has its sums."""
    schema = "doc_id long, term_idx long, cnt long, batch long"
    return spark.read.schema(schema).parquet(path).groupBy("doc_id", "term_idx").agg(F.sum("cnt").alias("cnt"))


def batch_shares(model: topics.TopicModel, vocab: DataFrame, order: int = 1) -> Callable[[DataFrame], DataFrame]:
    """``doc_id, theta`` of a micro-batch's documents by a stored model, with the
    mean covariates; documents without a known term have the prior's shares."""

    def shares(batch: DataFrame) -> DataFrame:
        dtm = batch_counts(vocab, order)(batch)
        width = len(model.gamma)
        level = batch.select("doc_id", F.lit("all").alias("level")).distinct()
        docs = topics.as_documents(dtm, "doc_id", level, ["all"]).withColumn("x", F.array(*([F.lit(1.0)] * width)))
        return model.transform(docs, "doc_id")

    return shares
