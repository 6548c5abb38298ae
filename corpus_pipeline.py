"""A corpus pipeline: five operators, each on what its predecessor kept.

``run`` applies the stages to ``documents``; each stage's rows are written as
Parquet to the shared folder and read again as the next one's input.  What a
stage writes on its way is deleted after it, and its input after the next one.

Null texts count as empty, and an empty table gives an empty result.  Extra
columns of ``documents`` are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, decontaminate, minhash, pii, quality
from lexiloom.llm.queries import tokenizer_path
from lexiloom.llm.storage import materialize, scratch

#: SQL can express neither the classifier nor the byte-pair merges.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with a score of 0.3 or more."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates
    (five-word shingles, similarity 0.8 or more).

    An id goes where all its rows do; of the rows of an id that stays, one
    stays, the first by the hash of its text.  Rows without an id stay.
    """
    per_id = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    marks = materialize(per_id.where("n > 1 or not stays").select("doc_id", "stays"), "pipeline-marks")
    once = docs.join(marks, "doc_id", "left_anti").select(*docs.columns)
    repeated = marks.where("stays")
    if repeated.isEmpty():
        return once
    first = F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")
    return once.unionByName(docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data, and what reveals it, replaced in their texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts (little-endian 32-bit integers), digests of them and of the texts they decode to."""
    back = bpe.round_trip(docs, tokenizer_path())
    return back.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", pii_removal),
    ("byte-level BPE", tokenisation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            out = written.pop()
            if before:
                written.append(before)
            before = out
    return docs
