"""Readers and writers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table dealt over all cores, where it has fewer files than that: a
    file of one row group would be one task's work.  Tables of more files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",") -> DataFrame:
    """CSV with a header and quoted line breaks; the schema is given, so nothing is read twice."""
    return spark.read.csv(path, schema=schema, header=True, sep=delimiter, multiLine=True, escape='"')


def _placed(lines: DataFrame) -> DataFrame:
    """Rows of a file source with ``_file, _block, _id``, in whose order they stand in the files (by name)."""
    return lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def numbered(lines: DataFrame, name: str = "at") -> DataFrame:
    """Rows of a file source with ``name``: their number, from 0, in the order of the files.

    Rows are counted by block of a file first; a row's number is what earlier
    blocks hold and its place in its own, so rows are neither shuffled nor
    sorted.
    """
    placed, columns = _placed(lines), lines.columns
    read = [F.max(F.length(F.col(f"`{c}`").cast("string"))) for c in columns]  # the same columns in both passes
    blocks = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.greatest(*read, F.lit(0)).alias("_read"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    offsets = blocks.select("_file", "_block", (before - F.col("_first")).alias("_offset"))
    return placed.join(F.broadcast(offsets), ["_file", "_block"]).select(*columns, (F.col("_offset") + F.col("_id")).alias(name))


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """One-column CSV with its order: ``term_idx, term``."""
    return numbered(csv(spark, path, "term string"), "term_idx").select("term_idx", "term")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate file, or numbered part files of one: ``i, j, value`` (1-based), without comments and the size line."""
    at = F.struct("_file", "_block", "_id").alias("at")
    lines = _placed(spark.read.text(path)).select("value", at).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    size_line = lines.agg(F.min("at").alias("first"))
    rows = lines.join(F.broadcast(size_line), F.col("at") > F.col("first"))
    return rows.select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), F.coalesce(F.try_element_at(parts, F.lit(3)).cast("double"), F.lit(1.0)).alias("value"))


def write_matrix_market(rows: DataFrame, path: str, n_rows: int, n_columns: int) -> None:
    """Numbered part files, the header in the first; put together in order they are one coordinate file."""
    head = f"%%MatrixMarket matrix coordinate real general\n{n_rows} {n_columns} {rows.count()}"
    first = rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    first.union(rows.select(F.concat_ws(" ", "i", "j", "value").alias("value"))).write.text(path)


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """CSV with a header; with ``index`` that column comes first, as the key."""
    columns = [index, *(c for c in df.columns if c != index)] if index else df.columns
    df.select(*(f"`{c}`" for c in columns)).write.csv(path, header=True, escape='"')


def feature_table(spark: SparkSession, folder: str, kind: str, granularity: int) -> DataFrame:
    """Stored features ``fs``, ``topic`` or ``style``; value columns get the kind as prefix."""
    if kind not in ("fs", "topic", "style"):
        raise ValueError(f"unknown feature type: {kind}")
    rows = spark.read.parquet(f"{folder}/{kind}_features_cat{granularity}")
    return rows if kind == "fs" else rows.select("doc_id", *(F.col(f"`{c}`").alias(f"{kind}_{c}") for c in rows.columns if c != "doc_id"))


def cast_all_but(df: DataFrame, prefixes: tuple[str, ...], to: str = "string") -> DataFrame:
    """All columns cast to ``to`` except those whose names begin with a prefix."""
    return df.select(*(F.col(f"`{c}`") if c.startswith(prefixes) else F.col(f"`{c}`").cast(to).alias(c) for c in df.columns))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without columns whose names match, whatever the case."""
    return df.select(*(f"`{c}`" for c in df.columns if not re.search(pattern, c, re.IGNORECASE)))


def write_matrix(rows: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """A sparse matrix of long rows with its vocabulary (``term_idx, ...``) beside it."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and vocabulary of :func:`write_matrix`."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/vocabulary")


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """Settings and names as one JSON document, in any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """A JSON document, also one over several lines."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
