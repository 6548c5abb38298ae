"""Exact global ranks without a task that sees all rows.

Rows are dealt into buckets that follow the order; bucket sizes are counted and
summed up, and a row's rank is the number of rows in earlier buckets plus its
place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BEFORE = (Window.unboundedPreceding, -1)


def _add_up(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def rank_in_buckets(df: DataFrame, by: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, from 1, within equal ``by``, by ``bucket`` and then ``order``.

    ``bucket``: a number that must not fall along ``order``; there should be some
    thousands of them at most, as their counts are ordered in one task per ``by``.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    lower = sizes.withColumn("_below", _add_up(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*_BEFORE))))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    on = F.col("r._bucket").eqNullSafe(F.col("l._bucket"))
    for c in by:
        on = on & F.col(f"r.`{c}`").eqNullSafe(F.col(f"l.`{c}`"))
    joined = rows.withColumn("_place", place).alias("r").join(lower.drop("_n").alias("l"), on)
    return joined.select(*(F.col(f"r.`{c}`") for c in df.columns), (F.col("_below") + F.col("_place")).alias(name))


def rank_by_name(df: DataFrame, first: str, text: str, name: str = "rank") -> DataFrame:
    """``df``, a written table, with ``name``, from 1, by ``first`` and then ``text``.

    Rows are dealt into ranges at sampled quantiles, each range is numbered by
    itself, and the exact counts of lower ranges are added.
    """
    from .stored import written

    dealt = written(df.repartitionByRange(first, text).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    lower = sizes.select("_range", _add_up(F.sum("_n").over(Window.orderBy("_range").rowsBetween(*_BEFORE))).alias("_low"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(first, text))
    return dealt.withColumn("_place", place).join(F.broadcast(lower), "_range").select(*df.columns, (F.col("_low") + F.col("_place")).alias(name))


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """``df``, a written table, with ``name``: the rank of a value of 0 or more
    within equal ``by``, from 1 for the smallest; equals share the mean of their ranks.

    Equal values are counted first, then running counts are taken within bins
    that follow the order (64 for each power of two), so no task sees all rows
    of a group.
    """
    per = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    bin_ = F.when(F.col(value) <= 0, F.lit(-80_000)).otherwise(F.floor(F.log2(value) * 64).cast("int"))
    binned = per.withColumn("_bin", bin_)
    sizes = binned.groupBy(*by, "_bin").agg(F.sum("_n").alias("_in"))
    lower = sizes.select(*by, "_bin", _add_up(F.sum("_in").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(*_BEFORE))).alias("_low"))
    before = _add_up(F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(*_BEFORE)))
    ranks = binned.withColumn("_before", before).join(lower, [*by, "_bin"]).select(*by, value, (F.col("_low") + F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value]).select(*df.columns, name)
