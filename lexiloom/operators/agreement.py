"""Agreement of raters, simulated from vote counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpivot_votes(wide: DataFrame, key: str, granularity: int) -> DataFrame:
    """``key, genre, votes`` from columns ``cat{granularity}_n_{genre}``; ``ValueError`` without any."""
    pattern = re.compile(rf"^cat{granularity}_n_(.+)$")
    found = sorted((m[1], c) for c in wide.columns if (m := pattern.match(c)))
    if not found:
        raise ValueError(f"no vote columns for granularity {granularity}")
    cells = F.array(*(F.struct(F.lit(g).alias("genre"), F.col(f"`{c}`").cast("long").alias("votes")) for g, c in found))
    return wide.select(key, F.explode(cells).alias("v")).select(key, "v.genre", "v.votes")


def vote_cdf(votes: DataFrame, key: str) -> DataFrame:
    """``key, genre, lo, cdf``; keys without votes are left out."""
    upto = Window.partitionBy(key).orderBy("genre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("votes").over(Window.partitionBy(key))
    v = votes.withColumn("total", total).withColumn("upto", F.sum("votes").over(upto)).where("total > 0")
    return v.select(key, "genre", ((F.col("upto") - F.col("votes")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("cdf"))


BLOCK = 250  # iterations that are drawn at a time
CELLS = 1 << 20  # draws compared at a time


def uniform(key: np.ndarray, iteration: np.ndarray, rater: int) -> np.ndarray:
    """Numbers in (0, 1), keys x iterations, by whole-number arithmetic that any engine repeats."""
    a = (key[:, None] * 7919 + iteration * 104_729 + (rater * 15_485_863 + 12_345)) % 999_983
    return ((a * a + 31 * a + key[:, None]) % 999_983 + 0.5) / 999_983


def simulate(votes: DataFrame, key: str, iterations: int) -> DataFrame:
    """``iteration, genre, f1`` of two raters who draw each key's genre from its votes.

    A row per key carries its distribution as arrays.  Tasks draw blocks of
    iterations for batches of keys and hand on tallies (iterations x genres), so
    what is shuffled doesn't grow with the keys of a task.
    """
    genres = sorted(r[0] for r in votes.select("genre").distinct().collect())  # few by nature
    place = F.array_position(F.array(*(F.lit(g) for g in genres)), F.col("genre")) - 1 if genres else F.lit(0)
    bands = vote_cdf(votes, key).withColumn("g", place.cast("int")).groupBy(F.col(key).cast("long").alias("key"))
    bands = bands.agg(F.sort_array(F.collect_list(F.struct("cdf", "genre", "g"))).alias("b"))
    n = len(genres)
    short = F.lit(n) - F.size("b")  # genres that a key has no row of are never drawn
    cdf, own = F.transform("b", lambda b: b["cdf"]), F.transform("b", lambda b: b["g"])
    rows = bands.select("key", F.concat(cdf, F.array_repeat(F.lit(2.0), short)).alias("cdf"), F.concat(own, F.array_repeat(F.lit(0), short)).alias("g"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((iterations, 3, n), np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            step = max(1, CELLS // (BLOCK * max(n, 1)))
            for low in range(0, len(keys), step):
                part = batch.slice(low, step)
                cdf, own = (part.column(k).flatten().to_numpy().reshape(part.num_rows, n) for k in (1, 2))
                for begin in range(0, iterations, BLOCK):
                    i = np.arange(begin, min(begin + BLOCK, iterations))
                    a, b = (np.take_along_axis(own, (cdf[:, None] < uniform(keys[low : low + step], i, r)[:, :, None]).sum(2), 1) for r in (0, 1))
                    at = np.arange(len(i)) * n
                    for kind, cells in enumerate(((at + a)[a == b], (at + b)[a != b], (at + a)[a != b])):
                        tally[i, kind] += np.bincount(cells.ravel(), minlength=len(i) * n).reshape(len(i), n)
        blocks = range(0, iterations, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([tally[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], ["block", "tally"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_py(), np.int64)
                sums[block] = sums[block] + x if block in sums else x
        for block, x in sums.items():
            x = x.reshape(-1, 3, n)
            i, g = np.repeat(np.arange(block, block + len(x)), n), np.tile(np.arange(n), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(g, pa.int32()), *(pa.array(x[:, k].ravel()) for k in range(3))], ["iteration", "g", "tp", "fp", "fn"])

    tally = rows.mapInArrow(draw, "block int, tally binary").repartition("block").mapInArrow(add, "iteration int, g int, tp long, fp long, fn long")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    names = F.array(*(F.lit(g) for g in genres)) if genres else F.array(F.lit(""))
    return tally.select("iteration", F.element_at(names, F.col("g") + 1).alias("genre"), f1.alias("f1"))


def summary(simulated: DataFrame) -> DataFrame:
    """``genre, mean, std, low, high`` (95 % interval) of each genre and of the mean over genres (``macro``)."""

    def stats(df: DataFrame) -> DataFrame:
        return df.groupBy("genre").agg(
            F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std"), F.percentile("f1", 0.025).alias("low"), F.percentile("f1", 0.975).alias("high")
        )

    macro = simulated.groupBy("iteration").agg(F.avg("f1").alias("f1")).withColumn("genre", F.lit("macro"))
    return stats(macro).unionByName(stats(simulated))


def mean_and_error(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and standard error of each group."""
    return scores.groupBy(by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))
