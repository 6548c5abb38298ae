"""Exact forests of tables that are too large to be sent in one piece.

The rows are written once.  The driver takes a few features at a time and sends
them on, so it holds ``CHUNK`` bytes of them and no tree.  Each worker process
keeps all features as files without a name, from which trees grow as in
:mod:`.forests`: no limit of depth, no bins, and the same trees as there.
Finished trees are written by the tasks that grew them, as in :mod:`.forests`.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forests
from .stored import written

CHUNK = 16 << 20  # bytes of features that the driver holds at a time
TASKS = 16  # of growth, for each core


class Columns:
    """What :class:`forests.Table` has, with the features' codes and values on the disk."""

    def __init__(self, y: np.ndarray, keys: np.ndarray, classes: int, width: int):
        self.y, self.keys, self.classes = y, keys, classes
        shape = (width, len(y))
        self.codes, self._values = _on_disk(np.int32, shape), _on_disk(np.float64, shape)
        self._sizes = np.zeros(width, np.int64)

    def put(self, j: int, column: np.ndarray) -> None:
        values, self.codes[j] = np.unique(column, return_inverse=True)
        self._values[j, : len(values)] = values
        self._sizes[j] = len(values)

    def distinct(self, j: int) -> np.ndarray:
        return self._values[j, : self._sizes[j]]

    def training(self, fit: forests.Fit) -> np.ndarray:
        if fit.fold is not None:
            raise ValueError("large tables have no folds")
        return np.arange(len(self.y))


def _on_disk(kind, shape: tuple[int, int]) -> np.ndarray:
    if not np.prod(shape):
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as file:  # its name is gone at once, its bytes with the array
        return np.asarray(np.memmap(file, kind, "w+", shape=shape))


def _taken(written_rows: DataFrame, columns: list) -> pa.Table:
    """Columns of all rows, in the order of the hashes of their contents."""
    found = written_rows.select("h", "at", *columns).toArrow().combine_chunks()
    return found.take(np.lexsort((found["at"].to_numpy(), found["h"].to_numpy())))


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Sent:
    """A table's parts as broadcasts."""

    def __init__(self, rows: DataFrame, classes: int):
        context = rows.sparkSession.sparkContext
        self.mark, self.classes = uuid.uuid4().hex, classes
        kept = written(rows.select("x", "y", F.xxhash64("x", "y").alias("h"), F.monotonically_increasing_id().alias("at")), "training")
        size = kept.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
        self.rows, self.width = size["n"], size["high"] or 0
        if not self.rows:
            raise ValueError("no rows to grow trees from")
        if size["low"] != size["high"]:
            raise ValueError(f"rows have {size['low']} to {size['high']} features")
        self.labels = context.broadcast(_taken(kept, ["y"])["y"].to_numpy().astype(np.int64))
        step = max(1, CHUNK // (8 * self.rows))
        self.parts = []
        for j in range(0, self.width, step):
            some = _taken(kept, [F.slice("x", j + 1, step).alias("x")])["x"].combine_chunks()
            self.parts.append((j, context.broadcast(np.ascontiguousarray(_matrix(some, self.rows).T))))

    def here(self) -> Columns:
        """The table in this process, built by the first task that asks for it."""
        if self.mark not in _here:
            _here.clear()
            y = _loaded(self.labels)
            table = Columns(y, np.arange(len(y)), self.classes, self.width)
            for first, part in self.parts:
                for j, column in enumerate(_loaded(part), first):
                    table.put(j, column)
            _here[self.mark] = table
        return _here[self.mark]

    def destroy(self) -> None:
        for held in (self.labels, *(p for _, p in self.parts)):
            held.destroy()


#: The last table that this process grew trees from.
_here: dict[str, Columns] = {}


def _loaded(held) -> np.ndarray:
    """A broadcast's value that doesn't stay in memory where it is read from a file."""
    path = getattr(held, "_path", None)
    return held.load_from_path(path) if path else held.value


class DeepForest:
    """A forest of a large table: a written table of packed trees."""

    def __init__(self, trees: DataFrame, classes: int):
        self.trees, self.classes = trees, classes

    @staticmethod
    def fit(spark: SparkSession, rows: DataFrame, classes: int, fit: forests.Fit) -> DeepForest:
        """A forest of all rows ``x, y``."""
        sent = Sent(rows, classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high in zip(batch["low"].to_pylist(), batch["high"].to_pylist()):
                    yield forests.packed(0, low, forests.grow_block(sent.here(), fit, np.arange(low, high)))

        trees = written(forests._units(spark, [fit], sent.rows, TASKS).mapInArrow(run, forests.PACKED), "forest")
        sent.destroy()
        return DeepForest(trees, classes)

    def add_votes(self, rows: DataFrame, features: str, name: str = "_votes") -> DataFrame:
        return forests.votes_in_place(self.trees, self.classes, rows, features, name)

    def save(self, path: str) -> None:
        self.trees.withColumn("classes", F.lit(self.classes)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> DeepForest:
        trees = spark.read.parquet(path)
        return DeepForest(trees.drop("classes"), trees.first()["classes"])
