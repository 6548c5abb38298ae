"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine (``local`` master, as in
    tests) gets a temporary folder that lasts as long as the application; on a
    cluster there is no folder that all executors see, and this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="lexiloom-")
        folder = _own[application]
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the tasks of the stage
    that is running, and later reads prune columns.  The files live until the
    folder is emptied, as those of ``checkpoint()`` do, or until the end of a
    :func:`scratch` block that they were written in.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _scopes[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Block whose written tables are deleted at its end, but for those taken off the list it gives."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield written
    finally:
        _scopes.remove(written)
        for path in written:
            delete(spark, path)


def small(table: DataFrame, rows: int, weight: Column | None = None, most: int = 1_000_000) -> bool:
    """Whether a written table has at most ``rows`` rows, of a ``weight`` of at most ``most`` together: proof before a broadcast."""
    counted = table.agg(F.count("*").alias("n"), *([F.sum(weight).alias("w")] if weight is not None else [])).first()
    return counted["n"] <= rows and (weight is None or (counted["w"] or 0) <= most)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's rows per Arrow batch to ``rows`` at most, where it is more.

    It can only be set for the session, and the plan reads it when it runs, so
    it stays set.  With the default of 10,000 rows the pipeline's executors
    took 2,959 MB and more, with 1,000 about 500 MB less.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
