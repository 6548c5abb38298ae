"""Results kept by a fingerprint of everything they depend on, and tables written to be read several times."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(params: dict, *inputs: DataFrame) -> str:
    """Hash of all parameters and of the inputs' columns, row counts and row hashes (whatever their order)."""
    parts = [json.dumps(params, sort_keys=True, default=str)]
    for df in inputs:
        rows = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).alias("h")).first()
        parts.append(f"{df.dtypes}{rows['n']}{rows['h']}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


_own: dict[str, str] = {}
#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet, for plans that read it several times.

    The files go to ``spark.checkpoint.dir``, which all executors share, and
    stay until it is emptied; they outlive lost executors.  A session of one
    machine without that setting takes a temporary folder; a cluster without it
    has no such folder, and this raises.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="lexiloom-")
        folder = _own[application]
    path = f"{folder.rstrip('/')}/lexiloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_slices(slices: Iterable[DataFrame], name: str) -> DataFrame:
    """Several tables of one schema written one after the other and read as one.

    What a slice shuffled is deleted before the next begins, so only one
    slice's shuffle is on the disks at a time.
    """
    parts: list[DataFrame] = []
    for df in slices:
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            parts.append(written(df, name))
        finally:
            conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return reduce(DataFrame.unionAll, parts)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def stored(folder: str, name: str, params: dict, inputs: list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of an earlier call with equal parameters and inputs, or a new one that is then kept.

    A table that was not written to its end has no ``_SUCCESS`` file and is
    written again.
    """
    spark = inputs[0].sparkSession
    path = f"{folder}/{name}-{fingerprint(params, *inputs)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
