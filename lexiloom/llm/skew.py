"""Joins with a table of unique keys where one key may hold a third of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 1000  # a key with more than 1/HEAVY of the rows is heavy, so there are fewer than HEAVY of them


def join_counted(rows: DataFrame, keys: DataFrame, on: str, total: int, number: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which has each value of ``on`` once
    and in ``number`` how many of the ``total`` rows have it.

    Heavy keys, fewer than ``HEAVY`` by that count, go to all executors, so
    their rows stay where they are; only the others' rows are shuffled.  Both
    sides are read twice and should be written tables.
    """
    heavy = keys.where(F.col(number) * HEAVY > total)
    apart = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(keys.where(F.col(number) * HEAVY <= total), on)
    return apart.unionByName(rest)
