"""Bounded samples that don't depend on how rows are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, n: int, hash_: Column, *ties: str) -> DataFrame:
    """About the n rows with the smallest hashes (never more), the same in every run.

    Of many rows, only those under a bound that leaves about three times n are ordered, so no task keeps n rows of its
    own and what reaches the driver doesn't grow with the number of tasks.
    """
    total = rows.count()
    hashed = rows.withColumn("_h", F.shiftrightunsigned(hash_, 1))
    if total > 4 * n:
        hashed = hashed.where(F.col("_h") < int(2.0**63 * 3 * n / total))
    return hashed.orderBy("_h", *ties).limit(n).drop("_h")
