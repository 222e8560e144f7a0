"""Rows dealt to all cores before long work on each of them, and rows of equal texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """df in at least two partitions a core. A small file has one row group or a few, and a row group is read by one task:
    where a row takes about a millisecond, a shuffle of all rows costs little beside it."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of a part that dealt() makes; a task sorts and counts a few hundred bytes of each.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with rows of equal keys in one of as many partitions as its rows need. Partitions that Spark joins by their compressed
    size grow with the table, and what a task sorts grows with them; these don't. The rows are counted first."""
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / PART_ROWS))
    return df.repartition(parts, *keys)


def copies(df: DataFrame, text: str, order: list[str], k: int | None = None) -> DataFrame:
    """df with copy, a digest that equal texts share; with k only the first k rows of each text, and nth, their place among its rows."""
    keyed = df.withColumn("copy", F.sha2(F.coalesce(text, F.lit("")), 256))
    if k is None:
        return keyed
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("copy").orderBy(*order))).filter(F.col("nth") <= k)
