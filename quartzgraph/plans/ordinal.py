"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written


def in_order(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df range-partitioned and sorted by keys, with __pos: grows with the order, but has gaps."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__pos", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, keys: list[str | Column], name: str, as_: str) -> DataFrame:
    """df with the number of each row in the order of keys, from 0: range partitions, each begun where those before it end."""
    rows = in_order(df, keys, name).withColumn("__part", F.shiftright("__pos", 33))
    first, n = [], 0
    for p, c in sorted(rows.groupBy("__part").count().collect()):  # one row for each partition of the sort
        first.append((p, n))
        n += c
    starts = df.sparkSession.createDataFrame(first or [(0, 0)], "__part long, __first long")
    return rows.join(F.broadcast(starts), "__part").withColumn(as_, F.col("__first") + F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__first", "__pos")
