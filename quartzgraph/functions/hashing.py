"""Arithmetic hashes that any SQL engine can work out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER, MODULUS = 2654435761, 4294967296


def mixed(c: Column) -> Column:
    """Multiplicative hash to 32 bits, its halves swapped so that low bits depend on all."""
    h = F.pmod(F.pmod(c, F.lit(MODULUS // 2)) * F.lit(MULTIPLIER), F.lit(MODULUS))
    return F.pmod(h, F.lit(65536)) * 65536 + F.shiftright(h, 16)


def query_pairs(spark: SparkSession, n: int, count: int, seed: int = 1) -> DataFrame:
    """(qid, u, v): count pseudo-random pairs of ids below n."""
    at = lambda k: F.pmod(mixed(F.col("id") * 2 + (seed * 1000003 + k)), F.lit(n))
    return spark.range(count).select(F.col("id").alias("qid"), at(0).cast("long").alias("u"), at(1).cast("long").alias("v"))
