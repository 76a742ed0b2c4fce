"""Undirected graphs as tables of edges and vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.scratch import written


class Graph:
    """edges (u, v[, w]): symmetric, distinct, without loops. Vertices are 0..n-1; isolated ones come from n alone. pid: optional table (id, pid).

    plain: the same edges as they were before partitions were dealt, for who reads them without."""

    def __init__(self, edges: DataFrame, n: int, pid: DataFrame | None = None, plain: DataFrame | None = None) -> None:
        self.edges, self.n, self.pid, self.plain = edges, n, pid, edges if plain is None else plain

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    @classmethod
    def from_pairs(cls, pairs: DataFrame, u: str, v: str, n: int | None = None) -> Graph:
        """Raw pairs of 0-based ids: loops go, edges are mirrored and told apart; null ends are no edge. n: largest id of an edge, plus one, unless given."""
        p = pairs.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v")
        # told apart in one direction first, which halves what is shuffled
        p = p.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        p = written(p.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v"), "edges")
        top = p.agg(F.max("u")).first()[0]
        return cls(p, n if n is not None else (top + 1 if top is not None else 0))

    @classmethod
    def from_adjacency(cls, lists: DataFrame, id: str = "id", nbrs: str = "nbrs") -> Graph:
        """Lists are taken as they are: no mirroring, no telling apart."""
        e = lists.select(F.col(id).cast("long").alias("u"), F.explode(nbrs).alias("v")).select("u", F.col("v").cast("long").alias("v"))
        top = lists.agg(F.max(id)).first()[0]
        return cls(e, top + 1 if top is not None else 0)

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    @property
    def degrees(self) -> DataFrame:
        """(u, d) of vertices with edges."""
        return self.edges.groupBy("u").agg(F.count("*").alias("d"))

    def adjacency(self) -> DataFrame:
        """(id, nbrs) of vertices with edges, nbrs ascending."""
        return self.edges.groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_list("v")).alias("nbrs"))

    def with_weights(self) -> Graph:
        """Deterministic symmetric weights in 1..floor(log2 n)."""
        return Graph(self.edges.select("u", "v", weight("u", "v", self.n).alias("w")), self.n, self.pid)

    def partitioned(self, pid: DataFrame) -> Graph:
        """The graph with edges that carry the partition of their destination and are dealt by it."""
        p = pid.select(F.col("id").alias("v"), "pid")
        count = (pid.agg(F.max("pid")).first()[0] or 0) + 1
        return Graph(self.edges.join(p, "v").repartition(count, "pid"), self.n, pid, self.plain)

    def partition_count(self) -> int:
        return (self.pid.agg(F.max("pid")).first()[0] or 0) + 1 if self.pid is not None else 1


def weight(u: str, v: str, n: int):
    top = max(1, n.bit_length() - 1)
    return (F.lit(1) + (F.least(u, v) * 31 + F.greatest(u, v) * 17) % top).cast("long")
