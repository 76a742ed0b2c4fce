"""Neighbourhood lookups, single and in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.ordinal import in_order, numbered


def degrees(g: Graph) -> DataFrame:
    """(id, deg) of all vertices."""
    return g.vertices.join(g.degrees, F.col("id") == F.col("u"), "left").select("id", F.coalesce("d", F.lit(0)).alias("deg"))


def max_degree(g: Graph) -> DataFrame:
    return g.degrees.agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_deg"))


def counts(g: Graph) -> DataFrame:
    """(edges, vertices, partitions); edges are counted in both directions. size_bytes: of offsets and targets at four bytes each."""
    return g.edges.agg(F.count("*").alias("edges")).select("edges", F.lit(g.n).cast("long").alias("vertices"), F.lit(g.partition_count()).cast("long").alias("partitions"), ((F.lit(g.n) + 1) * 4 + F.col("edges") * 4).alias("size_bytes"))


def neighbours(g: Graph, u: int, pid: int | None = None) -> DataFrame:
    """Neighbours of u, or its slice in a partition, ascending."""
    e = g.edges.filter(F.col("u") == u)
    if pid is not None:
        e = e.filter(F.col("pid") == pid)
    return e.select(F.col("v").alias("id")).orderBy("id")


def has_edges(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (qid, u, v) -> (qid, found)."""
    hit = g.edges.select(F.col("u").alias("eu"), F.col("v").alias("ev"))
    return pairs.join(hit, (F.col("u") == F.col("eu")) & (F.col("v") == F.col("ev")), "left").select("qid", F.col("eu").isNotNull().alias("found"))


def kth_neighbours(g: Graph, asked: DataFrame) -> DataFrame:
    """asked (qid, u, k) -> (qid, nbr): the k-th smallest neighbour from 0, null if there is none.

    Ranks come from edge offsets, so a hub's list isn't gathered anywhere.
    """
    at = edge_offsets(g)
    first = at.groupBy("u").agg(F.min("off").alias("first"))
    want = asked.join(first, "u", "left").select("qid", "u", (F.col("first") + F.col("k")).alias("off"))
    return want.join(at.select(F.col("u").alias("eu"), "off", "v"), "off", "left").select("qid", F.when(F.col("u") == F.col("eu"), F.col("v")).alias("nbr"))


def edge_offsets(g: Graph) -> DataFrame:
    """(off, u, v): the place of each edge in the order of u and v, from 0."""
    return numbered(g.edges.select("u", "v"), ["u", "v"], "offsets", "off").select("off", "u", "v")


def vertex_offsets(g: Graph) -> DataFrame:
    """(id, first, last): where each vertex's edges lie in that order; last is exclusive."""
    at = edge_offsets(g).groupBy("u").agg(F.min("off").alias("first"), (F.max("off") + 1).alias("last"))
    return at.select(F.col("u").alias("id"), "first", "last")


def csr_offsets(g: Graph) -> DataFrame:
    """(id, off) for ids 0..n: where each vertex's edges begin, isolated ones too, and at n the number of edges."""
    d = g.vertices.join(g.degrees.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    rows = in_order(d, ["id"], "csr").withColumn("__part", F.shiftright("__pos", 33))
    first, m = [], 0
    for p, s in sorted(rows.groupBy("__part").agg(F.sum("d")).collect()):  # one row for each partition of the sort
        first.append((p, m))
        m += s
    starts = F.broadcast(g.spark.createDataFrame(first or [(0, 0)], "__part long, __first long"))
    own = Window.partitionBy("__part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.join(starts, "__part").select("id", (F.col("__first") + F.coalesce(F.sum("d").over(own), F.lit(0))).alias("off"))
    return at.union(g.spark.createDataFrame([(g.n, m)], "id long, off long"))


def two_hop(g: Graph, of: DataFrame | None = None) -> DataFrame:
    """(id, nbr): distinct neighbours of neighbours, the vertex itself among them, for vertices (id) or all."""
    a = g.edges if of is None else g.edges.join(of.select(F.col("id").alias("u")), "u", "left_semi")
    b = g.edges.select(F.col("u").alias("v"), F.col("v").alias("nbr"))
    return a.select(F.col("u").alias("id"), "v").join(b, "v").select("id", "nbr").distinct()
