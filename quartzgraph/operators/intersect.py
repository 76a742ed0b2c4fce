"""Intersections of neighbour lists. Queries meet edges in joins; `method` only chooses the physical form.

merge: an edge join and a count. galloping: sorted adjacency arrays and array_intersect. On a graph with partitions the count is made
in two steps, per partition of the common neighbour and then over all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def _common(g: Graph, pairs: DataFrame) -> DataFrame:
    """(qid, x[, pid]): common neighbours x of the ends of each query."""
    e = g.edges.select(F.col("u"), F.col("v").alias("x"), *(["pid"] if "pid" in g.edges.columns else []))
    both = g.edges.select(F.col("u").alias("v"), F.col("v").alias("x"))
    return pairs.select("qid", "u", "v").join(e, "u").join(both, ["v", "x"])


def pair_counts(g: Graph, pairs: DataFrame, method: str = "merge", below: str | None = None) -> DataFrame:
    """pairs (qid, u, v) -> (qid, c) with zeros. below: a column of pairs; only neighbours with lower ids count."""
    if method == "galloping":
        adj = g.adjacency()
        a, b = adj.select(F.col("id").alias("u"), F.col("nbrs").alias("a")), adj.select(F.col("id").alias("v"), F.col("nbrs").alias("b"))
        both = F.array_intersect("a", "b")
        both = F.filter(both, lambda x: x < F.col(below)) if below else both
        return pairs.join(a, "u", "left").join(b, "v", "left").select("qid", F.coalesce(F.size(both), F.lit(0)).cast("long").alias("c"))
    hits = _common(g, pairs)
    if below:
        hits = hits.join(pairs.select("qid", F.col(below).alias("below")), "qid").filter("x < below")
    if "pid" in hits.columns:
        hits = hits.groupBy("qid", "pid").agg(F.count("*").alias("part")).groupBy("qid").agg(F.sum("part").alias("c"))
    else:
        hits = hits.groupBy("qid").agg(F.count("*").alias("c"))
    return pairs.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("c"))


def pair_lists(g: Graph, pairs: DataFrame) -> DataFrame:
    """(qid, x), one row for each common neighbour."""
    return _common(g, pairs).select("qid", "x")


def kway_counts(g: Graph, queries: DataFrame) -> DataFrame:
    """queries (qid, vertices) -> (qid, c): neighbours that all vertices of the query share. A vertex named twice counts once; an empty query gives 0."""
    named = queries.select("qid", F.explode(F.array_distinct("vertices")).alias("u"))
    need = queries.select("qid", F.size(F.array_distinct("vertices")).alias("k"))
    hits = named.join(g.edges.select("u", F.col("v").alias("x")), "u").groupBy("qid", "x").agg(F.count("*").alias("have"))
    c = hits.join(need, "qid").filter("have = k").groupBy("qid").agg(F.count("*").alias("c"))
    return queries.select("qid").join(c, "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("c"))


def list_hits(g: Graph, queries: DataFrame) -> DataFrame:
    """queries (qid, u, nodes) -> (qid, x): neighbours of u that nodes names."""
    named = queries.select("qid", "u", F.explode(F.array_distinct("nodes")).alias("v"))
    return named.join(g.edges.select("u", "v"), ["u", "v"]).select("qid", F.col("v").alias("x"))


def list_counts(g: Graph, queries: DataFrame) -> DataFrame:
    c = list_hits(g, queries).groupBy("qid").agg(F.count("*").alias("c"))
    return queries.select("qid").join(c, "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("c"))
