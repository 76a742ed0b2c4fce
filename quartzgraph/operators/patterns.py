"""Triangles, squares and friend triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.scratch import written


def _led(g: Graph) -> DataFrame:
    """Each edge once, from the end with the lower (degree, id): a vertex leads at most about sqrt(2m) edges, which bounds the wedges."""
    d = g.degrees
    e = g.edges.filter("u < v").join(d.withColumnRenamed("d", "du"), "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    return e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(g: Graph) -> DataFrame:
    """(a, b, c): each triangle once."""
    led = written(_led(g), "led")
    other = led.select("a", F.col("b").alias("c"))
    wedges = led.join(other, "a").filter("b < c")
    shut = led.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return wedges.join(shut, ["b", "c"]).select("a", "b", "c")


def triangle_count(g: Graph, method: str = "merge") -> DataFrame:
    """t: distinct triangles (merge), or the sum over directed edges of common neighbours (galloping), six times as much."""
    return triangles(g).agg((F.count("*") * (6 if method == "galloping" else 1)).alias("t"))


def triangles_by_partition(g: Graph, pid: DataFrame) -> DataFrame:
    """(pid, t): triangles by the partition of their smallest vertex."""
    low = triangles(g).groupBy(F.least("a", "b", "c").alias("id")).agg(F.count("*").alias("t"))
    return low.join(pid, "id").groupBy("pid").agg(F.sum("t").alias("t"))


def _wedges(g: Graph) -> DataFrame:
    """(p, q, mid), p > q: paths p - mid - q."""
    return g.edges.select(F.col("u").alias("p"), F.col("v").alias("mid")).join(g.edges.select(F.col("u").alias("q"), F.col("v").alias("mid")), "mid").filter("p > q")


def squares_ordered(g: Graph) -> DataFrame:
    """s: tuples u > v > w > x with u and x both next to v and w: for each pair (v, w), middles above v times middles below w."""
    ends = _wedges(g).groupBy("p", "q").agg(F.count_if(F.col("mid") > F.col("p")).alias("above"), F.count_if(F.col("mid") < F.col("q")).alias("below"))
    return ends.agg(F.coalesce(F.sum(F.col("above") * F.col("below")), F.lit(0)).alias("s"))


def squares_true(g: Graph) -> DataFrame:
    """s: distinct four-cycles, each seen from its highest vertex by (degree, id): of paths top - mid - end with mid and end below top, any two with the same top and end close one.

    A vertex has at most sqrt(2m) neighbours above it, which bounds the paths at hubs.
    """
    d = g.degrees
    e = g.edges.join(d.withColumnRenamed("d", "du"), "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = e.filter(F.struct("dv", "v") > F.struct("du", "u")).select(F.col("u").alias("mid"), F.struct("dv", "v").alias("top"))
    paths = up.join(e.select(F.col("u").alias("mid"), F.struct("dv", "v").alias("end")), "mid").filter(F.col("end") < F.col("top"))
    c = paths.groupBy(F.col("top.v").alias("top"), F.col("end.v").alias("end")).agg(F.count("*").alias("c"))
    return c.agg(F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).alias("s"))


def friend_triangles(g: Graph, groups: DataFrame | None = None) -> DataFrame:
    """(root, t): over positions i < j of the root's nodes, the neighbours that root, n_i and n_j share.

    groups (root, nodes); none: all vertices with their neighbours. Counted by the shared neighbour v: with k of the nodes next to it, it
    stands for k (k - 1) / 2 pairs, so no pair is written out.
    """
    if groups is None:
        named, roots = g.edges.select(F.col("u").alias("root"), F.col("v").alias("node")), g.vertices.select(F.col("id").alias("root"))
    else:
        named, roots = groups.select("root", F.explode("nodes").alias("node")).filter("node <> root"), groups.select("root")
    near = named.join(g.edges.select(F.col("u").alias("node"), F.col("v").alias("x")), "node")
    k = near.join(g.edges.select(F.col("u").alias("root"), F.col("v").alias("x")), ["root", "x"]).groupBy("root", "x").agg(F.count("*").alias("k"))
    t = k.groupBy("root").agg(F.sum(F.expr("k * (k - 1) div 2")).alias("t"))
    return roots.join(t, "root", "left").select("root", F.coalesce("t", F.lit(0)).alias("t"))
