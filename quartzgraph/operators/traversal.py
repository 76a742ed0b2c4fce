"""Breadth-first search and shortest paths: without leaves, in one task if that is small, else in rounds of relaxation over a written state table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import until
from ..plans.ordinal import in_order
from ..plans.reduced import distances, in_one_task, is_small, parents, peeled, with_leaves
from ..plans.scratch import written

UNREACHED_LEVEL, UNREACHED_DISTANCE, SOURCE_PARENT = 2**31 - 1, (2**31 - 1) // 2, -1
COMPACT = 16


def _distances(g: Graph, w: DataFrame, source: int, far: int) -> DataFrame:
    """(id, d): least sums of w from source; far: unreached. A leaf's path goes over its only neighbour."""
    rest, layers = peeled(w, g.n, source)
    start = g.spark.range(source, source + 1).select("id", F.lit(0).cast("long").alias("d"))
    if is_small(rest):
        near = start.union(in_one_task(rest, partial(distances, source), "id long, d long").filter(F.col("id") != source))
    elif layers:
        ids = start.select("id").union(rest.select("u")).distinct()
        near = _relax(ids, rest, source, far).filter(F.col("d") < far)
    else:
        return _relax(g.vertices, rest, source, far)
    near = with_leaves(near, layers, lambda x: x.select(F.col("u").alias("id"), (F.col("d") + F.col("w")).alias("d")))
    return g.vertices.join(near, "id", "left").select("id", F.coalesce("d", F.lit(far)).cast("long").alias("d"))


def _relax(ids: DataFrame, w: DataFrame, source: int, far: int, each=None) -> DataFrame:
    """The same for vertices (id), in rounds. Only vertices that have just improved send."""
    start = ids.select("id", F.when(F.col("id") == source, 0).otherwise(far).cast("long").alias("d"), (F.col("id") == source).alias("open"))

    def step(s: DataFrame, _: int) -> DataFrame:
        sent = s.filter("open").join(w, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("c"))
        better = F.coalesce(F.col("c") < F.col("d"), F.lit(False))
        return s.join(sent, "id", "left").select("id", F.when(better, F.col("c")).otherwise(F.col("d")).alias("d"), better.alias("open"))

    return until(start, step, "open", "relax", each=each).select("id", "d")


def bfs_levels(g: Graph, source: int = 0, sentinel: bool = True) -> DataFrame:
    """(id, lev) with the source at 0; unreached vertices have 2147483647, or no row without sentinel."""
    lev = _distances(g, g.edges.select("u", "v", F.lit(1).cast("long").alias("w")), source, UNREACHED_LEVEL).withColumnRenamed("d", "lev")
    return lev if sentinel else lev.filter(F.col("lev") < UNREACHED_LEVEL)


def sssp(g: Graph, source: int = 0) -> DataFrame:
    """(id, d): exact distances over w; unreached 1073741823."""
    return _distances(g, g.edges.select("u", "v", "w"), source, UNREACHED_DISTANCE)


def sssp_workload(g: Graph, pid: DataFrame, source: int = 0) -> DataFrame:
    """(pid, relaxations): edges relaxed in each partition of the destination, over level-synchronous rounds."""
    w = written(g.edges.select("u", "v", "w").join(pid.withColumnRenamed("id", "v"), "v"), "edges-pid")
    seen: list[DataFrame] = []

    def count(s: DataFrame, i: int) -> None:
        seen.append(written(s.filter("open").join(w, F.col("id") == F.col("u")).groupBy("pid").agg(F.count("*").alias("n")), "relaxed"))

    _relax(g.vertices, w.select("u", "v", "w"), source, UNREACHED_DISTANCE, each=count)
    out = pid.select("pid").distinct().select("pid", F.lit(0).cast("long").alias("n"))
    for s in seen:
        out = out.union(s)
    return out.groupBy("pid").agg(F.sum("n").alias("relaxations"))


def workload_balance(work: DataFrame) -> DataFrame:
    """(max_work, min_work, ratio) of what sssp_workload gives; ratio is null where a partition relaxes nothing."""
    return work.agg(F.max("relaxations").alias("max_work"), F.min("relaxations").alias("min_work")).withColumn("ratio", F.try_divide("max_work", "min_work"))


def bfs_parents(g: Graph, source: int = 0) -> DataFrame:
    """(id, lev, par) of reached vertices, par as a queue would have it: the neighbour that was dequeued first; -1 for the source.

    A leaf's parent is its only neighbour, and a leaf's place in the queue is nobody else's matter.
    """
    rest, layers = peeled(g.edges.select("u", "v"), g.n, source)
    if is_small(rest):
        first = g.spark.range(source, source + 1).select("id", F.lit(0).cast("long").alias("lev"), F.lit(SOURCE_PARENT).cast("long").alias("par"))
        near = first.union(in_one_task(rest, partial(parents, source), "id long, lev long, par long").filter(F.col("id") != source))
    else:
        near = _queued(rest, source)
    return with_leaves(near, layers, lambda x: x.select(F.col("u").alias("id"), (F.col("lev") + 1).alias("lev"), F.col("v").alias("par")))


def _queued(edges: DataFrame, source: int) -> DataFrame:
    """The same over tables, a level a round.

    Queue places need only grow in order inside a level, so they are taken from a range-partitioned sort by (parent's place, id) and may have gaps.
    """
    front = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).cast("long").alias("lev"), F.lit(SOURCE_PARENT).cast("long").alias("par"), F.lit(0).cast("long").alias("pos"))
    front = written(front, "bfs")
    seen, tables = front, 1
    while front.limit(1).count():
        reached = front.join(edges, F.col("id") == F.col("u")).groupBy("v").agg(F.min(F.struct("pos", "id")).alias("p"), F.max("lev").alias("lev"))
        new = reached.join(seen.select(F.col("id").alias("v")), "v", "left_anti").select(F.col("v").alias("id"), (F.col("lev") + 1).alias("lev"), F.col("p.id").alias("par"), F.col("p.pos").alias("pp"))
        front = in_order(new, ["pp", "id"], "bfs").select("id", "lev", "par", F.col("__pos").alias("pos"))
        seen, tables = seen.union(front), tables + 1
        if tables == COMPACT:  # what has been seen stays a few tables, however deep the search
            seen, tables = written(seen, "bfs-seen"), 1
    return seen.select("id", "lev", "par")


def all_parents(g: Graph, source: int = 0, source_parent: int = SOURCE_PARENT, unreached: int = UNREACHED_LEVEL) -> DataFrame:
    """(id, par) of all vertices, with the sentinels asked for."""
    p = bfs_parents(g, source).select("id", F.when(F.col("id") == source, source_parent).otherwise(F.col("par")).alias("par"))
    return g.vertices.join(p, "id", "left").select("id", F.coalesce("par", F.lit(unreached)).cast("long").alias("par"))
