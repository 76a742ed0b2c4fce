"""Vertex programs: PageRank, label propagation, core numbers, independent sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import rounds, until
from ..plans.reduced import cores, in_one_task, is_small, peeled
from ..plans.scratch import laid_out


def _sending(g: Graph) -> DataFrame:
    """(u, v, share): edges with 1 / degree of the sender, worked out once and dealt by sender, so that a round moves only what vertices send."""
    return laid_out(g.edges.join(g.degrees, "u").select("u", "v", (F.lit(1.0) / F.col("d")).alias("share")), "u", "sending")


def _received(edges: DataFrame, state: DataFrame, p: str = "p") -> DataFrame:
    return state.join(edges, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.sum(F.col(p) * F.col("share")).alias("s"))


def pagerank(g: Graph, times: int = 10, damping: float = 0.85, init: str = "one") -> DataFrame:
    """(id, p) after so many rounds of (1 - d) / n + d * sum(p / degree). init: one (1.0), uniform (1 / n), degree (deg / (d n)). No tolerance and no dangling share."""
    edges, rest = _sending(g), (1 - damping) / max(g.n, 1)
    first = {"one": F.lit(1.0), "uniform": F.lit(1.0 / max(g.n, 1)), "degree": F.coalesce("deg", F.lit(0)) / (damping * max(g.n, 1))}[init]
    start = g.vertices.join(g.degrees.select(F.col("u").alias("id"), F.col("d").alias("deg")), "id", "left").select("id", first.alias("p"))

    def step(s: DataFrame, _: int) -> DataFrame:
        return g.vertices.join(_received(edges, s), "id", "left").select("id", (F.lit(rest) + damping * F.coalesce("s", F.lit(0.0))).alias("p"))

    return rounds(start, step, times, "pagerank")


def pagerank_residual(g: Graph, times: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, p, active): as pagerank from 1 / n, but a vertex that moved by less than tolerance keeps its value from then on."""
    edges, rest = _sending(g), (1 - damping) / max(g.n, 1)
    start = g.vertices.select("id", F.lit(1.0 / max(g.n, 1)).alias("p"), F.lit(True).alias("active"))

    def step(s: DataFrame, _: int) -> DataFrame:
        new = F.lit(rest) + damping * F.coalesce("s", F.lit(0.0))
        return s.join(_received(edges, s), "id", "left").select("id", F.when(F.col("active"), new).otherwise(F.col("p")).alias("p"), (F.col("active") & (F.abs(new - F.col("p")) >= tolerance)).alias("active"))

    return rounds(start, step, times, "residual")


def max_labels(g: Graph, times: int = 5) -> DataFrame:
    """(id, l): in each round the largest label among the neighbours, the own one left out; isolated vertices get 0."""

    def step(s: DataFrame, _: int) -> DataFrame:
        got = s.join(g.edges, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.max("l").alias("m"))
        return g.vertices.join(got, "id", "left").select("id", F.coalesce("m", F.lit(0)).cast("long").alias("l"))

    return rounds(g.vertices.select("id", F.col("id").alias("l")), step, times, "labels")


def core_numbers(g: Graph) -> DataFrame:
    """(id, core). Vertices with an edge have 1 at least, and no core of 2 or more needs a leaf, so leaves are taken off first; a small rest is peeled in one task."""
    rest, layers = peeled(g.edges.select("u", "v"), g.n)
    if is_small(rest):
        core = in_one_task(rest, cores, "id long, core long")
    elif layers:
        core = _h_indices(Graph(rest, g.n), rest.select(F.col("u").alias("id")).distinct())
    else:
        return _h_indices(g, g.vertices)
    if layers:
        core = core.union(g.edges.select("u", F.lit(1).cast("long")).distinct()).groupBy("id").agg(F.max("core").alias("core"))
    return g.vertices.join(core, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"))


def _h_indices(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, core) of vertices (id), over tables. From the degrees down, each vertex takes the h-index of its neighbours' values until nothing moves, which is its core number.

    The h-index is read off a histogram of values cut at the own one, so a hub's neighbours aren't gathered.
    """
    start = ids.join(g.degrees.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("core"), F.lit(True).alias("open"))
    over = Window.partitionBy("id").orderBy(F.desc("c"))

    def step(s: DataFrame, _: int) -> DataFrame:
        mine = s.select(F.col("id").alias("v"), F.col("core").alias("own"))
        cut = s.join(g.edges, F.col("id") == F.col("u")).join(mine, "v").groupBy(F.col("v").alias("id"), F.least("core", "own").alias("c")).agg(F.count("*").alias("n"))
        h = cut.withColumn("n", F.sum("n").over(over)).groupBy("id").agg(F.max(F.least("c", "n")).alias("h"))
        return s.join(h, "id", "left").select("id", F.coalesce("h", F.lit(0)).alias("h"), "core").select("id", F.least("h", "core").alias("core"), (F.col("h") < F.col("core")).alias("open"))

    return until(start, step, "open", "core").select("id", "core")


def largest_core(g: Graph) -> DataFrame:
    return core_numbers(g).agg(F.coalesce(F.max("core"), F.lit(0)).alias("max_core"))


def independent_set(g: Graph) -> DataFrame:
    """(id, in_set): the lexicographically first maximal independent set. Each round an undecided vertex joins if no smaller undecided neighbour and no member is next to it."""
    start = g.vertices.select("id", F.lit(0).alias("f"), F.lit(True).alias("open"))

    def step(s: DataFrame, _: int) -> DataFrame:
        near = (
            s.filter("f < 2").join(g.edges, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id"))
            .agg(F.max(F.col("f") == 1).alias("member"), F.min(F.when(F.col("f") == 0, F.col("u"))).alias("low"))
        )
        f = F.when(F.col("f") != 0, F.col("f")).when(F.coalesce("member", F.lit(False)), 2).when(F.coalesce(F.col("low") < F.col("id"), F.lit(False)), 0).otherwise(1)
        return s.join(near, "id", "left").select("id", f.alias("f")).withColumn("open", F.col("f") == 0)

    return until(start, step, "open", "mis").select("id", (F.col("f") == 1).cast("int").alias("in_set"))
