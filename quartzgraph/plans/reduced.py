"""Less work for the same answer: leaves come off in layers, and what is left is one task's work where it is small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, written

#: Edges, counted in both directions, that one task works on; larger rests loop over tables.
SMALL = 1 << 20
#: Leaves are looked for in graphs of at most so many edges a vertex, and taken off while they are a share of this of the vertices.
SPARSE, SHARE = 4, 0.1
#: Vertices that are broadcast, at most.
BROADCAST = 1 << 19


def is_small(edges: DataFrame) -> bool:
    return edges.count() <= SMALL


def peeled(edges: DataFrame, n: int, keep: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The rest of symmetric edges (u, v, ...), and layers (u, v, ...) of leaves with the one edge that each had when its layer came off.

    keep is never a leaf. Two vertices with one edge between them are both leaves, each the other's neighbour.
    """
    m, layers, own = edges.count(), [], None
    more = [c for c in edges.columns if c not in ("u", "v")]
    while SMALL < m <= SPARSE * n:
        ends = written(edges.groupBy("u").agg(F.count("*").alias("d"), *[F.min(c).alias(c) for c in ("v", *more)]), "ends")
        leaf = F.col("d") == 1 if keep is None else (F.col("d") == 1) & (F.col("u") != keep)
        inner = ends.filter(~leaf).select("u")
        total, n = ends.count(), inner.count()
        if total - n < SHARE * total:
            remove(ends)
            break
        inner = F.broadcast(inner) if n <= BROADCAST else inner
        rest = written(edges.join(inner, "u", "left_semi").join(inner.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v", *more), "rest")
        if own is not None:
            remove(own)
        layers.append(ends.filter(leaf).select("u", "v", *more))
        edges = own = rest
        m = rest.count()
    return edges, layers


def with_leaves(state: DataFrame, layers: list[DataFrame], of_leaf: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state (id, ...) with rows of the leaves whose neighbours have one, last layer first. of_leaf: rows of state's columns from a layer joined with its neighbours' rows."""
    for k, layer in enumerate(reversed(layers)):
        state = state.union(of_leaf(layer.join(state, F.col("v") == F.col("id"))).select(state.columns))
        if k < len(layers) - 1:
            state = written(state, "leaves")
    return state


def in_one_task(df: DataFrame, work: Callable[..., tuple], schema: str) -> DataFrame:
    """What work makes of the columns of df, as arrays, in one task: for tables that are known to be small. An empty df may give no rows."""
    names, out = df.columns, [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            rows = pa.Table.from_batches(got)
            yield from pa.table(dict(zip(out, work(*[rows[c].to_numpy() for c in names]), strict=True))).to_batches(1 << 16)

    return written(df.repartition(1).mapInArrow(run, schema), "one-task")


class Lists:
    """Neighbour lists of edges, ascending, over the places of the ids in their order."""

    def __init__(self, u: np.ndarray, v: np.ndarray, *more: np.ndarray) -> None:
        self.ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        order = np.lexsort((b, a))
        self.to, self.more = b[order], [x[order] for x in more]
        self.count = np.bincount(a, minlength=len(self.ids))
        self.first = np.cumsum(self.count) - self.count

    def place(self, id: int) -> np.ndarray:
        """The id's place, or nothing if it has no edge."""
        return np.flatnonzero(self.ids == id)

    def edges_of(self, rows: np.ndarray) -> np.ndarray:
        """Places of the rows' edges, list after list."""
        n = self.count[rows]
        return np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def distances(source: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple:
    """ids that source reaches, and the least sums of w."""
    g, far = Lists(u, v, w), np.iinfo(np.int64).max
    d = np.full(len(g.ids), far)
    front = g.place(source)
    d[front] = 0
    while len(front):
        e = g.edges_of(front)
        to, c = g.to[e], np.repeat(d[front], g.count[front]) + g.more[0][e]
        better = c < d[to]
        np.minimum.at(d, to[better], c[better])
        front = np.unique(to[better])
    return g.ids[d < far], d[d < far]


def parents(source: int, u: np.ndarray, v: np.ndarray) -> tuple:
    """ids that source reaches, their levels, and the neighbour that a queue gives out first; -1 for the source."""
    g = Lists(u, v)
    lev, par = np.full(len(g.ids), -1), np.full(len(g.ids), -1)
    front, k = g.place(source), 0
    lev[front] = 0
    while len(front):
        to, by = g.to[g.edges_of(front)], np.repeat(front, g.count[front])
        to, by = to[lev[to] < 0], by[lev[to] < 0]
        _, one = np.unique(to, return_index=True)
        one.sort()
        front, k = to[one], k + 1
        lev[front], par[front] = k, g.ids[by[one]]
    return g.ids[lev >= 0], lev[lev >= 0], par[lev >= 0]


def cores(u: np.ndarray, v: np.ndarray) -> tuple:
    """ids and core numbers, by peeling."""
    g, k = Lists(u, v), 0
    d, core, left = g.count.copy(), np.full(len(g.ids), -1), np.arange(len(g.ids))
    while len(left):
        k = max(k, int(d[left].min()))
        out = left[d[left] <= k]
        while len(out):
            core[out] = k
            to = g.to[g.edges_of(out)]
            to, n = np.unique(to[core[to] < 0], return_counts=True)
            d[to] -= n
            out = to[d[to] <= k]
        left = left[core[left] < 0]
    return g.ids, core
