"""Vertex partitions, their quality, and relabelling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mixed
from ..graph import Graph
from ..plans.ordinal import numbered


def by_hash(g: Graph, parts: int, seed: int = 0) -> DataFrame:
    """(id, pid) by an arithmetic hash of the id."""
    return g.vertices.select("id", F.pmod(mixed(F.col("id") + seed), F.lit(parts)).cast("long").alias("pid"))


def _on_one_task(g: Graph, place) -> DataFrame:
    """Sequential methods need all lists in turn: one task sees the adjacency by falling degree, then id. They hold parts * n counters, which bounds the graphs they suit."""
    lists = g.vertices.join(g.adjacency(), "id", "left").select("id", "nbrs", F.lit(0).alias("one"))
    n = g.n

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nbrs: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        for i, x in zip(pdf["id"], pdf["nbrs"], strict=True):
            if x is not None:
                nbrs[i] = np.asarray(x, np.int64)
        order = sorted(range(n), key=lambda i: (-len(nbrs[i]), i))
        return pd.DataFrame({"id": np.arange(n), "pid": place(nbrs, order)})

    return lists.groupBy("one").applyInPandas(run, "id long, pid long")


def greedy_balanced(g: Graph, parts: int) -> DataFrame:
    """(id, pid): by falling degree (ties by id), each vertex goes where the fullest of its neighbours' slices is least full, the lowest such partition; isolated ones by hash."""

    def place(nbrs: list[np.ndarray], order: list[int]) -> np.ndarray:
        count = np.zeros((parts, len(nbrs)), np.int32)
        pid = np.zeros(len(nbrs), np.int64)
        for i in order:
            if len(nbrs[i]):
                pid[i] = int(count[:, nbrs[i]].max(1).argmin())
                count[pid[i], nbrs[i]] += 1
            else:
                pid[i] = i % parts
        return pid

    return _on_one_task(g, place)


def greedy_dealt(g: Graph, parts: int, seed: int = 0) -> DataFrame:
    """(id, pid): by falling degree, a vertex's neighbours without a partition are shuffled and dealt out by what each partition lacks of an even share; what is left over goes at random."""

    def place(nbrs: list[np.ndarray], order: list[int]) -> np.ndarray:
        rng, pid = np.random.default_rng(seed), np.full(len(nbrs), -1, np.int64)
        for i in order:
            own = pid[nbrs[i]]
            free = nbrs[i][own < 0]
            if not len(free):
                continue
            rng.shuffle(free)
            quota = np.maximum(0, len(nbrs[i]) // parts - np.bincount(own[own >= 0], minlength=parts))
            share = quota * len(free) // quota.sum() if quota.sum() else np.zeros(parts, np.int64)
            deal = np.repeat(np.arange(parts), share)
            pid[free[: len(deal)]] = deal
            pid[free[len(deal) :]] = rng.integers(0, parts, len(free) - len(deal))
        pid[pid < 0] = rng.integers(0, parts, int((pid < 0).sum()))
        return pid

    return _on_one_task(g, place)


def evaluate(g: Graph, pid: DataFrame, parts: int) -> DataFrame:
    """(max_part_deg, max_deg, ratio): the largest slice of a list, the largest list, and parts * slice / list, 1.0 at best."""
    slices = g.edges.join(pid.withColumnRenamed("id", "v"), "v").groupBy("u", "pid").agg(F.count("*").alias("c"))
    by_vertex = slices.groupBy("u").agg(F.max("c").alias("s"), F.sum("c").alias("d"))
    return by_vertex.agg(F.max("s").alias("max_part_deg"), F.max("d").alias("max_deg")).withColumn("ratio", F.try_divide(parts * F.col("max_part_deg"), F.col("max_deg")))


def relabel(g: Graph, new_ids: DataFrame) -> Graph:
    """The graph with ids replaced by (id, new_id); a negative or missing new_id leaves the vertex out, and weights go along. Two ids with one target are an error."""
    keep = new_ids.filter("new_id >= 0")
    twice = keep.groupBy("new_id").agg(F.count("*").alias("c")).filter("c > 1").limit(1).collect()
    if twice:
        raise ValueError(f"new_id {twice[0]['new_id']} is given to more than one vertex")
    e = g.edges.join(keep.select(F.col("id").alias("u"), F.col("new_id").alias("nu")), "u").join(keep.select(F.col("id").alias("v"), F.col("new_id").alias("nv")), "v")
    rest = [c for c in g.edges.columns if c not in ("u", "v")]
    top = keep.agg(F.max("new_id")).first()[0]
    return Graph(e.select(F.col("nu").alias("u"), F.col("nv").alias("v"), *rest), top + 1 if top is not None else 0)


def partition_order(pid: DataFrame) -> DataFrame:
    """(id, new_id): ids become contiguous in each partition, in their old order."""
    return numbered(pid.select("id", "pid"), ["pid", "id"], "order", "new_id").select("id", "new_id")
