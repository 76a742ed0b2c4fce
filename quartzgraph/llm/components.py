"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: Edges up to which one task works out the components: of 16-byte nodes, some 50 MB.
FEW = 1 << 18


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        kind = batch.schema.field("a").type
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in list(root)], kind)], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, root), root the smallest node that can be reached.

    At most `few` edges are one task's work. Beyond, each round takes the smallest label among the neighbours (a partial aggregate, so a hub is no
    hot task) and then the label of that label, which halves the depth; the labels are written each
    round, so a lost executor costs one round. Nothing is collected but one count.
    """
    if edges.limit(few + 1).count() <= few:
        kind = dict(edges.dtypes)["a"]
        return written(edges.select("a", "b").repartition(1).mapInArrow(_in_one_task, f"node {kind}, root {kind}"), "cc-labels")
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = written(
            low.join(jump, "low").select("node", "was", F.least("low", "far").alias("root")), "cc-labels"
        )
        moved = after.filter(F.col("was") != F.col("root")).limit(1).count()
        remove(labels)
        labels = after.select("node", "root")
        if not moved:
            remove(both)
            return labels
