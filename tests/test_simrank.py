"""SimRank in blocks against plain matrices."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quartzgraph.graph import Graph
from quartzgraph.operators import similarity
from quartzgraph.plans import fixpoint


def plain(a, times, decay):
    p = a / np.maximum(a.sum(1), 1)[:, None]
    s = np.eye(len(a))
    for _ in range(times):
        s = p @ s @ p.T * decay
        np.fill_diagonal(s, 1)
    return s


@pytest.mark.parametrize("times, decay", [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.8)])
def test_blocks(spark, monkeypatch, times, decay):
    """Leaves, a hub, a lone edge and isolated vertices, in blocks that don't divide n; no table of all pairs is written between rounds."""

    def written(*_, **__):
        raise AssertionError("all pairs are written")

    monkeypatch.setattr(fixpoint, "written", written)
    rng = np.random.default_rng(5)
    pairs = [(0, i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(40, 130, (150, 2))] + [(3, 41), (135, 136)]
    g = Graph.from_pairs(spark.createDataFrame(pairs, "u long, v long"), "u", "v", 140)
    a = np.zeros((140, 140))
    for u, v in pairs:
        a[u, v] = a[v, u] = u != v
    want = plain(a, times, decay)
    rows = similarity.simrank(g, times, decay).collect()
    got = {(r["i"], r["j"]): r["x"] for r in rows}
    assert len(got) == len(rows) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
    assert all(abs(x - want[k]) < 1e-12 for k, x in got.items())


def test_less_work(monkeypatch):
    """Each pair's last sum is worked out once, and rows that few reach are added to their neighbours' alone: the edges aren't gone through three times a block."""
    n, ring = 640, np.arange(640)
    u, v = np.concatenate([ring, ring]), np.concatenate([(ring + 1) % n, (ring - 1) % n])
    order = np.lexsort((v, u))
    edges, a, summed = pd.DataFrame({"u": u[order], "v": v[order]}), np.zeros((n, n)), []
    a[u, v] = 1
    monkeypatch.setattr(similarity, "read_in_turn", lambda *_: [edges])
    counted = SimpleNamespace(**{k: getattr(np, k) for k in dir(np)})
    counted.dot = lambda x, y, out: (summed.append(len(x)), np.dot(x, y, out=out))
    monkeypatch.setattr(similarity, "np", counted)
    got = np.zeros((n, n))
    for b in similarity._Rows([], n, 2, 1.0, [np.full(n, 0.5)]).rows(iter([pa.record_batch({"id": np.arange(0, n, similarity.ROWS)})])):
        if "j" in b.schema.names:
            got[b["i"].to_numpy(), b["j"].to_numpy()] = b["x"].to_numpy()
            continue
        for i, first, x in zip(b["i"].to_pylist(), b["first"].to_pylist(), b["x"].to_pylist(), strict=True):
            got[i, first : first + len(x)] = x
    assert np.abs(got - plain(a, 2, 1.0)).max() < 1e-12
    assert sum(summed) <= 0.6 * len(edges) * (n // similarity.ROWS)


def test_rounded_half_up(spark):
    """Leaves of two hubs with 16 neighbours each, one of them shared: what is rounded to 0 stays a row."""
    g = Graph.from_pairs(spark.createDataFrame([(0, i) for i in range(2, 18)] + [(1, i) for i in range(17, 33)], "u long, v long"), "u", "v")
    exact = {(r["i"], r["j"]): r["x"] for r in similarity.simrank(g, 1).collect()}
    for digits in (0, 2, 6):
        got = {(r["i"], r["j"]): r["x"] for r in similarity.simrank(g, 1, digits=digits).collect()}
        assert got == {k: np.floor(x * 10**digits + 0.5) / 10**digits for k, x in exact.items()}
    assert exact[0, 1] == 1 / 256
