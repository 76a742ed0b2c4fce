"""Long graphs with leaves: one task's work and rounds over tables, each with leaves taken off or not, against plain loops."""

from heapq import heappop, heappush

import numpy as np
import pytest

from quartzgraph.graph import Graph
from quartzgraph.operators import iterative, traversal
from quartzgraph.plans import reduced

FAR = 2**31 - 1


@pytest.fixture(scope="module")
def pairs():
    """A ring of 8 with a tail of 12, a clique, trees of random parents, a star, a lone edge, isolated ids."""
    rng = np.random.default_rng(3)
    p = [(i, (i + 1) % 8) for i in range(8)] + [(i, i + 1) for i in range(7, 19)] + [(a, b) for a in range(20, 25) for b in range(20, a)] + [(20, 3)]
    p += [(i, int(rng.integers(0, i))) for i in range(25, 120)]
    return p + [(200, x) for x in range(201, 206)] + [(210, 211), (220, 221), (221, 222), (222, 223)]


def near(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return {a: sorted(b) for a, b in out.items()}


def queue(pairs, source):
    of, par, lev, todo = near(pairs), {source: -1}, {source: 0}, [source]
    for a in todo:
        for b in of.get(a, []):
            if b not in par:
                par[b], lev[b] = a, lev[a] + 1
                todo.append(b)
    return par, lev


def shortest(pairs, w, source):
    of, d, todo = near(pairs), {}, [(0, source)]
    while todo:
        c, a = heappop(todo)
        if a not in d:
            d[a] = c
            for b in of.get(a, []):
                heappush(todo, (c + w[a, b], b))
    return d


def peel(pairs):
    of, core, k = {a: set(b) for a, b in near(pairs).items()}, {}, 0
    while of:
        a = min(of, key=lambda x: len(of[x]))
        k = core[a] = max(k, len(of[a]))
        for b in of.pop(a):
            of[b].discard(a)
    return core


@pytest.fixture(params=["one task", "one task without leaves", "rounds", "rounds without leaves"])
def way(request, monkeypatch):
    """Small rests in one task or none; leaves are looked for in all graphs or none."""
    monkeypatch.setattr(reduced, "SMALL", {"one task": 1 << 20, "one task without leaves": 260, "rounds": 0, "rounds without leaves": 0}[request.param])
    monkeypatch.setattr(reduced, "SPARSE", 0 if request.param == "rounds" else 100)
    return request.param


def graph(spark, pairs):
    return Graph.from_pairs(spark.createDataFrame(pairs, "u long, v long"), "u", "v", 230)


def no_rounds(monkeypatch, where):
    def until(*_, **__):
        raise AssertionError("a round over tables")

    monkeypatch.setattr(where, "until", until)
    if where is traversal:
        monkeypatch.setattr(where, "in_order", until)


def got(df, value):
    return {r["id"]: r[value] for r in df.collect()}


@pytest.mark.parametrize("source", [0, 119, 200])
def test_parents(spark, pairs, way, monkeypatch, source):
    if way.startswith("one"):
        no_rounds(monkeypatch, traversal)
    par, lev = queue(pairs, source)
    g = graph(spark, pairs)
    assert got(traversal.all_parents(g, source), "par") == {i: par.get(i, FAR) for i in range(230)}
    assert got(traversal.bfs_parents(g, source), "lev") == lev


@pytest.mark.parametrize("source", [0, 119, 200])
def test_levels(spark, pairs, way, monkeypatch, source):
    if way.startswith("one"):
        no_rounds(monkeypatch, traversal)
    _, lev = queue(pairs, source)
    assert got(traversal.bfs_levels(graph(spark, pairs), source), "lev") == {i: lev.get(i, FAR) for i in range(230)}


@pytest.mark.parametrize("source", [0, 119, 200])
def test_distances(spark, pairs, way, monkeypatch, source):
    if way.startswith("one"):
        no_rounds(monkeypatch, traversal)
    g = graph(spark, pairs).with_weights()
    w = {(r["u"], r["v"]): r["w"] for r in g.edges.collect()}
    d = shortest(pairs, w, source)
    assert got(traversal.sssp(g, source), "d") == {i: d.get(i, FAR // 2) for i in range(230)}


def test_cores(spark, pairs, way, monkeypatch):
    if way.startswith("one"):
        no_rounds(monkeypatch, iterative)
    core = peel(pairs)
    assert got(iterative.core_numbers(graph(spark, pairs)), "core") == {i: core.get(i, 0) for i in range(230)}


def test_layers(spark, pairs, monkeypatch):
    """Trees come off, the ring and the clique stay; a lone edge's ends are each the other's neighbour."""
    monkeypatch.setattr(reduced, "SMALL", 0)
    monkeypatch.setattr(reduced, "SHARE", 1e-9)
    g = graph(spark, pairs)
    rest, layers = reduced.peeled(g.edges, g.n)
    core = {i for i, c in peel(pairs).items() if c > 1}
    assert {r["u"] for r in rest.collect()} <= core | {r["v"] for x in layers for r in x.collect()} and len(layers) > 1
    assert {(r["u"], r["v"]) for r in layers[0].collect()} >= {(210, 211), (211, 210), (220, 221)}
    assert traversal.UNREACHED_LEVEL == FAR
