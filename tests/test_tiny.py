"""Hand-checked values on a graph of ten vertices."""

import math
from itertools import combinations

import numpy as np
import pytest

from quartzgraph.graph import Graph
from quartzgraph.operators import access, intersect, iterative, partition, patterns, similarity, traversal
from quartzgraph.sources import files

TEXT = "# c\n% c\n1 2\n2 1\n1 3\n2 3\n2 4\n3 4\n4 5\n5 6\n6 4\n3 3\n7 8\n10 1 99\n"
FAR = 2**31 - 1


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("g") / "edges.txt"
    p.write_text(TEXT)
    return files.read_edge_list(spark, str(p))


def column(df, key, value):
    return [r[value] for r in sorted(df.collect(), key=lambda r: r[key])]


def edges(g, *cols):
    return sorted(tuple(r) for r in g.edges.select("u", "v", *cols).collect())


def of_pairs(spark, pairs, n=None):
    return Graph.from_pairs(spark.createDataFrame(pairs, "u long, v long"), "u", "v", n)


def test_edge_list(spark, g, tmp_path):
    assert g.n == 10 and len(edges(g)) == 20
    assert column(access.degrees(g), "id", "deg") == [3, 3, 3, 4, 2, 2, 1, 1, 0, 1]

    def read(text, compat=True):
        p = tmp_path / f"{abs(hash((text, compat)))}.txt"
        p.write_text(text)
        return files.read_edge_list(spark, str(p), compat)

    assert read(TEXT + "\n").n == 11 and read(TEXT + "0 0\n").n == 11
    assert read(TEXT + "\n", compat=False).n == 10
    assert (1, 0) in edges(read("1  2\n")) and (0, 3) in edges(read(" 3 4\n"))
    assert read("5 5\n1 2\n").n == 2
    with pytest.raises(Exception):
        files.read_edge_list(spark, str(tmp_path / "none"))


def test_lookups(spark, g):
    assert {r["nbr"] for r in access.two_hop(g, spark.createDataFrame([(0,)], "id long")).collect()} == {0, 1, 2, 3}
    assert [r["id"] for r in access.neighbours(g, 3).collect()] == [1, 2, 4, 5]
    asked = spark.createDataFrame([(0, 3, 0), (1, 3, 3), (2, 3, 4), (3, 8, 0)], "qid long, u long, k long")
    assert column(access.kth_neighbours(g, asked), "qid", "nbr") == [1, 5, None, None]
    pairs = spark.createDataFrame([(0, 0, 9), (1, 0, 8)], "qid long, u long, v long")
    assert column(access.has_edges(g, pairs), "qid", "found") == [True, False]
    assert [tuple(r) for r in sorted(access.edge_offsets(g).collect())][:2] == [(0, 0, 1), (1, 0, 2)]
    assert access.max_degree(g).first()[0] == 4


def test_intersections(spark, g):
    q = spark.createDataFrame([(0, [0, 1, 3]), (1, [3]), (2, []), (3, [8, 1]), (4, [3, 3])], "qid long, vertices array<long>")
    assert column(intersect.kway_counts(g, q), "qid", "c") == [1, 4, 0, 0, 4]
    pairs = spark.createDataFrame([(i * 10 + j, i, j) for i in range(10) for j in range(10)], "qid long, u long, v long")
    want = column(intersect.pair_counts(g, pairs), "qid", "c")
    assert want == column(intersect.pair_counts(g, pairs, "galloping"), "qid", "c")
    rng = np.random.default_rng(1)
    pid = spark.createDataFrame([(i, int(rng.integers(0, 3))) for i in range(10)], "id long, pid long")
    assert want == column(intersect.pair_counts(g.partitioned(pid), pairs), "qid", "c")
    assert [want[i * 11] for i in range(10)] == [3, 3, 3, 4, 2, 2, 1, 1, 0, 1]


def test_patterns(spark, g):
    assert patterns.triangle_count(g).first()[0] == 3 and patterns.triangle_count(g, "galloping").first()[0] == 18
    assert patterns.squares_ordered(g).first()[0] == 1 and patterns.squares_true(g).first()[0] == 1
    k4 = of_pairs(spark, list(combinations(range(4), 2)))
    assert (patterns.squares_ordered(k4).first()[0], patterns.squares_true(k4).first()[0]) == (1, 3)
    ring = of_pairs(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    assert (patterns.squares_ordered(ring).first()[0], patterns.squares_true(ring).first()[0]) == (0, 1)
    other = of_pairs(spark, [(0, 1), (1, 3), (3, 2), (2, 0)])
    assert (patterns.squares_ordered(other).first()[0], patterns.squares_true(other).first()[0]) == (1, 1)
    assert column(patterns.friend_triangles(g), "root", "t")[:2] == [0, 1]
    lists = spark.createDataFrame([(1, [0, 2, 3, 3, 1])], "root long, nodes array<long>")
    # 3 twice: the pairs (0,3) and (2,3) count twice, and (3,3) counts its shared neighbours once
    assert patterns.friend_triangles(g, lists).collect()[0]["t"] == sum(len({0: {1, 2, 9}, 2: {0, 1, 3}, 3: {1, 2, 4, 5}}[a] & {0: {1, 2, 9}, 2: {0, 1, 3}, 3: {1, 2, 4, 5}}[b] & {0, 2, 3}) for a, b in combinations([0, 2, 3, 3], 2))


def test_similarity(spark, g):
    j = similarity.jaccard(g, spark.range(4)).collect()
    assert [round(r["jac"], 4) for r in sorted(j)] == [1, 0.2, 0.2, 0.4, 0.2, 1, 0.5, 0.1667, 0.2, 0.5, 1, 0.1667, 0.4, 0.1667, 0.1667, 1]
    assert math.isnan(similarity.jaccard(g, spark.createDataFrame([(8,)], "id long")).collect()[0]["jac"])
    lcc = column(similarity.clustering(g), "id", "lcc")
    want = [1 / 3, 2 / 3, 2 / 3, 1 / 3, 1, 1, math.nan, math.nan, 0, math.nan]
    assert all(math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-12 for a, b in zip(lcc, want, strict=True))
    x = {(r["i"], r["j"]): r["x"] for r in similarity.simrank(g, 3).collect()}
    assert [round(x.get((0, j), 0), 4) for j in range(10)] == [1, 0.2978, 0.2978, 0.3917, 0.1698, 0.1698, 0, 0, 0, 0.1687]


def test_traversal(spark, g):
    assert column(traversal.all_parents(g), "id", "par") == [-1, 0, 0, 1, 3, 3, FAR, FAR, FAR, 0]
    assert column(traversal.bfs_levels(g), "id", "lev") == [0, 1, 1, 2, 3, 3, FAR, FAR, FAR, 1]
    w = g.with_weights()
    d = column(traversal.sssp(w), "id", "d")
    assert d == [0, 3, 2, 5, 8, 7, FAR // 2, FAR // 2, FAR // 2, 1]
    for u, v, x in edges(w, "w"):
        assert d[v] <= d[u] + x or d[u] == FAR // 2
    pid = g.vertices.selectExpr("id", "id % 2 pid")
    assert traversal.sssp_workload(w, pid).count() == 2


def test_vertex_programs(spark, g):
    pr = [round(x, 6) for x in column(iterative.pagerank(g), "id", "p")]
    assert pr == [0.322422, 0.32098, 0.32098, 0.419175, 0.218167, 0.218167, 0.277187, 0.277187, 0.015, 0.120417]
    pr = [round(x, 6) for x in column(iterative.pagerank(g, init="degree"), "id", "p")]
    assert pr == [0.166597, 0.158359, 0.158359, 0.208692, 0.1113, 0.1113, 0.103474, 0.103474, 0.015, 0.06449]
    assert column(iterative.max_labels(g, 1), "id", "l") == [9, 3, 3, 5, 5, 4, 7, 6, 0, 0]
    assert column(iterative.max_labels(g, 5), "id", "l") == [9, 9, 9, 9, 9, 9, 7, 6, 0, 9]
    assert column(iterative.core_numbers(g), "id", "core") == [2, 2, 2, 2, 2, 2, 1, 1, 0, 1]
    assert iterative.largest_core(of_pairs(spark, list(combinations(range(6), 2)))).first()[0] == 5
    assert [i for i, x in enumerate(column(iterative.independent_set(g), "id", "in_set")) if x] == [0, 3, 6, 8]


def test_partitions(spark, g):
    pid = column(partition.greedy_balanced(g, 2), "id", "pid")
    assert pid[:8] + pid[9:] == [1, 0, 0, 0, 1, 1, 0, 0, 1]
    table = spark.createDataFrame(list(enumerate(pid)), "id long, pid long")
    assert partition.evaluate(g, table, 2).first()["ratio"] == 1.0
    even = g.vertices.selectExpr("id", "id % 2 pid")
    assert tuple(partition.evaluate(g, even, 2).first()) == (2, 4, 1.0)
    dealt = column(partition.greedy_dealt(g, 3, seed=4), "id", "pid")
    assert len(dealt) == 10 and set(dealt) <= {0, 1, 2} and dealt == column(partition.greedy_dealt(g, 3, seed=4), "id", "pid")
    new = partition.partition_order(even)
    assert [r["new_id"] for r in sorted(new.collect())] == [0, 5, 1, 6, 2, 7, 3, 8, 4, 9]
    moved = partition.relabel(g, new)
    assert patterns.triangle_count(moved).first()[0] == 3
    with pytest.raises(ValueError):
        partition.relabel(g, g.vertices.selectExpr("id", "0L new_id"))


def test_files(spark, g, tmp_path):
    w = g.with_weights()
    files.write_csr(w, str(tmp_path))
    back = files.read_csr(spark, str(tmp_path), weighted=True)
    assert back.n == 10 and edges(back, "w") == edges(w, "w")
    assert np.fromfile(tmp_path / "csr_vlist.bin", "<u8").tolist() == [0, 3, 6, 9, 13, 15, 17, 18, 19, 19, 20]
    files.write_adjacency_text(w, str(tmp_path / "adj"))
    lines = (tmp_path / "adj").read_text().split()
    assert lines[:3] == ["WeightedAdjacencyGraph", "10", "20"] and len(lines) == 3 + 10 + 40 and lines[3:13] == ["0", "3", "6", "9", "13", "15", "17", "18", "19", "19"]
    files.write_edge_list(w, str(tmp_path / "el"))
    got = sorted(tuple(map(int, r["value"].split())) for r in spark.read.text(str(tmp_path / "el")).collect())
    assert got == edges(w, "w")
    adj = Graph.from_adjacency(g.adjacency())
    assert edges(adj) == edges(g)
    pid = partition.by_hash(g, 3)
    files.write_partition(pid, str(tmp_path / "pid"))
    assert sorted(files.read_partition(spark, str(tmp_path / "pid")).collect()) == sorted(pid.collect())
    with pytest.raises(Exception):
        files.read_csr(spark, str(tmp_path / "none")).edges.count()


def test_empty(spark):
    e = of_pairs(spark, [(3, 3), (None, 1)])
    assert e.n == 0 and patterns.triangle_count(e).first()[0] == 0 and iterative.core_numbers(e).count() == 0 and traversal.bfs_levels(e).count() == 0
