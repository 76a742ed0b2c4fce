"""Every graph query against its SQL."""

import pytest

from quartzgraph import queries

SF = "/root/testdata/sf0.001"
ORACLES = queries.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, SF), duck(SF).sql(ORACLES[name]))


def test_only_these_have_no_sql():
    assert set(queries.QUERIES) - set(ORACLES) == {"partition_greedy", "partition_greedy2"}


def test_greedy_against_plain_loops(spark):
    """The balanced partition of the whole ue graph, vertex by vertex."""
    g = queries.graph(spark, SF, "ue")
    near = {i: [] for i in range(g.n)}
    for r in g.edges.collect():
        near[r["u"]].append(r["v"])
    held = [[0] * g.n for _ in range(queries.PARTS)]
    want = {}
    for u in sorted(near, key=lambda i: (-len(near[i]), i)):
        fullest = [max((held[p][v] for v in near[u]), default=0) for p in range(queries.PARTS)]
        want[u] = fullest.index(min(fullest)) if near[u] else u % queries.PARTS
        for v in near[u]:
            held[want[u]][v] += 1
    assert {r["id"]: r["pid"] for r in queries.QUERIES["partition_greedy2"](spark, SF).collect()} == want


def test_ranges_of_an_array_file(spark, tmp_path):
    import numpy as np

    from quartzgraph.sources import files

    a = np.arange(100_003, dtype="<u8") * 7
    a.tofile(tmp_path / "a.bin")
    got = files.read_vector(spark, str(tmp_path / "a.bin"), "<u8", step=777).orderBy("i").toPandas()
    assert (got["i"].to_numpy() == np.arange(len(a))).all() and (got["value"].to_numpy() == a.astype(np.int64)).all()
    with pytest.raises(FileNotFoundError):
        files.read_vector(spark, str(tmp_path / "none.bin"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()[0]["t"] == 7852
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
