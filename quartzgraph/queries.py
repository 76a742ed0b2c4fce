"""One query for each operator, over graphs that the tables hold, and the SQL that gives the same rows.

Graphs: ps (lineitem: part, supplier), oc (orders: order, customer), ue (events: user, event folded onto the users), ev (events: user, event, both
times three: most vertices are isolated, many have one neighbour, and not all can be reached).
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import query_pairs
from .graph import Graph
from .operators import access, intersect, iterative, partition, patterns, similarity, traversal
from .plans.scratch import scratch_dir
from .sources import files

PARTS = 4


def graph(spark: SparkSession, sf_dir: str, name: str = "ps") -> Graph:
    t = {"ps": ("lineitem", "l_partkey", "l_suppkey"), "oc": ("orders", "o_orderkey", "o_custkey"), "ue": ("events", "user_id", "event_id"), "ev": ("events", "user_id", "event_id")}[name]
    df = spark.read.parquet(f"{sf_dir}/{t[0]}.parquet")
    if name == "ue":
        users = df.agg(F.max("user_id")).first()[0] + 1
        df = df.select("user_id", (F.col("event_id") % users).alias("event_id"))
    if name == "ev":
        df = df.select((F.col("user_id") * 3).alias("user_id"), (F.col("event_id") * 3).alias("event_id"))
    return Graph.from_pairs(df, t[1], t[2])


def _pid(g: Graph) -> DataFrame:
    return g.vertices.select("id", (F.col("id") % PARTS).alias("pid"))


def _pairs(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("qid"), F.col("id").alias("u"), ((F.col("id") * 37 + 11) % g.n).alias("v"))


def _groups(g: Graph) -> DataFrame:
    q = F.col("id")
    return g.vertices.select(q.alias("qid"), q.alias("u"), F.array(q, (q + 7) % g.n, (q * 3) % g.n).alias("vertices"))


def _round(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def _of(name: str):
    """A query over one of the graphs."""

    def deco(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(graph(spark, sf_dir, name))

        query.__name__, query.graph = f.__name__, name
        QUERIES[f.__name__] = query
        return query

    return deco


QUERIES: dict = {}

# --- sources and lookups


@_of("ps")
def edge_load(g):
    return g.edges.select("u", "v")


@_of("oc")
def degrees(g):
    return access.degrees(g)


@_of("ps")
def max_degree(g):
    return access.max_degree(g)


@_of("oc")
def graph_counts(g):
    return access.counts(g)


@_of("ps")
def has_edge_batch(g):
    return access.has_edges(g, _pairs(g))


@_of("ps")
def kth_neighbor(g):
    return access.kth_neighbours(g, g.vertices.select(F.col("id").alias("qid"), F.col("id").alias("u"), (F.col("id") % 40).alias("k")))


@_of("ps")
def edge_at_offset(g):
    return access.edge_offsets(g)


@_of("oc")
def vertex_offsets(g):
    return access.vertex_offsets(g)


@_of("oc")
def two_hop(g):
    return access.two_hop(g)


@_of("ps")
def neighbors_partitioned(g):
    return g.partitioned(_pid(g)).edges.select("u", "v", "pid")


# --- intersections


@_of("ps")
def cn_pairs(g):
    return intersect.pair_counts(g, _pairs(g))


@_of("ps")
def cn_pairs_galloping(g):
    return intersect.pair_counts(g, _pairs(g), "galloping")


@_of("ps")
def cn_pairs_partitioned(g):
    return intersect.pair_counts(g.partitioned(_pid(g)), _pairs(g))


@_of("ps")
def cn_bounded(g):
    return intersect.pair_counts(g, _pairs(g).withColumn("t", F.col("v")), below="t")


@_of("ps")
def cn_kway(g):
    return intersect.kway_counts(g, _groups(g))


@_of("ps")
def common_list(g):
    return intersect.pair_lists(g, _pairs(g))


@_of("ps")
def list_hits(g):
    return intersect.list_hits(g, _groups(g).withColumnRenamed("vertices", "nodes"))


@_of("ps")
def list_counts(g):
    return intersect.list_counts(g, _groups(g).withColumnRenamed("vertices", "nodes"))


# --- patterns and similarity


@_of("ps")
def tri_merge(g):
    return patterns.triangle_count(g)


@_of("ps")
def tri_galloping(g):
    return patterns.triangle_count(g, "galloping")


@_of("ps")
def tri_by_partition(g):
    return patterns.triangles_by_partition(g, _pid(g))


@_of("ue")
def squares_ordered(g):
    return patterns.squares_ordered(g)


@_of("ue")
def squares_true(g):
    return patterns.squares_true(g)


@_of("ue")
def friend_triangle(g):
    return patterns.friend_triangles(g)


@_of("ps")
def jaccard(g):
    return similarity.jaccard(g, g.vertices.filter("id % 50 = 0"), g.vertices, 6)


@_of("ps")
def jaccard_partitioned(g):
    return similarity.jaccard(g.partitioned(_pid(g)), g.vertices.filter("id % 50 = 0"), g.vertices, 6)


@_of("ps")
def lcc_partitioned(g):
    return _round(similarity.clustering(g.partitioned(_pid(g))), "lcc")


@_of("ps")
def lcc(g):
    return _round(similarity.clustering(g), "lcc")


@_of("ue")
def simrank(g):
    return similarity.simrank(g, 2, digits=6)


# --- traversal


@_of("ps")
def bfs_level(g):
    return traversal.bfs_levels(g)


@_of("ps")
def bfs_parent(g):
    return traversal.bfs_parents(g)


@_of("ps")
def sssp(g):
    return traversal.sssp(g.with_weights())


@_of("ps")
def sssp_workload(g):
    return traversal.sssp_workload(g.with_weights(), _pid(g))


@_of("ps")
def sssp_workload_balance(g):
    return _round(traversal.workload_balance(traversal.sssp_workload(g.with_weights(), _pid(g))), "ratio")


# --- vertex programs


@_of("ps")
def pagerank(g):
    return _round(iterative.pagerank(g), "p")


@_of("ps")
def pagerank_degree_init(g):
    return _round(iterative.pagerank(g, init="degree"), "p")


@_of("ps")
def pagerank_residual(g):
    return _round(iterative.pagerank_residual(g), "p").select("id", "p")


@_of("ps")
def cdlp(g):
    return iterative.max_labels(g)


@_of("ue")
def kcore(g):
    return iterative.core_numbers(g)


@_of("ps")
def mis(g):
    return iterative.independent_set(g)


# --- the same over a graph with isolated, lonely and unreached vertices


@_of("ev")
def csr_offsets(g):
    return access.csr_offsets(g)


@_of("ev")
def bfs_level_gaps(g):
    return traversal.bfs_levels(g)


@_of("ev")
def bfs_parent_gaps(g):
    return traversal.all_parents(g)


@_of("ev")
def sssp_gaps(g):
    return traversal.sssp(g.with_weights())


@_of("ev")
def lcc_gaps(g):
    return _round(similarity.clustering(g), "lcc")


@_of("ev")
def pagerank_gaps(g):
    return _round(iterative.pagerank(g), "p")


@_of("ev")
def cdlp_gaps(g):
    return iterative.max_labels(g)


@_of("ev")
def kcore_gaps(g):
    return iterative.core_numbers(g)


@_of("ev")
def mis_gaps(g):
    return iterative.independent_set(g)


# --- files: what is written is read again


def _folder(spark: SparkSession) -> str:
    at = f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(at)
    store.create_dir(root, recursive=True)
    return at


def _mounted(at: str) -> str:
    """Raw arrays and adjacency texts have one writer, the driver, which needs a mounted folder."""
    return fs.FileSystem.from_uri(at)[1]


@_of("ev")
def file_edge_list(g):
    at = _folder(g.spark)
    files.write_edge_list(g, f"{at}/edges")
    return files.read_edge_list(g.spark, f"{at}/edges", compat=False).edges


@_of("ev")
def file_edge_list_compat(g):
    at = _folder(g.spark)
    files.write_edge_list(g.with_weights(), f"{at}/edges")
    return files.read_edge_list(g.spark, f"{at}/edges").edges


@_of("ev")
def file_csr(g):
    at = _mounted(_folder(g.spark))
    files.write_csr(g.with_weights(), at)
    return files.read_csr(g.spark, at, weighted=True).edges


@_of("ev")
def file_adjacency(g):
    at = _folder(g.spark)
    files.write_adjacency_text(g.with_weights(), f"{_mounted(at)}/graph.adj")
    return g.spark.read.text(f"{at}/graph.adj").groupBy("value").count()


@_of("ev")
def file_vector(g):
    at = f"{_mounted(_folder(g.spark))}/degrees.bin"
    files.write_vector(access.degrees(g).orderBy("id"), "deg", at)
    return files.read_vector(g.spark, at, step=1000).select(F.col("i").alias("id"), F.col("value").alias("deg"))


@_of("ps")
def file_partition(g):
    at = _folder(g.spark)
    files.write_partition(_pid(g), f"{at}/pid")
    return files.read_partition(g.spark, f"{at}/pid")


@_of("ev")
def adjacency_lists(g):
    return Graph.from_adjacency(g.adjacency(), "id", "nbrs").edges


# --- partitions


@_of("ps")
def partition_hash(g):
    return partition.by_hash(g, PARTS)


@_of("ue")
def partition_greedy(g):
    return partition.greedy_dealt(g, PARTS)


@_of("ue")
def partition_greedy2(g):
    return partition.greedy_balanced(g, PARTS)


@_of("ps")
def partition_eval(g):
    return _round(partition.evaluate(g, _pid(g), PARTS), "ratio")


@_of("ps")
def reorder(g):
    ids = g.vertices.select("id", F.when(F.col("id") % 7 == 3, -1).otherwise(g.n - 1 - F.col("id")).alias("new_id"))
    return partition.relabel(g.with_weights(), ids).edges


@_of("ps")
def partition_reorder(g):
    return partition.partition_order(_pid(g))


@_of("ps")
def weights(g):
    return g.with_weights().edges


@_of("ps")
def query_gen(g):
    return query_pairs(g.spark, g.n, 2 * g.n)


# --- the same in SQL

_RAW = {
    "ps": "select l_partkey u, l_suppkey v from lineitem",
    "oc": "select o_orderkey u, o_custkey v from orders",
    "ue": "select user_id u, event_id % (select max(user_id) + 1 from events) v from events",
    "ev": "select user_id * 3 u, event_id * 3 v from events",
}
_PRE = """raw as ({raw}),
e as materialized (select distinct u, v from (select u, v from raw union all select v, u from raw) where u <> v),
n as (select max(u) + 1 n from e), vx as (select range id from range((select n from n))),
dg as (select u, count(*) d from e group by u)"""
_CN = ", cn as (select a.u, b.u v, count(*) c from e a join e b on a.v = b.v group by a.u, b.u)"
_Q = ", q as (select id qid, id u, (id * 37 + 11) % (select n from n) v from vx)"
_HITS = _Q + ", hit as (select qid, q.v t, a.v x from q join e a on a.u = q.u join e b on b.u = q.v and b.v = a.v)"
_G = ", g as (select id qid, id u, [id, (id + 7) % (select n from n), (id * 3) % (select n from n)] q from vx)"
_LIST = _G + ", h as (select x.qid, e.v x from (select qid, u, unnest(list_distinct(q)) s from g) x join e on e.u = x.u and e.v = x.s)"
_TRI = ", tri as (select a.u a, a.v b, b.v c from e a join e b on a.v = b.u join e c on c.u = a.u and c.v = b.v where a.u > a.v and b.u > b.v)"
_WEDGE = ", wd as (select a.u p, b.u q, a.v m from e a join e b on a.v = b.v where a.u > b.u)"
_PIDS = ", pid as (select id, id % 4 pid from vx)"
_W = ", w as (select u, v, 1 + (least(u, v) * 31 + greatest(u, v) * 17) % floor(log2((select n from n)))::bigint w from e)"
_PR = """pr(it, id, p) as (select 0, id, {init} from vx left join dg on dg.u = vx.id union all select * from (with cur as (select * from pr where it < 10)
  select (select max(it) from cur) + 1, vx.id, 0.15 / (select n from n) + 0.85 * coalesce(s, 0) from vx left join
    (select e.v, sum(cur.p / dg.d) s from cur join e on e.u = cur.id join dg on dg.u = cur.id group by e.v) x on x.v = vx.id where exists (select 1 from cur)))"""


def _sql(name: str, extra: str, body: str, recursive: str = "") -> str:
    pre = _PRE.format(raw=_RAW[QUERIES[name].graph])
    return f"with {'recursive ' if recursive else ''}{pre}{extra}{', ' + recursive if recursive else ''}\n{body}"


_MIX = "(((({x}) % 2147483648 * 2654435761) % 4294967296) % 65536 * 65536 + (({x}) % 2147483648 * 2654435761) % 4294967296 // 65536)"


def oracles() -> dict[str, str]:
    one = {
        "edge_load": ("", "select u, v from e"),
        "degrees": ("", "select id, coalesce(d, 0) deg from vx left join dg on dg.u = vx.id"),
        "max_degree": ("", "select max(d) max_deg from dg"),
        "graph_counts": ("", "select count(*) edges, (select n from n) vertices, 1::bigint partitions, ((select n from n) + 1) * 4 + count(*) * 4 size_bytes from e"),
        "has_edge_batch": (_Q, "select qid, e.u is not null found from q left join e on e.u = q.u and e.v = q.v"),
        "kth_neighbor": ("", "select id qid, l.v nbr from vx left join (select u, v, row_number() over (partition by u order by v) - 1 k from e) l on l.u = vx.id and l.k = vx.id % 40"),
        "edge_at_offset": ("", "select row_number() over (order by u, v) - 1 off, u, v from e"),
        "vertex_offsets": ("", "select u id, (sum(d) over (order by u) - d)::bigint first, (sum(d) over (order by u))::bigint last from dg"),
        "two_hop": ("", "select distinct a.u id, b.v nbr from e a join e b on a.v = b.u"),
        "neighbors_partitioned": (_PIDS, "select u, v, pid from e join pid on pid.id = e.v"),
        "cn_bounded": (_HITS, "select q.qid, count(x) c from q left join hit on hit.qid = q.qid and x < t group by q.qid"),
        "cn_kway": (
            _G + ", x as (select distinct qid, unnest(q) s from g), k as (select qid, count(*) k from x group by qid), "
            "h as (select x.qid, e.v from x join e on e.u = x.s join k using (qid) group by x.qid, e.v, k.k having count(*) = k.k)",
            "select g.qid, count(h.v) c from g left join h using (qid) group by g.qid",
        ),
        "common_list": (_HITS, "select qid, x from hit"),
        "list_hits": (_LIST, "select qid, x from h"),
        "list_counts": (_LIST, "select g.qid, count(x) c from g left join h using (qid) group by g.qid"),
        "tri_merge": (_TRI, "select count(*) t from tri"),
        "tri_galloping": (_TRI, "select 6 * count(*) t from tri"),
        "tri_by_partition": (_TRI, "select c % 4 pid, count(*) t from tri group by 1"),
        "squares_ordered": (_WEDGE, "select sum(x * y)::bigint s from (select count(*) filter (m > p) x, count(*) filter (m < q) y from wd group by p, q)"),
        "squares_true": (_WEDGE, "select (sum(c * (c - 1) // 2) // 2)::bigint s from (select count(*) c from wd group by p, q)"),
        "friend_triangle": (_CN, "select id root, coalesce(t, 0)::bigint t from vx left join (select e.u, sum(c * (c - 1) // 2) t from e join cn on cn.u = e.u and cn.v = e.v group by e.u) x on x.u = vx.id"),
        "jaccard": (
            ", q as (select id from vx where id % 50 = 0), f as (select * from e where u % 50 = 0), c as (select a.u i, b.u j, count(*) c from f a join e b on a.v = b.v group by 1, 2)",
            "select a.id i, b.id j, round(case when da.d is null and db.d is null then 'NaN'::double else coalesce(c, 0) / (coalesce(da.d, 0) + coalesce(db.d, 0) - coalesce(c, 0))::double end, 6) jac "
            "from q a cross join vx b left join dg da on da.u = a.id left join dg db on db.u = b.id left join c on c.i = a.id and c.j = b.id",
        ),
        "lcc": (
            _TRI + ", t as (select v, count(*) t from (select a v from tri union all select b from tri union all select c from tri) group by v)",
            "select id, round(case when d is null then 0 when d = 1 then 'NaN'::double else 2.0 * coalesce(t, 0) / (d * (d - 1.0)) end, 6) lcc from vx left join dg on dg.u = vx.id left join t on t.v = vx.id",
        ),
        "partition_hash": ("", f"select id, {_MIX.format(x='id')} % 4 pid from vx"),
        "partition_eval": (
            _PIDS + ", sl as (select u, pid, count(*) c from e join pid on pid.id = e.v group by 1, 2)",
            "select max(c) max_part_deg, (select max(d) from dg) max_deg, round(4 * max(c) / (select max(d) from dg), 6) ratio from sl",
        ),
        "reorder": (_W, "select (select n from n) - 1 - u u, (select n from n) - 1 - v v, w from w where u % 7 <> 3 and v % 7 <> 3"),
        "partition_reorder": ("", "select id, row_number() over (order by id % 4, id) - 1 new_id from vx"),
        "weights": (_W, "select u, v, w from w"),
        "query_gen": ("", f"select range qid, {_MIX.format(x='range * 2 + 1000003')} % (select n from n) u, {_MIX.format(x='range * 2 + 1000004')} % (select n from n) v from range((select 2 * n from n))"),
    }
    for name in ("file_edge_list", "file_edge_list_compat", "adjacency_lists"):
        one[name] = one["edge_load"]
    one["file_csr"], one["file_vector"], one["file_partition"] = one["weights"], one["degrees"], (_PIDS, "select id, pid from pid")
    one["file_adjacency"] = (
        _W,
        "select value, count(*) count from (select 'WeightedAdjacencyGraph' as value union all select (select n from n)::varchar union all select count(*)::varchar from e "
        "union all select coalesce(sum(d) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint::varchar from vx left join dg on dg.u = id "
        "union all select v::varchar from e union all select w::varchar from w) group by value",
    )
    one["jaccard_partitioned"], one["lcc_partitioned"], one["lcc_gaps"] = one["jaccard"], one["lcc"], one["lcc"]
    one["csr_offsets"] = ("", "select id, coalesce(sum(d) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint off from (select range id from range((select n from n) + 1)) left join dg on dg.u = id")
    for name in ("cn_pairs", "cn_pairs_galloping", "cn_pairs_partitioned"):
        one[name] = (_HITS, "select q.qid, count(x) c from q left join hit using (qid) group by q.qid")
    out = {name: _sql(name, *x) for name, x in one.items()}
    loops = {
        "simrank": (
            "",
            "s(it, i, j, x) as (select 0, id, id, 1.0::double from vx union all select * from (with cur as (select * from s where it < 2), "
            "half as (select a.u i, cur.j, sum(cur.x / da.d) x from cur join e a on a.v = cur.i join dg da on da.u = a.u group by 1, 2), "
            "nx as (select half.i, b.u j, sum(half.x / db.d) x from half join e b on b.v = half.j join dg db on db.u = b.u group by 1, 2) "
            "select (select max(it) from cur) + 1, i, j, x from nx where i <> j union all select (select max(it) from cur) + 1, id, id, 1.0 from vx where exists (select 1 from cur)))",
            "select i, j, round(x, 6) x from s where it = 2",
        ),
        "bfs_level": (
            "",
            "b(id, lev) using key (id) as (select 0::bigint, 0::bigint union select e.v, min(b.lev) + 1 from b join e on b.id = e.u where not exists (select 1 from recurring.b r where r.id = e.v) group by e.v)",
            "select vx.id, coalesce(lev, 2147483647)::bigint lev from vx left join b on b.id = vx.id",
        ),
        "bfs_parent": (
            "",
            "b(lev, id, par, pos) as (select 0::bigint, 0::bigint, -1::bigint, 0::bigint union all select * from (with cur as (select * from b), "
            "c as (select e.v id, arg_min(cur.id, cur.pos) par, min(cur.pos) pp from cur join e on e.u = cur.id where cur.lev = (select max(lev) from cur) and e.v not in (select id from cur) group by e.v) "
            "select lev, id, par, pos from cur where exists (select 1 from c) union all "
            "select (select max(lev) + 1 from cur), id, par, row_number() over (order by pp, id) + (select max(pos) from cur) from c))",
            "select distinct id, lev, par from b",
        ),
        "sssp": (
            _W,
            "s(id, d) using key (id) as (select 0::bigint, 0::bigint union select w.v, min(s.d + w.w) from s join w on w.u = s.id left join recurring.s r on r.id = w.v where r.id is null or s.d + w.w < r.d group by w.v)",
            "select vx.id, coalesce(d, 1073741823)::bigint d from vx left join s using (id)",
        ),
        "pagerank": ("", _PR.format(init="1.0::double"), "select id, round(p, 6) p from pr where it = 10"),
        "pagerank_degree_init": ("", _PR.format(init="coalesce(d, 0) / (0.85 * (select n from n))"), "select id, round(p, 6) p from pr where it = 10"),
        "pagerank_residual": (
            "",
            "pr(it, id, p, act) as (select 0, id, 1.0::double / (select n from n), true from vx union all select * from (with cur as (select * from pr), "
            "s as (select e.v id, sum(cur.p / dg.d) s from cur join e on e.u = cur.id join dg on dg.u = cur.id group by e.v), "
            "nx as (select cur.it, cur.id, cur.p, cur.act, 0.15 / (select n from n) + 0.85 * coalesce(s.s, 0) np from cur left join s using (id)) "
            "select it + 1, id, case when act then np else p end, act and abs(np - p) >= 1e-6 from nx where it < 20))",
            "select id, round(p, 6) p from pr where it = 20",
        ),
        "cdlp": (
            "",
            "c(it, id, l) as (select 0, id, id from vx union all select any_value(x.it), x.id, max(x.l) from (select c.it + 1 it, e.v id, c.l from c join e on e.u = c.id where c.it < 5) x group by x.id)",
            "select vx.id, coalesce(l, 0) l from vx left join (from c where it = 5) using (id)",
        ),
        "kcore": (
            "",
            "k(it, k, id, core, alive) as (select 0, 1, id, 0::bigint, true from vx union all select * from (with cur as (select * from k), "
            "lv as (select c.id, count(x.id) d from cur c left join e on e.u = c.id left join cur x on x.id = e.v and x.alive where c.alive group by c.id), "
            "rm as (select id from lv, (select any_value(k) kk from cur) where d < kk) "
            "select cur.it + 1, case when exists (select 1 from rm) then cur.k else cur.k + 1 end, cur.id, case when rm.id is not null then cur.k - 1 else cur.core end, cur.alive and rm.id is null "
            "from cur left join rm on rm.id = cur.id where (select bool_or(alive) from cur)))",
            "select id, core from k where it = (select max(it) from k)",
        ),
        "mis": (
            "",
            "m(it, id, f) as (select 0, id, 0 from vx union all select * from (with cur as (select * from m), "
            "nb as (select c.id, bool_or(x.f = 1) hasin, bool_or(x.f = 0 and x.id < c.id) blocked from cur c join e on e.u = c.id join cur x on x.id = e.v where c.f = 0 group by c.id) "
            "select cur.it + 1, cur.id, case when cur.f <> 0 then cur.f when nb.hasin then 2 when coalesce(nb.blocked, false) then 0 else 1 end "
            "from cur left join nb on nb.id = cur.id where (select bool_or(f = 0) from cur)))",
            "select id, (f = 1)::int in_set from m where it = (select max(it) from m)",
        ),
    }
    work = (
        _W + _PIDS,
        "r(it, id, d, open) as (select 0, id, case when id = 0 then 0 else 1073741823 end::bigint, id = 0 from vx union all select * from (with cur as (select * from r), "
        "sent as (select w.v id, min(cur.d + w.w) c from cur join w on w.u = cur.id where cur.open group by w.v) "
        "select cur.it + 1, cur.id, least(cur.d, coalesce(c, cur.d)), coalesce(c < cur.d, false) from cur left join sent using (id) where (select bool_or(open) from cur))), "
        "work as (select p.pid, coalesce(n, 0)::bigint relaxations from (select distinct pid from pid) p left join (select pid, count(*) n from r join w on w.u = r.id join pid on pid.id = w.v where open group by pid) x using (pid))",
    )
    loops["sssp_workload"] = (*work, "select pid, relaxations from work")
    loops["sssp_workload_balance"] = (*work, "select max(relaxations) max_work, min(relaxations) min_work, round(max(relaxations) / min(relaxations), 6) ratio from work")
    for name in ("bfs_level", "sssp", "pagerank", "cdlp", "kcore", "mis"):
        loops[f"{name}_gaps"] = loops[name]
    loops["bfs_parent_gaps"] = (*loops["bfs_parent"][:2], "select vx.id, coalesce(par, 2147483647)::bigint par from vx left join (select distinct id, par from b) using (id)")
    out |= {name: _sql(name, extra, body, rec) for name, (extra, rec, body) in loops.items()}
    return out
