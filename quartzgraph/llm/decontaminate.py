"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

A window is a run of WINDOW words of an item (all of them in a shorter one). Its set is that of its
w-shingles (SHINGLE words). A document holds a window only if it holds all of them, so the necessary
prefix of a window, in the order of rarity over all documents, is its one rarest shingle. Steps:

1. one pass over the documents keeps the places of those shingles that occur in the benchmark at all;
2. their document counts give the order of rarity, and so each window's prefix shingle;
3. the places join the prefixes: a candidate is a document and the place where the window would begin
   (positional bound), if it ends inside the document (length bound);
4. each candidate is compared word by word, and the spans of the equal ones are united.

Both joins with benchmark tables are plain ones: Spark broadcasts a side only below its own size
threshold, and splits skewed shuffles otherwise. Documents are keyed by doc_id and a hash of the text,
so repeated rows are worked on once and each of them gets its result.

Defined cases: null text has no words and isn't contaminated; null or wordless items have no
windows; equal windows of several items count for each; item_ids are told apart as strings, null as the empty one; extra
columns are ignored. doc_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, remove, table, written

WINDOW, SHINGLE = 10, 3
#: Characters that stand between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(c: Column) -> Column:
    """Words of A-Z lower-cased text."""
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), BETWEEN, -1), lambda x: x != "")


def bound(c: Column, use) -> Column:
    """use(c), with c worked out once however often use refers to it."""
    return F.transform(F.array(c), use)[0]


def _shingles(w: Column, k: int) -> Column:
    """Hash of the k words from each place on, for each place that has them."""
    return F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<long>"))


def _all_shingles(w: Column, sizes: list[int]) -> Column:
    """(place, hash) for each of the sizes."""
    one = [F.transform(_shingles(w, k), lambda h, i: F.struct(i.alias("at"), h.alias("g"))) for k in sizes]
    return F.concat(*one) if len(one) > 1 else one[0]


def benchmark_windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows and (wid, item_id) of who has them; wid: the words, joined."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        return F.when(n <= WINDOW, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - WINDOW + 1)), lambda i: F.slice(w, i, WINDOW)))

    each = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.explode(bound(words(F.col(text)), cut)).alias("words")).filter(F.size("words") > 0)
    owners = each.select(F.array_join("words", " ").alias("wid"), "item_id").distinct()
    return each.select(F.array_join("words", " ").alias("wid"), "words").dropDuplicates(["wid"]), owners


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and th (xxhash64 of the text) of every row of docs."""
    windows, owners = benchmark_windows(items, item_text, item_id)
    windows, owners = written(windows, "bench-windows"), written(owners, "bench-owners")
    least = windows.agg(F.min(F.size("words")).alias("k")).first()["k"]
    sizes = [k for k in range(SHINGLE, 0, -1) if k == SHINGLE or (least is not None and k >= least)]

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    # 1. the benchmark's shingles, and their places in the documents; the words column isn't carried along
    own = F.when(F.size("words") >= SHINGLE, _all_shingles(F.col("words"), [SHINGLE]))
    for k in range(SHINGLE - 1, 0, -1):
        own = own.when(F.size("words") == k, _all_shingles(F.col("words"), [k]))
    mine = written(windows.select("wid", F.size("words").alias("len"), F.explode(own).alias("s")).select("wid", "len", F.col("s.at").alias("off"), F.col("s.g").alias("g")), "bench-shingles")
    tokens = base.select("doc_id", "th", bound(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), _all_shingles(w, sizes).alias("gs"))).alias("x"))
    places = tokens.select("doc_id", "th", F.col("x.n_words").alias("n_words"), F.explode("x.gs").alias("s")).select("doc_id", "th", "n_words", F.col("s.at").alias("at"), F.col("s.g").alias("g"))
    found = written(places.join(mine.select("g").distinct(), "g", "left_semi"), "bench-places")
    # 2. rarity over all documents
    df = found.select("doc_id", "th", "g").distinct().groupBy("g").agg(F.count("*").alias("df"))
    prefix = (
        mine.join(df, "g").groupBy("wid", "len").agg(F.min(F.struct("df", "g", "off")).alias("p"), F.count("*").alias("have"))
        .select("wid", "len", F.col("p.g").alias("g"), F.col("p.off").alias("off"), "have")
    )
    # a window with a shingle that no document has can't occur
    size = F.when(F.col("len") >= SHINGLE, F.col("len") - SHINGLE + 1).otherwise(1)
    prefix = prefix.filter(F.col("have") == size).drop("have")
    # 3. candidates within bounds
    begin = F.col("at") - F.col("off")
    cands = (
        found.join(prefix, "g").filter((begin >= 0) & (begin + F.col("len") <= F.col("n_words")))
        .select("doc_id", "th", "wid", "len", begin.alias("begin")).distinct()
        .groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin", "len", "wid")).alias("cands"))
    )
    # 4. word by word
    texts = base.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), "text")
    c = cands.join(texts, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).dropDuplicates(["doc_id", "th"])

    def holding(w: Column) -> Column:
        return F.filter("cands", lambda x: F.array_join(F.slice(w, x["begin"] + 1, x["len"]), " ") == x["wid"])

    hit = c.select("doc_id", "th", bound(words(F.col("text")), holding).alias("hits")).filter(F.size("hits") > 0)
    hit = written(
        hit.select(
            "doc_id", "th", F.array_distinct(F.transform("hits", lambda x: x["wid"])).alias("wids"),
            F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["begin"], x["begin"] + x["len"] - 1))))).cast("long").alias("n_hit"),
        ),
        "bench-hits",
    )
    whose = (
        hit.select("doc_id", "th", F.explode("wids").alias("wid")).join(owners, "wid").select("doc_id", "th", "item_id").distinct()
        .groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        .select("doc_id", "th", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    per = hit.select("doc_id", "th", "n_hit").join(whose.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t"), (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    per = written(per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_hit", "n_items", "items_sha256"), "bench-per-doc")
    for done in (found, hit, mine, windows, owners):
        remove(done)
    out = base.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(per, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "th",
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    bad = contamination(docs, items, text, doc_id).filter("contaminated").select(F.col("doc_id").alias("__q_d"), F.col("th").alias("__q_th")).distinct()
    bad = written(bad, "bench-bad")
    return docs.join(bad, (F.col("__q_th") == F.xxhash64(F.col(text))) & F.col("__q_d").eqNullSafe(F.col(doc_id)), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


SQL_OP7 = r"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id::varchar item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item, len(x) k, array_to_string(x, ' ') g from (
  select item, unnest(case when len(w) <= 10 then [w] else list_transform(range(1, len(w) - 8), lambda i: w[i:i+9]) end) x from b where len(w) > 0)),
ks as (select distinct k from win),
dg as (select rid, k, i, array_to_string(w[i:i+k-1], ' ') g from (select rid, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
hit as (select dg.rid, dg.k, dg.i, win.item from dg join win on win.g = dg.g and win.k = dg.k),
cov as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + k)) p from (select distinct rid, i, k from hit)) group by rid),
it as (select rid, count(*) n, array_to_string(list_sort(list(item)), ',') s from (select distinct rid, item from hit) group by rid)
select d.doc_id, len(w)::bigint n_words, coalesce(cov.n, 0) n_hit, coalesce(it.n, 0) n_items, sha256(coalesce(it.s, '')) items_sha256, cov.n is not null contaminated
from d left join cov using (rid) left join it using (rid)
"""
