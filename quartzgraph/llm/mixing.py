"""Temperature mixing of sources; DataFrame functions only.

With q the token shares of the sources, the weights are q**a, normalised. The exponent a in [0, 1] is found by bisection, 32 places a
round: the largest whose weights have at least the target entropy, raised if need be until no source is
repeated more than max_repeats times (the entropy falls, and repetition too, as a rises). A source's budget is its
weight times the whole budget. It is realised as block permutations: block 0, 1, ... each hold the source once in a keyed
order of their own, and the last is cut where the budget is reached. Prefix sums run over hash buckets, about sqrt(rows)
of them, and inside a bucket, so no task holds a source. Sources' totals are a table; only sums over it reach the driver.

Tokens are words [^\\x20\\x09-\\x0D]+. Defined cases: null or empty text has no tokens, and goes along while its place is within the
budget, and once at least where each source is held whole; a null source is a source of its own; rows of one doc_id share a place, and stay or go together; rows
without doc_id are placed by their text; empty input gives an empty result; all columns of docs are kept by mix(), which adds none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SECTIONS, ROUNDS = 32, 8
SEED = 17


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def exponent(shares: DataFrame, entropy_share: float | None, max_repeats: float, whole: float | None) -> float:
    """a for shares (q). entropy_share: of the largest entropy, log of the number of sources. whole: the budget over all tokens; None: so large that each source is held once."""
    lo_q, hi_q, n = shares.agg(F.min("q"), F.max("q"), F.count("*")).first()
    if not n:
        return 1.0

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition for each exponent."""
        cols = [c for a in exponents for c in (F.sum(F.pow("q", F.lit(a))), F.sum(F.pow("q", F.lit(a)) * F.log("q")))]
        row = shares.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        out = []
        for i, a in enumerate(exponents):
            z, s = row[2 * i], row[2 * i + 1]
            w = whole if whole is not None else hi_q ** (1 - a) * z
            out.append((math.log(z) - a * s / z, w * lo_q ** (a - 1) / z))
        return out

    def bisect(good) -> float:
        """The border of good in [0, 1], good at and below it (or above it, for repeats)."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            xs = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
            ok = [good(*v) for v in at(xs)]
            k = next((i for i in range(1, len(xs)) if not ok[i]), len(xs)) if ok[0] else 0
            if k in (0, len(xs)):
                return xs[0] if k == 0 else xs[-1]
            lo, hi = xs[k - 1], xs[k]
        return (lo + hi) / 2

    a = bisect(lambda h, _r: h >= entropy_share * math.log(n)) if entropy_share is not None and n > 1 else 0.0
    b = bisect(lambda _h, r: r > max_repeats + 1e-12)
    return round(max(a, b), 9)


def weights(docs: DataFrame, source: str, text: str, entropy_share: float | None, max_repeats: float, whole: float | None) -> DataFrame:
    """(k, source, tokens, docs, weight, budget, a) of each source with tokens."""
    totals = written(docs.select(_key(F.col(source)).alias("k"), F.col(source).alias("source"), tokens_of(F.col(text)).alias("n")).groupBy("k", "source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "mix-totals")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.filter("tokens > 0").withColumn("q", F.col("tokens") / F.lit(float(max(all_tokens, 1))))
    a = exponent(shares, entropy_share, max_repeats, whole)
    z, largest = shares.agg(F.sum(F.pow("q", F.lit(a))), F.max("q")).first() if all_tokens else (1.0, 1.0)
    part = whole if whole is not None else largest ** (1 - a) * z
    w = F.pow("q", F.lit(a)) / F.lit(float(z))
    budget = F.when(F.col("q") == F.lit(largest), F.ceil(w * (part * all_tokens))).otherwise(F.floor(w * (part * all_tokens))) if whole is None else F.floor(w * (part * all_tokens))
    return shares.select("k", "source", "tokens", "docs", w.alias("weight"), F.greatest(budget.cast("long"), F.when(F.lit(whole is None), F.col("tokens")).otherwise(F.lit(1))).alias("budget"), F.lit(a).alias("a"))


def _order(block: Column, ident: Column) -> Column:
    """Keyed place in a block: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), block.cast("string"), ident)), 1, 15), 16, 10).cast("long")


def _ident(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("="), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def placed(docs: DataFrame, plan: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, k, n_tokens, block, h, start, weight, budget) of every row and block within its source's budget; start: in the source's stream."""
    n_rows = plan.agg(F.sum("docs")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(2, n_rows)) / 2))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _ident(F.col(doc_id), F.col(text)).alias("ident"), _key(F.col(source)).alias("k"), tokens_of(F.col(text)).alias("n_tokens"))
    rows = rows.join(plan.select("k", "source", "tokens", "weight", "budget"), "k")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / F.col("tokens")))))
    rows = rows.withColumn("h", _order(F.col("block"), F.col("ident"))).drop("ident").withColumn("bucket", F.shiftright("h", 60 - bits))
    rows = written(rows, "mix-rows")
    sums = rows.groupBy("k", "block", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("base", F.sum("n").over(Window.partitionBy("k").orderBy("block", "bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("k", "block", "bucket").orderBy("h").rangeBetween(Window.unboundedPreceding, -1)
    out = rows.join(before, ["k", "block", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return out.filter(F.col("start") < F.col("budget")).select("doc_id", "source", "k", "n_tokens", "block", "h", "start", "weight", "budget")


def mix(docs: DataFrame, entropy_share: float | None = None, max_repeats: float = 2.0, whole: float | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs as the budgets have it: each row as often as blocks hold it. Texts aren't shuffled: a row's blocks follow from its hash and its source's cut."""
    plan = weights(docs, source, text, entropy_share, max_repeats, whole)
    cut = placed(docs, plan, source, text, doc_id).groupBy("k", "block").agg(F.max("h").alias("cut"))
    cut = written(cut.groupBy("k").agg(F.max(F.struct("block", "cut")).alias("last")).select("k", F.col("last.block").alias("__q_last"), F.col("last.cut").alias("__q_cut")), "mix-cuts")
    last = _order(F.col("__q_last"), _ident(F.col(doc_id), F.col(text))) <= F.col("__q_cut")
    # sources without any token have no cut, and go along once
    least = 1 if whole is None else 0
    out = docs.withColumn("__q_k", _key(F.col(source))).join(cut.withColumnRenamed("k", "__q_k"), "__q_k", "left")
    times = F.when(F.col("__q_last").isNull(), 1).otherwise(F.greatest(F.lit(least), F.col("__q_last") + last.cast("long")))
    return out.withColumn("__q_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = weights(docs, "source", "text", 0.999, 4.0, 1.0)
    out = placed(docs, plan)
    return out.select("doc_id", "source", "n_tokens", "block", "start", F.round("weight", 6).alias("weight"), "budget", F.round((F.col("start") + 0.5) / F.col("budget"), 6).alias("place"))


SQL_OP3 = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n from documents),
t as (select source, sum(n)::bigint tokens from d group by 1 having sum(n) > 0),
q as (select *, tokens / (select sum(tokens) from t)::double q from t),
m as (select count(*) n, min(q) lo from q),
bis(it, lo, hi, l2, h2) as (select 0, 0.0::double, 1.0::double, 0.0::double, 1.0::double union all
  select it + 1, case when ent >= 0.999 * ln(m.n) then mid else b.lo end, case when ent >= 0.999 * ln(m.n) then hi else mid end,
    case when rep > 4 then mid2 else l2 end, case when rep > 4 then h2 else mid2 end
  from (select *, (lo + hi) / 2 mid, (l2 + h2) / 2 mid2,
      (select ln(sum(pow(q, (bis.lo + bis.hi) / 2))) - (bis.lo + bis.hi) / 2 * sum(pow(q, (bis.lo + bis.hi) / 2) * ln(q)) / sum(pow(q, (bis.lo + bis.hi) / 2)) from q) ent,
      (select pow((select lo from m), (bis.l2 + bis.h2) / 2 - 1) / sum(pow(q, (bis.l2 + bis.h2) / 2)) from q) rep
    from bis where it < 60) b, m),
ends as (select
  case when (select ln(sum(q)) - sum(q * ln(q)) / sum(q) from q) >= 0.999 * ln((select n from m)) then 1.0 else lo end ae,
  case when (select pow((select lo from m), -1) / count(*) from q) <= 4 then 0.0 else l2 end ar from bis where it = 60),
a as (select round(greatest(ae, ar), 9) a from ends),
w as (select source, tokens, pow(q, (select a from a)) / (select sum(pow(q, (select a from a))) from q) weight from q),
p as (select *, greatest(floor(weight * (select sum(tokens) from t))::bigint, 1) budget from w),
r as (select d.*, tokens, weight, budget, unnest(range(0, ((budget - 1) // tokens) + 1)) block from d join p using (source)),
h as (select *, ('0x' || substr(md5('17:' || block || ':' || doc_id), 1, 15))::bigint h from r),
s as (select *, block * tokens + coalesce(sum(n) over (partition by source, block order by h range between unbounded preceding and 1 preceding), 0) start from h)
select doc_id, source, n::bigint n_tokens, block::bigint block, start::bigint start, round(weight, 6) weight, budget::bigint budget, round((start + 0.5) / budget, 6) place
from s where start < budget
"""
