"""Multi-party perspective rotation of dialogues; DataFrame functions only.

For every participant of a conversation (every role but `system`) the dialogue is rendered once with that speaker as
the assistant, the others as named users, and system turns as they are. The mask gives the spans (code
points in the rendered dialogue, end exclusive) that a loss is taken on: what the assistant says, with the end mark.

A dialogue of at most PART turns is one row. A longer one comes in parts of PART consecutive turns: put together in their order they are the
dialogue, `start` says where in it a part's text begins, and masks count from the dialogue's beginning. So no task holds a
conversation of unbounded length. Turns of long conversations are numbered by a range-partitioned sort. Turns meet their conversation's
participants, a small distinct table, in a join on the conversation that Spark may split where it is skewed.

Defined cases: null text is empty; a null role is the speaker `unknown`; a null conv_id is one conversation; null turns come first;
repeated rows count once; turns that share a number are in the order of role and text; a conversation of system turns only has no participant
and gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordinal import numbered
from .common import table

PART = 1024
SYSTEM, END = "system", "<|end|>\n"
ASSISTANT = "<|assistant|>\n"


def _starts(turns: DataFrame, who: DataFrame) -> DataFrame:
    """(k, speaker, part, start): where the parts of long dialogues begin, from sums over each part, for every speaker."""
    sums = turns.groupBy("k", "part", "role").agg(F.sum(F.length("head") + F.length("text") + len(END)).alias("chars"), F.count("*").alias("n"), F.max(F.length("head")).alias("head"))
    whole = sums.groupBy("k", "part").agg(F.sum("chars").alias("chars")).join(who, "k")
    # the speaker's own turns have another head
    own = sums.select("k", "part", F.col("role").alias("speaker"), (F.col("n") * (len(ASSISTANT) - F.col("head"))).alias("less"))
    parts = whole.join(own, ["k", "part", "speaker"], "left").withColumn("chars", F.col("chars") + F.coalesce("less", F.lit(0)))
    before = Window.partitionBy("k", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("k", "speaker", "part", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, start, n_turns, text, mask, loss_chars) for every participant, and part of a long dialogue."""
    t = turns.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("k"),
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).distinct().withColumn("head", F.when(F.col("role") == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n"))))
    who = t.filter(F.col("role") != SYSTEM).select("k", F.col("role").alias("speaker")).distinct()
    long_ = t.groupBy("k").agg(F.count("*").alias("size")).filter(F.col("size") > part).select("k")
    start = F.lit(0).cast("long")
    if long_.limit(1).count():
        large = numbered(t.join(long_, "k", "left_semi"), ["k", "turn", "role", "text"], "chat-long", "place")
        first = large.groupBy("k").agg(F.min("place").alias("first"))
        large = large.join(first, "k").withColumn("part", F.floor((F.col("place") - F.col("first")) / part).cast("long")).drop("place", "first")
        t = t.join(long_, "k", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(large)
        t = t.join(who, "k").join(_starts(large, who), ["k", "speaker", "part"], "left")
        start = F.coalesce("start", start)
    else:
        t = t.withColumn("part", F.lit(0).cast("long")).join(who, "k")
    on = F.col("role") == F.col("speaker")
    t = t.select("conv_id", "k", "speaker", "part", start.alias("start"), "turn", "role", "text", F.when(on, ASSISTANT).otherwise(F.col("head")).alias("head"), on.alias("on"))
    own = ["k", "speaker", "part"]
    before = Window.partitionBy(*own).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("text") + len(END)
    t = t.withColumn("at", F.col("start") + F.coalesce(F.sum(size).over(before), F.lit(0)))
    said = F.struct("at", F.concat("head", "text", F.lit(END)).alias("said"), F.when(F.col("on"), F.col("at") + F.length("head")).alias("a"), (F.col("at") + size).alias("b"))
    g = t.groupBy(*own).agg(F.first("conv_id").alias("conv_id"), F.first("start").alias("start"), F.array_sort(F.collect_list(said)).alias("xs"))
    spans = F.filter("xs", lambda x: x["a"].isNotNull())
    return g.withColumn("spans", spans).select(
        "conv_id", "speaker", "part", "start", F.size("xs").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("xs", lambda x: x["said"])).alias("text"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string")))).alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("loss_chars"),
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL_OP4 = r"""
with t as (select distinct conv_id, turn, coalesce(role, 'unknown') role, coalesce(text, '') text from conversations),
n as (select *, ((row_number() over (partition by conv_id order by turn nulls first, role, text) - 1) // 1024)::bigint part from t),
w as (select distinct conv_id, role speaker from t where role <> 'system'),
x as (select n.*, speaker, role = speaker "on",
  case when role = 'system' then '<|system|>' when role = speaker then '<|assistant|>' else '<|user name=' || role || '|>' end || chr(10) head
  from n join w on n.conv_id is not distinct from w.conv_id),
y as (select *, len(head) + len(text) + 8 size, coalesce(sum(len(head) + len(text) + 8) over (partition by conv_id, speaker order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) pos from x)
select conv_id, speaker, part, min(pos)::bigint start, count(*) n_turns,
  string_agg(head || text || '<|end|>' || chr(10), '' order by turn nulls first, role, text) "text",
  coalesce(string_agg((pos + len(head))::bigint || ':' || (pos + size)::bigint, ',' order by turn nulls first, role, text) filter ("on"), '') mask,
  coalesce(sum(size - len(head)) filter ("on"), 0)::bigint loss_chars
from y group by conv_id, speaker, part
"""
