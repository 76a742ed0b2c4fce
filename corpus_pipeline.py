"""From documents to training shards: toxic documents go, one of each group of near-duplicates stays, documents with
benchmark passages go, sources are mixed, and token shards are written in a keyed random order.

Each stage takes (spark, docs, sf_dir); docs is all that its predecessor kept. All but the last return the
columns of documents. A stage with learned models (toxicity) and a cipher (shards) can't be put in SQL.

Every stage takes null columns, empty and very long texts, repeated rows, extra columns and empty tables; what becomes of such rows is said
with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzgraph.llm import decontaminate, mixing, near_dedup, toxicity, training_order
from quartzgraph.llm.common import remove, ship, table, written

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the threshold of the score stay. Null and empty texts hold no toxic word and stay; repeated rows stay or go together; without labels of both classes all stay."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays, once. Rows of the same null or wordless text and doc_id are copies; of a group without any doc_id one row for each text stays."""
    ship(spark)
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of any item stay. Null and wordless texts hold none; null and wordless items have none; without items all stay."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays once at least; rows of small sources come up to twice. A null source is a source; rows without tokens come once or as their place has it."""
    return mixing.mix(docs, max_repeats=2.0)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all rows, null and empty texts as the end mark alone; one row of the index for each document."""
    ship(spark)
    return training_order.materialise(docs)


STAGES = [("toxicity", toxic), ("near-duplicates", near_duplicate), ("decontamination", benchmark), ("mixing", mixed), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            remove(before)
        before = docs
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage-shards")
