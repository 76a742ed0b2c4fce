"""Tables in the shared checkpoint folder: they cut lineage and outlive a lost executor. Each is known by its session, which can remove all it has left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a temporary one is set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quartz-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = _place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, dealt into buckets by key, which later joins on key don't shuffle again."""
    spark = df.sparkSession
    n, path = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), _place(spark, name)
    own = "quartz_" + path.rpartition("-")[2]
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(own)
    return spark.table(own)


def _place(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_PATHS: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this session has written here; results that were not read yet are lost with them."""
    for path in _PATHS.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def remove(df: DataFrame) -> None:
    """Deletes the files behind a table that written() made, once nothing reads it any more."""
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, p)
