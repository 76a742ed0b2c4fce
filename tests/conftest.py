import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def at(sf_dir):
        c = duckdb.connect()
        for p in sorted(Path(sf_dir).glob("*.parquet")):
            c.sql(f"create view {p.stem} as from '{p}'")
        return c

    return at


@pytest.fixture(scope="session")
def same_rows():
    import math

    def text(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "none"
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    def check(spark_df, relation):
        cols = sorted(spark_df.columns)
        assert cols == sorted(relation.columns)
        names = list(relation.columns)
        a = sorted(tuple(text(r[c]) for c in cols) for r in spark_df.collect())
        b = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in relation.fetchall())
        assert a == b

    return check
