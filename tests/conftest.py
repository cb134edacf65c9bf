from __future__ import annotations

import glob
import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    """The smallest tables as DuckDB views."""
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    import math

    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(frame, cols):
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=repr)


def same(spark_df, oracle_frame):
    """Equal rows; doubles may differ by one in the last digit, where sums in another order round a tie the other way."""
    got = spark_df.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(oracle_frame.columns)
    a, b = rows(got, cols), rows(oracle_frame, cols)
    if a != b:
        near = lambda r: repr([round(v, 3) if isinstance(v, float) else v for v in r])
        assert len(a) == len(b)
        for x, y in zip(sorted(a, key=near), sorted(b, key=near)):
            assert list(x) == [pytest.approx(v, rel=0, abs=1.5e-6) if isinstance(v, float) else v for v in y]
