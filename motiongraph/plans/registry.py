"""Registration of queries: a name, a function of (spark, sf_dir) and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Decimals that results are rounded to, on both sides.
DIGITS = 6


def query(name: str, tables: str = "", sql: str | None = None):
    """Register a query; its doubles are rounded, as ``r()`` does in the SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(tables, sql)
        return f

    return put


def r(**columns: str) -> str:
    """SQL select items, rounded: r(a="x + y") is round(x + y, 6) + 0 AS a."""
    return ", ".join(f"round(CAST({v} AS DOUBLE), {DIGITS}) + CAST(0.0 AS DOUBLE) AS {k}" for k, v in columns.items())
