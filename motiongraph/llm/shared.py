"""Helpers that the text operators share: reading tables, cutting lineage, whitespace."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class body of the ASCII white space that separates words.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a new local one only where none is set and the session is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df once to the shared folder and return the table read back.

    Later plans start from these files, so a lost executor costs no more than
    re-reading them, and values such as generated row numbers stay as written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motiongraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, wait: float = 0.0) -> None:
    """Let Spark drop the shuffle files of finished jobs.

    Its cleaner follows the driver's garbage collection, which a few large jobs
    or many small ones hardly trigger, while their files add up. The scheduler
    still knows the last job, and the cleaner works beside the driver: with
    ``wait`` a tiny job displaces the last one, and its files get seconds to go.
    """
    if wait:
        spark.range(8).repartition(2).count()
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    time.sleep(wait)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_blanks(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def uniform(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
