"""Sources and sinks: scan catalogs, wide sheets to long rows and back, packed graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: <patient>_<time point>_<crop>_<kind>, as in the names of stored scans.
SCAN_NAME = r"([^/_]+)_([^/_]+)_([^/_]+)_([^/_.]+)(?:\.[a-z]+)?$"

#: Rows that may be broadcast.
FEW = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a new local one, which only a local session can use."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/motiongraph/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the session's shared folder.

    Unlike a checkpoint, the table read back has its true size: estimates of
    joined sizes, which are products, would square in every round of a loop.
    Rows dealt by dealt_by() stay so: the table is bucketed.
    """
    spark, path, by = df.sparkSession, new_folder(df.sparkSession, "round"), getattr(df, "_dealt_by", None)
    with shuffles_dropped(spark):
        if by is None:
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        name = f"round_{uuid.uuid4().hex}"
        df.write.bucketBy(shuffle_partitions(spark), *by).option("path", path).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only, its files stay
    return table


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written here drops its shuffles' files when it is done, instead of when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_by(df: DataFrame, *by: str) -> DataFrame:
    """df with equal rows of the columns in one task; a table of it is joined on and grouped by them without a shuffle."""
    dealt = df.repartition(shuffle_partitions(df.sparkSession), *by)
    dealt._dealt_by = by
    return dealt


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, a stored table, to be broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def released(*tables: DataFrame) -> None:
    """Delete tables made by checkpointed() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/motiongraph/round-" in parent:
                path = spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parse_scan_name(name: Column) -> list[Column]:
    part = lambda i: F.nullif(F.regexp_extract(name, SCAN_NAME, i), F.lit(""))
    return [part(i).alias(n) for i, n in enumerate(("patient", "timepoint", "crop", "kind"), 1)]


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored scan below a path: path, files, bytes and what its name says; contents are not read.

    A scan is a file, or a folder of part files as a distributed sink writes it
    (also one of a partition, column=name).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    scan = F.regexp_replace("path", r"/(part-|_)[^/]*$", "")
    scans = files.groupBy(scan.alias("path")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return scans.select("path", "files", "bytes", *parse_scan_name(F.regexp_replace("path", r"/[^/=]*=([^/]*)$", "/$1")))


def phase_from_text(c: Column) -> Column:
    """Phase from a series description: the digits before "%"; null without any."""
    return F.nullif(F.regexp_extract(c, r"(\d+)%", 1), F.lit("")).cast("int")


def rename_manifest(files: DataFrame, series: str = "series", name: str = "name") -> DataFrame:
    """New names for the files of each series, numbered from 1 in name order; moves nothing."""
    k = F.row_number().over(Window.partitionBy(series).orderBy(name))
    return files.withColumn("new_name", F.format_string("%s_%04d", F.col(series), k))


def read_voxels(spark: SparkSession, path: str, scans: DataFrame, scan_filter: Column | None = None) -> DataFrame:
    """Voxels with their scan's sampling and origin; the filter prunes partitions of patient and time point."""
    v = spark.read.parquet(path)
    if scan_filter is not None:
        v = v.filter(scan_filter)
    return v.join(scans.select("scan_id", "sampling", "origin"), "scan_id")


def pack_graph(node: DataFrame, edge: DataFrame, keys: Sequence[str] = ("scan_id",), size: int = 50_000) -> DataFrame:
    """Rows (keys, block, nodes, edges): arrays of about ``size`` nodes and edges, so that large scans take many rows."""

    def packed(df: DataFrame, n: str) -> DataFrame:
        df = checkpointed(df)
        # the counts of few keys are broadcast, so that a large scan does not meet in one task
        blocks = few(checkpointed(df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("blocks"))))
        dealt = df.join(blocks, list(keys)).withColumn("block", F.pmod(F.xxhash64(*df.columns), F.col("blocks")))
        return dealt.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in keys]))).alias(n))

    return packed(node, "nodes").join(packed(edge, "edges"), [*keys, "block"], "full")


def unpack_graph(packed: DataFrame, keys: Sequence[str] = ("scan_id",)) -> tuple[DataFrame, DataFrame]:
    return packed.select(*keys, F.inline("nodes")), packed.select(*keys, F.inline("edges"))


def write_graph(node: DataFrame, edge: DataFrame, path: str, keys: Sequence[str] = ("scan_id",), by: Sequence[str] = ()) -> None:
    pack_graph(node, edge, keys).write.partitionBy(*by).parquet(path)


def read_graph(spark: SparkSession, path: str, keys: Sequence[str] = ("scan_id",)) -> tuple[DataFrame, DataFrame]:
    return unpack_graph(spark.read.parquet(path), keys)


def append_graph(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; of equal keys the new attributes win."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("a")).select(*keys, "a.*")


def unpivot(wide: DataFrame, ids: Sequence[str], name: str, value: str, pattern: str, parts: Sequence[str]) -> DataFrame:
    """Wide columns to rows; ``parts`` names the groups of the pattern that column names follow."""
    import re

    cols = [c for c in wide.columns if c not in ids and re.fullmatch(pattern, c)]
    long = wide.unpivot(list(ids), cols, name, value)
    return long.select(*ids, *[F.regexp_extract(name, f"^{pattern}$", i).alias(p) for i, p in enumerate(parts, 1)], value)


def unpivot_positions(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns p<phase>_<axis> to one row a phase with x, y, z."""
    long = unpivot(wide, ids, "name", "value", r"p(\d+)_([xyz])", ("phase", "axis"))
    return long.groupBy(*ids, F.col("phase").cast("long").alias("phase")).pivot("axis", ["x", "y", "z"]).agg(F.first("value"))


def unpivot_phases(wide: DataFrame, ids: Sequence[str], mid: int = 5) -> DataFrame:
    """Columns p<phase> to rows, with the offset from the mid-cycle value."""
    long = unpivot(wide, ids, "name", "value", r"p(\d+)", ("phase",)).withColumn("phase", F.col("phase").cast("long"))
    ref = F.max(F.when(F.col("phase") == mid, F.col("value"))).over(Window.partitionBy(*ids))
    return long.withColumn("offset", F.col("value") - ref)


def unpivot_signal(sheet: DataFrame, ids: Sequence[str] = ("source",)) -> DataFrame:
    """Arrays t and value of a two-row sheet to rows."""
    z = F.posexplode(F.arrays_zip("t", "value")).alias("idx", "s")
    return sheet.select(*ids, z).select(*ids, F.col("idx").cast("long").alias("idx"), "s.t", "s.value")


def unpivot_blocks(rows: DataFrame, ids: Sequence[str], size: int = 3) -> DataFrame:
    """Rows numbered ``row`` that stand in blocks of ``size`` (x, y, z): block number and axis."""
    axis = F.element_at(F.array(*[F.lit(a) for a in "xyz"]), (F.col("row") % size + 1).cast("int"))
    return rows.select(*ids, F.floor(F.col("row") / size).alias("block"), axis.alias("axis"), "value")


def unpivot_cohort(wide: DataFrame, ids: Sequence[str], columns: Sequence[str], positive: bool = True) -> DataFrame:
    """Columns per time point to rows; positive: absolute distances."""
    long = wide.unpivot(list(ids), list(columns), "timepoint", "value")
    return long.withColumn("value", F.abs("value")) if positive else long


def parse_xyz(c: Column) -> list[Column]:
    """x, y, z of "(x, y, z)" or of "At z=.., y=.., x=.."; null for anything else."""
    num = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    plain = rf"^\s*\(\s*{num}\s*,\s*{num}\s*,\s*{num}\s*\)\s*$"
    named = rf"z\s*=\s*{num}\s*,\s*y\s*=\s*{num}\s*,\s*x\s*=\s*{num}"
    out = []
    for i, n in enumerate("xyz"):
        p, q = F.regexp_extract(c, plain, i + 1), F.regexp_extract(c, named, 3 - i)
        out.append(F.coalesce(F.nullif(p, F.lit("")), F.nullif(q, F.lit(""))).try_cast("double").alias(n))
    return out


def clean_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """"NA", other text, NaN and null become null; the rest doubles."""
    for c in cols:
        d = F.col(c).try_cast("double")
        df = df.withColumn(c, F.when(~F.isnan(d), d))
    return df


def write_measures(measure: DataFrame, path: str, wide: bool = False) -> None:
    """Long measure table as Parquet; wide: one column a metric."""
    out = measure.groupBy("patient", "timepoint").pivot("metric").agg(F.first("value")) if wide else measure
    out.write.mode("error").parquet(path)


def import_centerline(rows: DataFrame, scan: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Imported index rows (keys, idx, x, y, z) to world units, z in reverse order.

    scan: keys, sampling and origin structs (z, y, x).
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    turned = rows.withColumn("idx", n - 1 - F.col("idx")).select(*keys, "idx", F.col("z").alias("rz"))
    j = rows.drop("z").join(turned, [*keys, "idx"]).join(scan, list(keys))
    return j.select(*keys, "idx", *[(F.col(c) * F.col(f"sampling.{a}") + F.col(f"origin.{a}")).alias(a) for a, c in (("x", "x"), ("y", "y"), ("z", "rz"))])


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("observer", "case_id", "landmark", "phase")
