"""Engine tables derived from the driver's parquet files, in Spark and in SQL.

Both sides use one definition; see FIXTURES.md. Floats become doubles before any
arithmetic and no generated id depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _element(i) -> Column:
    return F.element_at("embedding", F.lit(i) if isinstance(i, int) else i.cast("int")).cast("double")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, sf_dir, "embeddings").withColumn("path_id", F.col("label").cast("long")).withColumn("idx", idx.cast("long"))


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("path_id", "idx", *[_element(i + 1).alias(n) for i, n in enumerate("xyz")])


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("phase")
    rows = _indexed(spark, sf_dir).withColumn("phase", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return rows.select("path_id", "idx", "phase", *[_element(p * 3 + 4 + i).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and order numbers are nodes of one numbering; every row of lineitem links two of them."""
    n = [F.col(c).cast("long") for c in ("l_partkey", "l_orderkey")]
    return (
        read(spark, sf_dir, "lineitem").filter("l_partkey <> l_orderkey").groupBy(F.col("l_linestatus").alias("scan_id"), F.least(*n).alias("n1"), F.greatest(*n).alias("n2"))
        .agg(F.min(F.col("l_extendedprice").cast("double")).alias("cost"), F.max(F.col("l_quantity").cast("double")).alias("ctvalue"))
    )


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of edge, with coordinates and flags that follow from its number; straight from the rows, whose edges need not be found first."""
    ends = F.explode(F.array(*[F.col(c).cast("long") for c in ("l_partkey", "l_orderkey")]))
    ids = read(spark, sf_dir, "lineitem").filter("l_partkey <> l_orderkey").select(F.col("l_linestatus").alias("scan_id"), ends.alias("node_id")).distinct()
    n = F.col("node_id")
    return ids.select("scan_id", "node_id", (n % 20).cast("double").alias("x"), (n % 17).cast("double").alias("y"), (n % 43).cast("double").alias("z"), (n % 5 == 0).alias("spared"), (n % 11 == 0).alias("corner"))


def voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"z": ("l_suppkey", 20), "y": ("l_partkey", 30), "x": ("l_orderkey", 30)}
    return read(spark, sf_dir, "lineitem").groupBy(*[(F.col(c) % m).cast("long").alias(n) for n, (c, m) in axes.items()]).agg(F.max(F.col("l_extendedprice").cast("double")).alias("v"))


def voxel_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = ((F.col("l_linenumber") * 7 + F.col("l_suppkey")) % 10).cast("long").alias("phase")
    return read(spark, sf_dir, "lineitem").groupBy(phase, *[(F.col(c) % 10).cast("long").alias(n) for n, c in (("z", "l_suppkey"), ("y", "l_partkey"), ("x", "l_orderkey"))]).agg(F.max(F.col("l_extendedprice").cast("double")).alias("v"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("source", F.col("event_type"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t = (micros - F.min(micros).over(Window.partitionBy("source"))) / F.lit(1e6)
    return e.select("source", (F.row_number().over(w) - 1).cast("long").alias("idx"), t.alias("t"), F.col("value").cast("double").alias("value"))


def measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").cast("long").alias("patient"), (F.year("o_orderdate") - 1995).cast("long").alias("timepoint"), F.col("o_orderpriority").alias("metric")).agg(
        (F.sum(F.round(F.col("o_totalprice").cast("double") * 100).cast("long")).cast("double") / 100000 / F.count("*")).alias("value")
    )


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("patient"), (F.lit(25.0) + F.col("c_nationkey") % 5 * F.lit(2.5)).alias("device_size"))


def face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face for each row of lineitem, over all vertices."""
    o, p, k = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_linenumber"))
    n = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    f = read(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_returnflag").alias("mesh_id"), (o * 8 + k).alias("f"), ((o + k) % F.col("n")).alias("v1"), (p % F.col("n")).alias("v2"), ((p * 7 + o * 3) % F.col("n")).alias("v3"))
    return f.filter("v1 <> v2 AND v2 <> v3 AND v1 <> v3")


def vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("v"), *[_element(i + 1).alias(n) for i, n in enumerate("xyz")])


#: The same tables for the oracle, each a SELECT that may use the ones before it.
SQL = {
    "path": "SELECT CAST(label AS BIGINT) AS path_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings",
    "motion": "SELECT path_id, idx, p AS phase, CAST(e[4 + 3 * p] AS DOUBLE) AS dx, CAST(e[5 + 3 * p] AS DOUBLE) AS dy, CAST(e[6 + 3 * p] AS DOUBLE) AS dz FROM (SELECT CAST(label AS BIGINT) AS path_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS e FROM embeddings), range(10) r(p)",
    "posed": "SELECT p.path_id, p.idx, phase, x + dx AS x, y + dy AS y, z + dz AS z FROM path p JOIN motion m ON p.path_id = m.path_id AND p.idx = m.idx",
    "edge": "SELECT l_linestatus AS scan_id, CAST(least(l_partkey, l_orderkey) AS BIGINT) AS n1, CAST(greatest(l_partkey, l_orderkey) AS BIGINT) AS n2, CAST(min(l_extendedprice) AS DOUBLE) AS cost, CAST(max(l_quantity) AS DOUBLE) AS ctvalue FROM lineitem WHERE l_partkey <> l_orderkey GROUP BY 1, 2, 3",
    "half": "SELECT scan_id, n1 AS a, n2 AS b, cost, ctvalue FROM edge UNION ALL SELECT scan_id, n2, n1, cost, ctvalue FROM edge WHERE n1 <> n2",
    "node": "SELECT DISTINCT scan_id, node_id, CAST(node_id % 20 AS DOUBLE) AS x, CAST(node_id % 17 AS DOUBLE) AS y, CAST(node_id % 43 AS DOUBLE) AS z, node_id % 5 = 0 AS spared, node_id % 11 = 0 AS corner FROM (SELECT scan_id, n1 AS node_id FROM edge UNION SELECT scan_id, n2 FROM edge)",
    "voxel": "SELECT CAST(l_suppkey % 20 AS BIGINT) AS z, CAST(l_partkey % 30 AS BIGINT) AS y, CAST(l_orderkey % 30 AS BIGINT) AS x, CAST(max(l_extendedprice) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3",
    "voxel_phase": "SELECT CAST((l_linenumber * 7 + l_suppkey) % 10 AS BIGINT) AS phase, CAST(l_suppkey % 10 AS BIGINT) AS z, CAST(l_partkey % 10 AS BIGINT) AS y, CAST(l_orderkey % 10 AS BIGINT) AS x, CAST(max(l_extendedprice) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3, 4",
    "signal": "SELECT event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, (epoch_us(CAST(ts AS TIMESTAMP)) - min(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY event_type)) / 1e6 AS t, CAST(value AS DOUBLE) AS value FROM events",
    "measure": "SELECT CAST(o_custkey AS BIGINT) AS patient, CAST(year(o_orderdate) - 1995 AS BIGINT) AS timepoint, o_orderpriority AS metric, CAST(sum(CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT)) AS DOUBLE) / 100000 / count(*) AS value FROM orders GROUP BY 1, 2, 3",
    "device": "SELECT CAST(c_custkey AS BIGINT) AS patient, 25.0::DOUBLE + c_nationkey % 5 * 2.5::DOUBLE AS device_size FROM customer",
    "face": "SELECT * FROM (SELECT l_returnflag AS mesh_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS f, CAST((l_orderkey + l_linenumber) % n AS BIGINT) AS v1, CAST(l_partkey % n AS BIGINT) AS v2, CAST((l_partkey * 7 + l_orderkey * 3) % n AS BIGINT) AS v3 FROM lineitem, (SELECT count(*) AS n FROM embeddings)) WHERE v1 <> v2 AND v2 <> v3 AND v1 <> v3",
    "vertex": "SELECT CAST(vec_id AS BIGINT) AS v, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings",
}
_NEEDS = {"posed": ("path", "motion"), "half": ("edge",), "node": ("edge",)}


def oracle(tables: str, body: str) -> str:
    """Oracle SQL: the named tables as common table expressions, then the body.

    The body may start with further expressions: "name AS (...), ... SELECT".
    """
    names: list[str] = []
    for t in tables.split():
        names += [x for x in (*_NEEDS.get(t, ()), t) if x not in names]
    head = ",\n".join(f"{t} AS ({SQL[t]})" for t in names)
    body = body.strip()
    return f"WITH {head}{',' if names and not body.upper().startswith('SELECT') else ''}\n{body}" if names else body
