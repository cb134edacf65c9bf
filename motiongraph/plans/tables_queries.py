"""Queries over sources, sinks and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources import tables as t
from .motion_queries import posed
from .registry import query, r

NAMES = "nm AS (SELECT page_id, 'pt' || lpad(CAST(page_id % 20 AS VARCHAR), 3, '0') || '_' || CASE page_id % 3 WHEN 0 THEN 'discharge' WHEN 1 THEN '1month' ELSE '6months' END || '_ring_' || CASE page_id % 2 WHEN 0 THEN 'avgreg' ELSE 'deforms' END || '.ssdf' AS name, page_id % 10 || '0%, ' || page_id AS series FROM pages)"


def _names(spark, d):
    p = t.read(spark, d, "pages")
    i = F.col("page_id")
    tp = F.when(i % 3 == 0, "discharge").when(i % 3 == 1, "1month").otherwise("6months")
    name = F.concat(F.lit("pt"), F.lpad((i % 20).cast("string"), 3, "0"), F.lit("_"), tp, F.lit("_ring_"), F.when(i % 2 == 0, "avgreg").otherwise("deforms"), F.lit(".ssdf"))
    return p.select("page_id", name.alias("name"), F.concat((i % 10).cast("string"), F.lit("0%, "), i.cast("string")).alias("series"))


@query("s1_scan_catalog", "", f"WITH {NAMES} SELECT page_id, split_part(name, '_', 1) AS patient, split_part(name, '_', 2) AS timepoint, split_part(name, '_', 3) AS crop, replace(split_part(name, '_', 4), '.ssdf', '') AS kind FROM nm")
def s1(spark, d):
    return _names(spark, d).select("page_id", *io.parse_scan_name(F.col("name")))


@query("s1_scan_catalog_stored", "", f"WITH {NAMES} SELECT DISTINCT split_part(name, '_', 1) AS patient, split_part(name, '_', 2) AS timepoint, split_part(name, '_', 3) AS crop, replace(split_part(name, '_', 4), '.ssdf', '') AS kind FROM nm")
def s1_stored(spark, d):
    """The catalog of scans that a sink has stored, a folder each."""
    path = io.new_folder(spark, "scans")
    _names(spark, d).write.partitionBy("name").parquet(path)
    return io.scan_catalog(spark, path).filter("bytes > 0").select("patient", "timepoint", "crop", "kind")


@query("s3_phase_from_text", "", f"WITH {NAMES} SELECT page_id, CAST(regexp_extract(series, '([0-9]+)%', 1) AS INTEGER) AS phase FROM nm")
def s3(spark, d):
    return _names(spark, d).select("page_id", io.phase_from_text(F.col("series")).alias("phase"))


@query("s4_rename_manifest", "", f"WITH {NAMES} SELECT page_id, split_part(name, '_', 1) || '_' || lpad(CAST(row_number() OVER (PARTITION BY split_part(name, '_', 1) ORDER BY name, page_id) AS VARCHAR), 4, '0') AS new_name FROM (SELECT page_id, name || '/' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS name FROM nm)")
def s4(spark, d):
    f = _names(spark, d).select("page_id", F.substring_index("name", "_", 1).alias("series"), F.concat("name", F.lit("/"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("name"))
    return io.rename_manifest(f).select("page_id", "new_name")


def _stored_voxels(spark, d):
    """Two scans, stored by patient and time point; their folder and their sampling."""
    path = io.new_folder(spark, "voxels")
    v = t.voxel(spark, d).withColumn("scan_id", F.concat(F.lit("s"), F.col("z") % 2)).withColumns({"patient": F.col("scan_id"), "timepoint": F.lit("1month")})
    v.write.partitionBy("patient", "timepoint").parquet(path)
    zyx = lambda *c: F.struct(*[x.cast("double").alias(a) for x, a in zip(c, "zyx")])
    one = F.lit(1.0)
    return path, v.select("scan_id").distinct().select("scan_id", zyx(F.when(F.col("scan_id") == "s0", 0.5).otherwise(0.75), one, one).alias("sampling"), zyx(one, one, one).alias("origin"))


@query("s5_read_voxels", "voxel", f"SELECT z, y, x, {r(wz='z * CASE z % 2 WHEN 0 THEN 0.5 ELSE 0.75 END + 1')} FROM voxel")
def s5(spark, d):
    """Two scans, read back with their sampling."""
    path, scan = _stored_voxels(spark, d)
    return io.read_voxels(spark, path, scan).select("z", "y", "x", (F.col("z") * F.col("sampling.z") + F.col("origin.z")).alias("wz"))


@query("s5_read_voxels_pruned", "voxel", f"SELECT z, y, x, {r(wz='z * 0.75 + 1')} FROM voxel WHERE z % 2 = 1")
def s5_pruned(spark, d):
    """One scan of two; the other's files are not read."""
    path, scan = _stored_voxels(spark, d)
    return io.read_voxels(spark, path, scan, F.col("patient") == "s1").select("z", "y", "x", (F.col("z") * F.col("sampling.z") + F.col("origin.z")).alias("wz"))


@query("s6_read_graph", "edge", f"SELECT scan_id, n1, n2, {r(cost='cost', ctvalue='ctvalue')} FROM edge")
def s6(spark, d):
    """Edges of a stored graph."""
    path = io.new_folder(spark, "graph")
    io.write_graph(t.node(spark, d), t.edge(spark, d), path)
    return io.read_graph(spark, path)[1]


@query("s7_write_graph", "edge node", "SELECT scan_id, count(DISTINCT node_id) AS n_nodes, (SELECT count(*) FROM edge e WHERE e.scan_id = node.scan_id) AS n_edges FROM node GROUP BY 1")
def s7(spark, d):
    """What the stored graph holds."""
    path = io.new_folder(spark, "graph")
    io.write_graph(t.node(spark, d), t.edge(spark, d), path)
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("long")
    return spark.read.parquet(path).groupBy("scan_id").agg(n("nodes").alias("n_nodes"), n("edges").alias("n_edges"))


@query("s8_append_graph", "edge", f"SELECT scan_id, n1, n2, {r(cost='CASE WHEN n1 % 3 = 0 THEN cost + 1 ELSE cost END')} FROM edge")
def s8(spark, d):
    e = t.edge(spark, d)
    new = e.filter("n1 % 3 = 0").withColumn("cost", F.col("cost") + 1)
    return io.append_graph(e, new, ("scan_id", "n1", "n2")).select("scan_id", "n1", "n2", "cost")


def _wide(spark, d):
    """One row for each point of each path."""
    m = t.motion(spark, d)
    cols = [F.max(F.when(F.col("phase") == p, F.col(f"d{a}"))).alias(f"p{p}_{a}") for p in range(10) for a in "xyz"]
    return m.groupBy("path_id", "idx").agg(*cols)


@query("s12_unpivot_positions", "motion", f"SELECT path_id, idx, phase, {r(x='dx', y='dy', z='dz')} FROM motion")
def s12(spark, d):
    return io.unpivot_positions(_wide(spark, d), ("path_id", "idx"))


@query("s13_unpivot_phases", "motion", f"SELECT path_id, idx, phase, {r(value='dz', offset='dz - max(dz) FILTER (WHERE phase = 5) OVER (PARTITION BY path_id, idx)').replace(' AS offset', ' AS \"offset\"')} FROM motion")
def s13(spark, d):
    w = _wide(spark, d).select("path_id", "idx", *[F.col(f"p{p}_z").alias(f"p{p}") for p in range(10)])
    return io.unpivot_phases(w, ("path_id", "idx"))


@query("s14_unpivot_signal", "signal", f"SELECT source, idx, {r(t='t', value='value')} FROM signal")
def s14(spark, d):
    """Sheets of 1,000 samples, so that no row holds a whole signal."""
    s = t.signal(spark, d).withColumn("sheet", F.floor(F.col("idx") / 1000))
    pts = F.array_sort(F.collect_list(F.struct("idx", "t", "value")))
    sheet = s.groupBy("source", "sheet").agg(pts.alias("p")).select("source", "sheet", F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["value"]).alias("value"))
    return io.unpivot_signal(sheet, ("source", "sheet")).select("source", (F.col("sheet") * 1000 + F.col("idx")).alias("idx"), "t", "value")


@query("s15_unpivot_blocks", "path", f"SELECT path_id, idx // 3 AS block, substr('xyz', CAST(idx % 3 + 1 AS INTEGER), 1) AS axis, {r(value='x')} FROM path")
def s15(spark, d):
    return io.unpivot_blocks(t.path(spark, d).select("path_id", F.col("idx").alias("row"), F.col("x").alias("value")), ("path_id",))


@query("s16_unpivot_cohort", "motion", f"SELECT path_id, idx, 'p' || phase || '_z' AS timepoint, {r(value='abs(dz)')} FROM motion WHERE phase < 5")
def s16(spark, d):
    return io.unpivot_cohort(_wide(spark, d).select("path_id", "idx", *[f"p{p}_z" for p in range(5)]), ("path_id", "idx"), [f"p{p}_z" for p in range(5)])


@query("s17_parse_xyz", "", f"SELECT c_custkey AS id, {r(x='c_nationkey + 0.5', y='CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE -1.25 END', z='c_custkey').replace('c_nationkey + 0.5', 'CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_nationkey + 0.5 END').replace('CAST(c_custkey AS DOUBLE)', 'CAST(CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_custkey END AS DOUBLE)')} FROM customer")
def s17(spark, d):
    c = t.read(spark, d, "customer")
    k, n = F.col("c_custkey").cast("string"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))
    s = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("("), n, F.lit(", -1.25, "), k, F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("At z="), k, F.lit(", y=-1.25, x="), n)).otherwise("none")
    return c.select(F.col("c_custkey").alias("id"), *io.parse_xyz(s))


@query("s18_clean_missing", "", f"SELECT c_custkey AS id, {r(v='CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 0.25 END')} FROM customer")
def s18(spark, d):
    c = t.read(spark, d, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(".25"))).when(k % 4 == 1, "NA").when(k % 4 == 2, "NaN")
    return io.clean_missing(c.select(k.alias("id"), text.alias("v")), ["v"])


@query("s19_write_measures", "measure", f"SELECT patient, timepoint, {r(urgent='max(value) FILTER (WHERE metric = $1-URGENT$)', low='max(value) FILTER (WHERE metric = $5-LOW$)').replace('$', chr(39))} FROM measure GROUP BY 1, 2")
def s19(spark, d):
    """The wide form, stored and read back."""
    path = io.new_folder(spark, "measures")
    io.write_measures(t.measure(spark, d), path, wide=True)
    return spark.read.parquet(path).select("patient", "timepoint", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("s22_import_centerline", "path", f"n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM path) SELECT a.path_id, a.idx, {r(x='a.x * 0.7 + 3', y='a.y * 0.7 + 2', z='b.z * 0.5 + 1')} FROM n a JOIN n b ON a.path_id = b.path_id AND b.idx = a.n - 1 - a.idx")
def s22(spark, d):
    p = t.path(spark, d)
    zyx = lambda *v: F.struct(*[F.lit(x).alias(a) for x, a in zip(v, "zyx")])
    scan = p.select("path_id").distinct().select("path_id", zyx(0.5, 0.7, 0.7).alias("sampling"), zyx(1.0, 2.0, 3.0).alias("origin"))
    return io.import_centerline(p, scan, ("path_id",))


@query("s23_read_landmarks", "posed", f"SELECT path_id AS observer, idx AS landmark, phase, {r(x='x', y='y', z='z')} FROM posed")
def s23(spark, d):
    path = io.new_folder(spark, "landmarks")
    posed(spark, d).select(F.col("path_id").alias("observer"), F.lit(0).alias("case_id"), F.col("idx").alias("landmark"), "phase", "x", "y", "z").write.parquet(path)
    return io.read_landmarks(spark, path).drop("case_id")


@query("p9_fix_left_right", "path", f"o AS (SELECT a.path_id, a.idx, a.x AS l, b.x AS r FROM path a JOIN path b ON b.path_id = a.path_id + 1 AND b.idx = a.idx) SELECT path_id, idx, {r(left_x='greatest(l, r)', right_x='least(l, r)')} FROM o")
def p9(spark, d):
    p = t.path(spark, d)
    o = p.select((F.col("path_id") - 1).alias("path_id"), "idx", F.col("x").alias("right_x"))
    j = p.select("path_id", "idx", F.col("x").alias("left_x")).join(o, ["path_id", "idx"])
    swap = F.col("left_x") < F.col("right_x")
    return j.select("path_id", "idx", F.when(swap, F.col("right_x")).otherwise(F.col("left_x")).alias("left_x"), F.when(swap, F.col("left_x")).otherwise(F.col("right_x")).alias("right_x"))


@query("p14_select_models", "", f"WITH {NAMES} SELECT page_id, name FROM nm WHERE NOT starts_with(name, 'pt01')")
def p14(spark, d):
    return _names(spark, d).filter(~F.col("name").startswith("pt01")).select("page_id", "name")
