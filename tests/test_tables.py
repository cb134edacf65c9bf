"""Derived tables and packed graphs: what they read and how it is dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from motiongraph.operators import chains, graph
from motiongraph.operators.contraction import components
from motiongraph.sources import io
from motiongraph.sources import tables as t

SMALL = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def edges(spark, rows, scan="s"):
    return spark.createDataFrame([(scan, a, b, 1.0, 1.0) for a, b in rows], "scan_id string, n1 long, n2 long, cost double, ctvalue double")


def pairs(df):
    return sorted((r.n1, r.n2) for r in df.collect())


def test_nodes_come_from_one_scan_and_one_shuffle(spark):
    got = plan(t.node(spark, SMALL).select("scan_id", "node_id"))
    final = got.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("Exchange hashpartitioning") == 1


def test_nodes_are_the_ends_of_edges(spark):
    e = t.edge(spark, SMALL)
    ends = e.select("scan_id", F.explode(F.array("n1", "n2")).alias("node_id")).distinct()
    nodes = t.node(spark, SMALL).select("scan_id", "node_id")
    assert nodes.exceptAll(ends).isEmpty() and ends.exceptAll(nodes).isEmpty()


def test_a_large_scan_is_packed_in_many_tasks(spark):
    """The number of blocks comes to the rows; the rows do not go to the one task of their scan."""
    e = spark.range(20_000).selectExpr("'s' AS scan_id", "id AS n1", "id + 1 AS n2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = io.pack_graph(e.selectExpr("scan_id", "n1 AS node_id"), e, size=1_000)
        assert "hashpartitioning(scan_id#" not in "".join(x for x in plan(p).splitlines() if "block" not in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.select(F.sum(F.size("edges"))).first()[0] == 20_000 and p.count() == 20


def test_tails_are_told_by_edges(spark):
    # a tail of three nodes at 10, one of four, a lone path, a loop at the end of a path, two edges between a pair
    rows = [(10, 11), (10, 12), (11, 12), (10, 20), (20, 21), (21, 22), (11, 30), (30, 31), (31, 32), (32, 33), (40, 41), (41, 42), (12, 50), (50, 50), (60, 61), (60, 61), (60, 62)]
    e = edges(spark, rows)
    gone = {(10, 20), (20, 21), (21, 22), (60, 62)}
    assert pairs(graph.prune_tails(e, 3)) == sorted(r for r in rows if r not in gone)


def test_components_of_loops_and_nodes_alone(spark):
    e = edges(spark, [(1, 2), (2, 3), (7, 7)])
    node = spark.createDataFrame([("s", 3), ("s", 9)], "scan_id string, node_id long")
    assert sorted((r.node_id, r.component) for r in components(e, node).collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 9)]
    assert sorted((r.node_id, r.component) for r in components(e).collect()) == [(1, 1), (2, 1), (3, 1), (7, 7)]
    only = edges(spark, [(7, 7)])
    assert [(r.node_id, r.component) for r in components(only).collect()] == [(7, 7)]


def test_lone_loops_go_and_tied_ones_stay(spark):
    e = edges(spark, [(1, 1), (2, 2), (2, 3), (4, 5)])
    assert pairs(graph.drop_lone_loops(e)) == [(2, 2), (2, 3), (4, 5)]


def test_only_points_of_short_chains_are_made(spark):
    # 1-2-3-1 with a hook at 3 and a long edge 3-4, 4-5-6-4; the chain between 3 and 4 is too long
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (4, 6), (5, 6), (3, 9)])
    place = {1: 0.0, 2: 1.0, 3: 2.0, 4: 99.0, 5: 100.0, 6: 101.0, 9: 3.0}
    node = spark.createDataFrame([("s", n, x, 0.0, 0.0) for n, x in place.items()], "scan_id string, node_id long, x double, y double, z double")
    e = e.unionByName(edges(spark, [(1, 7), (3, 7)]).select(*e.columns))
    node = node.unionByName(spark.createDataFrame([("s", 7, 1.5, 0.0, 0.0)], node.schema))
    asked = []

    def path(some):
        asked.extend(pairs(some))
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
        return some.withColumn("idx", step).select("scan_id", "n1", "n2", "idx", *[(F.col("idx") + i).cast("double").alias(a) for i, a in enumerate("xyz")])

    got = chains.peak_valley_midpoints(e, node, path=path).drop("x", "y", "z").collect()
    assert asked and not {(3, 9), (3, 4)} & set(asked)
    whole = chains.peak_valley_midpoints(e, node, path=path(e.select("scan_id", "n1", "n2"))).drop("x", "y", "z").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and got


def test_what_is_no_hook_is_the_rest(spark):
    hook, rest = graph.hooks(edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (7, 7)]))
    assert pairs(hook) == [(3, 4), (5, 6)] and pairs(rest) == [(1, 2), (1, 3), (2, 3), (7, 7)]
