"""Plane cuts of closed meshes: closed again, loop by loop, with the volume in front of the plane."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motiongraph.operators import shape

BOX = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def box(lo, hi):
    (a, b, c), (d, e, f) = lo, hi
    return [(a, b, c), (d, b, c), (d, e, c), (a, e, c), (a, b, f), (d, b, f), (d, e, f), (a, e, f)]


def tube(n=24, rings=20, r=0.4, bend=2.0):
    """A closed torus: a plane through its axis cuts it in two loops."""
    at = lambda i, j: ((bend + r * np.cos(2 * np.pi * j / n)) * np.cos(2 * np.pi * i / rings), r * np.sin(2 * np.pi * j / n), (bend + r * np.cos(2 * np.pi * j / n)) * np.sin(2 * np.pi * i / rings))
    number = lambda i, j: (i % rings) * n + j % n
    faces = [t for i in range(rings) for j in range(n) for t in ((number(i, j), number(i, j + 1), number(i + 1, j + 1)), (number(i, j), number(i + 1, j + 1), number(i + 1, j)))]
    return [at(i, j) for i in range(rings) for j in range(n)], faces


@pytest.fixture(scope="module")
def meshes(spark):
    """Two boxes of one key, a torus, a box with corners on the plane."""
    vs, fs = [], []

    def add(name, points, faces):
        start = len(vs)
        vs.extend(points)
        fs.extend((name, len(fs) + k, *(start + c for c in f)) for k, f in enumerate(faces))

    add("boxes", box((0, 0, -1), (1, 1, 2)), BOX)
    add("boxes", box((5, 5, -3), (7, 8, 1)), BOX)
    add("torus", *tube())
    add("touching", box((0, 0, 0), (1, 1, 1)), BOX)
    add("behind", box((0, 0, -2), (1, 1, -1)), BOX)
    add("under", box((0, 0, -2), (1, 1, 0)), BOX)
    vertex = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(vs)], "v long, x double, y double, z double")
    return vertex, spark.createDataFrame(fs, "mesh_id string, f long, v1 long, v2 long, v3 long")


def welded(t):
    """vertex and face tables of triangles given by their corners."""
    rows = t.withColumn("f", F.monotonically_increasing_id()).cache()
    corner = rows.select("mesh_id", "f", F.posexplode(F.array(*[F.struct(*[F.col(p + a).alias(a) for a in "xyz"]) for p in "pqr"])).alias("k", "c"))
    ids = corner.select("c").distinct().withColumn("v", F.xxhash64("c"))
    face = corner.join(ids, "c").groupBy("mesh_id", "f").pivot("k", [0, 1, 2]).agg(F.first("v"))
    return ids.select("v", "c.x", "c.y", "c.z"), face.withColumnsRenamed({"0": "v1", "1": "v2", "2": "v3"})


def test_cut_meshes_are_closed_again(meshes):
    vertex, face = meshes
    whole = {r["mesh_id"]: r["volume"] for r in shape.mesh_volume(vertex, face).collect()}
    v, f = welded(shape.cut_mesh(vertex, face, (0, 0, 1, 0)))
    assert shape.mesh_edge_check(f).collect() == [] and shape.winding_conflicts(f).collect() == []
    got = {r["mesh_id"]: r["volume"] for r in shape.mesh_volume(v, f).collect()}
    sign = np.sign(whole["boxes"])
    assert got.get("under", 0.0) == pytest.approx(0) and "behind" not in got
    assert {k: got[k] for k in ("boxes", "torus", "touching")} == pytest.approx({"boxes": sign * 8.0, "torus": whole["torus"] / 2, "touching": sign * 1.0})


def test_slanted_cuts_are_closed(meshes):
    vertex, face = meshes
    _, f = welded(shape.cut_mesh(vertex, face.filter("mesh_id <> 'under'"), (0.6, 0.0, 0.8, 0.1)))
    assert shape.mesh_edge_check(f).collect() == [] and shape.winding_conflicts(f).collect() == []


def test_without_lids_the_rims_stay_open(meshes):
    vertex, face = meshes
    _, f = welded(shape.cut_mesh(vertex, face.filter("mesh_id = 'boxes'"), (0, 0, 1, 0), lid=False))
    assert shape.mesh_edge_check(f).count() == 16  # two rims of eight segments


def test_loops_of_the_rim_are_sought_by_numbers(spark, meshes, monkeypatch):
    """Also where each face has vertices of its own and meets others in place only, at 0.0 and -0.0 too."""
    vertex, face = meshes
    face = face.withColumn("f", F.row_number().over(Window.orderBy("mesh_id", "v1", "v2", "v3")).cast("long"))
    kinds, found = [], shape.linked_labels
    monkeypatch.setattr(shape, "linked_labels", lambda links, keys: kinds.append(dict(links.dtypes)["u"]) or found(links, keys))
    corner = face.select("mesh_id", "f", F.posexplode(F.array("v1", "v2", "v3")).alias("k", "v")).join(vertex, "v").withColumn("v", F.col("f") * 3 + F.col("k"))
    own = corner.select("v", *[F.when((F.col(a) == 0) & (F.col("v") % 2 == 0), -0.0).otherwise(F.col(a)).alias(a) for a in "xyz"])
    apart = face.select("mesh_id", "f", *[(F.col("f") * 3 + k).alias(f"v{k + 1}") for k in range(3)])
    sides = ("mesh_id", *(p + a for p in "pqr" for a in "xyz"))
    rows = lambda v, f: sorted(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in shape.cut_mesh(v, f, (0, 0, 1, 0.25)).select(*sides).collect())
    assert rows(own, apart) == rows(vertex, face) and set(kinds) == {"bigint"}


def test_segments_that_meet_no_other_need_no_search(spark, monkeypatch):
    """Only segments that share an end are linked; one on its own is a loop whose mean is where it begins."""
    points, faces = [], []
    for i in range(3):  # apart from each other
        faces.append(("m", i, *(len(points) + k for k in range(3))))
        points += [(10.0 * i, 0, 0), (10.0 * i + 1, 0, 1), (10.0 * i, 1, 0)]
    n = len(points)
    points += [(100, 0, 0), (100, 0, 1), (101, 0, 0), (99, 0, 0)]
    faces += [("m", 3, n, n + 1, n + 2), ("m", 4, n + 1, n, n + 3), ("other", 5, n, n + 1, n + 2)]
    vertex = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "v long, x double, y double, z double")
    face = spark.createDataFrame(faces, "mesh_id string, f long, v1 long, v2 long, v3 long")
    linked, real = [], shape.linked_labels
    monkeypatch.setattr(shape, "linked_labels", lambda links, keys: linked.append(links.count()) or real(links, keys))
    rows = [tuple(r[c] for c in ("mesh_id", *shape._named("pqr"))) for r in shape.cut_mesh(vertex, face, (0, 0, 1, 0.25)).collect()]
    assert linked == [2]
    lids = [(r[0], r[1:4], r[4:7], r[7:]) for r in rows if {r[3], r[6], r[9]} == {0.25}]
    assert len(rows) == 12 and len(lids) == 6
    assert sorted(p for m, p, _, c in lids if p == c) == sorted([p for m, p, _, _ in lids if p[0] < 50] + [p for m, p, _, _ in lids if m == "other"])
    pair = [(p, c) for m, p, _, c in lids if m == "m" and p[0] > 50]
    assert len(pair) == 2 and all(c == pytest.approx(np.mean([p for p, _ in pair], 0)) for _, c in pair)


def test_places_that_share_a_number_are_noticed(spark):
    at = lambda *rows: spark.createDataFrame([("m", a, b, 1, *map(float, (*p, *q))) for a, b, p, q in rows], f"mesh_id string, a long, b long, n long, {', '.join(f'{c} double' for c in shape._named('ab'))}")
    o, p, q, r = (0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)
    lone = lambda net: None if (t := shape._lone(shape.checkpointed(shape.dealt_by(net, "mesh_id", "a")), ["mesh_id"], 0)) is None else sorted(x["a"] for x in t.collect())
    assert lone(at((1, 2, o, p), (3, 4, q, r))) == [1, 3]
    assert lone(at((1, 2, o, p), (2, 3, p, q), (4, 5, r, o))) == [4]
    assert lone(at((1, 2, o, p), (1, 3, o, q), (4, 5, r, o))) == [4]
    assert lone(at((1, 3, o, p), (2, 3, q, p))) == []
    assert lone(at((1, 2, o, p), (1, 3, q, r))) is None  # as first ends
    assert lone(at((1, 3, o, p), (2, 3, q, r))) is None  # as second ends
    assert lone(at((1, 2, o, p), (2, 3, q, r))) is None  # as either
    assert lone(at((1, 1, o, p))) is None  # of one segment
