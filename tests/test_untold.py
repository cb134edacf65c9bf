"""Operators without oracle SQL, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiongraph.functions import vec
from motiongraph.operators import graph, motion, nearest, neighbours, shape

from .test_operators import edges


def ring(centre, r1, r2, phi, n=30):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    x, y = r1 * np.cos(t), r2 * np.sin(t)
    return np.stack([centre[0] + x * np.cos(phi) - y * np.sin(phi), centre[1] + x * np.sin(phi) + y * np.cos(phi)], 1)


def test_area_and_radii_over_the_cycle(spark):
    """An ellipse that breathes, on a plane that leans over one axis (the projection shears over two)."""
    u, v = np.array([1, 0, 0.5]) / np.sqrt(1.25), np.array([0, 1, 0])
    flat, slanted = [], []
    for phase in range(10):
        r1, r2 = 3 + 0.1 * phase, 2 - 0.05 * phase
        for i, (a, b) in enumerate(ring((0.3, -0.2), r1, r2, 0.4)):
            flat.append((1, i, phase, float(a), float(b)))
            slanted.append((1, i, phase, *map(float, a * u + b * v + np.array([5, 6, 7]))))
    got = shape.area_change(spark.createDataFrame(slanted, "k0 long, idx long, phase long, x double, y double, z double"), ("k0",)).first()
    areas = [np.pi * (3 + 0.1 * p) * (2 - 0.05 * p) for p in range(10)]
    assert (got["min"], got["max"]) == pytest.approx((min(areas), max(areas)), rel=1e-6)
    assert got["percent"] == pytest.approx(100 * (max(areas) - min(areas)) / min(areas), rel=1e-5)
    got = shape.ellipse_expansion(spark.createDataFrame(flat, "k0 long, idx long, phase long, x double, y double"), ("k0",)).first()
    assert (got["change_r1"], got["change_r2"]) == pytest.approx((0.9, 0.45), rel=1e-5)


def test_span_vectors(spark):
    """Two unit vectors that span the plane across a direction, also for directions along an axis."""
    rng = np.random.default_rng(2)
    rows = [*map(tuple, rng.normal(size=(20, 3)).tolist()), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, -2.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    n = vec.normalize((F.col("x"), F.col("y"), F.col("z")))
    a, b = vec.span_vectors(n, (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    for r in df.select(F.array(*n).alias("n"), F.array(*a).alias("a"), F.array(*b).alias("b")).collect():
        n_, a_, b_ = map(np.array, r)
        assert abs(n_ @ a_) < 1e-9 and abs(n_ @ b_) < 1e-9 and abs(a_ @ b_) < 1e-9
        assert np.linalg.norm(a_) == pytest.approx(1) and np.linalg.norm(b_) == pytest.approx(1)


def test_needles_stand_out(spark):
    """Bright dots are found where they are; a ridge, curved one way only, is not."""
    v = np.zeros((24, 24))
    v[6, 7], v[15, 12], v[:, 20] = 100, 80, 100
    px = spark.createDataFrame([(0, y, x, float(v[y, x])) for y in range(24) for x in range(24)], "z long, y long, x long, v double")
    got = {(r["y"], r["x"]) for r in neighbours.needle_points(px, 1.0, 200.0, ("z",)).collect()}
    assert {(6, 7), (15, 12)} <= got and not any(x == 20 and 3 < y < 20 for y, x in got)


def test_mesh_points_move_with_the_field(spark):
    """Amplitude of points in a field that is linear in space and a cosine in time."""
    cells = [(p, z, y, x, *(float(np.cos(2 * np.pi * p / 10) * s * (z + 2 * y + 3 * x)) for s in (1, 2, 3))) for p in range(10) for z in range(4) for y in range(4) for x in range(4)]
    field = spark.createDataFrame(cells, "phase long, z long, y long, x long, dz double, dy double, dx double")
    pts = [(0, 1.25, 1.5, 0.75), (1, 2.0, 0.5, 1.0)]
    p = spark.createDataFrame(pts, "idx long, x double, y double, z double")
    got = {r["idx"]: r["amplitude"] for r in motion.amplitude(motion.sample_field(p, field, ("idx",)), "xyz", ("idx",)).collect()}
    swing = np.cos(0) - np.cos(np.pi)
    assert got == {i: pytest.approx(swing * np.sqrt(14) * (z + 2 * y + 3 * x)) for i, x, y, z in pts}


def test_clusters_of_midpoints(spark):
    rng = np.random.default_rng(1)
    home = [(0, 0, 0), (50, 0, 0), (0, 50, 0), (0, 0, 50)]
    rows = [(k * 10 + i, *map(float, np.array(c) + rng.normal(size=3))) for k, c in enumerate(home) for i in range(10)]
    got = nearest.cluster_midpoints(spark.createDataFrame(rows, "idx long, x double, y double, z double"), 4).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["idx"] // 10)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2], [3]]


def test_ring_parts(spark):
    """Two rings of six joined by two steep struts, with a hook on each."""
    at = {k: (6 * np.cos(k * np.pi / 3), 6 * np.sin(k * np.pi / 3), 20.0) for k in range(6)} | {10 + k: (6 * np.cos(k * np.pi / 3), 6 * np.sin(k * np.pi / 3), 12.0) for k in range(6)} | {20: (9.0, 0.0, 22.0), 21: (-9.0, 0.0, 10.0)}
    ways = [(k, (k + 1) % 6) for k in range(6)] + [(10 + k, 10 + (k + 1) % 6) for k in range(6)] + [(0, 10), (3, 13), (0, 20), (13, 21)]
    node = spark.createDataFrame([("s", k, *map(float, p)) for k, p in at.items()], "scan_id string, node_id long, x double, y double, z double")
    got = {(r["n1"], r["n2"]): r["part"] for r in graph.ring_parts(node, edges(spark, *[(a, b, 1, 1) for a, b in ways]), 2).collect()}
    want = {tuple(sorted(w)): "ring1" if max(w) < 10 else "ring2" for w in ways[:12]} | {(0, 10): "strut", (3, 13): "strut", (0, 20): "hook", (13, 21): "hook"}
    assert got == want
