"""Operators on small literal tables."""

from __future__ import annotations

import itertools
import math

import numpy as np

import pytest

from motiongraph.operators import cohort, graph, motion, neighbours, paths, shape, signal
from motiongraph.sources import io


def edges(spark, *rows):
    return spark.createDataFrame([("s", min(a, b), max(a, b), float(c), float(v)) for a, b, c, v in rows], "scan_id string, n1 long, n2 long, cost double, ctvalue double")


def nodes(spark, *ids):
    return spark.createDataFrame([("s", i, float(i), 0.0, float(i), False) for i in ids], "scan_id string, node_id long, x double, y double, z double, spared boolean")


def pairs(df):
    return sorted((r["n1"], r["n2"]) for r in df.collect())


def test_redundant_and_tails(spark):
    e = edges(spark, (1, 4, 1, 60), (1, 5, 2, 60), (4, 5, 3, 50), (2, 3, 1, 60), (3, 6, 2, 60), (2, 6, 3, 60), (1, 2, 4, 50))
    once = graph.prune_redundant(e, 55)
    assert len(pairs(once)) == 6
    assert pairs(graph.prune_redundant(once, 55)) == pairs(once)
    assert len(pairs(graph.prune_redundant(e, 65))) == 5


def test_tails(spark):
    # a triangle with tails of four and three nodes
    e = edges(spark, *[(a, b, 1, 1) for a, b in ((1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 6), (6, 7), (2, 8), (8, 9), (9, 10))])
    assert len(pairs(graph.prune_tails(e, 3))) == 7
    assert pairs(graph.prune_tails(e, 9)) == [(1, 2), (1, 3), (2, 3)]
    assert len(pairs(graph.prune_tails(e, 0))) == 10


def test_clusters(spark):
    e = edges(spark, *[(a, b, 1, 1) for a, b in ((1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 7), (7, 4), (3, 4))])
    n = nodes(spark, *range(1, 10))
    kept, left = graph.prune_clusters(n, e, 4)
    assert (kept.count(), left.count()) == (7, 8)
    kept, left = graph.prune_clusters(n, e.filter("NOT (n1 = 3 AND n2 = 4)"), 4)
    assert (kept.count(), left.count()) == (4, 4)
    kept, left = graph.prune_clusters(n, e.filter("NOT (n1 = 3 AND n2 = 4)"), 5)
    assert (kept.count(), left.count()) == (0, 0)


def test_very_weak(spark):
    assert len(pairs(graph.prune_very_weak(edges(spark, (1, 2, 1, 50), (1, 3, 1, 40), (1, 4, 1, 30), (1, 5, 1, 20)), 35))) == 2


def test_weak_goes_one_by_one(spark):
    """Once the dearest edge is gone, the others' ranks allow them to stay."""
    e = edges(spark, (1, 2, 1, 50), (1, 3, 2, 50), (1, 4, 3, 50), (2, 3, 2, 50), (3, 4, 3, 50), (2, 4, 1, 50))
    left = graph.prune_weak(e, 2, 80)
    assert set(pairs(left)) < set(pairs(e))
    deg = {r["node_id"]: r["degree"] for r in graph.degree(left).collect()}
    assert min(deg.values()) >= 2


def test_triangles_and_quadrangles_by_brute_force(spark):
    rng = np.random.default_rng(5)
    known = {tuple(sorted(map(int, p))): float(c) for p, c in zip(rng.integers(0, 14, (60, 2)), rng.integers(0, 99, 60))}
    known |= {(0, k): float(k) for k in range(1, 14)}
    e = edges(spark, *[(a, b, c, 1) for (a, b), c in known.items()])
    tied = lambda a, b: a != b and tuple(sorted((a, b))) in known
    want = sorted((a, b, c, known[a, b], known[a, c], known[b, c]) for a, b, c in itertools.combinations(range(14), 3) if tied(a, b) and tied(a, c) and tied(b, c))
    assert sorted(tuple(r)[1:] for r in graph.triangles(e).collect()) == want and want
    want = sorted((a, b, p, q) for a, b in known if a != b for p in range(14) for q in range(14) if len({a, b, p, q}) == 4 and tied(a, p) and tied(b, q) and tied(p, q))
    assert sorted((r["n1"], r["n2"], r["m1"], r["m2"]) for r in graph.quadrangles(e).collect()) == want and want


def test_clean_in_ring_order(spark):
    # a ring of four with a tail of two, and a lone pair
    e = edges(spark, *[(a, b, 1, 90) for a, b in ((1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (7, 8))])
    node, left = graph.clean(nodes(spark, *range(1, 9)), e, 10, 30, 45, 3, 3, 3, rings=True)
    assert pairs(left) == [(1, 2), (1, 4), (2, 3), (3, 4)] and node.count() == 4


def test_suppress_adjacent(spark):
    seeds = spark.createDataFrame([(0, 0, i) for i in range(6)], "z long, y long, x long")
    assert sorted(r["x"] for r in graph.suppress_adjacent(seeds).collect()) == [0, 2, 4]


def test_corners_of_a_zigzag(spark):
    pts, x, y = [], 0, 0
    for i in range(20):
        pts.append((1, i, float(x), float(y), 0.0))
        x, y = (x + 1, y) if i // 5 % 2 == 0 else (x, y + 1)
    p = spark.createDataFrame(pts, "path_id long, idx long, x double, y double, z double")
    got = paths.corners(p, 3, 1.0).filter("corner").orderBy("idx")
    assert [r["idx"] for r in got.collect()] == [5, 10, 15]
    pieces = paths.split_at(paths.corners(p, 3, 1.0).drop("bend"))
    assert pieces.select("piece").distinct().count() == 4


def helix(spark, r, c, n=200):
    return spark.createDataFrame([(1, i, r * math.cos(i / 10), r * math.sin(i / 10), c * i / 10) for i in range(n)], "path_id long, idx long, x double, y double, z double")


def test_curvature_of_a_helix(spark):
    got = paths.accuracy_vs_constant(paths.curvature(helix(spark, 2.0, 1.0)), 2 / 5, 5).first()
    assert got["percent_error"] < 1


def test_smoothing_keeps_the_ends(spark):
    h = helix(spark, 2.0, 1.0, 30)
    a, b = ({r["idx"]: (r["x"], r["y"], r["z"]) for r in df.collect()} for df in (h, paths.smooth_open(h, 15)))
    assert a[0] == b[0] and a[29] == b[29] and a[10] != b[10]


def test_amplitude_is_at_most_the_way(spark):
    m = spark.createDataFrame([(1, 0, p, math.sin(p), math.cos(2 * p), 0.1 * p) for p in range(10)], "path_id long, idx long, phase long, dx double, dy double, dz double")
    assert motion.amplitude(m).first()["amplitude"] <= motion.sum_motion(m).first()["way"]


def test_peaks(spark):
    v = [0, 1, 0, 1, 0, 2, 0, 0.2, 0, 1]
    s = spark.createDataFrame([("s", i, float(i), float(x)) for i, x in enumerate(v)], "source string, idx long, t double, value double")
    got = [(r["idx"], r["kind"]) for r in signal.peaks(s, 0.3).orderBy("idx").collect()]
    assert got == [(1, "max"), (2, "min"), (3, "max"), (4, "min"), (5, "max"), (6, "min")]


def turning_points(v, delta):
    """By definition: the first value more than delta short of the best since the last turn confirms that best one."""
    found, start, sign = [], 0, 1
    for i in range(len(v)):
        best = max(range(start, i + 1), key=lambda j: (sign * v[j], -j))
        if sign * v[i] < sign * v[best] - delta:
            found.append((best, "max" if sign > 0 else "min"))
            start, sign = i, -sign
    return found


def test_peaks_in_chunks(spark):
    rng = np.random.default_rng(3)
    waves = {
        "noise": rng.integers(0, 9, 150),
        "walk": rng.integers(-2, 3, 150).cumsum(),
        "flat": np.zeros(150),
        "ramp": np.arange(150) / 50,
        "steps": np.repeat(rng.integers(0, 20, 15), 10),
        None: rng.normal(0, 4, 150).cumsum(),
    }
    rows = [(k, i, float(x)) for k, v in waves.items() for i, x in enumerate(v)] + [("noise", 150, None), ("noise", 151, math.nan)]
    s = spark.createDataFrame(rows, "source string, idx long, value double")
    for chunk in (1, 4, 16, 1000):
        got = {}
        for r in signal.peaks(s, 4.0, chunk=chunk).orderBy("idx").collect():
            got.setdefault(r["source"], []).append((r["idx"], r["kind"]))
            assert r["value"] == waves[r["source"]][r["idx"]]
        assert got == {k: t for k, v in waves.items() if (t := turning_points([float(x) for x in v], 4.0))}, chunk
    assert signal.peaks(s.limit(0), 4.0).count() == 0


CUBE = [(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cube(spark):
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(CUBE)], "v long, x double, y double, z double")
    return v, spark.createDataFrame([("m", i, *f) for i, f in enumerate(FACES)], "mesh_id string, f long, v1 long, v2 long, v3 long")


def test_cube(spark):
    v, f = cube(spark)
    assert shape.mesh_edge_check(f).count() == 0 and shape.winding_conflicts(f).count() == 0
    assert abs(shape.mesh_volume(v, f).first()["volume"]) == pytest.approx(8)
    assert shape.mesh_edge_check(f.filter("f > 0")).count() == 3


def test_cut_cube(spark):
    v, f = cube(spark)
    t = shape.cut_mesh(v, f, (0, 0, 1, 0))
    vol = 0.0
    for r in t.collect():
        (px, py, pz), (qx, qy, qz), (rx, ry, rz) = ((r[p + "x"], r[p + "y"], r[p + "z"]) for p in "pqr")
        vol += (px * (qy * rz - qz * ry) + py * (qz * rx - qx * rz) + pz * (qx * ry - qy * rx)) / 6
    assert abs(vol) == pytest.approx(4)


def test_fits_recover_samples(spark):
    c = shape.sample_circle(spark.createDataFrame([(1, 2.0, -1.0, 3.0)], "k0 long, x double, y double, r double"), 20).selectExpr("k0", "px AS x", "py AS y")
    got = shape.fit_circle(c, ("k0",)).first()
    assert (got["x"], got["y"], got["r"]) == pytest.approx((2, -1, 3), abs=0.1)
    e = shape.sample_ellipse(spark.createDataFrame([(1, 2.0, -1.0, 3.0, 1.5, 0.6)], "k0 long, x double, y double, r1 double, r2 double, phi double"), 40).selectExpr("k0", "px AS x", "py AS y")
    got = shape.fit_ellipse(e, ("k0",)).first()
    assert tuple(got)[1:] == pytest.approx((2, -1, 3, 1.5, 0.6), abs=1e-6)
    line = spark.createDataFrame([(1, float(i), float(i)) for i in range(5)], "k0 long, x double, y double")
    assert tuple(shape.fit_circle(line, ("k0",)).first())[1:] == (0.0, 0.0, 0.0)


def test_plane_fit(spark):
    pts = spark.createDataFrame([(1, float(x), float(y), 2.0 + 0.5 * x) for x in range(4) for y in range(4)], "k0 long, x double, y double, z double")
    p = shape.fit_plane(pts, ("k0",)).first()
    assert p["d"] <= 0 and p["a"] ** 2 + p["b"] ** 2 + p["c"] ** 2 == pytest.approx(1)
    assert p["a"] / p["c"] == pytest.approx(-0.5) and p["d"] / p["c"] == pytest.approx(2)


def test_convex_hull(spark):
    pts = spark.createDataFrame([(1, float(x), float(y)) for x in range(4) for y in range(4)], "k0 long, x double, y double")
    assert [(r["x"], r["y"]) for r in shape.convex_hull(pts, ("k0",)).orderBy("k").collect()] == [(0, 0), (3, 0), (3, 3), (0, 3)]


def test_p_value():
    # 2.228 is the 5 % point of t with 10 degrees of freedom
    assert cohort._beta_tail(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-5)


def test_graph_round_trip(spark, tmp_path):
    e, n = edges(spark, (1, 2, 1, 2), (2, 3, 3, 4)), nodes(spark, 1, 2, 3)
    io.pack_graph(n, e).write.parquet(str(tmp_path / "g"))
    n2, e2 = io.read_graph(spark, str(tmp_path / "g"))
    assert sorted(n2.select(n.columns).collect()) == sorted(n.collect()) and sorted(e2.select(e.columns).collect()) == sorted(e.collect())


def test_partitions_do_not_matter(spark):
    v = spark.createDataFrame([(z, y, x, float((z * 7 + y * 5 + x * 3) % 11)) for z in range(4) for y in range(4) for x in range(4)], "z long, y long, x long, v double")
    assert sorted(neighbours.local_maxima(v.repartition(7), 3).collect()) == sorted(neighbours.local_maxima(v.coalesce(1), 3).collect())
