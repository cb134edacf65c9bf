"""Greatest change of pairs by blocks, nearest in crowded cells, angles at nodes: against all pairs in numpy."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiongraph.operators import motion, nearest

from .test_operators import edges


def test_greatest_change_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a = {k: rng.normal(size=(60, 1, 3)) + rng.gamma(0.3, 1, (60, 1, 1)) * rng.normal(size=(60, 4, 3)) for k in "pq"}
    b = {k: rng.normal(size=(70, 1, 3)) + rng.gamma(0.3, 1, (70, 1, 1)) * rng.normal(size=(70, 4, 3)) for k in "pqr"}
    a["still"], b["still"] = np.ones((3, 4, 3)), np.zeros((2, 4, 3))  # ties at no change
    frame = lambda d: spark.createDataFrame([(k, i, p, *map(float, m[i, p])) for k, m in d.items() for i in range(len(m)) for p in range(4)], "k string, idx long, phase long, x double, y double, z double")
    real = nearest._best_of_tiles
    count = spark.sparkContext.accumulator(0)

    def counted(keys, n):
        run = real(keys, n)

        def wrapped(batches):
            for x in batches:
                count.add(x.num_rows)
                yield from run([x])

        return wrapped

    monkeypatch.setattr(nearest, "_best_of_tiles", counted)
    got = {r["k"]: (r["change"], r["idx_a"], r["idx_b"]) for r in nearest.max_pair_pulsatility(frame(a), frame(b), ("k",), block=4).collect()}
    assert set(got) == {"p", "q", "still"}
    for k in got:
        d = np.sqrt(((a[k][:, None] - b[k][None]) ** 2).sum(-1))
        change = d.max(-1) - d.min(-1)
        i, j = np.unravel_index(change.argmax(), change.shape)
        assert got[k] == (pytest.approx(change[i, j], rel=1e-12), i, j)
    assert count.value < 2 * 15 * 18 / 2  # most pairs of blocks cannot reach it


def test_crowded_cells_are_halved(spark):
    rng = np.random.default_rng(9)
    pts = np.concatenate((rng.normal(0, 0.01, (800, 3)), rng.normal(0, 3, (40, 3)), np.zeros((300, 3))))
    others = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "idx long, x double, y double, z double")
    assert nearest._uncrowded(others.filter("x <> 0"), 0.5) < 0.02
    mine = others.withColumn("x", F.col("x") + 0.03)
    d = np.sqrt((((pts + [0.03, 0, 0])[:, None] - pts[None]) ** 2).sum(-1))
    got = {r["idx"]: (r["near"], r["d"]) for r in nearest.nearest_in_grid(mine, others, 0.5).collect()}
    assert got == {i: (int(row.argmin()), pytest.approx(row.min(), rel=1e-9)) for i, row in enumerate(d)}


def test_angles_of_arms(spark):
    rng = np.random.default_rng(10)
    links = {tuple(sorted(map(int, p))) for p in rng.integers(0, 12, (30, 2))}
    e = edges(spark, *[(a, b, 1, 1) for a, b in links])
    at, move = rng.normal(size=(12, 3)), rng.normal(0, 0.3, (12, 3, 3))
    node = spark.createDataFrame([("s", i, *map(float, at[i])) for i in range(12)], "scan_id string, node_id long, x double, y double, z double")
    moves = spark.createDataFrame([("s", i, p, *map(float, move[i, p])) for i in range(12) for p in range(3) if (i, p) != (4, 2)], "scan_id string, node_id long, phase long, dx double, dy double, dz double")
    angle = lambda u, v: np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1)))
    want = {}
    for n in range(12):
        near = sorted({x for l in links if n in l for x in l} - {n})
        for p, (a, b) in itertools.product(range(3), itertools.combinations(near, 2)):
            if p == 2 and 4 in (n, a, b):
                continue
            now = at + move[:, p]
            change = abs(angle(now[a] - now[n], now[b] - now[n]) - angle(at[a] - at[n], at[b] - at[n]))
            want[n] = max(want.get(n, 0), change)
    df = motion.node_angle_change(e, node, moves)
    assert {r["node_id"]: r["change"] for r in df.collect()} == pytest.approx(want)


def test_arms_go_to_their_node_once(spark):
    """Not once a phase; repeated rows of a phase and places that coincide count as before."""
    e = edges(spark, *[(0, k, 1, 1) for k in (1, 2, 3, 4)], (5, 6, 1, 1), (5, 7, 1, 1))
    at = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 2), (0, 0, 0), (9, 9, 9), (9, 9, 9), (8, 9, 9)]
    node = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(at)], "scan_id string, node_id long, x double, y double, z double")
    move = [("s", i, p, 0.0, float(i == 1 and p), 0.0) for i in range(8) for p in range(40)] + [("s", 1, 3, -1.0, -1.0, 0.0), ("s", 2, 3, None, 0.0, 0.0)]
    moves = spark.createDataFrame(move, "scan_id string, node_id long, phase long, dx double, dy double, dz double")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = motion.node_angle_change(e, node, moves)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert {r["node_id"]: r["change"] for r in df.collect()} == {0: pytest.approx(90.0), 5: None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("phase" in line for line in dealt)
