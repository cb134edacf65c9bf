"""Arms of fixed length against all pairs, with points and blocks so small that every step is taken."""

from __future__ import annotations

import numpy as np
import pytest

from motiongraph.operators import paths


@pytest.mark.parametrize("near,block", [(2, 4), (16, 256)])
def test_first_points_beyond_the_arm(spark, monkeypatch, near, block):
    monkeypatch.setattr(paths, "NEAR", near)
    monkeypatch.setattr(paths, "BLOCK", block)
    rng = np.random.default_rng(3)
    lines = {"slow": np.cumsum(rng.normal(0, 0.02, (150, 3)), 0), "wild": rng.normal(0, 0.15, (90, 3)), "still": np.ones((40, 3)), "one": np.ones((1, 3))}
    lines["late"] = np.concatenate((np.zeros((70, 3)), np.ones((1, 3)), np.zeros((9, 3))))
    df = spark.createDataFrame([(k, 3 * i, *map(float, p)) for k, m in lines.items() for i, p in enumerate(m)], "path_id string, idx long, x double, y double, z double")
    place = lambda p: p and (p["x"], p["y"], p["z"])
    got = {(r["path_id"], r["idx"] // 3): (place(r["before"]), place(r["after"])) for r in paths._reach(df, 0.3, ("path_id",)).collect()}
    assert len(got) == sum(map(len, lines.values()))
    for k, m in lines.items():
        far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) >= 0.3
        for i in range(len(m)):
            before, after = np.flatnonzero(far[i, :i]), np.flatnonzero(far[i, i + 1 :])
            assert got[k, i] == (tuple(m[before[-1]]) if len(before) else None, tuple(m[i + 1 + after[0]]) if len(after) else None)


def test_pairs_stay_few(spark):
    """No join of a path with itself."""
    df = spark.range(400).selectExpr("0 AS path_id", "id AS idx", "id * 0.1 AS x", "0D AS y", "0D AS z")
    plan = paths._reach(df, 0.2, ("path_id",))._jdf.queryExecution().optimizedPlan().toString()
    assert "sqrt" not in plan.lower()  # distances were taken before, among close points
