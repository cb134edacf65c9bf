"""Nearest and k nearest by cells, hulls of partial hulls, blocked transforms: against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from motiongraph.operators import nearest, shape, signal


@pytest.fixture(scope="module")
def clouds(spark):
    """Two keys: one even, one with a dense clump, copies and far points; ties in index order."""
    rng = np.random.default_rng(4)
    a = {"even": rng.uniform(-3, 3, (150, 3)), "clump": np.concatenate((rng.normal(0, 1e-3, (90, 3)), rng.normal(0, 50, (20, 3)), np.zeros((5, 3))))}
    b = {"even": rng.uniform(-3, 3, (200, 3)), "clump": np.concatenate((rng.normal(0, 1e-3, (300, 3)), rng.normal(0, 50, (12, 3)), np.zeros((9, 3)), [[1e4, 0, 0]]))}
    b["same"], a["same"] = np.ones((90, 3)), np.ones((4, 3))
    frame = lambda d: spark.createDataFrame([(k, i, *map(float, p)) for k, m in d.items() for i, p in enumerate(m)], "k string, idx long, x double, y double, z double")
    return a, b, frame(a), frame(b)


@pytest.mark.parametrize("k", [1, 4])
def test_k_nearest_in_cells(clouds, k):
    a, b, da, db = clouds
    for most in (0, 1 << 24):
        got = {}
        for r in nearest.k_nearest(da, db, ("k",), k, most_pairs=most).collect():
            got.setdefault((r["k"], r["idx"]), []).append((r["rank"], r["near"], r["d"]))
        assert len(got) == sum(map(len, a.values()))
        for name in a:
            d = np.sqrt(((a[name][:, None] - b[name][None]) ** 2).sum(-1))
            for i, row in enumerate(d):
                want = np.lexsort((np.arange(len(row)), row))[:k]
                have = sorted(got[name, i])
                assert [h[0] for h in have] == list(range(1, k + 1))
                assert [h[2] for h in have] == pytest.approx(row[want].tolist(), rel=1e-12, abs=1e-15)
                if len(set(np.round(row[np.lexsort((np.arange(len(row)), row))[: k + 1]], 12))) == min(k + 1, len(row)):
                    assert [h[1] for h in have] == want.tolist()
        assert [h[1] for h in sorted(got["same", 2])] == list(range(k))


def test_bands_by_cells(clouds, spark):
    a, _, da, _ = clouds
    pairs = {(r["k"], r["idx"], r["oidx"]) for r in nearest.within(da, da, ("k",), 0.7).filter("pow(x - ox, 2) + pow(y - oy, 2) + pow(z - oz, 2) < 0.49").collect()}
    want = {(n, i, j) for n, m in a.items() for i, j in zip(*np.nonzero(((m[:, None] - m[None]) ** 2).sum(-1) < 0.49))}
    assert pairs == want


def plain_hull(points):
    """Gift wrapping: corners only, counter-clockwise from the smallest."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts
    out, at = [], pts[0]
    while not out or at != out[0]:
        out.append(at)
        best = pts[0] if pts[0] != at else pts[1]
        for p in pts:
            turn = (best[0] - at[0]) * (p[1] - at[1]) - (best[1] - at[1]) * (p[0] - at[0])
            far = (p[0] - at[0]) ** 2 + (p[1] - at[1]) ** 2 > (best[0] - at[0]) ** 2 + (best[1] - at[1]) ** 2
            if p != at and (turn < 0 or turn == 0 and far):
                best = p
        at = best
    return out


def test_hulls_of_partial_hulls(spark):
    rng = np.random.default_rng(6)
    sets = {"disc": rng.normal(size=(900, 2)), "grid": np.array([(x, y) for x in range(12) for y in range(9)], float), "line": np.array([(i, 2.0 * i) for i in range(30)]), "one": np.ones((5, 2)), "circle": np.array([(np.cos(t), np.sin(t)) for t in np.linspace(0, 6, 200)])}
    df = spark.createDataFrame([(k, *map(float, p)) for k, m in sets.items() for p in m] + [("disc", None, 1.0)], "name string, x double, y double")
    for share in (1 << 16, 40):
        got = {}
        for r in shape.convex_hull(df, ("name",), share).orderBy("k").collect():
            got.setdefault(r["name"], []).append((r["x"], r["y"]))
        for name, m in sets.items():
            assert got[name] == (plain_hull(m) if name != "line" else [(0.0, 0.0), (29.0, 58.0)])
    assert shape.convex_hull(df.limit(0), ("name",)).collect() == []


def test_blocked_transforms(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(2, 64, 2))
    df = spark.createDataFrame([(f"s{k}", 64, j, float(a), float(b)) for k in range(2) for j, (a, b) in enumerate(x[k])], "source string, size long, j long, rex double, imx double")
    for block in (1, 24, 1 << 17):
        monkeypatch.setattr(signal, "BLOCK", block)
        got = signal._fourier(df, ("source",), ("x",)).orderBy("source", "j").toPandas()
        for k in range(2):
            g = got[got.source == f"s{k}"]
            assert np.allclose(g.rex + 1j * g.imx, np.fft.fft(x[k, :, 0] + 1j * x[k, :, 1]))
