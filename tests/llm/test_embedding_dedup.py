"""Near-duplicate vectors against plain numpy on awkward vectors, and the bounds behind the tiles."""

from __future__ import annotations

import numpy as np
import pytest

from motiongraph.llm import embedding_dedup as ed

from ..conftest import DATA, same

SCHEMA = "n_links int, vec_id long, embedding array<double>, v string, cid int"


def expected(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for d in {len(rows[k][1]) for k in good}:
        some = [k for k in good if len(rows[k][1]) == d]
        u = ed.units(np.array([rows[k][1] for k in some], float))
        for p, q in zip(*np.nonzero(u @ u.T >= threshold)):
            if p != q:
                links[some[p]].add(some[q])
        for k in some:  # equal vectors, whatever rounding says
            links[k] |= {m for m in some if m != k and rows[m][1] == rows[k][1]}
    out, comp = [], {}
    for k in links:
        if k in comp:
            continue
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        comp |= dict.fromkeys(seen, least)
    for k, (i, _) in enumerate(rows):
        out.append((i, len(links[k]), comp[k], i == comp[k]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(1, i, v, "extra", 2) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((40, 16))
    vs = [(centre[i % 40] + 0.28 * rng.standard_normal(16)).tolist() for i in range(500)]  # many cosines near 0.95
    chain = [[float(np.cos(0.3 * k)), float(np.sin(0.3 * k)), 0.0] for k in range(12)]  # each near the one before
    rows = [(i, v) for i, v in enumerate(vs)] + [(1000 - k, v) for k, v in enumerate(chain)]
    rows += [(600 + i, vs[3]) for i in range(50)] + [(700, [2 * x for x in vs[3]]), (701, [-x for x in vs[3]]), (702, [1e300 * x for x in vs[3]]), (703, [1e-300 * x for x in vs[3]])]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [float("inf")] * 16), (805, [None] * 16), (None, vs[5]), (None, None), (5, vs[5]), (5, vs[5]), (6, vs[90])]
    rows += [(None, [5.0, -5.0]), (None, [5.0, -5.0]), (810, [0.0, -0.0, 3.0, 1.0]), (811, [0.0, 0.0, 3.0, 1.0])]
    return rows


def test_equals_numpy(spark, rows):
    assert found(ed.near_vectors(table(spark, rows).repartition(3))) == expected(rows)


def test_small_blocks_and_other_threshold(spark, rows, monkeypatch):
    monkeypatch.setattr(ed, "ROWS", 31)
    monkeypatch.setattr(ed, "STRIP", 7)
    monkeypatch.setattr(ed, "GATHERED", 100)
    assert found(ed.near_vectors(table(spark, rows), threshold=0.8)) == expected(rows, 0.8)


def test_long_vectors_and_empty_table(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((5, 1500))
    wide = [(i, (base[i % 5] + 0.31 * rng.standard_normal(1500)).tolist()) for i in range(40)]
    assert found(ed.near_vectors(table(spark, wide))) == expected(wide)
    assert found(ed.near_vectors(table(spark, []))) == []
    with pytest.raises(ValueError):
        ed.near_vectors(table(spark, []), threshold=0)


def test_bounds_hold_and_few_pairs_are_open():
    rng = np.random.default_rng(10)
    u = ed.units(rng.standard_normal((300, 64)) + 2 * rng.standard_normal(64))
    q, scale, size, left = ed.quantised(u)
    off = size[:, None] * left + left[:, None]
    near = scale[:, None] * scale * (q.astype(float) @ q.T)
    assert (np.abs(u @ u.T - near) <= off + 1e-12).all()
    assert off.max() < 0.03


def test_tiles_of_far_blocks_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(ed, "ROWS", 40)
    rng = np.random.default_rng(11)
    centre = ed.units(rng.standard_normal((6, 32)))
    rows = [(i, (centre[i % 6] + 0.02 * rng.standard_normal(32)).tolist()) for i in range(300)]
    seen = []
    real = ed._tiles
    monkeypatch.setattr(ed, "_tiles", lambda blocks, t: seen.append((blocks.count(), real(blocks, t).count())) or real(blocks, t))
    assert found(ed.near_vectors(table(spark, rows))) == expected(rows)
    blocks, tiles = seen[0]
    assert blocks <= tiles < blocks * (blocks + 1) // 2


def test_merged_roots():
    rng = np.random.default_rng(12)
    for _ in range(50):
        n = 60
        u, v = rng.integers(0, n, 50), rng.integers(0, n, 50)
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(u, v):
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        assert ed.merged(np.arange(n), u, v).tolist() == label.tolist()


def test_query_equals_sql(spark, duck):
    same(ed.op11_embedding_dedup(spark, f"{DATA}/sf0.001"), duck.execute(ed.OP11_SQL).df())
