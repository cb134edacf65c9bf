"""Hard negatives against plain Python on awkward vectors, and the intervals against exact products."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from motiongraph.llm import hard_negatives as hn

from ..conftest import DATA, same

SCHEMA = "label int, vec_id long, embedding array<double>, id string, score int"


def expected(rows, every=10, scale=256, positives=5, negatives=3, low=50, high=95):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(scale * x) for x in v):
            continue
        if i not in best or (label, [scale * x for x in v]) < best[i][:2]:
            best[i] = (label, [scale * x for x in v], [math.floor(scale * x) for x in v])
    out = []
    for a, (la, _, va) in best.items():
        if a % every:
            continue
        near = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(va, v)))), i, lab) for i, (lab, _, v) in best.items() if i != a and len(v) == len(va))
        for s, p, _ in [x for x in near if x[2] == la][:positives]:
            s = -s
            hits = [(-t, n) for t, n, lab in near if lab != la and low * s <= 100 * -t <= high * s]
            out += [(a, p, r, n, s, t) for r, (t, n) in enumerate(hits[:negatives], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(spark, rows):
    return spark.createDataFrame([(lab, i, v, "extra", 1) for i, lab, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 24))
    out = [(i, int(rng.integers(4)), (centre[i % 6] * rng.uniform(0.2, 1) + 0.6 * rng.standard_normal(24)).tolist()) for i in range(400)]
    out += [(400 + i, i % 3, out[7][2]) for i in range(60)]  # copies: ties
    out += [(460 + i, 1, [0.0] * 24) for i in range(3)] + [(470, 2, [-x for x in out[0][2]])]
    out += [(480 + i, i % 2, [0.1 * (i + 1), 1.0, -0.5]) for i in range(20)] + [(510 + i, i % 2, []) for i in range(11)]
    out += [(None, 1, out[0][2]), (530, None, out[0][2]), (540, 1, None), (550, 1, [None] * 24), (560, 1, [float("nan")] * 24), (570, 1, [float("inf")] + [0.0] * 23)]
    out += [out[10], out[10], (20, 3, out[21][2]), (20, 0, out[22][2])]
    return out


@pytest.mark.parametrize("levels", [1, 4])
def test_equals_plain_python(spark, rows, levels):
    assert found(hn.mine_negatives(table(spark, rows).repartition(3), F.col("id") % 10 == 0, levels=levels)) == expected(rows)


def test_other_parameters_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 37)
    monkeypatch.setattr(hn, "ANCHORS", 11)
    monkeypatch.setattr(hn, "HELD", 2)
    got = found(hn.mine_negatives(table(spark, rows), F.col("id") % 5 == 0, scale=1000, positives=2, negatives=7, low=-100, high=100))
    assert got == expected(rows, 5, 1000, 2, 7, -100, 100)


def test_long_and_large_vectors(spark):
    rng = np.random.default_rng(4)
    wide = [(i, i % 2, rng.uniform(0, 1, 1500).tolist()) for i in range(40)]
    assert found(hn.mine_negatives(table(spark, wide), F.col("id") % 10 == 0)) == expected(wide)
    large = [(i, i % 2, (rng.uniform(0, 1, 8) * 10.0 ** (i % 19)).tolist()) for i in range(60)]
    assert found(hn.mine_negatives(table(spark, large), F.col("id") % 10 == 0)) == expected(large)


def test_empty_tables(spark, rows):
    assert found(hn.mine_negatives(table(spark, []), F.col("id") % 10 == 0)) == []
    assert found(hn.mine_negatives(table(spark, rows), F.col("id") < 0)) == []


def test_intervals_hold():
    """Every exact product lies in its interval, and more codes make intervals narrower."""
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.standard_normal((500, 70)) * rng.uniform(0, 3, (500, 1)))
    q = np.floor(256 * np.concatenate((rng.standard_normal((40, 70)), rows[:9] / 256, np.zeros((1, 70)))))
    mean = []
    for levels in (1, 2, 4):
        est, off = hn.intervals(hn.planes_of(q, levels), np.linalg.norm(q, axis=1), *hn.codes_of(rows, levels), np.linalg.norm(rows, axis=1))
        assert (np.abs(q @ rows.T - est) <= off).all()
        mean.append(off.mean())
    assert mean[0] > mean[1] > mean[2]


def test_query_equals_sql(spark, duck):
    same(hn.op12_hard_negatives(spark, f"{DATA}/sf0.001"), duck.execute(hn.OP12_SQL).df())


def test_no_side_is_broadcast(spark):
    """Anchors are repeated for every group, which Spark's estimate of their size leaves out."""
    anchors, blocks = (spark.createDataFrame([(8, 1, *[b""] * 7)], hn.BLOCK) for _ in range(2))
    plan = hn._tiles(anchors, blocks, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
