"""Queries cover their whole tables, operators lose no rows."""

from __future__ import annotations

import numpy as np
import pytest

from motiongraph.operators import graph, nearest, signal
from motiongraph.operators.patterns import motion_pattern
from motiongraph.operators.motion import at_phase
from motiongraph.plans import catalog
from motiongraph.sources import tables

from .conftest import DATA
from .test_operators import edges, nodes

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name, table, times", [("s5_read_voxels", "voxel", 1), ("s12_unpivot_positions", "motion", 1), ("s13_unpivot_phases", "motion", 1), ("s16_unpivot_cohort", "motion", 0.5), ("w23_tile", "signal", 3)])
def test_no_row_is_left_out(spark, name, table, times):
    assert catalog.queries()[name](spark, SF).count() == getattr(tables, table)(spark, SF).count() * times


def test_unpivot_signal_gives_the_signal(spark):
    whole = tables.signal(spark, f"{DATA}/sf0.01").selectExpr("source", "idx", "round(t, 6) AS t", "round(value, 6) AS value")
    got = catalog.queries()["s14_unpivot_signal"](spark, f"{DATA}/sf0.01")
    assert got.count() == whole.count() and got.exceptAll(whole).isEmpty()


def test_resample_reaches_the_end(spark):
    got = {r["source"]: r["t"] for r in catalog.queries()["j25_resample"](spark, SF).filter("k = 49").collect()}
    ends = {r["source"]: r["t"] for r in tables.signal(spark, SF).groupBy("source").agg({"t": "max"}).toDF("source", "t").collect()}
    assert got == pytest.approx(ends)


def test_max_pair_over_all_points(spark):
    p = at_phase(tables.path(spark, SF), tables.motion(spark, SF)).toPandas().sort_values(["path_id", "idx", "phase"])
    rings = {k: g[["x", "y", "z"]].to_numpy().reshape(-1, 10, 3) for k, g in p.groupby("path_id")}
    want = {}
    for k, a in rings.items():
        if k + 1 in rings:
            d = np.linalg.norm(a[:, None] - rings[k + 1][None], axis=-1)
            change = d.max(axis=-1) - d.min(axis=-1)
            i, j = np.unravel_index(change.argmax(), change.shape)
            want[k] = (i, j, round(change.max(), 6))
    got = {r["path_id"]: (r["idx_a"], r["idx_b"], r["change"]) for r in catalog.queries()["j8_max_pair_pulsatility"](spark, SF).collect()}
    assert got == want


def test_dominant_line_above_forty(spark):
    """A high line beats a weaker low one; lengths that are prime, odd, even, two."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for n, high in ((1009, 411), (600, 300), (257, 128), (1024, 77), (2, 1)):
        i = np.arange(n)
        v = 50 + 3 * np.cos(2 * np.pi * high * i / n) + 2 * np.cos(2 * np.pi * 5 * i / n) + rng.normal(0, 0.1, n)
        lines = np.abs(np.fft.fft(v))[1 : n // 2 + 1]
        want[f"s{n}"] = (1 + int(lines.argmax())) * 20.0 / n
        rows += [(f"s{n}", int(k), float(x)) for k, x in zip(i, v)]
    got = signal.dominant_frequency(spark.createDataFrame(rows, "source string, idx long, value double"), 20.0).collect()
    assert {r["source"]: r["frequency"] for r in got} == pytest.approx(want)


def test_spectrum_is_that_of_numpy(spark):
    x = np.random.default_rng(5).normal(size=(32, 2))
    f = signal._fourier(spark.createDataFrame([("s", 32, j, float(a), float(b)) for j, (a, b) in enumerate(x)], "source string, size long, j long, rex double, imx double"), ("source",), ("x",))
    got = f.orderBy("j").toPandas()
    assert np.allclose(got.rex + 1j * got.imx, np.fft.fft(x[:, 0] + 1j * x[:, 1]))


def test_grid_reaches_far_points(spark):
    """Points thousands of cells away, without partner, with null coordinates."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(60, 3))
    a[:3] += [[5000, 0, 0], [0, -900, 40], [70, 70, 70]]
    frame = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "idx long, x double, y double, z double")
    lost = spark.createDataFrame([(99, None, 0.0, 0.0)], "idx long, x double, y double, z double")
    got = {r["idx"]: (r["near"], r["d"]) for r in nearest.nearest_in_grid(frame(a).union(lost), frame(b), 0.2).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=-1)
    assert got.pop(99) == (None, None)
    assert got == {i: (int(d[i].argmin()), pytest.approx(d[i].min())) for i in range(40)}
    assert [tuple(r) for r in nearest.nearest_in_grid(frame(a[3:5]), frame(b).limit(0), 0.2).orderBy("idx").collect()] == [(0, None, None), (1, None, None)]


def test_motion_pattern(spark):
    """Peak and half widths, the extra peak in shares of the period, no sample at its end."""
    rows = motion_pattern(spark.createDataFrame([(2.0,)], "amplitude double"), 0.8, 20, 0.35, (0.5, 0.7, 0.05)).orderBy("k").collect()
    u = np.arange(20) / 20
    want = np.exp(-(((u - 0.35) / np.where(u < 0.35, 0.14, 0.26)) ** 2) / 2) + 0.5 * np.exp(-(((u - 0.7) / 0.05) ** 2) / 2)
    assert np.allclose([r["value"] for r in rows], 2 * want) and np.allclose([r["t"] for r in rows], 0.8 * u)
