"""Queries over voxel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import graph as gr
from ..operators import neighbours as op
from ..sources import tables as t
from .registry import query, r

NEAR = "nb AS (SELECT a.z, a.y, a.x, a.v, max(b.v) AS near, bool_or(b.v < a.v) AS smaller, bool_or(b.v > 60000) AS strong FROM voxel a JOIN (SELECT z + i AS z, y + j AS y, x + k AS x, v FROM voxel, range(-1, 2) r1(i), range(-1, 2) r2(j), range(-1, 2) r3(k) WHERE NOT (i = 0 AND j = 0 AND k = 0)) b ON a.z = b.z AND a.y = b.y AND a.x = b.x WHERE a.v > 60000 GROUP BY ALL)"


@query("j1_local_maxima", "voxel", f"{NEAR} SELECT z, y, x, {r(v='v')} FROM nb WHERE v >= near AND smaller")
def j1(spark, d):
    return op.local_maxima(t.voxel(spark, d), 60000)


@query("j2_dense_seeds", "voxel", f"{NEAR} SELECT z, y, x, {r(v='v')} FROM nb WHERE strong")
def j2(spark, d):
    return op.dense_seeds(t.voxel(spark, d), 60000)


@query("j3_suppress_adjacent")
def j3(spark, d):
    return gr.suppress_adjacent(op.dense_seeds(t.voxel(spark, d), 60000))


@query("j28_carve", "voxel", f"b AS (SELECT DISTINCT z + i AS z, y + j AS y, x + k AS x FROM voxel, range(-1, 2) r1(i), range(-2, 3) r2(j), range(-2, 3) r3(k) WHERE v > 90000) SELECT v.z, v.y, v.x, {r(v='CASE WHEN b.z IS NOT NULL THEN 0 ELSE v END')} FROM voxel v LEFT JOIN b ON v.z = b.z AND v.y = b.y AND v.x = b.x")
def j28(spark, d):
    v = t.voxel(spark, d)
    return op.carve(v, v.filter("v > 90000"), 2, 1)


def _iso(axis: str) -> str:
    on = " AND ".join(f"b.{a} = a.{a}{' + 1' if a == axis else ''}" for a in "zyx")
    return f"SELECT '{axis}' AS axis, a.z, a.y, a.x, {r(at=f'a.{axis} + (50000 - a.v) / (b.v - a.v)')} FROM voxel a JOIN voxel b ON {on} WHERE (a.v < 50000) <> (b.v < 50000)"


@query("j29_isosurface_points", "voxel", " UNION ALL ".join(map(_iso, "zyx")))
def j29(spark, d):
    return op.isosurface_points(t.voxel(spark, d), 50000.0)


def _tap(axis: str, s: int) -> str:
    return " AND ".join(f"{{n}}.{a} = p.{a}{f' {s:+d}' if a == axis else ''}" for a in "zyx")


_SUB = " ".join(f"LEFT JOIN voxel {n}{a} ON {_tap(a, s).format(n=n + a)}" for a in "zyx" for n, s in (("l", -1), ("h", 1)))


@query("w29_subpixel", "voxel", f"p AS (SELECT * FROM voxel WHERE v > 80000) SELECT p.z, p.y, p.x, {r(**{f'd{a}': f'coalesce(CASE WHEN abs(0.5 * (l{a}.v - h{a}.v) / nullif(l{a}.v - 2 * p.v + h{a}.v, 0)) <= 1 THEN 0.5 * (l{a}.v - h{a}.v) / nullif(l{a}.v - 2 * p.v + h{a}.v, 0) END, 0)' for a in 'zyx'})} FROM p {_SUB}")
def w29(spark, d):
    v = t.voxel(spark, d)
    return op.subpixel(v.filter("v > 80000").select("z", "y", "x"), v)


_KERNEL = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in op.kernel(1.5))


@query("w16_gaussian_filter", "voxel", f"k(k, w) AS (VALUES {_KERNEL}), s AS (SELECT z, y, x - k AS x, sum(v * w) AS g FROM voxel, k GROUP BY 1, 2, 3) SELECT voxel.z, voxel.y, voxel.x, {r(v='g')} FROM voxel JOIN s ON voxel.z = s.z AND voxel.y = s.y AND voxel.x = s.x")
def w16(spark, d):
    return op.gaussian_filter(t.voxel(spark, d), 1.5, "x", ("z", "y"))


@query("v18_needle_points")
def v18(spark, d):
    return op.needle_points(t.voxel(spark, d), 1.0, 1e6, ("z",))


@query("w30_band_peaks", "voxel", f"SELECT z, CAST(y // 5 AS BIGINT) AS band, arg_max(y, (v, -y, -x)) AS y, arg_max(x, (v, -y, -x)) AS x, {r(v='max(v)')} FROM voxel WHERE v > 50000 GROUP BY 1, 2")
def w30(spark, d):
    return op.band_peaks(t.voxel(spark, d), 5, 50000, ("z",))


@query("a44_path_min", "voxel path", f"p AS (SELECT path_id, CAST(floor(10 + 20 * z) AS BIGINT) AS z, CAST(floor(15 + 20 * y) AS BIGINT) AS y, CAST(floor(15 + 20 * x) AS BIGINT) AS x FROM path) SELECT path_id, {r(strength='min(v)')} FROM p JOIN voxel USING (z, y, x) GROUP BY 1")
def a44(spark, d):
    p = t.path(spark, d).select("path_id", *[F.floor(o + 20 * F.col(a)).cast("long").alias(a) for a, o in (("z", 10), ("y", 15), ("x", 15))])
    return op.path_min(p, t.voxel(spark, d))


@query("a42_drop_outlier_seeds", "voxel", f"m AS (SELECT z, avg(v) AS a, stddev_pop(v) AS s FROM voxel GROUP BY 1) SELECT voxel.z, y, x, {r(v='v')} FROM voxel JOIN m ON voxel.z = m.z WHERE NOT (v - a > 1.5 * s AND v >= 2200)")
def a42(spark, d):
    from ..operators import cohort

    return cohort.drop_outlier_seeds(t.voxel(spark, d), ("z",), 1.5, 2200)


@query("p1_index_to_world", "voxel", f"SELECT {r(z='z * 0.5 + 1', y='y * 0.7 + 2', x='x * 0.7 + 3', v='v')} FROM voxel")
def p1(spark, d):
    return op.index_to_world(t.voxel(spark, d), (0.5, 0.7, 0.7), (1.0, 2.0, 3.0))


@query("p2_world_to_index", "path", "SELECT path_id, idx, CAST(trunc(0.5 + (x - 0.1) / 0.03) AS INTEGER) AS x, CAST(trunc(0.5 + (y - 0.1) / 0.03) AS INTEGER) AS y, CAST(trunc(0.5 + (z - 0.1) / 0.05) AS INTEGER) AS z FROM path")
def p2(spark, d):
    return op.world_to_index(t.path(spark, d), (0.05, 0.03, 0.03), (0.1, 0.1, 0.1))


@query("p3_soft_limit", "voxel", f"SELECT z, y, x, {r(v='-3000 * (exp(-v / 3000) - 1)', one='1 - exp(-v / 50000)')} FROM voxel")
def p3(spark, d):
    return t.voxel(spark, d).select("z", "y", "x", vec.soft_limit(F.col("v"), 3000.0).alias("v"), vec.soft_limit(F.col("v") / 50000, 1).alias("one"))


@query("p4_cutoff", "voxel", f"SELECT z, y, x, {r(v='least(v, 55000)')} FROM voxel")
def p4(spark, d):
    return t.voxel(spark, d).select("z", "y", "x", vec.cutoff(F.col("v"), 55000).alias("v"))


@query("p5_threshold_mask", "voxel", f"e AS (SELECT min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM voxel) SELECT z, y, x, {r(v='v')} FROM voxel, e WHERE v > 60000 AND z BETWEEN z0 + 5 AND z1 - 5 AND y BETWEEN y0 + 5 AND y1 - 5 AND x BETWEEN x0 + 5 AND x1 - 5")
def p5(spark, d):
    return op.threshold_mask(t.voxel(spark, d), 60000, 5)


@query("p6_upper_threshold", "voxel", f"SELECT z, y, x, {r(v='v')} FROM voxel WHERE v < 70000")
def p6(spark, d):
    return t.voxel(spark, d).filter("v < 70000")


@query("p7_cost", "voxel", f"SELECT z, y, x, {r(cost='1 / pow(2, v / 20000)', back='log2(1 / (1 / pow(2, v / 20000))) * 20000')} FROM voxel")
def p7(spark, d):
    c = vec.to_cost(F.col("v"), 20000.0)
    return t.voxel(spark, d).select("z", "y", "x", c.alias("cost"), vec.from_cost(c, 20000.0).alias("back"))


@query("s2_check_phases", "voxel_phase", "e AS (SELECT phase, max(z) - min(z) + 1 AS a, max(y) - min(y) + 1 AS b, max(x) - min(x) + 1 AS c FROM voxel_phase GROUP BY 1) SELECT count(*) AS phases, count(*) = 10 AND count(DISTINCT (a, b, c)) = 1 AS complete FROM e")
def s2(spark, d):
    return op.check_phases(t.voxel_phase(spark, d))


@query("s9_crop", "voxel", f"SELECT z - 2 AS z, y - 5 AS y, x - 1 AS x, {r(v='v')} FROM voxel WHERE z BETWEEN 2 AND 9 AND y BETWEEN 5 AND 19 AND x BETWEEN 1 AND 11")
def s9(spark, d):
    """Nested crops compose by adding offsets."""
    return op.crop(op.crop(t.voxel(spark, d), {"z": (1, 15), "y": (2, 25), "x": (0, 20)}), {"z": (1, 9), "y": (3, 18), "x": (1, 12)})


@query("s10_average_phases", "voxel_phase", f"SELECT z, y, x, {r(v='avg(v)')} FROM voxel_phase WHERE phase >= 7 OR phase <= 2 GROUP BY 1, 2, 3")
def s10(spark, d):
    return op.average_phases(t.voxel_phase(spark, d), 7, 2)


@query("s11_mean_volume", "voxel_phase", f"SELECT z, y, x, {r(v='avg(v)')} FROM voxel_phase GROUP BY 1, 2, 3")
def s11(spark, d):
    return op.mean_volume(t.voxel_phase(spark, d))
