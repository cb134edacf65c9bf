"""Queries over ordered paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motion as mo
from ..operators import paths as op
from ..sources import tables as t
from .registry import query, r

W = "OVER (PARTITION BY path_id ORDER BY idx)"
D = "sqrt(pow(x - lag(x) {w}, 2) + pow(y - lag(y) {w}, 2) + pow(z - lag(z) {w}, 2))"
STEP = f"s AS (SELECT *, coalesce({D.format(w=W)}, 0) AS d, count(*) OVER (PARTITION BY path_id) AS n FROM path)"


def _grad(c: str, part: str = "path_id") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY idx)"
    return f"CASE WHEN lag({c}) {w} IS NULL THEN lead({c}) {w} - {c} WHEN lead({c}) {w} IS NULL THEN {c} - lag({c}) {w} ELSE (lead({c}) {w} - lag({c}) {w}) / 2.0 END"


def curv_sql(src: str, part: str) -> str:
    """Expressions ending in c(…, curvature) for a table of points."""
    g1 = ", ".join(f"{_grad(a, part)} AS g{a}" for a in "xyz")
    g2 = ", ".join(f"{_grad('g' + a, part)} AS h{a}" for a in "xyz")
    return f"""g1 AS (SELECT *, {g1} FROM {src}), g2 AS (SELECT *, {g2} FROM g1),
    c AS (SELECT *, coalesce(sqrt(pow(gy * hz - gz * hy, 2) + pow(gz * hx - gx * hz, 2) + pow(gx * hy - gy * hx, 2)) / nullif(pow(sqrt(gx * gx + gy * gy + gz * gz), 3), 0), 0) AS curvature FROM g2)"""


@query("w1_path_length", "path", f"{STEP} SELECT path_id, {r(length='sum(d)')} FROM s GROUP BY 1")
def w1(spark, d):
    return op.path_length(t.path(spark, d))


@query("w1_length_along", "path", f"{STEP} SELECT path_id, idx, {r(along='sum(d) OVER (PARTITION BY path_id ORDER BY idx)')} FROM s")
def w1_along(spark, d):
    return op.length_along(t.path(spark, d)).select("path_id", "idx", "along")


@query("w2_rel_index", "path", f"SELECT path_id, idx, {r(percent='100.0 * idx / (count(*) OVER (PARTITION BY path_id) - 1)')} FROM path")
def w2(spark, d):
    return op.rel_index(t.path(spark, d)).select("path_id", "idx", "percent")


def _smooth_sql(closed: bool) -> str:
    n = "count(*) OVER (PARTITION BY path_id)"
    out = []
    for a in "xyz":
        if closed:
            second, before_last = f"max(CASE WHEN idx = 1 THEN {a} END) OVER (PARTITION BY path_id)", f"max(CASE WHEN idx = n - 2 THEN {a} END) OVER (PARTITION BY path_id)"
            out.append(f"(coalesce(lag({a}) {W}, {before_last}) + {a} + coalesce(lead({a}) {W}, {second})) / 3.0 AS {a}")
        else:
            out.append(f"coalesce((lag({a}) {W} + {a} + lead({a}) {W}) / 3.0, {a}) AS {a}")
    return f"SELECT path_id, idx, n, {', '.join(out)} FROM (SELECT *, {n} AS n FROM {{src}})"


@query("w3_smooth_open", "path", f"a AS ({_smooth_sql(False).format(src='path')}), b AS ({_smooth_sql(False).replace('path_id, idx, n,', 'path_id, idx,').format(src='(SELECT path_id, idx, x, y, z FROM a)')}) SELECT path_id, idx, {r(x='x', y='y', z='z')} FROM b")
def w3(spark, d):
    return op.smooth_open(t.path(spark, d), 2)


@query("w4_smooth_closed", "path", f"a AS ({_smooth_sql(True).format(src='path')}) SELECT path_id, idx, {r(x='x', y='y', z='z')} FROM a")
def w4(spark, d):
    return op.smooth_closed(t.path(spark, d), 1)


@query("w5_gradient", "path", f"SELECT path_id, idx, {r(dx=_grad('x'), dz=_grad('z'))} FROM path")
def w5(spark, d):
    return op.gradient(t.path(spark, d), ("x", "z")).select("path_id", "idx", "dx", "dz")


@query("w6_curvature", "path", f"{curv_sql('path', 'path_id')} SELECT path_id, idx, {r(curvature='10 * curvature')} FROM c")
def w6(spark, d):
    return op.curvature(t.path(spark, d), scale=10.0).select("path_id", "idx", "curvature")


def _corner_sql(th: int, sigma: float) -> str:
    import math

    u = lambda a: f"{a} - lag({a}, {th}) {W}"
    v = lambda a: f"lead({a}, {th}) {W} - {a}"
    dots = " + ".join(f"({u(a)}) * ({v(a)})" for a in "xyz")
    nu, nv = ("sqrt(" + " + ".join(f"pow({f(a)}, 2)" for a in "xyz") + ")" for f in (u, v))
    raw = f"CASE WHEN lag(x, {th}) {W} IS NOT NULL AND lead(x, {th}) {W} IS NOT NULL THEN coalesce(degrees(acos(least(greatest(({dots}) / nullif({nu} * {nv}, 0), -1), 1))), 0) END"
    at = {k: f"lag(raw, {-k}) {W}" if k < 0 else f"lead(raw, {k}) {W}" for k in range(-math.ceil(3 * sigma), math.ceil(3 * sigma) + 1)}
    at = {k: f"lag(raw, {abs(k)}) {W}" if k < 0 else (f"lead(raw, {k}) {W}" if k else "raw") for k in at}
    g = {k: repr(math.exp(-0.5 * (k / sigma) ** 2)) + "::DOUBLE" for k in at}
    total = " + ".join(f"coalesce({at[k]} * {g[k]}, 0)" for k in at)
    weight = " + ".join(f"CASE WHEN {at[k]} IS NULL THEN 0 ELSE {g[k]} END" for k in at)
    return f"a AS (SELECT *, {raw} AS raw FROM path), b AS (SELECT path_id, idx, CASE WHEN raw IS NOT NULL THEN ({total}) / ({weight}) END AS bend FROM a) SELECT path_id, idx, {r(bend='bend')}, coalesce(bend > 45 AND coalesce(bend > lag(bend) {W}, TRUE) AND coalesce(bend > lead(bend) {W}, TRUE), FALSE) AS corner FROM b"


@query("w7_corners", "path", _corner_sql(5, 2.0))
def w7(spark, d):
    return op.corners(t.path(spark, d)).select("path_id", "idx", "bend", "corner")


@query("w8_split_at", "path", f"f AS (SELECT *, sum(CASE WHEN idx % 7 = 3 THEN 1 ELSE 0 END) {W} AS piece FROM path), u AS (SELECT path_id, piece, idx, x FROM f UNION ALL SELECT path_id, piece - 1, idx, x FROM f WHERE idx % 7 = 3) SELECT path_id, CAST(piece AS BIGINT) AS piece, row_number() OVER (PARTITION BY path_id, piece ORDER BY idx) - 1 AS idx, {r(x='x')} FROM u")
def w8(spark, d):
    p = t.path(spark, d).withColumn("corner", F.col("idx") % 7 == 3)
    return op.split_at(p).select("path_id", "piece", "idx", "x")


@query("w9_quadrants", "path", "n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM path) SELECT path_id, idx, CAST(least(((idx + CAST(floor(n * 0.125) AS BIGINT)) % n) // CAST(floor(n * 0.25) AS BIGINT), 3) + 1 AS BIGINT) AS quadrant FROM n")
def w9(spark, d):
    return op.quadrants(t.path(spark, d), "beforeafterstart").select("path_id", "idx", "quadrant")


@query("w10_orient_ring", "path", f"n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM path), q AS (SELECT path_id, max(CASE WHEN idx = floor(n * 0.25) THEN x END) > max(CASE WHEN idx = floor(n * 0.75) THEN x END) AS ok FROM n GROUP BY 1) SELECT path_id, CASE WHEN ok THEN idx ELSE n - 1 - idx END AS idx, {r(x='x', y='y', z='z')} FROM n JOIN q USING (path_id)")
def w10(spark, d):
    return op.orient_ring(t.path(spark, d))


@query("w11_rotate_ring", "path", f"n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n, sqrt(x * x + y * y + z * z) AS d FROM path), q AS (SELECT path_id, arg_min(idx, (d, idx)) AS s FROM n GROUP BY 1) SELECT path_id, (idx - s + n) % n AS idx, {r(x='x', y='y', z='z')} FROM n JOIN q USING (path_id)")
def w11(spark, d):
    return op.rotate_ring(t.path(spark, d), (0.0, 0.0, 0.0))


ENDS = "e AS (SELECT path_id, arg_min({'x': x, 'y': y, 'z': z}, idx) AS a, arg_max({'x': x, 'y': y, 'z': z}, idx) AS b FROM path GROUP BY 1)"


@query("w12_path_ends", "path", f"{ENDS} SELECT path_id, {r(px='CASE WHEN a.z <= b.z THEN a.x ELSE b.x END', pz='least(a.z, b.z)', dx='CASE WHEN a.z <= b.z THEN b.x ELSE a.x END', dz='greatest(a.z, b.z)')} FROM e")
def w12(spark, d):
    return op.path_ends(t.path(spark, d)).select("path_id", F.col("proximal.x").alias("px"), F.col("proximal.z").alias("pz"), F.col("distal.x").alias("dx"), F.col("distal.z").alias("dz"))


_ARM = """b AS (SELECT p.path_id, p.idx, arg_max({'x': o.x, 'y': o.y, 'z': o.z}, o.idx) AS q FROM path p JOIN path o ON p.path_id = o.path_id AND o.idx < p.idx AND sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2) + pow(p.z - o.z, 2)) >= 0.2 GROUP BY 1, 2),
a AS (SELECT p.path_id, p.idx, arg_min({'x': o.x, 'y': o.y, 'z': o.z}, o.idx) AS q FROM path p JOIN path o ON p.path_id = o.path_id AND o.idx > p.idx AND sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2) + pow(p.z - o.z, 2)) >= 0.2 GROUP BY 1, 2),
j AS (SELECT p.path_id, p.idx, x - b.q.x AS ux, y - b.q.y AS uy, z - b.q.z AS uz, a.q.x - x AS vx, a.q.y - y AS vy, a.q.z - z AS vz FROM path p LEFT JOIN b USING (path_id, idx) LEFT JOIN a USING (path_id, idx))"""
ACOS = "degrees(acos(least(greatest((ux * vx + uy * vy + uz * vz) / nullif(sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz), 0), -1), 1)))"
#: least and greatest skip nulls
ANGLE = f"CASE WHEN ux IS NOT NULL AND vx IS NOT NULL THEN {ACOS} END"


@query("w13_arm_angles", "path", f"{_ARM} SELECT path_id, idx, {r(angle=ANGLE)} FROM j")
def w13(spark, d):
    return op.arm_angles(t.path(spark, d), 0.2)


@query("w14_point_at_arm", "path", f"{ENDS} SELECT path_id, min(idx) AS idx, {r(x='arg_min(x, idx)')} FROM path JOIN e USING (path_id) WHERE sqrt(pow(x - a.x, 2) + pow(y - a.y, 2) + pow(z - a.z, 2)) >= 0.2 GROUP BY 1")
def w14(spark, d):
    return op.point_at_arm(t.path(spark, d), 0.2).select("path_id", "idx", "x")


@query("w15_segment", "path", f"SELECT path_id, idx, {r(x='x')} FROM path QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY idx DESC) <= 5")
def w15(spark, d):
    return op.segment(t.path(spark, d), 5, "last").select("path_id", "idx", "x")


@query("w26_cubic_at", "motion", "w AS (SELECT *, CASE phase WHEN 9 THEN (-0.027 + 0.18 - 0.3) / 2 WHEN 0 THEN (0.081 - 0.45 + 2) / 2 WHEN 1 THEN (-0.081 + 0.36 + 0.3) / 2 WHEN 2 THEN (0.027 - 0.09) / 2 ELSE 0 END AS w FROM motion) "
       f"SELECT path_id, idx, {r(dx='sum(w * dx)', dz='sum(w * dz)')} FROM w GROUP BY 1, 2")
def w26(spark, d):
    return op.cubic_at(t.motion(spark, d), F.lit(0.3), ("dx", "dz"), ("path_id", "idx"), index="phase")


@query("w27_length_between", "path", f"n AS (SELECT *, {D.replace('lag', 'lead').format(w=W)} AS d FROM path) SELECT path_id, {r(length='sum(coalesce(d * greatest(least(idx + 1, 12.25) - greatest(idx, 3.5), 0), 0))')} FROM n GROUP BY 1")
def w27(spark, d):
    return op.length_between(t.path(spark, d), 3.5, 12.25)


@query("a11_tortuosity", "path", f"{STEP}, {ENDS}, l AS (SELECT path_id, sum(d) AS l FROM s GROUP BY 1) SELECT path_id, {r(tortuosity='l / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))')} FROM l JOIN e USING (path_id)")
def a11(spark, d):
    return op.tortuosity(t.path(spark, d))


_POSED_W = "OVER (PARTITION BY path_id, phase ORDER BY idx)"
TORT = f"s AS (SELECT *, coalesce({D.format(w=_POSED_W)}, 0) AS d FROM posed), k AS (SELECT path_id, phase, sum(d) / sqrt(pow(arg_min(x, idx) - arg_max(x, idx), 2) + pow(arg_min(y, idx) - arg_max(y, idx), 2) + pow(arg_min(z, idx) - arg_max(z, idx), 2)) AS t FROM s GROUP BY 1, 2)"


@query("a12_tortuosity_change", "posed", f"{TORT} SELECT path_id, {r(mean='avg(t)', std='stddev_pop(t)', min='min(t)', max='max(t)', change='max(t) - min(t)')}, arg_min(phase, (t, phase)) AS phase_min, arg_max(phase, (t, -phase)) AS phase_max FROM k GROUP BY 1")
def a12(spark, d):
    return op.tortuosity_change(mo.at_phase(t.path(spark, d), t.motion(spark, d)))


_CURV = curv_sql("posed", "path_id, phase")


def _curv(spark, d):
    return op.curvature(mo.at_phase(t.path(spark, d), t.motion(spark, d)), ("path_id", "phase"))


@query("a14_curvature_mean", "posed", f"{_CURV}, m AS (SELECT path_id, phase, avg(curvature) AS m FROM c GROUP BY 1, 2) SELECT path_id, {r(mean='avg(m)', min='min(m)', max='max(m)', change='max(m) - min(m)', percent='100 * (max(m) - min(m)) / min(m)')} FROM m GROUP BY 1")
def a14(spark, d):
    return op.curvature_mean(_curv(spark, d))


@query("a15_curvature_max", "posed", f"{_CURV}, l AS (SELECT *, coalesce({D.format(w=_POSED_W)}, 0) AS dd, count(*) OVER (PARTITION BY path_id, phase) AS n FROM c), q AS (SELECT *, sum(dd) {_POSED_W} AS along FROM l) SELECT path_id, phase, {r(curvature='max(curvature)', percent='arg_max(100.0 * idx / (n - 1), (curvature, -idx))', along='arg_max(along, (curvature, -idx))')}, arg_max(idx, (curvature, -idx)) AS idx FROM q GROUP BY 1, 2")
def a15(spark, d):
    return op.curvature_max(_curv(spark, d))


@query("a16_curvature_maxchange", "posed", f"{_CURV}, m AS (SELECT path_id, idx, min(curvature) AS lo, max(curvature) AS hi FROM c GROUP BY 1, 2) SELECT path_id, arg_max(idx, (hi - lo, -idx)) AS idx, {r(change='max(hi - lo)', percent='100 * arg_max((hi - lo) / lo, (hi - lo, -idx))')} FROM m GROUP BY 1")
def a16(spark, d):
    return op.curvature_maxchange(_curv(spark, d))


@query("a47_accuracy_vs_constant", "path", f"{curv_sql('path', 'path_id')}, n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM c), e AS (SELECT path_id, abs(curvature - 2.5) AS e FROM n WHERE idx >= 3 AND idx < n - 3) SELECT path_id, {r(mean_error='avg(e)', std_error='stddev_pop(e)', percent_error='100 * avg(e) / 2.5')} FROM e GROUP BY 1")
def a47(spark, d):
    return op.accuracy_vs_constant(op.curvature(t.path(spark, d)), 2.5, 3)


@query("g18_path_to_graph", "path", f"n AS (SELECT *, lead(idx) {W} AS n2, {D.replace('lag', 'lead').format(w=W)} AS d FROM path) SELECT path_id, idx AS n1, n2, {r(length='d')} FROM n WHERE n2 IS NOT NULL")
def g18(spark, d):
    return op.path_to_graph(t.path(spark, d))


@query("p10_check_path_ends", "path", f"{ENDS} SELECT path_id FROM e WHERE abs(a.x - b.x) > 0.05 OR abs(a.y - b.y) > 0.05 OR abs(a.z - b.z) > 0.05")
def p10(spark, d):
    """Ends checked against a ring's own closing point."""
    p = t.path(spark, d)
    first = p.filter("idx = 0").select("path_id", *[F.col(a).alias(f"a{a}") for a in "xyz"], *[F.col(a).alias(f"b{a}") for a in "xyz"])
    return op.check_path_ends(p, first, 0.05)


@query("u6_concat_paths", "path", f"SELECT path_id, row_number() OVER (ORDER BY path_id, idx) - 1 AS idx, {r(x='x')} FROM path")
def u6(spark, d):
    return op.concat_paths(t.path(spark, d)).select("path_id", "idx", "x")
