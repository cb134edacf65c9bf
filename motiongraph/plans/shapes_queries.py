"""Queries over fits and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motion as mo
from ..operators import shape as op
from ..sources import tables as t
from .motion_queries import posed
from .registry import query, r

K = ("path_id",)


@query("a29_fit_circle", "path", f"s AS (SELECT path_id, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c, 0.5 * (covar_samp(x, y * y) + covar_samp(x, x * x)) AS d, 0.5 * (covar_samp(y, x * x) + covar_samp(y, y * y)) AS e FROM path GROUP BY 1), c AS (SELECT path_id, (d * c - b * e) / (a * c - b * b) AS cx, (a * e - b * d) / (a * c - b * b) AS cy FROM s) SELECT path_id, {r(x='any_value(cx)', y='any_value(cy)', r='avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2)))')} FROM path JOIN c USING (path_id) GROUP BY 1")
def a29(spark, d):
    return op.fit_circle(t.path(spark, d), K)


@query("a30_fit_ellipse")
def a30(spark, d):
    return op.fit_ellipse(t.path(spark, d), K)


@query("a31_fit_plane")
def a31(spark, d):
    return op.fit_plane(t.path(spark, d), K)


HERON = "sqrt(greatest((a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c), 0))"


@query("a32_fan_area", "path", f"n AS (SELECT path_id, x, y, z, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz, avg(x) OVER g AS mx, avg(y) OVER g AS my, avg(z) OVER g AS mz FROM path WINDOW w AS (PARTITION BY path_id ORDER BY idx), g AS (PARTITION BY path_id)), l AS (SELECT path_id, sqrt(pow(x - nx, 2) + pow(y - ny, 2) + pow(z - nz, 2)) AS a, sqrt(pow(nx - mx, 2) + pow(ny - my, 2) + pow(nz - mz, 2)) AS b, sqrt(pow(mx - x, 2) + pow(my - y, 2) + pow(mz - z, 2)) AS c FROM n) SELECT path_id, {r(area=f'sum({HERON})')} FROM l GROUP BY 1")
def a32(spark, d):
    return op.fan_area(t.path(spark, d), K)


@query("a33_area_change")
def a33(spark, d):
    return op.area_change(posed(spark, d), K)


@query("a34_ellipse_expansion")
def a34(spark, d):
    return op.ellipse_expansion(posed(spark, d), K)


CORNER = "cn AS (SELECT mesh_id, f, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, w.x AS rx, w.y AS ry, w.z AS rz FROM face JOIN vertex p ON p.v = v1 JOIN vertex q ON q.v = v2 JOIN vertex w ON w.v = v3)"


@query("a36_mesh_volume", "face vertex", f"{CORNER} SELECT mesh_id, {r(volume='sum(px * (qy * rz - qz * ry) + py * (qz * rx - qx * rz) + pz * (qx * ry - qy * rx)) / 6')} FROM cn GROUP BY 1")
def a36(spark, d):
    return op.mesh_volume(t.vertex(spark, d), t.face(spark, d))


DIRECTED = "de AS (SELECT mesh_id, f, v1 AS a, v2 AS b FROM face UNION ALL SELECT mesh_id, f, v2, v3 FROM face UNION ALL SELECT mesh_id, f, v3, v1 FROM face)"


@query("j15_weld_vertices", "face vertex", f"t AS (SELECT f * 3 + k AS pos, floor(x * 10) AS x, floor(y * 10) AS y, floor(z * 10) AS z FROM (SELECT f, 0 AS k, v1 AS v FROM face UNION ALL SELECT f, 1, v2 FROM face UNION ALL SELECT f, 2, v3 FROM face) c JOIN vertex USING (v)), m AS (SELECT x, y, z, min(pos) AS first FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY first, x, y, z) - 1 AS v FROM m) SELECT pos, v FROM t JOIN n USING (x, y, z)")
def j15(spark, d):
    flat = op.flatten_mesh(t.vertex(spark, d), t.face(spark, d))
    return op.weld_vertices(flat.select((F.col("f") * 3 + F.col("k")).alias("pos"), *[F.floor(F.col(a) * 10).alias(a) for a in "xyz"])).select("pos", "v")


@query("j16_mesh_edge_check", "face", f"{DIRECTED} SELECT mesh_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM de GROUP BY 1, 2, 3 HAVING count(*) <> 2")
def j16(spark, d):
    return op.mesh_edge_check(t.face(spark, d))


@query("j17_winding_conflicts", "face", f"{DIRECTED} SELECT mesh_id, a, b, count(*) AS n FROM de GROUP BY 1, 2, 3 HAVING count(*) > 1")
def j17(spark, d):
    return op.winding_conflicts(t.face(spark, d))


@query("j18_validate_mesh", "face vertex", "c AS (SELECT mesh_id, f, v1 AS v FROM face UNION ALL SELECT mesh_id, f, v2 FROM face UNION ALL SELECT mesh_id, f, v3 FROM face) SELECT DISTINCT mesh_id, 'missing' AS problem, f, v FROM c WHERE NOT EXISTS (SELECT 1 FROM vertex WHERE vertex.v = c.v) UNION ALL SELECT mesh_id, 'thin', NULL, v FROM c GROUP BY mesh_id, v HAVING count(DISTINCT f) < 3")
def j18(spark, d):
    return op.validate_mesh(t.vertex(spark, d), t.face(spark, d))


@query("j23_plane_section", "face vertex", f"{DIRECTED}, e AS (SELECT DISTINCT mesh_id, least(a, b) AS a, greatest(a, b) AS b FROM de), s AS (SELECT *, z - 0.02 AS d FROM vertex) SELECT mesh_id, a, b, {r(x='p.x + p.d / (p.d - q.d) * (q.x - p.x)', y='p.y + p.d / (p.d - q.d) * (q.y - p.y)', z='p.z + p.d / (p.d - q.d) * (q.z - p.z)')} FROM e JOIN s p ON p.v = a JOIN s q ON q.v = b WHERE p.d * q.d < 0")
def j23(spark, d):
    return op.plane_section(t.vertex(spark, d), t.face(spark, d), (0, 0, 1, 0.02))


@query("j24_cut_mesh")
def j24(spark, d):
    return op.cut_mesh(t.vertex(spark, d), t.face(spark, d), (0, 0, 1, 0.02))


@query("j30_mesh_motion")
def j30(spark, d):
    """Amplitude of the displacement of a mesh's distinct vertices."""
    v = t.voxel_phase(spark, d)
    field = v.select("phase", "z", "y", "x", *[(F.col("v") / s).alias(n) for n, s in (("dz", 1e5), ("dy", 2e5), ("dx", 4e5))])
    pts = op.points_from_mesh(t.vertex(spark, d)).select(F.xxhash64("x", "y", "z").alias("idx"), *[(3 + 2 * F.col(a)).alias(a) for a in "xyz"])
    return mo.amplitude(mo.sample_field(pts, field, ("idx",)), "xyz", ("idx",)).select("idx", "amplitude")


@query("j32_flatten_mesh", "face vertex", f"c AS (SELECT mesh_id, f, 0 AS k, v1 AS v FROM face UNION ALL SELECT mesh_id, f, 1, v2 FROM face UNION ALL SELECT mesh_id, f, 2, v3 FROM face) SELECT mesh_id, f, CAST(k AS BIGINT) AS k, {r(x='x', y='y', z='z')} FROM c JOIN vertex USING (v)")
def j32(spark, d):
    return op.flatten_mesh(t.vertex(spark, d), t.face(spark, d))


@query("s21_points_from_mesh", "vertex", f"SELECT DISTINCT {r(x='round(x, 1)', y='round(y, 1)', z='-round(z, 1)')} FROM vertex")
def s21(spark, d):
    v = t.vertex(spark, d).select("v", *[(F.round(a, 1) + F.lit(0.0)).alias(a) for a in "xyz"])
    return op.points_from_mesh(v, True)


@query("v11_sample_circle", "path", f"c AS (SELECT path_id, idx, x, y, 0.5 + abs(z) AS r FROM path) SELECT path_id, idx, k, {r(px='x + r * cos(k * 2 * pi() / 12)', py='y + r * sin(k * 2 * pi() / 12)')} FROM c, (SELECT CAST(unnest(range(13)) AS INTEGER) AS k)")
def v11(spark, d):
    c = t.path(spark, d).select("path_id", "idx", "x", "y", (0.5 + F.abs("z")).alias("r"))
    return op.sample_circle(c, 12).select("path_id", "idx", "k", "px", "py")


@query("v17_convex_hull")
def v17(spark, d):
    return op.convex_hull(t.path(spark, d), K)
