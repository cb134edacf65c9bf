"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as v
from ..sources import tables as t
from .paths_queries import ACOS
from .registry import query, r


def _pairs(spark, d):
    """Each path point with the next path's point of the same index as o*."""
    p = t.path(spark, d)
    o = p.select((F.col("path_id") - 1).alias("path_id"), "idx", *[F.col(a).alias(f"o{a}") for a in "xyz"])
    return p.join(o, ["path_id", "idx"])


PR = "pr AS (SELECT a.path_id, a.idx, a.x, a.y, a.z, b.x AS ox, b.y AS oy, b.z AS oz FROM path a JOIN path b ON b.path_id = a.path_id + 1 AND b.idx = a.idx)"
N = "sqrt(x * x + y * y + z * z)"


def _points():
    """Columns of the point and of its partner."""
    return v.xyz(), v.xyz("o")


def _select(spark, d, **cols):
    return _pairs(spark, d).select("path_id", "idx", *[c.alias(n) for n, c in cols.items()])


@query("v1_norm_distance", "path", f"{PR} SELECT path_id, idx, {r(norm=N, distance='sqrt(pow(x - ox, 2) + pow(y - oy, 2) + pow(z - oz, 2))', unit_x=f'x / {N}')} FROM pr")
def v1(spark, d):
    A, B = _points()
    return _select(spark, d, norm=v.norm(A), distance=v.distance(A, B), unit_x=v.normalize(A)[0])


@query("v2_normal_cross", "path", f"{PR} SELECT path_id, idx, {r(nx='y / sqrt(x * x + y * y)', ny='-x / sqrt(x * x + y * y)', cx='y * oz - z * oy', cy='z * ox - x * oz', cz='x * oy - y * ox')} FROM pr")
def v2(spark, d):
    A, B = _points()
    n, c = v.normal2(A[:2]), v.cross(A, B)
    return _select(spark, d, nx=n[0], ny=n[1], cx=c[0], cy=c[1], cz=c[2])


@query("v3_dot", "path", f"{PR} SELECT path_id, idx, {r(dot='x * ox + y * oy + z * oz')} FROM pr")
def v3(spark, d):
    A, B = _points()
    return _select(spark, d, dot=v.dot(A, B))


WRAP = "(({e} + pi()) - floor(({e} + pi()) / (2 * pi())) * 2 * pi() - pi())"


@query("v4_angle", "path", f"{PR}, q AS (SELECT *, x AS ux, y AS uy, z AS uz, ox AS vx, oy AS vy, oz AS vz FROM pr) SELECT path_id, idx, {r(flat=WRAP.format(e='(atan2(y, x) - atan2(oy, ox))'), space=f'radians({ACOS})', between='atan2(oy - y, ox - x)')} FROM q")
def v4(spark, d):
    A, B = _points()
    return _select(spark, d, flat=v.angle(A[:2], B[:2]), space=v.angle(A, B), between=v.angle_between(A[:2], B[:2]))


@query("v5_add_angles", "path", f"{PR} SELECT path_id, idx, {r(total=WRAP.format(e='(20 * x + 20 * oy)'), difference=WRAP.format(e='(20 * x - 20 * oy)'))} FROM pr")
def v5(spark, d):
    a, b = 20 * F.col("x"), 20 * F.col("oy")
    return _select(spark, d, total=v.add_angles(a, b), difference=v.sub_angles(a, b))


@query("v6_plane_distance", "path", f"{PR} SELECT path_id, idx, {r(away='(x * ox + y * oy + z * oz - 0.1) / sqrt(ox * ox + oy * oy + oz * oz)')} FROM pr")
def v6(spark, d):
    A, B = _points()
    return _select(spark, d, away=v.plane_distance(A, (*B, F.lit(0.1))))


@query("v7_volume_area", "path", f"{PR}, l AS (SELECT *, {N} AS a, sqrt(pow(x - ox, 2) + pow(y - oy, 2) + pow(z - oz, 2)) AS b, sqrt(ox * ox + oy * oy + oz * oz) AS c FROM pr) SELECT path_id, idx, {r(volume='(x * (oy * 1 - oz * 0) + y * (oz * 0 - ox * 1) + z * (ox * 0 - oy * 0)) / 6', area='sqrt(greatest((a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c), 0))')} FROM l")
def v7(spark, d):
    A, B = _points()
    zero, up = F.lit(0.0), F.lit(1.0)
    return _select(spark, d, volume=v.tetra_volume(A, B, (zero, zero, up)), area=v.tri_area((zero, zero, zero), A, B))


@query("v8_tilt", "path", f"{PR} SELECT path_id, idx, {r(tilt='degrees(asin(abs(z - oz) / (1 + abs(z) + abs(oz))))')} FROM pr")
def v8(spark, d):
    return _select(spark, d, tilt=v.tilt(F.col("z"), F.col("oz"), 1 + F.abs("z") + F.abs("oz")))


@query("v9_project", "path", f"{PR} SELECT path_id, idx, {r(u='x / cos(atan(ox / (1 + oz)))', v='y / cos(atan(oy / (1 + oz)))', back_z='(0.2 - ox * x - oy * y) / (1 + oz)')} FROM pr")
def v9(spark, d):
    A, B = _points()
    plane = (B[0], B[1], 1 + B[2], F.lit(0.2))
    q = v.to_plane(A, plane)
    return _select(spark, d, u=q[0], v=q[1], back_z=v.from_plane(q, plane)[2])


@query("v10_orientation", "path", f"{PR} SELECT path_id, idx, {r(angle='degrees(acos((oz - z) / sqrt(pow(x - ox, 2) + pow(y - oy, 2) + pow(z - oz, 2))))')} FROM pr")
def v10(spark, d):
    A, B = _points()
    return _select(spark, d, angle=v.orientation(A, B))


@query("v13_mm_to_rad", "path", f"SELECT path_id, idx, {r(rad='x / 35')} FROM path")
def v13(spark, d):
    return t.path(spark, d).select("path_id", "idx", v.mm_to_rad(F.col("x")).alias("rad"))


@query("v14_column_number", "", "SELECT c_custkey AS id, CAST((ascii(substr(s, 1, 1)) - 64) * 26 + ascii(substr(s, 2, 1)) - 64 AS INTEGER) AS n FROM (SELECT c_custkey, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || chr(CAST(65 + c_nationkey % 26 AS INTEGER)) AS s FROM customer)")
def v14(spark, d):
    s = F.concat(F.char(65 + F.col("c_custkey") % 26), F.char(65 + F.col("c_nationkey") % 26))
    return t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), v.column_number(s).alias("n"))


@query("v15_timepoint_name", "measure", "n AS (SELECT DISTINCT patient, CASE timepoint WHEN 0 THEN 'discharge' WHEN 1 THEN '1month' WHEN 2 THEN '6months' WHEN 3 THEN '12months' ELSE '24months' END AS tp FROM measure) SELECT patient, tp, CASE tp WHEN 'discharge' THEN 'D' WHEN '1month' THEN '1M' WHEN '6months' THEN '6M' WHEN '12months' THEN '12M' ELSE '24M' END AS name, patient || '_' || tp || '_ring_avgreg' AS file FROM n")
def v15(spark, d):
    tp = F.col("timepoint")
    code = F.when(tp == 0, "discharge").when(tp == 1, "1month").when(tp == 2, "6months").when(tp == 3, "12months").otherwise("24months")
    m = t.measure(spark, d).select("patient", code.alias("tp")).distinct()
    return m.select("patient", "tp", v.timepoint_name(F.col("tp")).alias("name"), v.scan_name(F.col("patient").cast("string"), F.col("tp"), F.lit("ring"), F.lit("avgreg")).alias("file"))


@query("v19_slice_to_world", "path", f"{PR} SELECT path_id, idx, {r(x='ox + (y - 127.5) * 0.5 + (x - 127.5) * 0.1', y='oy + (y - 127.5) * 0.2 + (x - 127.5) * 0.3', z='oz + (y - 127.5) * 0.0 + (x - 127.5) * 0.7')} FROM pr")
def v19(spark, d):
    A, B = _points()
    v1_, v2_ = (F.lit(0.5), F.lit(0.2), F.lit(0.0)), (F.lit(0.1), F.lit(0.3), F.lit(0.7))
    return _select(spark, d, **dict(zip("xyz", v.slice_to_world(A[:2], B, v1_, v2_))))


@query("v20_span_vectors")
def v20(spark, d):
    A, B = _points()
    unit = (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    a, b = v.span_vectors(v.normalize(A), unit, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    return _select(spark, d, ax=a[0], ay=a[1], az=a[2], bx=b[0], by=b[1], bz=b[2])


@query("v12_motion_pattern", "path", f"SELECT path_id, idx, k, {r(t='k / 20.0 * 0.8', value='(1 + abs(x)) * (exp(-0.5 * pow((k / 20.0 - 0.35) / CASE WHEN k / 20.0 < 0.35 THEN 0.4 * 0.35 ELSE 0.4 * 0.65 END, 2)) + 0.2 * exp(-0.5 * pow((k / 20.0 - 0.7) / 0.05, 2)))')} FROM path, (SELECT CAST(unnest(range(20)) AS INTEGER) AS k)")
def v12(spark, d):
    from ..operators.patterns import motion_pattern

    return motion_pattern(t.path(spark, d).select("path_id", "idx", (1 + F.abs("x")).alias("amplitude")), period=0.8, samples=20, top=0.35, extra=(0.2, 0.7, 0.05))


@query("p13_angle_straight0", "path", f"SELECT path_id, idx, {r(angle='180 - 100 * abs(x)')} FROM path")
def p13(spark, d):
    return t.path(spark, d).select("path_id", "idx", v.angle_straight0(100 * F.abs("x")).alias("angle"))
