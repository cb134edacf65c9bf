"""Queries over cyclic motion and nearest points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import motion as op
from ..operators import nearest as ne
from ..operators import paths as pa
from ..sources import tables as t
from .paths_queries import ACOS, TORT  # noqa: F401
from .registry import query, r

K = ("path_id",)
PAIR = "pr AS (SELECT a.path_id, a.idx, a.phase AS p, b.phase AS q, sqrt(pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2) + pow(a.dz - b.dz, 2)) AS d FROM motion a JOIN motion b ON a.path_id = b.path_id AND a.idx = b.idx AND a.phase < b.phase)"
STATS = {"mean": "avg({c})", "std": "stddev_pop({c})", "min": "min({c})", "max": "max({c})"}


def stats(c: str, **more: str) -> str:
    return r(**{k: v.format(c=c) for k, v in STATS.items()}, **more)


def posed(spark, d) -> DataFrame:
    return op.at_phase(t.path(spark, d), t.motion(spark, d))


@query("a1_amplitude", "motion", f"{PAIR} SELECT path_id, idx, {r(amplitude='max(d)')}, arg_max(p, (d, -p, -q)) AS phase_a, arg_max(q, (d, -p, -q)) AS phase_b FROM pr GROUP BY 1, 2")
def a1(spark, d):
    return op.amplitude(t.motion(spark, d))


@query("a1_amplitude_z", "motion", f"SELECT path_id, idx, {r(amplitude='max(dz) - min(dz)')}, arg_min(phase, (dz, phase)) AS phase_a, arg_max(phase, (dz, -phase)) AS phase_b FROM motion GROUP BY 1, 2")
def a1z(spark, d):
    return op.amplitude(t.motion(spark, d), "z")


_NEXT = "n AS (SELECT *, coalesce(lead(dx) OVER w, first_value(dx) OVER w) - dx AS ex, coalesce(lead(dy) OVER w, first_value(dy) OVER w) - dy AS ey, coalesce(lead(dz) OVER w, first_value(dz) OVER w) - dz AS ez FROM motion WINDOW w AS (PARTITION BY path_id, idx ORDER BY phase))"


@query("a2_sum_motion", "motion", f"{_NEXT} SELECT path_id, idx, {r(way='sum(sqrt(ex * ex + ey * ey + ez * ez))')} FROM n GROUP BY 1, 2")
def a2(spark, d):
    return op.sum_motion(t.motion(spark, d))


@query("a2_sum_motion_xy", "motion", f"{_NEXT} SELECT path_id, idx, {r(way='sum(sqrt(ex * ex + ey * ey))')} FROM n GROUP BY 1, 2")
def a2xy(spark, d):
    return op.sum_motion(t.motion(spark, d), "xy")


AMP = f"{PAIR}, am AS (SELECT path_id, idx, max(d) AS a FROM pr GROUP BY 1, 2)"


@query("a3_amplitude_stats", "motion", f"{AMP} SELECT path_id, {stats('a')} FROM am GROUP BY 1")
def a3(spark, d):
    return op.amplitude_stats(t.motion(spark, d))


@query("a4_total_deform", "motion", f"SELECT path_id, idx, {r(total='sum(sqrt(dx * dx + dy * dy + dz * dz))')} FROM motion GROUP BY 1, 2")
def a4(spark, d):
    return op.total_deform(t.motion(spark, d))


def _at(spark, d, i: int) -> DataFrame:
    return posed(spark, d).filter(F.col("idx") == i).drop("idx")


DIST = "dd AS (SELECT a.path_id, a.phase, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM posed a JOIN posed b ON a.path_id = b.path_id AND a.phase = b.phase WHERE a.idx = 0 AND b.idx = 9)"


@query("a5_pulsatility", "posed", f"{DIST} SELECT path_id, {r(min='min(d)', q1='quantile_cont(d, 0.25)', median='quantile_cont(d, 0.5)', q3='quantile_cont(d, 0.75)', max='max(d)', change='max(d) - min(d)', percent='100 * (max(d) - min(d)) / min(d)')}, arg_min(phase, (d, phase)) * 10 AS phase_min, arg_max(phase, (d, -phase)) * 10 AS phase_max FROM dd GROUP BY 1")
def a5(spark, d):
    return op.pulsatility(_at(spark, d, 0), _at(spark, d, 9), K)


CHANGE = "arg_min(phase, ({c}, phase)) AS phase_min, arg_max(phase, ({c}, -phase)) AS phase_max"


@query("a6_distance_change", "posed", f"{DIST} SELECT path_id, {stats('d', range='max(d) - min(d)', at_mid='max(d) FILTER (WHERE phase = 5)')}, {CHANGE.format(c='d')} FROM dd GROUP BY 1")
def a6(spark, d):
    return op.distance_change(_at(spark, d, 0), _at(spark, d, 9), K)


TRIPLE = f"tt AS (SELECT a.path_id, a.phase, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz, c.x - b.x AS vx, c.y - b.y AS vy, c.z - b.z AS vz FROM posed a JOIN posed b ON a.path_id = b.path_id AND a.phase = b.phase JOIN posed c ON a.path_id = c.path_id AND a.phase = c.phase WHERE a.idx = 0 AND b.idx = 5 AND c.idx = 9), ag AS (SELECT path_id, phase, {ACOS} AS a FROM tt)"


@query("a8_angle_change", "posed", f"{TRIPLE} SELECT path_id, {stats('a', range='max(a) - min(a)', at_mid='max(a) FILTER (WHERE phase = 0)')}, {CHANGE.format(c='a')} FROM ag GROUP BY 1")
def a8(spark, d):
    return op.angle_change(_at(spark, d, 0), _at(spark, d, 5), _at(spark, d, 9), K)


@query("a10_segment_angle_change", "posed", f"s AS (SELECT a.path_id, a.phase, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, e.x - c.x AS vx, e.y - c.y AS vy, e.z - c.z AS vz FROM posed a JOIN posed b ON b.path_id = a.path_id AND b.phase = a.phase AND b.idx = 4 JOIN posed c ON c.path_id = a.path_id AND c.phase = a.phase AND c.idx = 6 JOIN posed e ON e.path_id = a.path_id AND e.phase = a.phase AND e.idx = 9 WHERE a.idx = 0), ag AS (SELECT path_id, phase, {ACOS} AS a FROM s) SELECT path_id, {stats('a', range='max(a) - min(a)', at_mid='max(a) FILTER (WHERE phase = 0)')}, {CHANGE.format(c='a')} FROM ag GROUP BY 1")
def a10(spark, d):
    def seg(i, j):
        b = _at(spark, d, j).select("path_id", "phase", *[F.col(a).alias(f"o{a}") for a in "xyz"])
        return _at(spark, d, i).join(b, ["path_id", "phase"]).select("path_id", "phase", *[(F.col(f"o{a}") - F.col(a)).alias(f"u{a}") for a in "xyz"])

    return op.segment_angle_change(seg(0, 4), seg(6, 9), K)


@query("a13_segment_com", "posed", f"SELECT path_id, phase, {r(x='avg(x)', y='avg(y)', z='avg(z)')} FROM posed WHERE idx < 5 GROUP BY 1, 2")
def a13(spark, d):
    return op.segment_com(posed(spark, d), 5)


_LEN = "w AS (SELECT path_id, phase, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM posed WHERE idx BETWEEN 2 AND 12 WINDOW w AS (PARTITION BY path_id, phase ORDER BY idx)), ll AS (SELECT path_id, phase, sum(d) AS l FROM w GROUP BY 1, 2)"


@query("a35_strain", "posed", f"{_LEN} SELECT path_id, {r(strain='CASE WHEN min(l) = 0 THEN 0 ELSE (max(l) - min(l)) / min(l) END')} FROM ll GROUP BY 1")
def a35(spark, d):
    return op.strain(posed(spark, d), 2, 12)


@query("a50_phase_pair_extremes", "motion", f"{PAIR} SELECT path_id, idx, {r(max='max(d)', min='min(d)')}, arg_max(p, (d, -p, -q)) AS max_a, arg_max(q, (d, -p, -q)) AS max_b, arg_min(p, (d, p, q)) AS min_a, arg_min(q, (d, p, q)) AS min_b FROM pr GROUP BY 1, 2")
def a50(spark, d):
    return op.phase_pair_extremes(t.motion(spark, d))


@query("a51_path_distance_phases", "posed", f"{_LEN} SELECT path_id, {r(min='min(l)', max='max(l)')}, {CHANGE.format(c='l')} FROM ll GROUP BY 1")
def a51(spark, d):
    return op.path_distance_phases(posed(spark, d), 2, 12)


@query("a52_angle_pair_extremes", "posed", f"{TRIPLE} SELECT a.path_id, {r(max_difference='max(abs(a.a - b.a))', min_difference='min(abs(a.a - b.a))')} FROM ag a JOIN ag b ON a.path_id = b.path_id AND a.phase < b.phase GROUP BY 1")
def a52(spark, d):
    return op.angle_pair_extremes(op.three_point_angle(_at(spark, d, 0), _at(spark, d, 5), _at(spark, d, 9), K), K)


@query("a53_relative_displacement", "motion", f"m AS (SELECT *, max(dx) FILTER (WHERE phase = 5) OVER w AS ox, max(dy) FILTER (WHERE phase = 5) OVER w AS oy, max(dz) FILTER (WHERE phase = 5) OVER w AS oz FROM motion WINDOW w AS (PARTITION BY path_id, idx)) SELECT path_id, idx, phase, {r(displacement='sqrt(pow(dx - ox, 2) + pow(dy - oy, 2) + pow(dz - oz, 2))')} FROM m")
def a53(spark, d):
    return op.relative_displacement(t.motion(spark, d))


@query("a22_phase_spread", "motion", f"SELECT phase, {stats('dz', q1='quantile_cont(dz, 0.25)', median='quantile_cont(dz, 0.5)', q3='quantile_cont(dz, 0.75)')} FROM motion GROUP BY 1")
def a22(spark, d):
    return op.phase_spread(t.motion(spark, d), "dz")


@query("a27_ring_rollup", "path motion", f"{AMP}, n AS (SELECT path_id, idx, count(*) OVER (PARTITION BY path_id) AS n FROM path), q AS (SELECT path_id, idx, CAST(least(idx // CAST(floor(n * 0.25) AS BIGINT), 3) + 1 AS BIGINT) AS quadrant FROM n) SELECT path_id, quadrant, {stats('a')}, count(*) AS n FROM am JOIN q USING (path_id, idx) GROUP BY ROLLUP (path_id, quadrant)")
def a27(spark, d):
    quarter = pa.quadrants(t.path(spark, d)).select("path_id", "idx", "quadrant")
    return op.ring_rollup(op.amplitude(t.motion(spark, d)).join(quarter, ["path_id", "idx"]), "amplitude", ("path_id", "quadrant"))


@query("a48_location_shift", "motion", f"m AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS v, count(*) OVER (PARTITION BY path_id, phase) AS n FROM motion), a AS (SELECT path_id, phase, 100.0 * arg_max(idx, (v, -idx)) / (max(n) - 1) AS pos FROM m GROUP BY 1, 2) SELECT path_id, {r(min='min(pos)', max='max(pos)', shift='max(pos) - min(pos)')} FROM a GROUP BY 1")
def a48(spark, d):
    m = t.motion(spark, d).withColumn("v", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return op.location_shift(m, "v")


@query("w24_close_cycle", "motion", f"SELECT path_id, idx, phase, {r(dx='dx')} FROM motion UNION ALL SELECT path_id, idx, 10, {r(dx='dx')} FROM motion WHERE phase = 0")
def w24(spark, d):
    return op.close_cycle(t.motion(spark, d)).select("path_id", "idx", "phase", "dx")


@query("p11_at_phase", "posed", f"SELECT path_id, idx, phase, {r(x='x', y='y', z='z')} FROM posed WHERE phase = 3")
def p11(spark, d):
    return op.at_phase(t.path(spark, d), t.motion(spark, d), 3)


_FIELD = "fl AS (SELECT phase, z, y, x, v / 1e5 AS dz, v / 2e5 AS dy, v / 4e5 AS dx FROM voxel_phase), q AS (SELECT path_id, idx, 3 + 2 * z AS z, 3 + 2 * y AS y, 3 + 2 * x AS x FROM path), c AS (SELECT path_id, idx, CAST(floor(z) AS BIGINT) + a AS z, CAST(floor(y) AS BIGINT) + b AS y, CAST(floor(x) AS BIGINT) + g AS x, CASE a WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END * CASE b WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END * CASE g WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END AS w FROM q, range(2) r1(a), range(2) r2(b), range(2) r3(g))"


@query("j14_sample_field", "path voxel_phase", f"{_FIELD} SELECT path_id, idx, phase, {r(dz='sum(w * dz) / sum(w)', dy='sum(w * dy) / sum(w)', dx='sum(w * dx) / sum(w)')} FROM c JOIN fl USING (z, y, x) WHERE w > 0 GROUP BY 1, 2, 3")
def j14(spark, d):
    v = t.voxel_phase(spark, d)
    field = v.select("phase", "z", "y", "x", *[(F.col("v") / s).alias(n) for n, s in (("dz", 1e5), ("dy", 2e5), ("dx", 4e5))])
    return op.sample_field(t.path(spark, d).select("path_id", "idx", *[(3 + 2 * F.col(a)).alias(a) for a in "xyz"]), field, ("path_id", "idx"))


@query("a9_node_angle_change", "node edge", f"""mo AS (SELECT scan_id, node_id, p AS phase, CAST((node_id * 3 + p) % 7 AS DOUBLE) / 10 AS dx, CAST((node_id + p * 2) % 5 AS DOUBLE) / 10 AS dy, CAST((node_id * 2 + p) % 9 AS DOUBLE) / 10 AS dz FROM node, range(3) r(p)),
ps AS MATERIALIZED (SELECT scan_id, node_id, phase, x, y, z, x + dx AS mx, y + dy AS my, z + dz AS mz FROM node JOIN mo USING (scan_id, node_id)),
ad AS MATERIALIZED (SELECT scan_id, n1 AS node, n2 AS o FROM edge UNION SELECT scan_id, n2, n1 FROM edge), np AS MATERIALIZED (SELECT a.scan_id, a.node, a.o AS a, b.o AS b FROM ad a JOIN ad b ON a.scan_id = b.scan_id AND a.node = b.node AND a.o < b.o),
k1 AS MATERIALIZED (SELECT np.*, n.phase, n.x, n.y, n.z, n.mx, n.my, n.mz FROM np JOIN ps n ON n.scan_id = np.scan_id AND n.node_id = np.node),
k2 AS MATERIALIZED (SELECT k1.*, o.x - k1.x AS ux, o.y - k1.y AS uy, o.z - k1.z AS uz, o.mx - k1.mx AS px, o.my - k1.my AS py, o.mz - k1.mz AS pz FROM k1 JOIN ps o ON o.scan_id = k1.scan_id AND o.node_id = k1.a AND o.phase = k1.phase),
jj AS (SELECT k2.scan_id, k2.node AS node_id, ux, uy, uz, px, py, pz, o.x - k2.x AS vx, o.y - k2.y AS vy, o.z - k2.z AS vz, o.mx - k2.mx AS qx, o.my - k2.my AS qy, o.mz - k2.mz AS qz FROM k2 JOIN ps o ON o.scan_id = k2.scan_id AND o.node_id = k2.b AND o.phase = k2.phase)
SELECT scan_id, node_id, {r(change=f"max(CASE WHEN ux*ux+uy*uy+uz*uz > 0 AND vx*vx+vy*vy+vz*vz > 0 AND px*px+py*py+pz*pz > 0 AND qx*qx+qy*qy+qz*qz > 0 THEN degrees(abs(acos(least(greatest((px*qx+py*qy+pz*qz)/(sqrt(px*px+py*py+pz*pz)*sqrt(qx*qx+qy*qy+qz*qz)),-1),1)) - acos(least(greatest((ux*vx+uy*vy+uz*vz)/(sqrt(ux*ux+uy*uy+uz*uz)*sqrt(vx*vx+vy*vy+vz*vz)),-1),1)))) END)")} FROM jj GROUP BY 1, 2""")
def a9(spark, d):
    node = t.node(spark, d)
    n, p = F.col("node_id"), F.col("phase")
    m = node.select("scan_id", "node_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("phase"))
    m = m.select("*", ((n * 3 + p) % 7 / F.lit(10.0)).alias("dx"), ((n + p * 2) % 5 / F.lit(10.0)).alias("dy"), ((n * 2 + p) % 9 / F.lit(10.0)).alias("dz"))
    return op.node_angle_change(t.edge(spark, d), node, m)


def _next_path(df: DataFrame) -> DataFrame:
    """Each path under the key of the one before it, so that neighbouring rings meet."""
    return df.withColumn("path_id", F.col("path_id") - 1)


ND = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
NEAR = f"ne AS (SELECT a.path_id, a.idx, arg_min(b.idx, ({ND}, b.idx)) AS near, min({ND}) AS d FROM path a JOIN path b ON b.path_id = a.path_id + 1 GROUP BY 1, 2)"


@query("j4_nearest", "path", f"{NEAR} SELECT path_id, idx, near, {r(d='d')} FROM ne")
def j4(spark, d):
    p = t.path(spark, d)
    return ne.nearest(p, _next_path(p), K)


@query("j4_nearest_in_grid", "vertex", f"SELECT a.v AS idx, arg_min(b.v, ({ND}, b.v)) AS near, {r(d=f'min({ND})')} FROM (SELECT v, x + 0.03 AS x, y, z FROM vertex) a, vertex b GROUP BY 1")
def j4_grid(spark, d):
    v = t.vertex(spark, d).withColumnRenamed("v", "idx")
    return ne.nearest_in_grid(v.withColumn("x", F.col("x") + 0.03), v, 0.1)


PP = f"pp AS (SELECT ne.path_id, ne.idx, ne.near, a.phase, {ND} AS d FROM ne JOIN posed a ON a.path_id = ne.path_id AND a.idx = ne.idx JOIN posed b ON b.path_id = ne.path_id + 1 AND b.idx = ne.near AND b.phase = a.phase)"


def _ring_distances(spark, d):
    p, q = t.path(spark, d), posed(spark, d)
    return ne.ring_distances(p, _next_path(p), q, _next_path(q), K)


@query("j5_ring_distances", "posed", f"{NEAR}, {PP} SELECT path_id, idx, near, phase, {r(d='d')} FROM pp")
def j5(spark, d):
    return _ring_distances(spark, d)


@query("a7_ring_distance_change", "posed", f"{NEAR}, {PP}, c AS (SELECT path_id, idx, min(d) AS lo, max(d) AS hi FROM pp GROUP BY 1, 2) SELECT path_id, {r(mean_change='avg(hi - lo)', max_change='max(hi - lo)', max_percent='100 * arg_max((hi - lo) / lo, (hi - lo, -idx))')}, arg_max(idx, (hi - lo, -idx)) AS idx FROM c GROUP BY 1")
def a7(spark, d):
    return ne.ring_distance_change(_ring_distances(spark, d), K)


@query("j6_adjacent_ring_gaps", "path", f"{NEAR} SELECT path_id AS ring, {r(min='min(d)', mean='avg(d)', max='max(d)')}, arg_min(idx, (d, idx)) AS idx_min, arg_max(idx, (d, -idx)) AS idx_max FROM ne GROUP BY 1")
def j6(spark, d):
    return ne.adjacent_ring_gaps(t.path(spark, d).withColumnRenamed("path_id", "ring"))


@query("j7_nearest_device", "path", f"SELECT a.path_id AS end_id, arg_min(b.path_id, ({ND}, -b.path_id)) AS device, {r(d=f'min({ND})')} FROM path a, path b WHERE a.idx = 0 AND b.idx = 1 GROUP BY 1")
def j7(spark, d):
    p = t.path(spark, d)
    ends = p.filter("idx = 0").select(F.col("path_id").alias("end_id"), "x", "y", "z")
    return ne.nearest_device(ends, p.filter("idx = 1").select(F.col("path_id").alias("device"), "x", "y", "z"))


@query("j8_max_pair_pulsatility", "posed", f"cc AS (SELECT a.path_id, a.idx AS ia, b.idx AS ib, max({ND}) - min({ND}) AS ch FROM posed a JOIN posed b ON b.path_id = a.path_id + 1 AND a.phase = b.phase GROUP BY 1, 2, 3) SELECT path_id, {r(change='max(ch)')}, arg_max(ia, ch) AS idx_a, arg_max(ib, ch) AS idx_b FROM cc GROUP BY 1")
def j8(spark, d):
    p = posed(spark, d)
    return ne.max_pair_pulsatility(p, _next_path(p), K)


@query("j9_edge_midpoint", "path", f"e AS (SELECT path_id, count(*) AS n, (arg_min(x, idx) + arg_max(x, idx)) / 2 AS x, (arg_min(y, idx) + arg_max(y, idx)) / 2 AS y, (arg_min(z, idx) + arg_max(z, idx)) / 2 AS z FROM path GROUP BY 1), k AS (SELECT a.*, b.n, row_number() OVER (PARTITION BY a.path_id ORDER BY {ND}, a.idx) AS k FROM path a JOIN e b USING (path_id) QUALIFY k <= 2), g AS (SELECT path_id, any_value(n) % 2 = 0 AND max(idx) - min(idx) = 1 AS two, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, arg_min(x, k) AS x, arg_min(y, k) AS y, arg_min(z, k) AS z FROM k GROUP BY 1) SELECT path_id, {r(x='CASE WHEN two THEN ax ELSE x END', y='CASE WHEN two THEN ay ELSE y END', z='CASE WHEN two THEN az ELSE z END')} FROM g")
def j9(spark, d):
    return ne.edge_midpoint(t.path(spark, d), K)


@query("j10_band_neighbours", "path", f"SELECT a.path_id, a.idx, b.idx AS oidx, {r(d=ND)}, row_number() OVER (PARTITION BY a.path_id, a.idx ORDER BY {ND}, b.idx) AS rank FROM path a JOIN path b ON a.path_id = b.path_id AND a.idx % 2 <> b.idx % 2 WHERE {ND} > 0.1 AND {ND} < 0.3 QUALIFY rank <= 2")
def j10(spark, d):
    return ne.band_neighbours(t.path(spark, d).withColumn("side", F.col("idx") % 2), 0.1, 0.3, 2, K)


LINK = "lk AS (SELECT a.path_id AS slice, a.idx, b.idx AS oidx FROM path a JOIN path b ON b.path_id = a.path_id + {n} AND abs(a.x - b.x) + abs(a.y - b.y) <= 0.02)"


def _slices(spark, d):
    return t.path(spark, d).withColumnRenamed("path_id", "slice")


@query("j11_link_slices", "path", f"{LINK.format(n=1)} SELECT slice, idx, oidx FROM lk UNION ALL SELECT path_id, idx, NULL FROM path a WHERE NOT EXISTS (SELECT 1 FROM lk WHERE slice = a.path_id AND lk.idx = a.idx)")
def j11(spark, d):
    return ne.link_slices(_slices(spark, d), 0.02)


@query("j31_relink", "path", f"{LINK.format(n=1)}, {LINK.format(n=2).replace('lk AS', 'l2 AS')} SELECT slice, idx, oidx, CAST(1 AS BIGINT) AS step FROM lk UNION ALL SELECT slice, idx, oidx, 2 FROM l2 WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.slice = l2.slice AND lk.idx = l2.idx)")
def j31(spark, d):
    return ne.relink(_slices(spark, d), 0.02)


@query("j12_merge_close", "path", f"n AS (SELECT a.path_id, a.idx, b.idx AS oidx, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM path a JOIN path b ON a.path_id = b.path_id AND a.idx <> b.idx WHERE {ND} < 0.06) SELECT path_id, idx, oidx, {r(x='x', y='y', z='z')} FROM n WHERE idx < oidx UNION ALL SELECT path_id, idx, NULL, {r(x='x', y='y', z='z')} FROM path a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path_id = a.path_id AND n.idx = a.idx)")
def j12(spark, d):
    return ne.merge_close(t.path(spark, d), 0.06, K)


@query("j13_remove_points", "path", f"SELECT path_id, idx, {r(x='x')} FROM path WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = path.idx AND c_nationkey < 10)")
def j13(spark, d):
    gone = t.read(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").cast("long").alias("idx"))
    return ne.remove_points(t.path(spark, d), gone, ["idx"]).select("path_id", "idx", "x")


@query("a43_distance_measure", "path", f"k AS (SELECT a.path_id, a.idx, {ND} AS d, row_number() OVER (PARTITION BY a.path_id, a.idx ORDER BY {ND}, b.idx) AS k FROM path a JOIN path b ON b.path_id = a.path_id + 1 QUALIFY k <= 4) SELECT path_id, idx, {r(measure='sum(d * (1.0 - (k - 1) / 4.0))')} FROM k GROUP BY 1, 2")
def a43(spark, d):
    p = t.path(spark, d)
    return ne.distance_measure(p, _next_path(p), 4, K)


@query("t4_anatomical_extremes", "path", 'SELECT path_id, arg_min(idx, (x, idx)) AS "right", arg_max(idx, (x, -idx)) AS "left", arg_min(idx, (y, idx)) AS anterior, arg_max(idx, (y, -idx)) AS posterior FROM path GROUP BY 1')
def t4(spark, d):
    return ne.anatomical_extremes(t.path(spark, d), K)


@query("t5_sort_by_angle", "path", f"SELECT path_id, idx, {r(angle='atan2(y - 0.01, x - 0.02)')}, row_number() OVER (PARTITION BY path_id ORDER BY atan2(y - 0.01, x - 0.02), idx) - 1 AS rank FROM path")
def t5(spark, d):
    return ne.sort_by_angle(t.path(spark, d), (0.02, 0.01), K).select("path_id", "idx", "angle", "rank")


@query("t6_sector_nearest", "path", f"p AS (SELECT *, sqrt(x * x + y * y) AS d, atan2(y, x) AS a FROM path), z AS (SELECT *, first_value(a) OVER (PARTITION BY path_id ORDER BY d, idx) AS a0 FROM p), s AS (SELECT *, CAST(floor((((a - a0 + pi() / 8) % (2 * pi())) + 2 * pi()) % (2 * pi()) / (pi() / 4)) AS BIGINT) AS sector FROM z), b AS (SELECT path_id, sector, min(d) AS d, arg_min(idx, (d, idx)) AS idx FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY d, idx) AS k FROM b), f AS (SELECT *, max(CASE WHEN k = 3 THEN d END) OVER (PARTITION BY path_id) AS third FROM k) SELECT path_id, sector, {r(d='d')}, idx FROM f WHERE third IS NULL OR d <= 2 * third")
def t6(spark, d):
    return ne.sector_nearest(t.path(spark, d), (0.0, 0.0), 8, K).select("path_id", "sector", "d", "idx")


@query("t9_cluster_midpoints")
def t9(spark, d):
    return ne.cluster_midpoints(ne.edge_midpoint(t.path(spark, d), K), 4).select("path_id", F.col("cluster").cast("long").alias("cluster"))


@query("v16_migration", "path", f"al AS (SELECT path_id, idx, sum(coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)), 0)) OVER (PARTITION BY path_id ORDER BY idx) AS along FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM path WINDOW w AS (PARTITION BY path_id ORDER BY idx))), {NEAR}, l AS (SELECT ne.path_id, al.along, p.z FROM ne JOIN al ON al.path_id = ne.path_id + 1 AND al.idx = ne.near JOIN path p ON p.path_id = ne.path_id AND p.idx = ne.idx WHERE ne.idx = 0) SELECT ne.path_id, ne.idx, {r(dz='p.z - l.z', along='al.along - l.along')} FROM ne JOIN al ON al.path_id = ne.path_id + 1 AND al.idx = ne.near JOIN path p ON p.path_id = ne.path_id AND p.idx = ne.idx JOIN l ON l.path_id = ne.path_id")
def v16(spark, d):
    p = t.path(spark, d)
    return ne.migration(p, p.filter("idx = 0"), _next_path(p), K)
