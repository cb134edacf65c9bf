"""Fits of circles, ellipses and planes, polygon areas, and triangle meshes.

Fits reduce all points to power sums with Spark aggregates; only the small
eigenvector step runs in a pandas UDF, on one row a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import distance, plane_distance, tetra_volume, to_plane, tri_area, xyz
from ..sources.io import checkpointed, dealt_by, few, released, shuffle_partitions
from .contraction import linked_labels


def fit_circle(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Modified least squares circle: x, y, r; points on a line give 0, 0, 0."""
    s = points.groupBy(*keys).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "x").alias("a"), F.covar_samp("x", "y").alias("b"), F.covar_samp("y", "y").alias("c"),
        (F.covar_samp("x", F.col("y") * F.col("y")) + F.covar_samp("x", F.col("x") * F.col("x"))).alias("d0"),
        (F.covar_samp("y", F.col("x") * F.col("x")) + F.covar_samp("y", F.col("y") * F.col("y"))).alias("e0"),
    )
    d, e, det = F.col("d0") * 0.5, F.col("e0") * 0.5, F.col("a") * F.col("c") - F.col("b") * F.col("b")
    flat = F.coalesce(F.abs(det) <= 1e-12 * F.greatest(F.col("a") * F.col("c"), F.lit(1e-300)), F.lit(True))
    centre = s.select(*keys, flat.alias("flat"), F.when(flat, 0.0).otherwise((d * F.col("c") - F.col("b") * e) / det).alias("cx"), F.when(flat, 0.0).otherwise((F.col("a") * e - F.col("b") * d) / det).alias("cy"))
    r = distance((F.col("x"), F.col("y")), (F.col("cx"), F.col("cy")))
    return points.join(centre, list(keys)).groupBy(*keys, "cx", "cy", "flat").agg(F.avg(r).alias("r")).select(*keys, F.col("cx").alias("x"), F.col("cy").alias("y"), F.when(F.col("flat"), 0.0).otherwise(F.col("r")).alias("r"))


_QUAD = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0))  # exponents of x and y in a conic


def _conic(row: np.ndarray) -> tuple[float, ...]:
    """Ellipse x, y, r1, r2, phi of least algebraic error from the 6 x 6 scatter matrix."""
    none = (np.nan,) * 5
    s = row.reshape(6, 6)
    s1, s2, s3 = s[:3, :3], s[:3, 3:], s[3:, 3:]
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = np.linalg.solve(np.array([[0, 0, 2.0], [0, -1, 0], [2, 0, 0]]), s1 + s2 @ t)
        _, vec = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return none
    vec = np.real(vec)
    good = np.flatnonzero(4 * vec[0] * vec[2] - vec[1] ** 2 > 0)
    if not len(good):
        return none
    a, b, c = vec[:, good[0]]
    d, e, f = t @ vec[:, good[0]]
    det = 4 * a * c - b * b
    x, y = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
    level = -(f + (d * x + e * y) / 2)
    val, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / level)
    if (val <= 0).any():
        return none
    r1, r2 = 1 / np.sqrt(val)
    return x, y, r1, r2, float(np.arctan2(axes[1, 0], axes[0, 0]) % np.pi)


def fit_ellipse(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direct least squares ellipse: x, y, r1 >= r2, phi in [0, pi); null where there is none.

    Power sums are taken about the mean, which keeps them well conditioned.
    """
    w = Window.partitionBy(*keys)
    p = points.withColumns({"mx": F.avg("x").over(w), "my": F.avg("y").over(w)}).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    mono = lambda i, j: reduce(lambda a, b: a * b, [F.col("u")] * i + [F.col("v")] * j, F.lit(1.0))
    sums = [F.sum(mono(a + c, b + d)).alias(f"s{i}_{j}") for i, (a, b) in enumerate(_QUAD) for j, (c, d) in enumerate(_QUAD)]
    s = p.groupBy(*keys).agg(F.first("mx").alias("mx"), F.first("my").alias("my"), *sums)

    @F.pandas_udf("struct<x:double,y:double,r1:double,r2:double,phi:double>")
    def solve(m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_conic(np.asarray(r, float)) for r in m], columns=["x", "y", "r1", "r2", "phi"])

    e = s.select(*keys, "mx", "my", solve(F.array(*[f"s{i}_{j}" for i in range(6) for j in range(6)])).alias("e"))
    return e.select(*keys, (F.col("e.x") + F.col("mx")).alias("x"), (F.col("e.y") + F.col("my")).alias("y"), "e.r1", "e.r2", "e.phi")


def fit_plane(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plane a x + b y + c z = d of least algebraic residual: unit normal, d <= 0.

    The constant column takes part in the minimisation.
    """
    cols = [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]
    s = points.groupBy(*keys).agg(*[F.sum(a * b).alias(f"s{i}{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)])

    @F.pandas_udf("struct<a:double,b:double,c:double,d:double>")
    def solve(m: pd.Series) -> pd.DataFrame:
        out = []
        for r in m:
            v = np.linalg.eigh(np.asarray(r, float).reshape(4, 4))[1][:, 0]
            n = np.linalg.norm(v[:3])
            v = v / n if n else v * np.nan
            d = -v[3]
            out.append(tuple(-x for x in (*v[:3], d)) if d > 0 else (*v[:3], d))
        return pd.DataFrame(out, columns=["a", "b", "c", "d"])

    return s.select(*keys, solve(F.array(*[f"s{i}{j}" for i in range(4) for j in range(4)])).alias("p")).select(*keys, "p.*")


def project(points: DataFrame, plane: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points as 2-D coordinates x, y in their key's plane."""
    j = points.join(plane, list(keys))
    u, v = to_plane(xyz(), xyz("", "abcd"))
    return j.select(*keys, "idx", u.alias("x"), v.alias("y"))


def area_change(posed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ellipse area of a ring in each phase: min, max, change and change in % of the min."""
    k = [*keys, "phase"]
    e = fit_ellipse(project(posed, fit_plane(posed, k), k), k).withColumn("area", F.pi() * F.col("r1") * F.col("r2"))
    s = e.groupBy(*keys).agg(F.min("area").alias("min"), F.max("area").alias("max"))
    return s.withColumn("change", F.col("max") - F.col("min")).withColumn("percent", 100 * F.col("change") / F.nullif(F.col("min"), F.lit(0.0)))


def ellipse_expansion(posed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the ellipse in each phase: change of the radii over the cycle."""
    k = [*keys, "phase"]
    e = fit_ellipse(posed, k)
    return e.groupBy(*keys).agg((F.max("r1") - F.min("r1")).alias("change_r1"), (F.max("r2") - F.min("r2")).alias("change_r2"))


def fan_area(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area of a polygon as a fan of triangles from its mean point."""
    w = Window.partitionBy(*keys)
    first = F.min(F.struct("idx", "x", "y", "z")).over(w)
    nxt = F.lead(F.struct("idx", "x", "y", "z")).over(w.orderBy("idx"))
    p = path.withColumns({"n": F.coalesce(nxt, first), **{f"m{a}": F.avg(a).over(w) for a in "xyz"}})
    return p.groupBy(*keys).agg(F.sum(tri_area(xyz(), xyz("n."), xyz("m"))).alias("area"))


def sample_circle(circles: DataFrame, n: int) -> DataFrame:
    """n + 1 points of each circle (keys, x, y, r), the last one on the first."""
    c = circles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    a = F.col("k") * (2 * np.pi / n)
    return c.withColumns({"px": F.col("x") + F.col("r") * F.cos(a), "py": F.col("y") + F.col("r") * F.sin(a)})


def sample_ellipse(ellipses: DataFrame, n: int) -> DataFrame:
    e = ellipses.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    a = F.col("k") * (2 * np.pi / n)
    u, v = F.col("r1") * F.cos(a), F.col("r2") * F.sin(a)
    return e.withColumns({"px": F.col("x") + u * F.cos("phi") - v * F.sin("phi"), "py": F.col("y") + u * F.sin("phi") + v * F.cos("phi")})


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the hull of distinct points (n, 2), counter-clockwise from the smallest: the farthest point right of a
    side splits it, until no point lies beyond any side."""
    lo, hi = p[np.lexsort((p[:, 1], p[:, 0]))[[0, -1]]]
    corners, open_ = [], [(lo, hi, p), (hi, lo, p)][::-1]
    while open_:
        a, b, rest = open_.pop()
        side = b - a
        off = side[1] * (rest[:, 0] - a[0]) - side[0] * (rest[:, 1] - a[1])  # positive right of the way from a to b
        rest, off = rest[off > 0], off[off > 0]
        if not len(rest):
            corners.append(a)
            continue
        far = rest[off == off.max()]
        c = far[np.argmax(far @ side)]  # of several the last on the way, the others then lie on a side
        open_ += [(c, b, rest), (a, c, rest)]
    return np.array(corners) if (lo != hi).any() else lo[None]


def convex_hull(points: DataFrame, keys: Sequence[str], share: int = 1 << 16) -> DataFrame:
    """Corners (keys, k, x, y) of the hull of 2-D points, counter-clockwise from the smallest (x, y).

    A hull of partial hulls: a key's points are dealt to shares of about ``share``
    points, of each only the corners go on, and they are dealt again to fewer
    shares until each key has one. So the last task of a key holds no more than
    corners of shares, however many points the key has. Null coordinates are skipped.
    """
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def corners(g: pa.Table) -> pa.Table:
        p = np.unique(np.stack([g["x"].to_numpy(), g["y"].to_numpy()], 1) + 0.0, axis=0)
        h = _hull(p)
        same = pa.array(np.zeros(len(h), np.int64))
        return pa.table({c: g[c].take(same) for c in keys} | {"k": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    left = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    most = left.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shares = -(-most // share)
    while shares > 1:
        deal = F.pmod(F.xxhash64("x", "y"), F.lit(shares)).alias("_share")
        left = left.groupBy(*keys, deal).applyInArrow(corners, f"{kinds}, k long, x double, y double").drop("k")
        shares = shares // 64
    return left.groupBy(*keys).applyInArrow(corners, f"{kinds}, k long, x double, y double")


# Meshes: face (mesh_id, f, v1, v2, v3), vertex (v, x, y, z)

CORNERS = ("v1", "v2", "v3")


def directed_edges(face: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """The three directed edges (a, b) of each face."""
    e = F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in zip(CORNERS, (*CORNERS[1:], CORNERS[0]))]))
    return face.select(*keys, "f", e.alias("e")).select(*keys, "f", "e.a", "e.b")


def mesh_edge_check(face: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Edges that do not have exactly two faces, with their number; none: the mesh is closed."""
    e = directed_edges(face, keys)
    return e.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")).filter("n <> 2")


def winding_conflicts(face: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Directed edges that more than one face walks."""
    return directed_edges(face, keys).groupBy(*keys, "a", "b").agg(F.count("*").alias("n")).filter("n > 1")


def validate_mesh(vertex: DataFrame, face: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Problems: faces with an absent vertex ("missing"), and vertices in fewer than three faces ("thin")."""
    c = face.select(*keys, "f", F.explode(F.array(*CORNERS)).alias("v"))
    missing = c.join(vertex, "v", "left_anti").select(*keys, F.lit("missing").alias("problem"), "f", "v").distinct()
    thin = c.groupBy(*keys, "v").agg(F.count_distinct("f").alias("n")).filter("n < 3").select(*keys, F.lit("thin").alias("problem"), F.lit(None).cast("long").alias("f"), "v")
    return missing.unionByName(thin)


def with_corners(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """face with p, q, r coordinates of its corners."""
    for c, p in zip(CORNERS, "pqr"):
        face = face.join(vertex.select(F.col("v").alias(c), *[F.col(a).alias(p + a) for a in "xyz"]), c)
    return face


def mesh_volume(vertex: DataFrame, face: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Signed volume."""
    return with_corners(face, vertex).groupBy(*keys).agg(F.sum(tetra_volume(xyz("p"), xyz("q"), xyz("r"))).alias("volume"))


def plane_section(vertex: DataFrame, face: DataFrame, plane: tuple[float, float, float, float], keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Points where mesh edges cross a plane, each edge once."""
    e = directed_edges(face, keys).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pl = tuple(F.lit(float(c)) for c in plane)
    side = vertex.withColumn("d", plane_distance(xyz(), pl))
    for n in "ab":
        e = e.join(side.select(F.col("v").alias(n), *[F.col(c).alias(n + c) for c in ("x", "y", "z", "d")]), n)
    cut = e.filter(F.col("ad") * F.col("bd") < 0).withColumn("s", F.col("ad") / (F.col("ad") - F.col("bd")))
    return cut.select(*keys, "a", "b", *[(F.col(f"a{c}") + F.col("s") * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(c) for c in "xyz"])


def _named(points: str) -> list[str]:
    return [p + a for p in points for a in "xyz"]


def _cut_faces(keys: Sequence[str], rims: bool):
    """Of faces (keys, v1 .. v3, dp .. dr, px .. rz) the triangles in front of the plane (px .. rz), or the rim segments of
    those that cross it (ux .. wz), walked so that a lid faces away from what is kept."""

    def crossing(p, q):
        """Where edges p-q meet the plane; from the lower vertex on, so that both faces of an edge get the same point."""
        turn = p[0] > q[0]
        (lo, dlo), (hi, dhi) = ((np.where(turn[:, None], y[2], x[2]), np.where(turn, y[1], x[1])) for x, y in ((p, q), (q, p)))
        at = lo + (dlo / (dlo - dhi))[:, None] * (hi - lo)
        return np.where((p[1] == 0)[:, None], p[2], np.where((q[1] == 0)[:, None], q[2], at))

    def differ(p, q):
        return ((p != q) & ~(np.isnan(p) & np.isnan(q))).any(1)

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            v, d = np.stack([col(c) for c in CORNERS], 1), np.stack([col(f"d{p}") for p in "pqr"], 1)
            at = np.stack([col(c) for c in _named("pqr")], 1).reshape(-1, 3, 3)
            front = ~(d < 0)
            n = front.sum(1)
            row = np.flatnonzero((n == 1) | (n == 2))
            # turned so that the corner that lies alone on its side comes first
            odd = np.where((n[row] == 1)[:, None], front[row], ~front[row]).argmax(1)
            a, b, c = ((v[row, k], d[row, k], at[row, k]) for k in ((odd + i) % 3 for i in range(3)))
            with np.errstate(invalid="ignore", divide="ignore"):
                ab, ac = crossing(a, b), crossing(a, c)
            alone = n[row] == 1
            if rims:
                made, of = np.concatenate([np.where(alone[:, None], ac, ab), np.where(alone[:, None], ab, ac)], 1), row
            else:
                whole, pair = np.flatnonzero(n == 3), ~alone
                one, two, three = (np.concatenate(x) for x in ((at[whole, 0], a[2][alone], ab[pair], ab[pair]), (at[whole, 1], ab[alone], b[2][pair], c[2][pair]), (at[whole, 2], ac[alone], c[2][pair], ac[pair])))
                of = np.concatenate([whole, row[alone], row[pair], row[pair]])
                held = differ(one, two) & differ(two, three) & differ(one, three)
                made, of = np.concatenate([one, two, three], 1)[held], of[held]
            names = _named("uw" if rims else "pqr")
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in map(batch.schema.get_field_index, keys)), *(pa.array(np.ascontiguousarray(x)) for x in made.T)], [*keys, *names])

    return run


def _net_rim(rim: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """A table (keys, a, b, n, ax .. bz), dealt by a, of rim segments (keys, ux .. wz) with numbers a <= b of their ends, n times from a
    to b, less those that faces walk in opposite directions, as these bound nothing."""
    # 0.0 and -0.0 are one place
    rim = rim.select(*keys, *[(F.col(c) + F.lit(0.0)).alias(c) for c in _named("uw")]).filter("ux <> wx OR uy <> wy OR uz <> wz")
    named = rim.withColumns({e: F.xxhash64(F.lit(seed), *[F.col(c) for c in _named(e)]) for e in "uw"})
    turn = F.col("u") > F.col("w")
    ends = [F.when(turn == (e == "b"), F.col(f"u{c}")).otherwise(F.col(f"w{c}")).alias(e + c) for e in "ab" for c in "xyz"]
    flat = named.select(*keys, F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b"), F.when(turn, -1).otherwise(1).alias("there"), *ends)
    flat = flat.repartition(shuffle_partitions(rim.sparkSession), *keys, "a")
    net = flat.groupBy(*keys, "a", "b", *_named("ab")).agg(F.sum("there").alias("n")).filter("n <> 0")
    return checkpointed(dealt_by(net, *keys, "a"))


def _lone(net: DataFrame, keys: Sequence[str], seed: int) -> DataFrame | None:
    """A table (keys, a), dealt by a, of the segments whose ends belong to no other; None if two places share a number.

    Places are told apart by a second hash of their coordinates.
    """
    place = lambda e: F.xxhash64(F.lit(~seed), *[F.col(c) for c in _named(e)])
    least = [F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("times")]
    seen = net.select(*keys, F.col("a").alias("node"), place("a").alias("place")).groupBy(*keys, "node").agg(*least)
    if not seen.filter("lo <> hi").isEmpty():
        return None
    # the ends b go to their number; what comes back are segments that are alone there
    far = net.select(*keys, F.col("b").alias("node"), "a", place("b").alias("place")).repartition(shuffle_partitions(net.sparkSession), *keys, "node")
    w = Window.partitionBy(*keys, "node")
    ends = far.withColumns({"first": F.min("place").over(w), "last": F.max("place").over(w), "n": F.count("*").over(w)}).join(seen, [*keys, "node"], "left")
    ends = ends.withColumn("clash", (F.col("first") != F.col("last")) | F.coalesce(F.col("first") != F.col("lo"), F.lit(False)))
    back = ends.filter("clash OR n = 1 AND times IS NULL").select(*keys, "a", "clash")
    once = seen.filter("times = 1").join(far.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys, F.col("node").alias("a"), F.lit(True).alias("once"))
    lone = checkpointed(dealt_by(back.join(once, [*keys, "a"], "left").filter("clash OR once").select(*keys, "a", "clash"), *keys, "a"))
    return lone.drop("clash") if lone.filter("clash").isEmpty() else None


def _lids(rim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A fan (keys, px .. rz) on each loop of the rim segments (keys, ux .. wz), from the mean of its points.

    Coordinates are shuffled once, to the number of an end; all else goes by numbers. Segments that
    meet no other are loops of their own, whose mean is where they begin.
    """
    for seed in range(8):
        net = _net_rim(rim, keys, seed)
        if (lone := _lone(net, keys, seed)) is not None:
            break
        released(net)
    else:
        raise RuntimeError("no numbers that tell the points of the rim apart")
    rest, alone = (net.join(lone, [*keys, "a"], how) for how in ("left_anti", "left_semi"))
    loop = linked_labels(rest.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys)
    loop = checkpointed(dealt_by(loop.select(*keys, F.col("node").alias("a"), F.col("label").alias("loop")), *keys, "a"))
    back, walked = F.col("n") < 0, (("p", "b", "a"), ("q", "a", "b"))
    sides = [F.when(back, F.col(b + c)).otherwise(F.col(a + c)).alias(p + c) for p, b, a in walked for c in "xyz"]
    times = F.explode(F.sequence(F.lit(1), F.abs("n").cast("int"))).alias("copy")
    on = rest.join(loop, [*keys, "a"]).select(*keys, "loop", *sides, times)
    # a row a loop, broadcast if few: the segments of a long loop do not meet in one task
    centre = few(checkpointed(on.groupBy(*keys, "loop").agg(*[F.avg(f"p{c}").alias(f"r{c}") for c in "xyz"])))
    fans = on.join(centre, [*keys, "loop"]).select(*keys, *_named("pqr"))
    return fans.union(alone.select(*keys, *sides, times).select(*keys, *_named("pq"), *[F.col(f"p{c}").alias(f"r{c}") for c in "xyz"]))


#: Vertices that may be broadcast, 40 bytes each.
VERTICES = 1 << 20


def cut_mesh(vertex: DataFrame, face: DataFrame, plane: tuple[float, float, float, float], keys: Sequence[str] = ("mesh_id",), lid: bool = True) -> DataFrame:
    """Triangles in front of a plane (d >= 0), crossing faces split, with a lid on each loop of the rim.

    Rows: keys and corner coordinates px .. rz. A loop is a component of the rim's
    segments; its lid is a fan from the mean of its points, so a closed mesh stays
    closed however many loops the cut has. Vertices on the plane count as in
    front; triangles without extent are dropped.
    """
    pl = tuple(F.lit(float(c)) for c in plane)
    side = few(checkpointed(vertex.select("v", *[F.col(a).cast("double").alias(a) for a in "xyz"], plane_distance(xyz(), pl).alias("d")).filter("d IS NOT NULL")), VERTICES)
    f = face.select(*keys, *CORNERS)
    for c, p in zip(CORNERS, "pqr"):
        f = f.join(side.select(F.col("v").alias(c), F.col("d").alias(f"d{p}"), *[F.col(a).alias(p + a) for a in "xyz"]), c)
    kind = ", ".join(f"{c} {t}" for c, t in face.select(*keys).dtypes)
    rows = lambda points: ", ".join([kind, *(f"{c} double" for c in _named(points))])
    kept = f.filter("dp >= 0 OR dq >= 0 OR dr >= 0").mapInArrow(_cut_faces(keys, False), rows("pqr"))
    if lid:
        apart = F.least("dp", "dq", "dr") < 0
        rim = f.filter(apart & (F.greatest("dp", "dq", "dr") >= 0)).mapInArrow(_cut_faces(keys, True), rows("uw"))
        kept = kept.unionByName(_lids(rim, keys))
    return kept


def weld_vertices(triangles: DataFrame) -> DataFrame:
    """One vertex id for equal coordinates, numbered by first appearance: adds v to rows (pos, x, y, z).

    Ranks come from counts per range of first positions, so no window holds all.
    """
    first = triangles.groupBy("x", "y", "z").agg(F.min("pos").alias("first"))
    block = F.floor(F.col("first") / 4096)
    sizes = first.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("block", before.alias("before"))
    ranked = first.withColumn("block", block).join(sizes, "block").withColumn("v", F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("first", "x", "y", "z")) - 1)
    return triangles.join(ranked.select("x", "y", "z", "v"), ["x", "y", "z"])


def flatten_mesh(vertex: DataFrame, face: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Three coordinate rows a face, in order."""
    c = face.select(*keys, "f", F.posexplode(F.array(*CORNERS)).alias("k", "v"))
    return c.join(vertex, "v").select(*keys, "f", F.col("k").cast("long").alias("k"), "x", "y", "z")


def points_from_mesh(vertex: DataFrame, invert_z: bool = False) -> DataFrame:
    z = -F.col("z") if invert_z else F.col("z")
    return vertex.select("x", "y", z.alias("z")).dropDuplicates()
