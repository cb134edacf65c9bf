"""Ordered paths: lengths, smoothing, gradients, curvature, corners, segments.

A path table has key columns (``keys``), a running ``idx`` from 0 and x, y, z.
Windows are partitioned by the keys, so paths are dealt out over the cluster and
a path, some hundreds of points, stays together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import angle, cross, distance, norm, sub, xyz
from ..sources.io import checkpointed

KEYS = ("path_id",)
AXES = ("x", "y", "z")


def over(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("idx")


def count_of(keys: Sequence[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*keys))


def _step(keys: Sequence[str], axis: str | None = None) -> Column:
    """Distance from the point before; 0 at the first."""
    w = over(keys)
    if axis:
        return F.coalesce(F.abs(F.col(axis) - F.lag(axis).over(w)), F.lit(0.0))
    return F.coalesce(distance(xyz(), tuple(F.lag(a).over(w) for a in AXES)), F.lit(0.0))


def length_along(path: DataFrame, keys: Sequence[str] = KEYS, axis: str | None = None) -> DataFrame:
    """Adds ``along``, the length up to each point; axis: only along it."""
    p = path.withColumn("along", _step(keys, axis))
    return p.withColumn("along", F.sum("along").over(over(keys).rowsBetween(Window.unboundedPreceding, 0)))


def path_length(path: DataFrame, keys: Sequence[str] = KEYS, axis: str | None = None) -> DataFrame:
    return path.withColumn("along", _step(keys, axis)).groupBy(*keys).agg(F.sum("along").alias("length"))


def rel_index(path: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``percent`` = 100 idx / (n - 1)."""
    return path.withColumn("percent", 100.0 * F.col("idx") / F.nullif(count_of(keys) - 1, F.lit(0)))


def _arrays(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    return path.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", *AXES))).alias("pts"))


def _points(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline("pts"))


def _smoothed(path: DataFrame, n: int, keys: Sequence[str], closed: bool) -> DataFrame:
    """Passes of 3-point means over the collected points; one shuffle for any n."""

    def mean(acc, p, i):
        size = F.size(acc)
        # the last point of a closed path repeats the first
        before = F.when(i > 0, i).otherwise(size - 1) if closed else i
        after = F.when(i + 2 <= size, i + 2).otherwise(F.lit(2)) if closed else i + 2
        q, s = F.element_at(acc, F.greatest(before, F.lit(1))), F.element_at(acc, F.least(after, size))
        new = F.struct(p["idx"].alias("idx"), *[((q[a] + p[a] + s[a]) / 3.0).alias(a) for a in AXES])
        return new if closed else F.when((i == 0) | (i == size - 1), p).otherwise(new)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.col("pts"), lambda acc, _: F.transform(acc, lambda p, i: mean(acc, p, i)))
    return _points(_arrays(path, keys).withColumn("pts", done if n else F.col("pts")), keys)


def smooth_open(path: DataFrame, n: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """3-point means, end points fixed."""
    return _smoothed(path, n, keys, False)


def smooth_closed(path: DataFrame, n: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """3-point means around a ring whose last point repeats its first."""
    return _smoothed(path, n, keys, True)


def gradient(path: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, prefix: str = "d") -> DataFrame:
    """Adds prefix+col: central differences inside, one-sided at the ends."""
    w = over(keys)
    out = {}
    for c in cols:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        out[prefix + c] = F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2.0)
    return path.withColumns(out)


def curvature(path: DataFrame, keys: Sequence[str] = KEYS, scale: float = 1.0) -> DataFrame:
    """Adds ``curvature`` of the space curve; 0 where the path does not bend or stands still."""
    p = gradient(gradient(path, AXES, keys, "g_"), [f"g_{a}" for a in AXES], keys, "g")
    v, a = xyz("g_"), xyz("gg_")
    speed = norm(v)
    return p.withColumn("curvature", scale * F.coalesce(norm(cross(v, a)) / F.nullif(speed * speed * speed, F.lit(0.0)), F.lit(0.0))).drop(*[f"g_{x}" for x in AXES], *[f"gg_{x}" for x in AXES])


def corners(path: DataFrame, th: int = 5, smoothness: float = 2.0, limit: float = 45.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``bend`` (degrees, Gaussian-smoothed) and ``corner``: strict local maxima above the limit.

    The bend at i is the angle of the vectors over th points before and after it;
    points nearer than th to an end have none. Smoothing runs over the bends,
    weights renormalised at the ends.
    """
    w = over(keys)
    here = xyz()
    back, ahead = (tuple(F.lag(a, s * th).over(w) for a in AXES) for s in (1, -1))
    # no angle where two points coincide
    p = path.withColumn("raw", F.degrees(angle(sub(here, back), sub(ahead, here))))
    p = p.withColumn("raw", F.when(F.lag("x", th).over(w).isNotNull() & F.lead("x", th).over(w).isNotNull(), F.coalesce("raw", F.lit(0.0))))
    reach = math.ceil(3 * smoothness)
    total = weight = F.lit(0.0)
    for k in range(-reach, reach + 1):
        g = math.exp(-0.5 * (k / smoothness) ** 2)
        at = F.lag("raw", -k).over(w) if k else F.col("raw")
        total, weight = total + F.coalesce(at * g, F.lit(0.0)), weight + F.when(at.isNotNull(), g).otherwise(0.0)
    p = p.withColumn("bend", F.when(F.col("raw").isNotNull(), total / weight)).drop("raw")
    higher = lambda s: F.coalesce(F.col("bend") > F.lag("bend", s).over(w), F.lit(True))
    return p.withColumn("corner", F.coalesce((F.col("bend") > limit) & higher(1) & higher(-1), F.lit(False)))


def split_at(path: DataFrame, flag: str = "corner", keys: Sequence[str] = KEYS) -> DataFrame:
    """Pieces between flagged points, which belong to both: adds ``piece`` and renumbers idx."""
    w = over(keys)
    p = path.withColumn("piece", F.sum(F.col(flag).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = p.filter(F.col(flag) & (F.col("idx") > 0)).withColumn("piece", F.col("piece") - 1)
    every = p.unionByName(ends)
    return every.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys, "piece").orderBy("idx")) - 1).cast("long"))


def quadrants(path: DataFrame, kind: str = "fromstart", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``quadrant`` 1 to 4 of a ring, cut at floor(n/4) multiples.

    "beforeafterstart" turns the ring by an eighth, so that quadrant 1 lies on
    both sides of the start.
    """
    n = count_of(keys)
    quarter = F.greatest(F.floor(n * 0.25), F.lit(1))
    at = F.col("idx") if kind == "fromstart" else F.pmod(F.col("idx") + F.floor(n * 0.125), n)
    return path.withColumn("quadrant", F.least(F.floor(at / quarter), F.lit(3)).cast("long") + 1)


def orient_ring(path: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reverse idx unless x at 25 % of the points lies beyond x at 75 %."""
    n, w = count_of(keys), Window.partitionBy(*keys)
    x_at = lambda share: F.max(F.when(F.col("idx") == F.floor(F.col("n") * share), F.col("x"))).over(w)
    p = path.withColumn("n", n)
    p = p.withColumn("turn", ~(x_at(0.25) > x_at(0.75)))
    return p.withColumn("idx", F.when(F.col("turn"), F.col("n") - 1 - F.col("idx")).otherwise(F.col("idx"))).drop("n", "turn")


def rotate_ring(path: DataFrame, pos: tuple[float, float, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Start a closed path at the point nearest to pos; repeated points are dropped first."""
    first = Window.partitionBy(*keys, *AXES).orderBy("idx")
    p = path.withColumn("seen", F.row_number().over(first)).filter("seen = 1").drop("seen")
    w = Window.partitionBy(*keys)
    p = p.withColumn("idx", (F.row_number().over(over(keys)) - 1).cast("long")).withColumn("d", distance(xyz(), tuple(map(F.lit, pos))))
    start = F.min(F.struct("d", "idx")).over(w)["idx"]
    return p.withColumn("idx", F.pmod(F.col("idx") - start, count_of(keys))).drop("d")


def path_ends(path: DataFrame, keys: Sequence[str] = KEYS, axis: str = "z") -> DataFrame:
    """Per path the proximal (lower on the axis) and the distal end point."""
    point = F.struct(*AXES)
    e = path.groupBy(*keys).agg(F.min_by(point, "idx").alias("first"), F.max_by(point, "idx").alias("last"))
    low = F.col(f"first.{axis}") <= F.col(f"last.{axis}")
    return e.select(*keys, F.when(low, F.col("first")).otherwise(F.col("last")).alias("proximal"), F.when(low, F.col("last")).otherwise(F.col("first")).alias("distal"))


#: Points looked at first on each side, and points of a block beyond.
NEAR, BLOCK = 16, 256


def _first_beyond(path: DataFrame, arm: float, keys: Sequence[str], back: bool) -> DataFrame:
    """(keys, n, far): the first point before (back) or after each at distance arm or more; points without one have no row.

    path (keys, n, x, y, z), n from 0 along the path. Close points come first; the others look at blocks farther and
    farther off, in steps that double, and within them at those blocks whose box reaches beyond the arm.
    """
    point = F.struct("n", *AXES)
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(*((-NEAR, -1) if back else (1, NEAR)))
    hits = F.filter("near", lambda q: distance(xyz(), tuple(q[a] for a in AXES)) >= arm)
    seen = path.withColumn("near", F.collect_list(point).over(w)).withColumn("hits", hits)
    seen = checkpointed(seen.select(*keys, "n", *AXES, F.floor(F.col("n") / BLOCK).alias("block"), F.get("hits", (F.size("hits") - 1) if back else F.lit(0)).alias("far")))
    done, left = seen.filter("far IS NOT NULL").select(*keys, "n", "far"), seen.filter("far IS NULL").drop("far")
    others = seen.select(*keys, F.col("block").alias("to"), F.struct("n", *AXES).alias("o"))
    box = checkpointed(seen.groupBy(*keys, F.col("block").alias("to")).agg(*[f(a).alias(n + a) for a in AXES for n, f in (("lo_", F.min), ("hi_", F.max))]))
    last = box.groupBy(*keys).agg(F.max("to").alias("last"))
    first = 0
    while not left.isEmpty():
        span = max(first, 1)  # blocks 0, 1, 2-3, 4-7, ... off
        off = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + span - 1).cast("long")))
        tried = left.select("*", off.alias("off")).withColumn("to", F.col("block") - F.col("off") if back else F.col("block") + F.col("off"))
        corner = F.sqrt(sum(F.pow(F.greatest(F.abs(F.col(a) - F.col("lo_" + a)), F.abs(F.col(a) - F.col("hi_" + a))), F.lit(2.0)) for a in AXES))
        met = tried.join(box, [*keys, "to"]).filter(corner >= arm * (1 - 1e-9)).join(others, [*keys, "to"])
        side = F.col("o.n") < F.col("n") if back else F.col("o.n") > F.col("n")
        met = met.filter(side & (distance(xyz(), xyz("o.")) >= arm))
        found = checkpointed(met.groupBy(*keys, "n").agg((F.max if back else F.min)("o").alias("far")))
        done, first = done.unionByName(found), first + span
        more = F.col("block") - first >= 0 if back else F.col("block") + first <= F.col("last")
        left = checkpointed(left.join(found, [*keys, "n"], "left_anti").join(last, list(keys)).filter(more).drop("last"))
    return done


def _reach(path: DataFrame, arm: float, keys: Sequence[str]) -> DataFrame:
    """For each point the first point before and after it at distance arm or more, null where there is none."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1
    p = checkpointed(path.select(*keys, "idx", *AXES).withColumn("n", n.cast("long")))
    for back, name in ((True, "before"), (False, "after")):
        p = p.join(_first_beyond(p.select(*keys, "n", *AXES), arm, keys, back).withColumnRenamed("far", name), [*keys, "n"], "left")
    return p.drop("n")


def arm_angles(path: DataFrame, arm: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Angle at each point between arms of fixed length, 0 when straight; null where the path ends first."""
    p = _reach(path, arm, keys)
    got = p.withColumn("angle", F.degrees(angle(sub(xyz(), xyz("before.")), sub(xyz("after."), xyz())))).select(*keys, "idx", "angle")
    return path.select(*keys, "idx").join(got, [*keys, "idx"], "left")


def point_at_arm(path: DataFrame, arm: float, keys: Sequence[str] = KEYS, from_end: bool = False) -> DataFrame:
    """First point at distance arm or more from the first (or last) point, going inward."""
    w = Window.partitionBy(*keys)
    point = F.struct(*AXES)
    end = (F.max_by if from_end else F.min_by)(point, "idx").over(w)
    p = path.withColumn("end", end).filter(distance(xyz(), xyz("end.")) >= arm)
    return p.groupBy(*keys).agg((F.max_by if from_end else F.min_by)(F.struct("idx", *AXES), "idx").alias("p")).select(*keys, "p.*")


def segment(path: DataFrame, n: int, part: str = "first", keys: Sequence[str] = KEYS) -> DataFrame:
    """The first or last n points."""
    w = Window.partitionBy(*keys).orderBy(F.col("idx") if part == "first" else F.col("idx").desc())
    return path.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def cubic_at(df: DataFrame, fraction: Column, cols: Sequence[str] = AXES, keys: Sequence[str] = KEYS, cyclic: bool = True, index: str = "idx") -> DataFrame:
    """Values at a fractional index, one row per key, from four taps.

    Cyclic: Catmull-Rom over indices that wrap. Otherwise a cubic B-spline whose
    taps stop at the ends. fraction may use the keys.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    p = df.withColumn("n", n).withColumn("at", fraction.cast("double"))
    base, t = F.floor("at"), F.col("at") - F.floor("at")
    if cyclic:
        weights = ((-t * t * t + 2 * t * t - t) / 2, (3 * t * t * t - 5 * t * t + 2) / 2, (-3 * t * t * t + 4 * t * t + t) / 2, (t * t * t - t * t) / 2)
    else:
        weights = ((1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6)
    taps = [(F.pmod(base + k, F.col("n")) if cyclic else F.least(F.greatest(base + k, F.lit(0)), F.col("n") - 1), w) for k, w in zip((-1, 0, 1, 2), weights)]
    weight = F.lit(0.0)
    for tap, w in taps:
        weight = weight + F.when(F.col(index) == tap, w).otherwise(0.0)
    p = p.withColumn("w", weight)
    return p.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])


def length_between(path: DataFrame, i1: float, i2: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Length from fractional index i1 to i2."""
    w = over(keys)
    step = distance(tuple(F.lead(a).over(w) for a in AXES), xyz())
    share = F.greatest(F.least(F.col("idx") + 1, F.lit(i2)) - F.greatest(F.col("idx"), F.lit(i1)), F.lit(0.0))
    return path.withColumn("part", F.coalesce(step * share, F.lit(0.0))).groupBy(*keys).agg(F.sum("part").alias("length"))


def tortuosity(path: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Path length over the distance of its ends."""
    point = F.struct(*AXES)
    p = path.withColumn("along", _step(keys)).groupBy(*keys).agg(F.sum("along").alias("length"), F.min_by(point, "idx").alias("a"), F.max_by(point, "idx").alias("b"))
    return p.select(*keys, (F.col("length") / F.nullif(distance(xyz("a."), xyz("b.")), F.lit(0.0))).alias("tortuosity"))


def tortuosity_change(posed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tortuosity over the phases: mean, std, min, max, largest difference and its phases."""
    t = tortuosity(posed, [*keys, "phase"])
    low, high = F.struct(F.col("tortuosity"), F.col("phase")), F.struct(F.col("tortuosity"), -F.col("phase"))
    s = t.groupBy(*keys).agg(F.avg("tortuosity").alias("mean"), F.stddev_pop("tortuosity").alias("std"), F.min(low).alias("lo"), F.max(high).alias("hi"))
    return s.select(*keys, "mean", "std", F.col("lo.tortuosity").alias("min"), F.col("hi.tortuosity").alias("max"), (F.col("hi.tortuosity") - F.col("lo.tortuosity")).alias("change"), F.col("lo.phase").alias("phase_min"), (-F.col("hi.col2")).alias("phase_max"))


def curvature_mean(curv: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of the mean curvatures per phase: min, max, change and change in % of the min."""
    m = curv.groupBy(*keys, "phase").agg(F.avg("curvature").alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean"), F.min("m").alias("min"), F.max("m").alias("max"))
    return m.withColumn("change", F.col("max") - F.col("min")).withColumn("percent", 100 * F.col("change") / F.nullif(F.col("min"), F.lit(0.0)))


def curvature_max(curv: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per phase the largest curvature, its first index, and its place in % and along the path."""
    k = [*keys, "phase"]
    c = length_along(rel_index(curv, k), k)
    best = F.max(F.struct(F.col("curvature"), (-F.col("idx")).alias("neg"), F.col("percent"), F.col("along"))).alias("b")
    return c.groupBy(*k).agg(best).select(*k, F.col("b.curvature").alias("curvature"), (-F.col("b.neg")).alias("idx"), F.col("b.percent").alias("percent"), F.col("b.along").alias("along"))


def curvature_maxchange(curv: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The point whose curvature changes most over the phases: index, change, change in % of its min."""
    p = curv.groupBy(*keys, "idx").agg(F.min("curvature").alias("lo"), F.max("curvature").alias("hi"))
    best = F.max(F.struct((F.col("hi") - F.col("lo")).alias("change"), (-F.col("idx")).alias("neg"), "lo")).alias("b")
    return p.groupBy(*keys).agg(best).select(*keys, (-F.col("b.neg")).alias("idx"), F.col("b.change").alias("change"), (100 * F.col("b.change") / F.nullif(F.col("b.lo"), F.lit(0.0))).alias("percent"))


def accuracy_vs_constant(curv: DataFrame, constant: float, trim: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Error of the curvature against a known constant, ``trim`` points left out at both ends."""
    n = count_of(keys)
    e = curv.withColumn("n", n).filter((F.col("idx") >= trim) & (F.col("idx") < F.col("n") - trim)).withColumn("e", F.abs(F.col("curvature") - constant))
    return e.groupBy(*keys).agg(F.avg("e").alias("mean_error"), F.stddev_pop("e").alias("std_error"), (100 * F.avg("e") / constant).alias("percent_error"))


def path_to_graph(path: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One edge for each two consecutive points."""
    w = over(keys)
    return path.select(*keys, F.col("idx").alias("n1"), F.lead("idx").over(w).alias("n2"), distance(xyz(), tuple(F.lead(a).over(w) for a in AXES)).alias("length")).filter("n2 IS NOT NULL")


def check_path_ends(path: DataFrame, ends: DataFrame, tol: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Paths whose first or last point lies further than tol, on any axis, from ends (a*, b*)."""
    point = F.struct(*AXES)
    e = path.groupBy(*keys).agg(F.min_by(point, "idx").alias("first"), F.max_by(point, "idx").alias("last")).join(ends, list(keys))
    far = F.lit(False)
    for a in AXES:
        far = far | (F.abs(F.col(f"first.{a}") - F.col(f"a{a}")) > tol) | (F.abs(F.col(f"last.{a}") - F.col(f"b{a}")) > tol)
    return e.filter(far).select(*keys)


def concat_paths(paths: DataFrame, order: Sequence[str] = KEYS, keys: Sequence[str] = ()) -> DataFrame:
    """Several paths as one: idx runs through them in the given order.

    The offset of each path comes from the counts of the paths, so points are
    not gathered in one place.
    """
    sizes = paths.groupBy(*keys, *order).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return paths.join(sizes, [*keys, *order]).withColumn("idx", F.col("idx") + F.col("offset")).drop("offset")
