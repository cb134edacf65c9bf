"""Voxel neighbourhoods as equi-joins on exploded offsets.

Rows are dealt by coordinate, so one large scan spreads over the cluster. An
absent voxel is ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def offsets(reach: Sequence[int], centre: bool = False) -> list[tuple[int, ...]]:
    """All offsets of a box of the given half widths."""
    out: list[tuple[int, ...]] = [()]
    for r in reach:
        out = [(*o, k) for o in out for k in range(-r, r + 1)]
    return [o for o in out if centre or any(o)]


def shifted(df: DataFrame, by: Sequence[tuple[int, ...]], axes: Sequence[str] = AXES) -> DataFrame:
    """Each row once per offset: columns o+axis hold the row's own place, axis the shifted one."""
    s = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"s{a}") for a, v in zip(axes, o)]) for o in by])).alias("s")
    rest = [c for c in df.columns if c not in axes]
    return df.select(*rest, *axes, s).select(*rest, *[F.col(a).alias(f"o{a}") for a in axes], *[(F.col(a) + F.col(f"s.s{a}")).alias(a) for a in axes])


def _neighbourhood(voxels: DataFrame, keys: Sequence[str], th: float) -> DataFrame:
    """For each voxel above th: largest neighbour, and whether one is smaller or above th."""
    around = shifted(voxels.filter(F.col("v") > th).withColumnRenamed("v", "own"), offsets((1, 1, 1)))
    j = around.join(voxels, [*keys, *AXES])
    return j.groupBy(*keys, *[F.col(f"o{a}").alias(a) for a in AXES], F.col("own").alias("v")).agg(F.max("v").alias("near"), F.max(F.col("v") < F.col("own")).alias("smaller"), F.max(F.col("v") > th).alias("strong"))


def local_maxima(voxels: DataFrame, th: float, keys: Sequence[str] = ()) -> DataFrame:
    """Seeds: voxels above th that no neighbour exceeds and some neighbour is below; ties stay."""
    n = _neighbourhood(voxels, keys, th)
    return n.filter("v >= near AND smaller").select(*keys, *AXES, "v")


def dense_seeds(voxels: DataFrame, th: float, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels above th with a neighbour above th."""
    return _neighbourhood(voxels, keys, th).filter("strong").select(*keys, *AXES, "v")


def carve(voxels: DataFrame, path: DataFrame, r: int, rz: int, keys: Sequence[str] = ()) -> DataFrame:
    """Set voxels in boxes around path points (z, y, x) to 0."""
    boxes = shifted(path.select(*keys, *AXES), offsets((rz, r, r), True)).select(*keys, *AXES).distinct().withColumn("inside", F.lit(True))
    return voxels.join(boxes, [*keys, *AXES], "left").withColumn("v", F.when(F.col("inside"), 0.0).otherwise(F.col("v"))).drop("inside")


def isosurface_points(voxels: DataFrame, level: float, keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated crossing of a level on every voxel edge: (axis, z, y, x, at), at is the place on the axis."""
    out = None
    for i, a in enumerate(AXES):
        other = voxels.select(*keys, *[(F.col(b) - (1 if b == a else 0)).alias(b) for b in AXES], F.col("v").alias("w"))
        j = voxels.join(other, [*keys, *AXES]).filter((F.col("v") < level) != (F.col("w") < level))
        e = j.select(*keys, F.lit(a).alias("axis"), *AXES, (F.col(a) + (level - F.col("v")) / (F.col("w") - F.col("v"))).alias("at"))
        out = e if out is None else out.unionByName(e)
    return out


def subpixel(points: DataFrame, voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Offset per axis of the parabola's vertex through three neighbours; 0 beyond 1 or with an absent neighbour."""
    p = points.join(voxels, [*keys, *AXES])
    for a in AXES:
        for name, s in ((f"lo_{a}", 1), (f"hi_{a}", -1)):
            p = p.join(voxels.select(*keys, *[(F.col(b) + (s if b == a else 0)).alias(b) for b in AXES], F.col("v").alias(name)), [*keys, *AXES], "left")

    def vertex(a: str) -> Column:
        lo, hi = F.col(f"lo_{a}"), F.col(f"hi_{a}")
        t = 0.5 * (lo - hi) / F.nullif(lo - 2 * F.col("v") + hi, F.lit(0.0))
        return F.coalesce(F.when(F.abs(t) <= 1, t), F.lit(0.0)).alias(f"d{a}")

    return p.select(*keys, *AXES, *map(vertex, AXES))


def kernel(sigma: float, order: int = 0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian, or of its first or second derivative."""
    reach = math.ceil(3 * sigma)
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(g)
    shape = {0: lambda k: 1.0, 1: lambda k: -k / sigma**2, 2: lambda k: (k * k - sigma**2) / sigma**4}[order]
    return [(k, w / total * shape(k)) for k, w in zip(range(-reach, reach + 1), g)]


def gaussian_filter(df: DataFrame, sigma: float, axis: str = "idx", keys: Sequence[str] = (), value: str = "v", order: int = 0, edge: str = "zero") -> DataFrame:
    """Filter along one axis; chain calls for more. edge: zero, or nearest (needs the ends of each key)."""
    taps = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(w).alias("w")) for k, w in kernel(sigma, order)])).alias("t")
    src = df.select(*keys, axis, value)
    if edge == "nearest":
        w = Window.partitionBy(*keys)
        ends = src.withColumns({"lo": F.min(axis).over(w), "hi": F.max(axis).over(w)})
        reach = math.ceil(3 * sigma)
        # an end value stands for the places beyond it
        more = F.when((F.col(axis) == F.col("lo")) & (F.col(axis) == F.col("hi")), F.sequence(F.col(axis) - reach, F.col(axis) + reach)).when(F.col(axis) == F.col("lo"), F.sequence(F.col(axis) - reach, F.col(axis))).when(F.col(axis) == F.col("hi"), F.sequence(F.col(axis), F.col(axis) + reach)).otherwise(F.array(axis))
        src = ends.select(*keys, F.explode(more).alias(axis), value)
    sent = src.select(*keys, axis, value, taps).select(*keys, (F.col(axis) - F.col("t.k")).alias(axis), (F.col(value) * F.col("t.w")).alias(value))
    got = sent.groupBy(*keys, axis).agg(F.sum(value).alias(value))
    return df.drop(value).join(got, [*keys, axis])


def needle_points(pixels: DataFrame, sigma: float, th: float, keys: Sequence[str] = ()) -> DataFrame:
    """Needle response of slices (keys, y, x, v): product of the negative second derivatives, local maxima above th."""
    xx = gaussian_filter(pixels, sigma, "x", [*keys, "y"], "v", 2)
    yy = gaussian_filter(pixels, sigma, "y", [*keys, "x"], "v", 2)
    both = xx.withColumnRenamed("v", "xx").join(yy.withColumnRenamed("v", "yy"), [*keys, "y", "x"])
    resp = both.select(*keys, "y", "x", (F.least("xx", F.lit(0.0)) * F.least("yy", F.lit(0.0))).alias("v"))
    around = shifted(resp.filter(F.col("v") > th).withColumnRenamed("v", "own"), offsets((1, 1)), ("y", "x")).join(resp, [*keys, "y", "x"])
    top = around.groupBy(*keys, F.col("oy").alias("y"), F.col("ox").alias("x"), F.col("own").alias("v")).agg(F.max("v").alias("near"))
    return top.filter("v >= near").select(*keys, "y", "x", "v")


def threshold_mask(voxels: DataFrame, lo: float, border: int, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels above lo that lie at least ``border`` from the extent of their scan."""
    ext = voxels.groupBy(*keys).agg(*[f(a).alias(n + a) for a in AXES for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    v = voxels.filter(F.col("v") > lo)
    j = v.join(ext, list(keys)) if keys else v.join(F.broadcast(ext))  # one row
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"lo_{a}") + border) & (F.col(a) <= F.col(f"hi_{a}") - border)
    return j.filter(inside).select(*keys, *AXES, "v")


def crop(voxels: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Voxels of a box, indices from its corner on."""
    for a, (lo, hi) in ranges.items():
        voxels = voxels.filter(F.col(a).between(lo, hi - 1)).withColumn(a, F.col(a) - lo)
    return voxels


def average_phases(voxels: DataFrame, start: int, end: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over a window of phases, which may wrap."""
    p = F.col("phase")
    within = p.between(start, end) if start <= end else (p >= start) | (p <= end)
    return mean_volume(voxels.filter(within), keys)


def mean_volume(voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return voxels.groupBy(*keys, *AXES).agg(F.avg("v").alias("v"))


def index_to_world(df: DataFrame, sampling=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Index z, y, x to world x, y, z; sampling and origin are in z, y, x order."""
    world = {a: F.col(a) * s + o for a, s, o in zip(AXES, sampling, origin)}
    return df.withColumns(world)


def world_to_index(df: DataFrame, sampling=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), bias: float = 0.5) -> DataFrame:
    return df.withColumns({a: (bias + (F.col(a) - o) / s).cast("int") for a, s, o in zip(AXES, sampling, origin)})


def path_min(path: DataFrame, voxels: DataFrame, keys: Sequence[str] = ("path_id",)) -> DataFrame:
    """Smallest voxel value along each path (z, y, x)."""
    return path.join(voxels, list(AXES)).groupBy(*keys).agg(F.min("v").alias("strength"))


def check_phases(voxels: DataFrame, n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Per phase the extent; ``complete`` when all n phases are there and agree."""
    ext = voxels.groupBy(*keys, "phase").agg(*[(F.max(a) - F.min(a) + 1).alias(f"n{a}") for a in AXES])
    shape = F.struct(*[f"n{a}" for a in AXES])
    return ext.groupBy(*keys).agg(F.count("*").alias("phases"), ((F.count("*") == n) & (F.min(shape) == F.max(shape))).alias("complete"))


def band_peaks(pixels: DataFrame, spacing: int, th: float, keys: Sequence[str] = ()) -> DataFrame:
    """Strongest pixel above th in each band of rows; ties take the first y, x."""
    p = pixels.filter(F.col("v") > th).withColumn("band", F.floor(F.col("y") / spacing))
    best = F.max(F.struct(F.col("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b")
    return p.groupBy(*keys, "band").agg(best).select(*keys, "band", (-F.col("b.ny")).alias("y"), (-F.col("b.nx")).alias("x"), F.col("b.v").alias("v"))
