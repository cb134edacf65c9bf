"""Cyclic motion of points: positions per phase, amplitudes, distances and angles over the cycle.

A motion table has key columns, idx, phase and dx, dy, dz. All phases of a point
fit into one row, so phase pairs are compared inside the row and cost no join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import angle, distance, dot, norm, sub, xyz
from .scan import with_quantiles

KEYS = ("path_id",)
MOVES = ("dx", "dy", "dz")
#: Components of an arm, posed and at rest.
ARMS = tuple(f"u{r}{a}" for r in ("", "r") for a in "xyz")


def at_phase(path: DataFrame, motion: DataFrame, phase: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Position of each point in one phase, or in all (then with ``phase``)."""
    m = motion if phase is None else motion.filter(F.col("phase") == phase)
    p = path.join(m, [*keys, "idx"])
    return p.select(*keys, "idx", "phase", *[(F.col(a) + F.col(d)).alias(a) for a, d in zip("xyz", MOVES)])


def _cycle(motion: DataFrame, by: Sequence[str]) -> DataFrame:
    return motion.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("phase", *MOVES))).alias("m"))


def _pairs(better) -> Column:
    """Of all phase pairs of the array m, the best by ``better``: struct (d, p, q)."""
    far = lambda a, b: F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in MOVES[1:]), (a["dx"] - b["dx"]) * (a["dx"] - b["dx"])))
    every = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["phase"] > a["phase"]), lambda b: F.struct(far(a, b).alias("d"), (-a["phase"]).alias("p"), (-b["phase"]).alias("q")))))
    return better(every)


def amplitude(motion: DataFrame, dim: str = "xyz", by: Sequence[str] = (*KEYS, "idx")) -> DataFrame:
    """Largest distance between two phase positions, with the two phases.

    dim "xyz" compares all phase pairs; "x", "y" or "z" is max - min on the axis.
    Ties take the first phases.
    """
    if dim == "xyz":
        best = _pairs(F.array_max)
        return _cycle(motion, by).withColumn("b", best).select(*by, F.coalesce("b.d", F.lit(0.0)).alias("amplitude"), (-F.col("b.p")).alias("phase_a"), (-F.col("b.q")).alias("phase_b"))
    c = f"d{dim}"
    return motion.groupBy(*by).agg((F.max(c) - F.min(c)).alias("amplitude"), F.min(F.struct(c, "phase"))["phase"].alias("phase_a"), (-F.max(F.struct(F.col(c), (-F.col("phase")).alias("neg")))["neg"]).alias("phase_b"))


def phase_pair_extremes(motion: DataFrame, by: Sequence[str] = (*KEYS, "idx")) -> DataFrame:
    """Largest and smallest distance between two phases of a point, with the pairs."""
    low = lambda every: F.array_min(F.transform(every, lambda e: F.struct(e["d"].alias("d"), (-e["p"]).alias("p"), (-e["q"]).alias("q"))))
    c = _cycle(motion, by).withColumns({"hi": _pairs(F.array_max), "lo": _pairs(low)})
    return c.select(*by, F.col("hi.d").alias("max"), (-F.col("hi.p")).alias("max_a"), (-F.col("hi.q")).alias("max_b"), F.col("lo.d").alias("min"), F.col("lo.p").alias("min_a"), F.col("lo.q").alias("min_b"))


def sum_motion(motion: DataFrame, dim: str = "xyz", by: Sequence[str] = (*KEYS, "idx")) -> DataFrame:
    """Way around the closed cycle, from the last phase back to the first."""
    w = Window.partitionBy(*by).orderBy("phase")
    first = Window.partitionBy(*by).orderBy("phase").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = [F.coalesce(F.lead(f"d{a}").over(w), F.first(f"d{a}").over(first)) - F.col(f"d{a}") for a in dim]
    return motion.withColumn("step", norm(step)).groupBy(*by).agg(F.sum("step").alias("way"))


def amplitude_stats(motion: DataFrame, dim: str = "xyz", keys: Sequence[str] = KEYS) -> DataFrame:
    return amplitude(motion, dim, (*keys, "idx")).groupBy(*keys).agg(*spread("amplitude"))


def spread(c: str) -> list[Column]:
    return [F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def total_deform(motion: DataFrame, by: Sequence[str] = (*KEYS, "idx")) -> DataFrame:
    return motion.groupBy(*by).agg(F.sum(norm(xyz("d"))).alias("total"))


def pair_distance(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of two posed points (keys, phase, x, y, z) in every phase."""
    b = b.select(*keys, "phase", *[F.col(c).alias(f"o{c}") for c in "xyz"])
    return a.join(b, [*keys, "phase"]).select(*keys, "phase", distance(xyz(), xyz("o")).alias("d"))


def _extreme_phases(c: str) -> list[Column]:
    return [F.min(F.struct(c, "phase"))["phase"].alias("phase_min"), (-F.max(F.struct(F.col(c), (-F.col("phase")).alias("neg")))["neg"]).alias("phase_max")]


def pulsatility(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five numbers of the distance over the cycle (one value a phase), phases x 10, change in mm and % of the smallest."""
    d = pair_distance(a, b, keys).withColumn("phase", F.col("phase") * 10)
    quart = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    s = d.groupBy(*keys).agg(F.min("d").alias("min"), *[F.percentile("d", q).alias(n) for n, q in quart.items()], F.max("d").alias("max"), *_extreme_phases("d"))
    return s.withColumn("change", F.col("max") - F.col("min")).withColumn("percent", 100 * F.col("change") / F.nullif(F.col("min"), F.lit(0.0)))


def change_stats(values: DataFrame, c: str, keys: Sequence[str], mid: int = 0) -> DataFrame:
    """Mean, std, min, max, range, first phases of min and max, and the value at phase ``mid``."""
    s = values.groupBy(*keys).agg(*spread(c), *_extreme_phases(c), F.max(F.when(F.col("phase") == mid, F.col(c))).alias("at_mid"))
    return s.withColumn("range", F.col("max") - F.col("min"))


def distance_change(a: DataFrame, b: DataFrame, keys: Sequence[str], mid: int = 5) -> DataFrame:
    return change_stats(pair_distance(a, b, keys), "d", keys, mid)


def three_point_angle(a: DataFrame, b: DataFrame, c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Angle, in degrees, at b between the lines to a and c, in every phase."""
    named = lambda df, p: df.select(*keys, "phase", *[F.col(x).alias(p + x) for x in "xyz"])
    j = named(a, "a").join(named(b, "b"), [*keys, "phase"]).join(named(c, "c"), [*keys, "phase"])
    return j.select(*keys, "phase", F.degrees(angle(sub(xyz("a"), xyz("b")), sub(xyz("c"), xyz("b")))).alias("angle"))


def angle_change(a: DataFrame, b: DataFrame, c: DataFrame, keys: Sequence[str]) -> DataFrame:
    return change_stats(three_point_angle(a, b, c, keys), "angle", keys)


def angle_pair_extremes(values: DataFrame, keys: Sequence[str], c: str = "angle") -> DataFrame:
    """Largest and smallest difference of an angle between two phases."""
    arr = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("phase", F.col(c).alias("v")))).alias("m"))
    diffs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["phase"] > a["phase"]), lambda b: F.abs(a["v"] - b["v"]))))
    return arr.withColumn("d", diffs).select(*keys, F.array_max("d").alias("max_difference"), F.array_min("d").alias("min_difference"))


def _greatest_changes(keys: Sequence[str]):
    """Of arms (keys, node, phase, far, ux .. uz, urx .. urz), sorted by keys and node, the greatest change (keys, node_id, change) of each node."""
    def turns(cols):
        """Where a row differs from the one before in any column."""
        new = np.zeros(len(cols[0]), bool)
        new[:1] = True
        for c in cols:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy(zero_copy_only=False)
        return new

    def angles(u, held, i, j):
        dots = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
        p, q = u[:, i], u[:, j]
        both = np.sqrt(dots(p, p)) * np.sqrt(dots(q, q))
        cos = dots(p, q) / both
        return np.arccos(np.where(np.isnan(cos), 1.0, np.clip(cos, -1, 1))), held[i] & held[j] & (both != 0)

    def reduced(t):
        """One row a node of whole nodes."""
        t = t.combine_chunks()
        first = turns([t[c].combine_chunks() for c in (*keys, "node")])
        at = np.cumsum(first) - 1
        phase, far = (t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("phase", "far"))
        row = np.lexsort((phase, at))
        at, phase, far = at[row], phase[row], far[row]
        u, held = np.empty((6, len(row))), np.ones((2, len(row)), bool)
        for k, c in enumerate(ARMS):
            col = t[c].combine_chunks()
            u[k], held[k // 3] = col.to_numpy(zero_copy_only=False)[row], held[k // 3] & col.is_valid().to_numpy(zero_copy_only=False)[row]
        most, met = np.full(first.sum(), -1.0), np.zeros(first.sum(), bool)
        # each row with the d-th after it, as long as any two so far apart belong together
        i, d = np.arange(len(row)), 0
        while len(i):
            d += 1
            i = i[i + d < len(row)]
            i = i[(at[i] == at[i + d]) & (phase[i] == phase[i + d])]
            p = i[far[i] != far[i + d]]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                (now, held_now), (rest, held_rest) = (angles(u[s], held[k], p, p + d) for k, s in enumerate((slice(0, 3), slice(3, 6))))
            met[at[p]] = True
            known = held_now & held_rest
            np.maximum.at(most, at[p[known]], np.abs(now - rest)[known])
        which = pa.array(np.flatnonzero(first)[met])
        change = pa.array(np.degrees(most[met]), mask=most[met] < 0)
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(which) for c in (*keys, "node")), change], [*keys, "node_id", "change"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 1 << 16:  # the last node may go on
                t = pa.Table.from_batches(held)
                last = int(np.flatnonzero(turns([t[c].combine_chunks() for c in (*keys, "node")]))[-1])
                if last:
                    yield reduced(t.slice(0, last))
                held = t.slice(last).combine_chunks().to_batches()
                n = 0
        if held and sum(b.num_rows for b in held):
            yield reduced(pa.Table.from_batches(held))

    return run


def node_angle_change(edge: DataFrame, node: DataFrame, motion: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Largest change, over phases and pairs of neighbours, of the angle at each node against rest.

    edge (keys, n1, n2), node (keys, node_id, x, y, z), motion (keys, node_id, phase, dx, dy, dz).
    A node's positions in all phases are one row, so each arm goes to its node once, not
    once a phase, and the arms of a node are compared there as they arrive.
    """
    k = list(keys)
    moves = motion.groupBy(*k, "node_id").agg(F.collect_list(F.struct("phase", *MOVES)).alias("moves"))
    pose = node.select(*k, "node_id", *"xyz").join(moves, [*k, "node_id"])
    named = lambda n, p: pose.select(*k, F.col("node_id").alias(n), *[F.col(c).alias(p + c) for c in (*"xyz", "moves")])
    ends = F.explode(F.array(*[F.struct(F.col(p).alias("node"), F.col(q).alias("far")) for p, q in (("n1", "n2"), ("n2", "n1"))])).alias("e")
    half = edge.filter("n1 <> n2").select(*k, "n1", "n2").distinct().select(*k, ends).select(*k, "e.node", "e.far")
    arm = half.join(named("far", "f"), [*k, "far"]).join(named("node", "n"), [*k, "node"])
    # as the join leaves them, so rows of single phases are not sorted again
    arm = arm.repartition(*k, "node").sortWithinPartitions(*k, "node")
    arm = arm.withColumn("f", F.explode("fmoves")).withColumn("n", F.explode(F.filter("nmoves", lambda m: m["phase"] == F.col("f.phase"))))
    now, rest = ([F.col(f"{p}{a}") + F.col(f"{p}.{d}") for a, d in zip("xyz", MOVES)] for p in "fn"), (xyz(p) for p in "fn")
    arm = arm.select(*k, "node", "far", F.col("f.phase").alias("phase"), *[c.cast("double").alias(n) for n, c in zip(ARMS, (*sub(*now), *sub(*rest)))])
    kinds = dict(arm.dtypes)
    return arm.mapInArrow(_greatest_changes(k), ", ".join([*(f"{c} {kinds[c]}" for c in k), f"node_id {kinds['node']}, change double"]))


def segment_angle_change(posed_a: DataFrame, posed_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Angle between two moving segments: each has columns ux, uy, uz per keys and phase."""
    b = posed_b.select(*keys, "phase", *[F.col(f"u{a}").alias(f"v{a}") for a in "xyz"])
    j = posed_a.join(b, [*keys, "phase"]).select(*keys, "phase", F.degrees(angle(xyz("u"), xyz("v"))).alias("angle"))
    return change_stats(j, "angle", keys)


def segment_com(posed: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean position of the first n points in every phase."""
    return posed.filter(F.col("idx") < n).groupBy(*keys, "phase").agg(*[F.avg(a).alias(a) for a in "xyz"])


def strain(posed: DataFrame, i1: int, i2: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(max - min) / min over phases of the length from index i1 to i2; 0 when the min is 0."""
    from .paths import path_length

    part = posed.filter(F.col("idx").between(i1, i2))
    s = path_length(part, [*keys, "phase"]).groupBy(*keys).agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    return s.select(*keys, F.when(F.col("lo") == 0, 0.0).otherwise((F.col("hi") - F.col("lo")) / F.col("lo")).alias("strain"))


def path_distance_phases(posed: DataFrame, a: int, b: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance along the path between points a and b over the phases: min, max and their phases."""
    from .paths import path_length

    s = path_length(posed.filter(F.col("idx").between(a, b)), [*keys, "phase"])
    return s.groupBy(*keys).agg(F.min("length").alias("min"), F.max("length").alias("max"), *_extreme_phases("length"))


def sample_field(points: DataFrame, field: DataFrame, keys: Sequence[str], sampling=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Trilinear displacement at points: field (phase, z, y, x, dz, dy, dx) on its own grid.

    The origin is subtracted first; axes go z, y, x. The eight corners are
    looked up by equality; where some are absent, the weights of the others are
    renormalised. Points without any corner drop out.
    """
    p = points
    for a, s, o in zip("zyx", sampling, origin):
        p = p.withColumn(f"f{a}", (F.col(a) - o) / s)
    corner = F.explode(F.array(*[F.struct(*[F.lit(b).alias(f"c{a}") for a, b in zip("zyx", (i >> 2 & 1, i >> 1 & 1, i & 1))]) for i in range(8)])).alias("c")
    p = p.select(*keys, "fz", "fy", "fx", corner)
    weight = None
    for a in "zyx":
        part = F.when(F.col(f"c.c{a}") == 1, F.col(f"f{a}") - F.floor(f"f{a}")).otherwise(1 - F.col(f"f{a}") + F.floor(f"f{a}"))
        weight = part if weight is None else weight * part
    p = p.select(*keys, weight.alias("w"), *[(F.floor(f"f{a}") + F.col(f"c.c{a}")).cast("long").alias(a) for a in "zyx"]).filter("w > 0")
    j = p.join(field, ["z", "y", "x"])
    return j.groupBy(*keys, "phase").agg(*[(F.sum(F.col("w") * F.col(d)) / F.sum("w")).alias(d) for d in ("dz", "dy", "dx")])


def relative_displacement(motion: DataFrame, mid: int = 5, by: Sequence[str] = (*KEYS, "idx")) -> DataFrame:
    """Magnitude of each phase's displacement relative to phase ``mid``."""
    w = Window.partitionBy(*by)
    ref = tuple(F.max(F.when(F.col("phase") == mid, F.col(m))).over(w) for m in MOVES)
    return motion.select(*by, "phase", norm(sub(xyz("d"), ref)).alias("displacement"))


def close_cycle(df: DataFrame, n: int = 10) -> DataFrame:
    """Repeat phase 0 as phase n."""
    return df.unionByName(df.filter("phase = 0").withColumn("phase", F.lit(n).cast("long")))


def phase_spread(values: DataFrame, c: str, by: Sequence[str] = ("phase",)) -> DataFrame:
    """Per phase: mean, median, min, max, std and quartiles over the points."""
    return with_quantiles(values.groupBy(*by).agg(*spread(c)), values, by, c, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def ring_rollup(values: DataFrame, c: str, groups: Sequence[str]) -> DataFrame:
    """Mean, std, min, max per ring and quadrant, per ring and over all, in one pass."""
    return values.rollup(*groups).agg(*spread(c), F.count("*").alias("n"))


def location_shift(values: DataFrame, c: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Place, in % of the path, of each phase's largest value: min, max and shift over the phases.

    values: keys, idx, phase and c.
    """
    w = Window.partitionBy(*keys, "phase")
    p = values.withColumn("n", F.count("*").over(w))
    top = F.max(F.struct(F.col(c), (-F.col("idx")).alias("neg"), "n")).alias("t")
    at = p.groupBy(*keys, "phase").agg(top).select(*keys, (-100.0 * F.col("t.neg") / F.nullif(F.col("t.n") - 1, F.lit(0))).alias("at"))
    return at.groupBy(*keys).agg(F.min("at").alias("min"), F.max("at").alias("max"), (F.max("at") - F.min("at")).alias("shift"))
