"""Time signals: peaks, periods, alignment, resampling, spectra.

A signal table has keys (default ``source``), idx from 0, t and value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK, matched, neighbouring, numbered, running

KEYS = ("source",)


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("idx")


def _turn(w: np.ndarray, delta: float) -> tuple[int, int] | None:
    """Where w first lies more than delta below its highest value so far, after the place of that value."""
    width = 64
    while True:
        part = w[:width]
        below = part < np.maximum.accumulate(part) - delta
        if below.any():
            end = int(below.argmax())
            return int(part[:end].argmax()), end
        if width >= len(w):
            return None
        width *= 4


def peaks(signal: DataFrame, delta: float, keys: Sequence[str] = KEYS, chunk: int = 8192) -> DataFrame:
    """Alternating maxima and minima with hysteresis delta: (keys, idx, value, kind), a maximum first.

    A maximum counts once the signal falls more than delta below it, a minimum once
    it rises more than delta above it. Wherever the signal has moved by more than
    delta within a chunk, the search goes on from there in the same way whatever
    came before: after a fall for a minimum, after a rise for a maximum. So the
    signal is cut at the first such move of each chunk, and the segments are
    searched apart. Before that move only values above or below all earlier ones
    of their chunk matter, so quiet stretches shrink to those. Samples without a
    value are skipped.
    """
    part = Window.partitionBy(*keys, "chunk").orderBy("idx")
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    s = signal.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    s = s.withColumn("chunk", F.floor(F.col("idx") / chunk)).withColumns({"high": F.max("value").over(before), "low": F.min("value").over(before)})
    fall, rise = F.col("value") < F.col("high") - delta, F.col("value") > F.col("low") + delta
    record = F.col("high").isNull() | (F.col("value") > F.col("high")) | (F.col("value") < F.col("low"))
    s = s.withColumns({"move": F.when(fall, -1).when(rise, 1), "record": record}).drop("high", "low")
    here = F.struct("idx", F.col("move").alias("sign"))
    chunks = s.groupBy(*keys, "chunk").agg(F.min(F.when(F.col("move").isNotNull(), here)).alias("own"))
    along = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.struct(F.lit(None).cast("long").alias("idx"), F.lit(1).alias("sign"))
    chunks = chunks.withColumn("last", F.coalesce(F.last("own", ignorenulls=True).over(along), start))
    chunks = chunks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("chunk").alias("_chunk"), "own", "last")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "chunk")])
    j = s.join(chunks, same)
    at = F.col("idx") - F.coalesce(F.col("own.idx"), F.col("idx") + 1)
    # the row of the move ends one segment and begins the next
    seg = F.when(at < 0, F.array("last")).when(at == 0, F.array("last", "own")).otherwise(F.array("own"))
    dealt = j.filter(F.col("record") | (at >= 0)).select(*keys, "idx", "value", F.explode(seg).alias("seg")).select(*keys, "idx", "value", F.col("seg.idx").alias("seg"), "seg.sign")

    def own(key: tuple) -> list:
        return [None if pd.isna(k) else k for k in key[: len(keys)]]

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ignore_index=True)
        v, sign, at, found = rows["value"].to_numpy(), int(rows["sign"].iloc[0]), 0, []
        while (turn := _turn(sign * v[at:], delta)) is not None:
            k = at + turn[0]
            found.append((*own(key), rows["idx"].iloc[k], v[k], "max" if sign > 0 else "min"))
            at, sign = at + turn[1], -sign
        return pd.DataFrame(found, columns=[*keys, "idx", "value", "kind"])

    schema = f"{', '.join(f'{k} {signal.schema[k].dataType.simpleString()}' for k in keys)}, idx long, value double, kind string"
    return dealt.groupBy(*keys, "seg").applyInPandas(search, schema)


def periods(signal: DataFrame, minima: DataFrame, keys: Sequence[str] = KEYS, every: int = 1) -> DataFrame:
    """Samples from one minimum to the next, the end shared: adds period, and t and value from the period's start and minimum.

    Minima and periods are counted by two-level scans; only a period is a group.
    """
    m = numbered(minima.select(*keys, "idx"), keys, ("idx",), "_k").filter(F.col("_k") % every == 0).select(*keys, "idx", F.lit(1).alias("cut"))
    s = running(signal.join(m, [*keys, "idx"], "left"), keys, ("idx",), {"period": ("count", F.col("cut"))}).drop(CHUNK)
    shared = s.filter("cut = 1").withColumn("period", F.col("period") - 1)
    both = s.unionByName(shared).filter("period > 0")
    last = both.groupBy(*keys).agg(F.max("period").alias("last"))
    # after the last minimum no period follows
    whole = matched(both, last, keys).filter("period < last")
    start = whole.groupBy(*keys, "period").agg(F.min("t").alias("_t"), F.min("value").alias("_value"))
    return matched(whole, start, (*keys, "period")).select(*keys, "period", "idx", (F.col("t") - F.col("_t")).alias("t"), (F.col("value") - F.col("_value")).alias("value"))


def period_shape(cut: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Amplitude and duration of each period."""
    return cut.groupBy(*keys, "period").agg((F.max("value") - F.min("value")).alias("amplitude"), F.max("t").alias("duration"))


def first_period(signal: DataFrame, length: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples up to and including the first at or after t0 + length."""
    s = matched(signal, signal.groupBy(*keys).agg(F.min("t").alias("_t0")), keys)
    stop = s.groupBy(*keys).agg(F.min(F.when(F.col("t") >= F.col("_t0") + length, F.col("t"))).alias("_stop"))
    return matched(s, stop, keys).filter("_stop IS NULL OR t <= _stop").drop("_t0", "_stop")


def best_lag(signal: DataFrame, reference: DataFrame, lags: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key the lag of least root mean square error over the overlap; the last of equal lags."""
    s = signal.select(*keys, "idx", "value", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("idx", F.col("idx") + F.col("lag"))
    j = s.join(reference.select(*keys, "idx", F.col("value").alias("ref")), [*keys, "idx"])
    e = j.groupBy(*keys, "lag").agg(F.sqrt(F.avg((F.col("value") - F.col("ref")) * (F.col("value") - F.col("ref")))).alias("rmse"))
    return e.groupBy(*keys).agg(F.min(F.struct("rmse", (-F.col("lag")).alias("neg"))).alias("b")).select(*keys, (-F.col("b.neg")).cast("long").alias("lag"), F.col("b.rmse").alias("rmse"))


def roll(pattern: DataFrame, lag: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Circular shift: the sample at idx goes to idx + lag."""
    n = pattern.groupBy(*keys).agg(F.count("*").alias("_n"))
    return matched(pattern, n, keys).withColumn("idx", F.pmod(F.col("idx") + lag, F.col("_n"))).drop("_n")


def pad_periods(cut: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All periods at the length of the longest: (keys, period, k, value), null beyond a period's end."""
    k = (F.row_number().over(Window.partitionBy(*keys, "period").orderBy("idx")) - 1).cast("long")
    s = cut.filter("t >= 0").withColumn("k", k)
    longest = s.groupBy(*keys).agg(F.max("k").alias("most"))
    grid = s.select(*keys, "period").distinct().join(longest, list(keys)).select(*keys, "period", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("k"))
    return grid.join(s.select(*keys, "period", "k", "value"), [*keys, "period", "k"], "left")


def mean_period(padded: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and std of the periods at each sample; nulls are skipped."""
    return padded.groupBy(*keys, "k").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def tile(pattern: DataFrame, times: int, length: float) -> DataFrame:
    """A period repeated, each time ``length`` later."""
    p = pattern.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return p.withColumn("t", F.col("t") + F.col("turn") * length)


def rebase(df: DataFrame, how: str = "first", keys: Sequence[str] = KEYS, c: str = "value") -> DataFrame:
    """Values from the first sample, the minimum or the middle of the range on; "unit" also scales the amplitude to 1."""
    at = df.groupBy(*keys).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.min(F.struct("idx", F.col(c).alias("v")))["v"].alias("_first"))
    lo, hi = F.col("_lo"), F.col("_hi")
    base = {"first": F.col("_first"), "min": lo, "unit": lo, "middle": (lo + hi) / 2}[how]
    out = F.col(c) - base
    return matched(df, at, keys).withColumn(c, out / F.nullif(hi - lo, F.lit(0.0)) if how == "unit" else out).drop("_lo", "_hi", "_first")


def _between(t: Column) -> Column:
    """The value at t on the line from a sample (t, value) to the next (nt, nv); the sample's own at its time or without a next."""
    slope = (F.col("nv") - F.col("value")) / (F.col("nt") - F.col("t"))
    return F.when(F.col("nt").isNull() | (t == F.col("t")), F.col("value")).otherwise(F.col("value") + slope * (t - F.col("t")))


def resample(signal: DataFrame, n: int, keys: Sequence[str] = KEYS, t_new: float | None = None) -> DataFrame:
    """Linear interpolation at n equidistant times (n > 1) from the first sample to the last, or over the length t_new.

    New times meet the interval that holds them: each interval makes the grid
    points inside it, so there is no range join; its end comes by a two-level
    scan. Times beyond the last sample (t_new too long) give no row.
    """
    ends = signal.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    s = neighbouring(signal, keys, ("t", "idx"), {"nt": "t", "nv": "value"}, ahead=True).drop(CHUNK)
    s = matched(s, ends, keys).filter("nt > t OR nt IS NULL")
    step = (F.col("t1") - F.col("t0") if t_new is None else F.lit(float(t_new))) / (n - 1)
    # grid points k with t <= t0 + k step < nt; the last sample takes the last point
    first = F.ceil((F.col("t") - F.col("t0")) / step - 1e-9)
    end = F.least(F.floor((F.col("t") - F.col("t0")) / step + 1e-9), F.lit(n - 1)) if t_new is not None else F.lit(n - 1)
    last = F.when(F.col("nt").isNull(), end).otherwise(F.least(F.ceil((F.col("nt") - F.col("t0")) / step - 1e-9) - 1, F.lit(n - 1)))
    k = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("k")
    g = s.select(*keys, "t", "value", "nt", "nv", "t0", step.alias("step"), k).withColumn("at", F.col("t0") + F.col("k") * F.col("step"))
    return g.select(*keys, "k", F.col("at").alias("t"), _between(F.col("at")).alias("value"))


def resample_at(signal: DataFrame, times: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear interpolation of each signal at the given times (keys, t): adds value, null before the first and after the last sample.

    An as-of join by merged order: samples, each with the one after it, and times
    are dealt together to ranges of (keys, t), and a two-level scan brings every
    time the last sample at or before it. Of samples at one time a line ends at the
    first and the next begins at the last, whose value counts there.
    Other columns of ``times`` stay, repeated times too.
    """
    s = neighbouring(signal.select(*keys, "t", "idx", "value"), keys, ("t", "idx"), {"nt": "t", "nv": "value"}, ahead=True).drop(CHUNK).filter("nt > t OR nt IS NULL")
    rest = [c for c in times.columns if c not in (*keys, "t")]
    held = F.struct("t", "value", "nt", "nv")
    merged = s.select(*keys, "t", F.lit(0).alias("_late"), held.alias("_s"), *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in rest])
    asked = times.select(*keys, "t", F.lit(1).alias("_late"), F.lit(None).cast(merged.schema["_s"].dataType).alias("_s"), *rest)
    seen = running(merged.unionByName(asked), keys, ("t", "_late"), {"_s": ("last", F.col("_s"))}).filter("_late = 1")
    seen = seen.select(*keys, F.col("t").alias("_at"), *rest, "_s.*")
    value = F.when(F.col("nt").isNotNull() | (F.col("t") == F.col("_at")), _between(F.col("_at")))
    return seen.select(*keys, F.col("_at").alias("_t"), *rest, value.alias("_value")).withColumnsRenamed({"_t": "t", "_value": "value"})


#: Samples that are transformed together.
BLOCK = 1 << 17


def _fourier(points: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Discrete Fourier transforms of complex columns re<c>, im<c> at j < size; missing rows are zero.

    points: keys, size (a power of two), j and the columns. The size is cut in
    two factors p * q with p the larger or both equal: columns j = a * p + b are
    transformed over a, twiddled, then over b. k = k1 + q * k2 takes the place of
    j. A task transforms a block of columns at once, as one array of about BLOCK
    samples, or one column, the root of the size, if that is longer.
    """
    q = F.pow(F.lit(2.0), F.floor(F.log2("size") / 2 + 1e-9)).cast("long")
    values = [f"{part}{c}" for c in columns for part in ("re", "im")]
    schema = ", ".join([*(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys), "size long", "p long", "q long", "j long", *(f"{v} double" for v in values)])

    def lines(first: bool) -> Callable[[pa.Table], pa.Table]:
        def run(g: pa.Table) -> pa.Table:
            size, p, q = (g[c][0].as_py() for c in ("size", "p", "q"))
            # j is a * p + b before the first step and b * q + k1 before the second
            length, width = (q, p) if first else (p, q)
            at, rest = np.divmod(g["j"].to_numpy(), width)
            many = max(1, BLOCK // length)
            base = int(rest[0]) // many * many
            row = base + np.arange(min(many, width - base))[:, None]
            k = np.arange(length)
            turn = np.exp(-2j * np.pi * (row * k % size) / size) if first else 1.0
            out = {"j": (row * q + k if first else row + q * k).ravel()}
            for c in columns:
                x = np.zeros((len(row), length), complex)
                x[rest - base, at] = g[f"re{c}"].to_numpy() + 1j * g[f"im{c}"].to_numpy()
                y = np.fft.fft(x, axis=1) * turn
                out[f"re{c}"], out[f"im{c}"] = y.real.ravel(), y.imag.ravel()
            same = pa.array(np.zeros(len(out["j"]), np.int64))
            return pa.table({c: g[c].take(same) for c in (*keys, "size", "p", "q")} | out)

        return run

    x = points.withColumn("q", q).withColumn("p", F.expr("size div q")).select(*keys, "size", "p", "q", "j", *values)
    block = lambda width, length: F.floor((F.col("j") % F.col(width)) / F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col(length)))).alias("at")
    x = x.groupBy(*keys, block("p", "q")).applyInArrow(lines(True), schema)
    return x.groupBy(*keys, block("q", "p")).applyInArrow(lines(False), schema).drop("p", "q")


def dominant_frequency(signal: DataFrame, rate: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frequency of the largest spectral line besides the mean, with period and beats a minute; of equal lines the lowest.

    All n/2 lines of the n samples (idx 0 to n - 1) are searched. n is any
    number, so the spectrum is written as a convolution with a chirp and that is
    done at a power of two of at least 2n - 1 (Bluestein). A single sample has
    no line and gives no row.
    """
    signal = signal.withColumn("value", F.coalesce("value", F.lit(0.0)))
    stats = signal.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).filter("n > 1")
    s = signal.select(*keys, F.col("idx").cast("long").alias("j"), "value").join(stats, list(keys))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1) - 1e-12)).cast("long")
    # the square modulo 2n keeps the angle exact
    arg = math.pi * F.pmod(F.col("j") * F.col("j"), 2 * F.col("n")) / F.col("n")
    v = F.col("value") - F.col("mean")
    s = s.select(*keys, size.alias("size"), "j", (v * F.cos(arg)).alias("rex"), (-v * F.sin(arg)).alias("imx"), F.cos(arg).alias("rec"), F.sin(arg).alias("imc"))
    # the chirp goes round: its samples stand at j and at size - j
    zero = F.lit(0.0)
    back = s.filter("j > 0").select(*keys, "size", (F.col("size") - F.col("j")).alias("j"), zero.alias("rex"), zero.alias("imx"), "rec", "imc")
    f = _fourier(s.unionByName(back), keys, ("x", "c"))
    # the inverse transform is the conjugate's transform, conjugated, over the size
    product = f.select(*keys, "size", "j", (F.col("rex") * F.col("rec") - F.col("imx") * F.col("imc")).alias("rey"), (-F.col("rex") * F.col("imc") - F.col("imx") * F.col("rec")).alias("imy"))
    lines = _fourier(product, keys, ("y",)).join(stats, list(keys)).filter((F.col("j") >= 1) & (F.col("j") <= F.floor(F.col("n") / 2)))
    power = F.pow(F.col("rey") / F.col("size"), 2) + F.pow(F.col("imy") / F.col("size"), 2)
    best = lines.groupBy(*keys).agg(F.max(F.struct(power.alias("p"), (-F.col("j")).alias("neg"), "n")).alias("b"))
    hz = -F.col("b.neg") * rate / F.col("b.n")
    return best.select(*keys, hz.alias("frequency"), (1 / hz).alias("period"), (60 * hz).alias("bpm"))


def radius_drop(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First step whose radius falls below 0.75 of the running mean, after more than 10 steps and a move beyond 0.25 of it.

    series: keys, idx, r, x, y.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = series.withColumns({"m": F.avg("r").over(before), "n": F.count("*").over(before), "px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    moved = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    hit = s.filter((F.col("n") > 10) & (F.col("r") < 0.75 * F.col("m")) & (moved > 0.25 * F.col("m")))
    return hit.groupBy(*keys).agg(F.min(F.struct("idx", "r")).alias("h")).select(*keys, "h.idx", "h.r")
