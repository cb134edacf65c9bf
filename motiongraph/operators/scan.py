"""Prefix scans over long ordered runs of rows, in two levels.

Rows of all keys are dealt to ranges of (keys, order), so a key with most of the
rows spreads over many tasks and small keys share one. A scan summarises each
key's part of a range (a chunk), carries the summaries along the few chunks of
the key, and finishes within the chunks, all at once. No task holds more than
its range and no window runs over a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import checkpointed

CHUNK = "_chunk"


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with the number of its range; ranges follow (keys, order), and rows equal in both share one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order) if keys or order else df.repartition(1)
    return checkpointed(ranged.withColumn(CHUNK, F.spark_partition_id().cast("long")))


def matched(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys being equal; the columns of df, then those of other besides the keys."""
    other = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(other, same, how).drop(*[f"_{k}" for k in keys])


def _chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(df: DataFrame, keys: Sequence[str], summary: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """df with the carried columns of its chunk; summary are aggregates of a chunk, carried windows over the chunks before."""
    s = df.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    return matched(df, s.select(*keys, CHUNK, *[c.alias(n) for n, c in carried.items()]), (*keys, CHUNK))


_FOLD = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """df (see dealt) with running values of (kind, column), the row itself included unless ``exclusive``.

    Kinds: sum, count, max, min, and last (the last value that is not null). Nulls
    are skipped; before the first value a sum is null and a count 0.
    """
    df = df if CHUNK in df.columns else dealt(df, keys, order)
    held = df.withColumns({f"_v_{n}": c for n, (_, c) in columns.items()})
    at = F.struct(*order) if order else F.lit(0)
    summary, carried = {}, {}
    for n, (kind, _) in columns.items():
        v = F.col(f"_v_{n}")
        summary[f"_s_{n}"] = F.max_by(v, F.when(v.isNotNull(), at)) if kind == "last" else _FOLD[kind](v)
        s = F.col(f"_s_{n}")
        carried[f"_c_{n}"] = F.last(s, ignorenulls=True).over(_chunks(keys)) if kind == "last" else _FOLD["sum" if kind == "count" else kind](s).over(_chunks(keys))
    held = _with_carry(held, keys, summary, carried)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = {}
    for n, (kind, _) in columns.items():
        v, c = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        if kind == "last":
            out[n] = F.coalesce(F.last(v, ignorenulls=True).over(w), c)
        elif kind in ("max", "min"):
            out[n] = (F.greatest if kind == "max" else F.least)(_FOLD[kind](v).over(w), c)
        else:
            own = _FOLD[kind](v).over(w)
            whole = F.coalesce(own, F.lit(0)) + F.coalesce(c, F.lit(0))
            out[n] = whole if kind == "count" else F.when(own.isNotNull() | c.isNotNull(), whole)
    return held.withColumns(out).drop(*[f"_{p}_{n}" for n in columns for p in "vc"])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """df with the number of each row in its key's order, from 0; the order should be of one meaning."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, exclusive=True).withColumn(name, F.col(name).cast("long"))


def neighbouring(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], ahead: bool = False) -> DataFrame:
    """df with values of the row before, or ``ahead``, in the key's order: columns maps new names to old ones; null at the end."""
    df = df if CHUNK in df.columns else dealt(df, keys, order)
    at, row = F.struct(*order), F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    end = (F.min_by if ahead else F.max_by)(row, at)
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    step = F.lead if ahead else F.lag
    held = _with_carry(df.withColumn("_row", row), keys, {"_s": end}, {"_c": step("_s").over(chunks)})
    held = held.withColumn("_n", F.coalesce(step("_row").over(w), F.col("_c")))
    return held.withColumns({n: F.col(f"_n.{n}") for n in columns}).drop("_row", "_c", "_n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each entry of ``at``): exact quantiles, interpolated linearly between the two nearest ranks.

    Equal values are counted before anything moves. The distinct values of all
    keys are dealt to ranges, so neither a large key nor a grand total (no keys)
    meets in one task. Nulls are skipped; a key without values has nulls.
    """
    if not keys:
        return quantiles(df.withColumn("_all_rows", F.lit(0)), ("_all_rows",), value, at).drop("_all_rows")
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
    ranked = running(counted.filter("_v IS NOT NULL"), keys, ("_v",), {"_upto": ("sum", F.col("_n"))})
    whole = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = matched(whole, ranked, keys, "left")
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    picks, out = [], []
    for n, q in at.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((first <= rank) & (rank <= last), F.col("_v"))).alias(f"_{side}_{n}"))
        part, lo, hi = place - F.floor(place), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        out.append(F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi).alias(n))
    return ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks).select(*keys, *out)


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """stats, a row for each of the keys of df, with the quantiles of a column of df."""
    found = quantiles(df, keys, value, at)
    return matched(stats, found, keys) if keys else stats.withColumn("_one", F.lit(0)).join(found.withColumn("_one", F.lit(0)), "_one").drop("_one")
