"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, sweep


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the smallest of all."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        near = near.filter("v > u")
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the links (u, v); label is the smallest node reachable.

    Links stay in tables; only two sums a round, which tell whether the links
    changed, come to the driver. Repeated links, loops and an empty table are fine.
    """
    now = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        new = cut(_star(_star(now, True), False), "links")
        discard(now)
        now = new
        sweep(links.sparkSession)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
