"""Mixing sources to target weights by entropy balancing.

Each source gets a word target (``source_targets``). Document rates are the
ones nearest to 1 in relative entropy that meet the target under the limit of
``cap`` copies: rate = min(cap, exp(lambda * size / mean size)). The multiplier
of each source maximises the convex dual; Newton steps over a (source, size)
histogram find it, one distributed aggregation a step, guarded by a bracket.
Rates are then rounded to whole copies: first at random (by a hash of the id),
then a few correction rounds move single copies, between floor and ceiling as far as
that goes, until the source's words meet the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, discard, read, uniform

WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn. A target
    stops at ``cap`` times its source's size and the excess goes to the others
    by weight. In order of cap/weight the capped sources come first, so the
    level of the others follows from running sums. There is one row a source.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*map(F.lit, weights))
    t = (
        totals.withColumn("w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("most", (F.col("source_size") * cap).cast("double"))
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("left") * F.col("w") > F.col("most") * F.col("w_left"))
    )
    # the first source that is not capped fixes the level of all after it
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), "source", "left", "w_left"))).over(every)
    t = t.withColumn("rank", F.row_number().over(by_level)).withColumn("level", first)
    free = F.min(F.when(~F.col("capped"), F.col("rank"))).over(every)
    return t.withColumn("free", free).select(
        "source",
        "source_size",
        F.when(F.col("rank") >= F.col("free"), F.col("w") * F.col("level.left") / F.col("level.w_left")).otherwise(F.col("most")).alias("target"),
    )


def _with_source(rows: DataFrame, per_source: DataFrame, salt: Column, most: int = 100_000) -> DataFrame:
    """rows with the columns of their source; per_source has ``s`` and one row a source.

    Up to ``most`` sources, counted first, the table of sources is sent to all
    tasks, so rows stay where they are. Beyond that both sides are dealt by
    source and one of 64 salts, so a hot source spreads over as many tasks.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    if per_source.count() <= most:
        return rows.join(F.broadcast(per_source), same).drop("s")
    salted = per_source.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("_r", F.pmod(salt, F.lit(64)).cast("int")).join(salted, same & (F.col("_r") == F.col("_t"))).drop("s", "_r", "_t")


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(lam * x))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(F.round(value * 1024).cast("decimal(38,0)")).cast("double") / 1024


def solve_rates(hist: DataFrame, targets: DataFrame, cap: int = 3, steps: int = 25, tol: float = 1e-7) -> DataFrame:
    """(source, source_size, target, scale, lam): the dual multiplier of each source.

    hist: (source, size, n). Only one number a step, the largest relative miss,
    comes to the driver; the multipliers stay in a table.
    """
    scale = hist.filter("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = cut(
        targets.join(scale, targets.source.eqNullSafe(scale.source), "left").select(
            targets.source, "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"),
            F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e6).alias("hi"),
        ),
        "mix-state",
    )
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), x, cap)
        mass = F.col("n") * F.col("size") * rate
        moments = (
            _with_source(hist, state.withColumnRenamed("source", "s"), F.xxhash64("size"))
            .groupBy("source")
            .agg(_exact_sum(mass).alias("got"), _exact_sum(F.when(rate < cap, mass * x).otherwise(0.0)).alias("slope"))
            .withColumnRenamed("source", "s")
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        middle = F.when(hi >= 1e6, F.greatest(lo * 4, F.lit(1.0))).when(lo <= -1e4, F.least(hi * 4, F.lit(-1.0))).otherwise((lo + hi) / 2)
        met = F.abs(gap) <= tol * F.col("target")
        step = F.when(met, F.col("lam")).when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        new = cut(
            state.join(moments, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "scale", F.coalesce(step, F.col("lam")).alias("lam"),
                F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"),
                F.coalesce(F.when(F.col("target") > 0, F.abs(gap) / F.col("target")), F.lit(0.0)).alias("miss"),
            ),
            "mix-state",
        )
        discard(state)
        state = new.drop("miss")
        if (new.agg(F.max("miss")).first()[0] or 0.0) <= tol:
            break
    # a source at its limit takes every document cap times
    full = F.col("target") >= cap * F.col("source_size")
    return state.select("source", "source_size", "target", "scale", F.when(full, 1e6).otherwise(F.round("lam", 9)).alias("lam"))


def _corrected(docs: DataFrame, turn: int, cap: int, near: bool, cells: int = 4096) -> DataFrame:
    """Move single copies toward the target, in hash order, never past it.

    near: only between floor and ceiling of a document's rate; else between 0
    and ``cap``, for what small sources still miss.
    Documents are dealt to ``cells`` hash cells a source; sums over cells tell
    which cells move as a whole, and only the one where the target falls is
    looked at row by row.
    """
    miss = docs.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.max("target").alias("t"))
    miss = miss.select(F.col("source").alias("s"), (F.col("t") - F.col("got")).alias("miss"))
    miss = cut(miss, "mix-miss")
    d = _with_source(docs, miss, F.xxhash64("doc_id", "size"))
    up = F.col("miss") > 0
    most, least = (F.ceil("rate"), F.floor("rate")) if near else (F.lit(cap), F.lit(0))
    may = (F.col("size") > 0) & (F.col("size") <= F.abs("miss")) & F.when(up, F.col("copies") < most).otherwise(F.col("copies") > least)
    d = d.withColumn("may", may).withColumn("p", F.xxhash64(F.lit(f"turn {turn}"), "doc_id"))
    d = d.withColumn("cell", F.pmod("p", F.lit(cells)))
    cell = d.filter("may").groupBy("source", "cell").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("cell")
    cell = cell.withColumn("until", F.sum("words").over(order)).select(F.col("source").alias("s"), F.col("cell").alias("c"), (F.col("until") - F.col("words")).alias("before"), "until")
    d = d.join(cell, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")), "left").drop("s", "c")
    room = F.abs("miss")
    at_edge = F.col("may") & (F.col("before") <= room) & (F.col("until") > room)
    d = d.withColumn("at_edge", F.coalesce(at_edge, F.lit(False)))
    rows = Window.partitionBy("source", "cell").orderBy("p", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = d.filter("at_edge").withColumn("run", F.col("before") + F.sum("size").over(rows)).withColumn("move", F.col("run") <= room)
    rest = d.filter("NOT at_edge").withColumn("move", F.coalesce(F.col("may") & (F.col("until") <= room), F.lit(False)))
    out = edge.drop("run").unionByName(rest)
    return out.select(*docs.columns[:-1], (F.col("copies") + F.when(F.col("move"), F.when(up, 1).otherwise(-1)).otherwise(0)).alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, rounds: int = 4) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate, copies, taken.

    size counts words; null texts and texts without words have size 0 and take
    nothing. Null sources form one source. Repeated rows are mixed each on its
    own; an empty table gives an empty result. Other columns are not read, so
    names in them cannot clash. Reruns agree: every choice hangs on the id and
    the sums do not depend on the order of the rows.
    """
    sized = cut(
        docs.select(
            docs[id_col].alias("doc_id"),
            docs[source_col].alias("source"),
            F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    totals = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    duals = solve_rates(hist, source_targets(totals, cap=cap), cap).withColumnRenamed("source", "s")
    rate = _rate(F.col("lam"), F.col("size") / F.col("scale"), cap)
    rated = _with_source(sized, duals, F.xxhash64("doc_id", "size")).select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"))
    rounded = F.least(F.floor(F.col("rate") + uniform(F.lit("copies"), "doc_id")), F.lit(cap)).cast("long")
    out = cut(rated.withColumn("copies", F.when(F.col("size") > 0, rounded).otherwise(0)), "mix-copies")
    for turn in range(rounds):
        new = cut(_corrected(out, turn, cap, 2 * turn < rounds), "mix-copies")
        discard(out)
        out = new
    discard(hist, sized)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
