"""Chains of nodes of degree 2: ordering, contraction, their joined paths.

A chain is ordered by pointer doubling over directed edges: each edge that leads
to a node of the chain knows the edge 2, 4, 8, ... steps on and how many steps
that is, until it knows the chain's end. So the order of a chain of L edges
takes about log2 L joins, and its edges never meet in one row or task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import checkpointed, released
from .graph import EDGE, KEYS, degree, edge_lengths, hooks
from .nearest import edge_midpoint
from .scan import numbered

#: What tells the chains between the same two nodes apart: their first and last node on the way, null for a single edge.
CHAIN = (*EDGE, "first", "last")


def _to_the_end(ways: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Directed edges (a, b) with the last edge (ta, tb) of their chain and the steps there; and those that go round a
    cycle for ever, with the cycle's smallest node.

    ways: (keys, a, b, inner), inner telling whether b lies within a chain; both directions of an edge.
    """
    turn = ways.filter("inner").select(*keys, F.col("b").alias("m"), F.col("a").alias("c"))
    # the two neighbours of an inner node, and whether they lie within a chain
    far = ways.select(*keys, F.col("a").alias("m"), F.col("b").alias("c"), F.col("inner").alias("c_inner")).join(turn, [*keys, "m", "c"])
    pair = far.groupBy(*keys, "m").agg(F.min(F.struct("c", "c_inner")).alias("p"), F.max(F.struct("c", "c_inner")).alias("q"))
    went = ways.filter("inner").join(pair.withColumnRenamed("m", "b"), [*keys, "b"])
    to = F.when(F.col("a") == F.col("p.c"), F.col("q")).otherwise(F.col("p"))
    state = went.select(*keys, "a", "b", F.col("b").alias("ta"), to["c"].alias("tb"), F.lit(1).cast("long").alias("steps"), F.least("b", to["c"]).alias("low"), (~to["c_inner"]).alias("ended"))
    state = checkpointed(state.unionByName(ways.filter("NOT inner").select(*keys, "a", "b", F.col("a").alias("ta"), F.col("b").alias("tb"), F.lit(0).cast("long").alias("steps"), F.lit(None).cast("long").alias("low"), F.lit(True).alias("ended"))))
    while True:
        on = state.select(*keys, F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("ta").alias("na"), F.col("tb").alias("nb"), F.col("steps").alias("more"), F.col("low").alias("lower"), F.col("ended").alias("stops"))
        moved = state.filter("NOT ended").join(on, [*keys, "ta", "tb"]).select(
            *keys, "a", "b", F.col("na").alias("ta"), F.col("nb").alias("tb"), (F.col("steps") + F.col("more")).alias("steps"),
            F.least("low", "lower").alias("low"), F.col("stops").alias("ended"), (F.col("stops") | (F.col("lower") < F.col("low"))).alias("news"),
        )
        now = checkpointed(state.filter("ended").withColumn("news", F.lit(False)).unionByName(moved))
        news = not now.filter("news").isEmpty()
        released(state)
        state = now.drop("news")
        if not news:  # nothing ended and no window of a cycle met a smaller node: the rest goes round
            return state.filter("ended").select(*keys, "a", "b", "ta", "tb", "steps"), state.filter("NOT ended").select(*keys, "a", "b", "low")


def walked(edge: DataFrame, stay: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every edge with its chain and place there: (keys, n1, n2, first, last, pos, u, v, cost, ctvalue).

    A chain runs over nodes of degree 2 that are not listed in stay (keys,
    node_id), from n1 <= n2; edge ``pos`` of it leads from u to v. A chain from a
    node back to itself starts on the side of its smaller node; of a cycle
    without any other node the smallest node stays.
    """
    edge = checkpointed(edge.select(*keys, *EDGE, "cost", "ctvalue"))
    loops = edge.filter("n1 = n2").select(*keys, F.col("n1").alias("node_id"))
    inner = degree(edge, keys).filter("degree = 2").join(loops, [*keys, "node_id"], "left_anti").select(*keys, "node_id")
    if stay is not None:
        inner = inner.join(stay.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")
    inner = checkpointed(inner)

    def marked(e: DataFrame, inside: DataFrame) -> DataFrame:
        for n in EDGE:
            e = e.join(inside.select(*keys, F.col("node_id").alias(n), F.lit(True).alias(f"i{n}")), [*keys, n], "left")
        return e.withColumns({f"i{n}": F.coalesce(f"i{n}", F.lit(False)) for n in EDGE})

    def ways(e: DataFrame) -> DataFrame:
        there = e.filter("in1 OR in2")
        return there.select(*keys, F.col("n1").alias("a"), F.col("n2").alias("b"), F.col("in2").alias("inner")).unionByName(there.select(*keys, F.col("n2").alias("a"), F.col("n1").alias("b"), F.col("in1").alias("inner")))

    held = checkpointed(marked(edge, inner))
    ended, round_ = _to_the_end(ways(held), keys)
    kept = checkpointed(round_.select(*keys, F.col("low").alias("node_id")).distinct())
    if not kept.isEmpty():
        cycle = round_.select(*keys, F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2")).distinct()
        again = marked(cycle, inner.join(kept, [*keys, "node_id"], "left_anti"))
        ended = ended.unionByName(_to_the_end(ways(checkpointed(again)), keys)[0])
    there = ended.select(*keys, F.col("a").alias("n1"), F.col("b").alias("n2"), *[F.col(c).alias(f"f_{c}") for c in ("ta", "tb", "steps")])
    back = ended.select(*keys, F.col("b").alias("n1"), F.col("a").alias("n2"), *[F.col(c).alias(f"b_{c}") for c in ("ta", "tb", "steps")])
    part = held.filter("in1 OR in2").join(there, [*keys, *EDGE]).join(back, [*keys, *EDGE])
    # from the end behind n1 if that is the smaller one, or of one end the side of the smaller node
    onward = (F.col("b_tb") < F.col("f_tb")) | ((F.col("b_tb") == F.col("f_tb")) & (F.col("b_ta") < F.col("f_ta")))
    pick = lambda p, q: F.when(onward, F.col(p)).otherwise(F.col(q))
    chained = part.select(
        *keys, pick("b_tb", "f_tb").alias("n1"), pick("f_tb", "b_tb").alias("n2"), pick("b_ta", "f_ta").alias("first"), pick("f_ta", "b_ta").alias("last"),
        pick("b_steps", "f_steps").alias("pos"), pick("n1", "n2").alias("u"), pick("n2", "n1").alias("v"), "cost", "ctvalue",
    )
    none = F.lit(None).cast("long")
    whole = held.filter("NOT in1 AND NOT in2").select(*keys, *EDGE, none.alias("first"), none.alias("last"), F.lit(0).cast("long").alias("pos"), F.col("n1").alias("u"), F.col("n2").alias("v"), "cost", "ctvalue")
    # edges that are no part of a chain stand in a table already
    return whole.unionByName(checkpointed(chained))


def pop_nodes(edge: DataFrame, stay: DataFrame | None = None, keys: Sequence[str] = KEYS, walk: DataFrame | None = None) -> DataFrame:
    """Contract nodes of degree 2: (keys, n1, n2, first, last, cost = sum, ctvalue = min, n_nodes).

    See walked(), whose result may be given. Parallel chains stay apart, by their
    first and last node; n_nodes are those contracted. An edge that is no part of
    a chain, listed once, is a row already; only the others are grouped.
    """
    walk = walked(edge, stay, keys) if walk is None else walk
    made = walk.filter("first IS NOT NULL").groupBy(*keys, *CHAIN).agg(F.sum("cost").alias("cost"), F.min("ctvalue").alias("ctvalue"), (F.count("*") - 1).alias("n_nodes"))
    return walk.filter("first IS NULL").select(*keys, *CHAIN, *[F.col(c).cast(made.schema[c].dataType).alias(c) for c in ("cost", "ctvalue")], F.lit(0).cast("long").alias("n_nodes")).unionByName(made)


def chain_points(walk: DataFrame, node: DataFrame, path: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Joined paths of chains (see walked): (keys, n1, n2, first, last, idx, x, y, z), from n1 to n2.

    path (keys, n1, n2, idx, x, y, z) holds the points of each single edge from its
    n1 to its n2; an edge without any, and all without ``path``, is straight.
    Points where edges meet come once. Points are numbered by a two-level scan.
    """
    hop = walk.select(*keys, *CHAIN, "pos", "u", "v")
    last = hop.groupBy(*keys, *CHAIN).agg(F.max_by(F.struct("pos", "v"), "pos").alias("e")).select(*keys, *CHAIN, (F.col("e.pos") + 1).alias("pos"), F.col("e.v").alias("node_id"))
    stops = hop.select(*keys, *CHAIN, "pos", F.col("u").alias("node_id")).unionByName(last)
    at = stops.join(node.select(*keys, "node_id", *"xyz"), [*keys, "node_id"]).select(*keys, *CHAIN, "pos", F.lit(0).cast("long").alias("step"), *"xyz")
    if path is not None:
        ends = path.groupBy(*keys, *EDGE).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
        way = hop.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v"), "back": F.col("u") > F.col("v")})
        within = path.join(ends, [*keys, *EDGE]).filter("idx > lo AND idx < hi").select(*keys, F.col("n1").alias("a"), F.col("n2").alias("b"), "idx", "lo", "hi", *"xyz")
        step = F.when(F.col("back"), F.col("hi") - F.col("idx")).otherwise(F.col("idx") - F.col("lo")).cast("long")
        at = at.unionByName(way.join(within, [*keys, "a", "b"]).select(*keys, *CHAIN, "pos", step.alias("step"), *"xyz"))
    return numbered(at, [*keys, *CHAIN], ("pos", "step")).select(*keys, *CHAIN, "idx", *"xyz")


def peak_valley_midpoints(edge: DataFrame, node: DataFrame, longest: float = 10.0, keys: Sequence[str] = KEYS, path: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Path points nearest the chord middle of the contracted edges shorter than ``longest``, hooks left out (see chain_points).

    path may be a function that makes the points of the edges (keys, n1, n2) given
    to it; only those of short chains are asked for.
    """
    _, rest = hooks(edge, keys)
    walk = walked(rest, keys=keys)
    short = edge_lengths(pop_nodes(edge, keys=keys, walk=walk), node, keys).filter((F.col("length") < longest) & (F.col("n1") != F.col("n2"))).select(*keys, *CHAIN)
    named = ["first", "last"]  # null for a single edge
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, *CHAIN)]
    kept = checkpointed(walk.alias("w").join(short.alias("s"), same, "left_semi"))
    if callable(path):
        path = checkpointed(path(kept.select(*keys, F.least("u", "v").alias("n1"), F.greatest("u", "v").alias("n2")).distinct()))
    points = chain_points(kept, node, path, keys)
    return edge_midpoint(points.withColumns({c: F.coalesce(c, F.lit(-1)) for c in named}), [*keys, *CHAIN]).drop(*named)
