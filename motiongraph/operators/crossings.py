"""Nodes where paths from a common node part: the rewrite of a graph with shared path beginnings.

The paths that leave a node form a prefix tree: a running hash of the points so
far names each tree node, so grouping by it finds who shares what, whatever the
number of paths. A path that ends on another one cuts it there; where paths part
a new node comes, and what they shared becomes one edge. Nodes that would change
the same edge from both ends take turns; rounds go on with the nodes whose edges
changed until nothing is shared any more.

Points are stored once, in blocks, and never written again: an edge names its part of a given
path, ``lo`` to ``hi`` of ``src``, and whether it leads back there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import checkpointed
from .scan import matched, neighbouring, running

KEYS = ("scan_id",)
XYZ = ("x", "y", "z")
#: Points of a path in a row; where all paths are shorter, the points of one stay together.
BLOCK = 256
#: An edge's part of a path.
PART = ("src", "lo", "hi", "back")


def _one_edge_a_pair(edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of edges between the same two nodes the cheapest."""
    w = Window.partitionBy(*keys, "a", "b").orderBy("cost", "eid")
    return edge.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _upward(edge: DataFrame) -> DataFrame:
    """edge (a, b, src, lo, hi, back, ...) from its smaller to its larger node."""
    turned = F.col("a") > F.col("b")
    return edge.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "back": F.col("back") != turned})


def _points(part: DataFrame, point: DataFrame, short: bool) -> DataFrame:
    """part (src, lo, hi, ...) with its points (idx, x, y, z), joined by blocks of a path (src, block, points)."""
    block = F.lit(0).cast("long") if short else F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)))
    return part.withColumn("block", block).join(point, ["src", "block"]).select("*", F.inline("points")).filter("idx BETWEEN lo AND hi").drop("points")


def _half_paths(edge: DataFrame, point: DataFrame, active: DataFrame | None, keys: Sequence[str], short: bool) -> DataFrame:
    """Points of each edge seen from each of its ends: (keys, node, eid, side, i, tip, x, y, z, src, block), i from 0 at the node; tip: the node at the other end, at the last point only."""
    e = edge.filter("a <> b AND hi IS NOT NULL")
    seen = lambda node, far, side: e.select(*keys, F.col(node).alias("node"), F.col(far).alias("far"), "eid", F.lit(side).alias("side"), *PART)
    both = seen("a", "b", 1).unionByName(seen("b", "a", 2)).withColumn("d", F.count("*").over(Window.partitionBy(*keys, "node"))).filter("d > 1")
    both = both if active is None else both.join(active, [*keys, "node"], "left_semi")
    i = F.when((F.col("side") == 1) != F.col("back"), F.col("idx") - F.col("lo")).otherwise(F.col("hi") - F.col("idx"))
    tip = F.when(F.col("i") == F.col("hi") - F.col("lo"), F.col("far"))
    return _points(both, point, short).withColumn("i", i).select(*keys, "node", "eid", "side", "i", tip.alias("tip"), *XYZ, "src", "block")


def _parting(half: DataFrame, keys: Sequence[str], short: bool) -> DataFrame:
    """Of the points beyond the node that two paths or more have in common, named by (i, h), the last of each run of one
    number of paths; ``last`` of the path, ``m``: the last place (i, far) where another path ends on it, if any, and whether
    the edge is seen from both ends. Rows of an edge stay together."""
    # forty bits a point, so that sums stay exact; two of them name a beginning
    hashed = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(k), "i", *XYZ), 24)
    way, order = [*keys, "node", "eid", "side"], ("i",)
    if short:
        w = Window.partitionBy("src", "block", "eid", "side").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        named = half.withColumns({"h1": F.sum(hashed(1)).over(w), "h2": F.sum(hashed(2)).over(w)})
    else:
        named = running(half, ["eid", "side"], order, {"h1": ("sum", hashed(1)), "h2": ("sum", hashed(2))})
    named = named.filter("i > 0").select(*way, "i", "tip", *XYZ, F.xxhash64("h1", "h2").alias("h"))
    group = Window.partitionBy(*keys, "node", "i", "h")
    end = F.min(F.when(F.col("tip").isNotNull(), F.struct("eid", "tip"))).over(group)
    shared = named.withColumns({"paths": F.count("*").over(group), "q": end}).filter("paths > 1")
    shared = shared.select(*way, "i", *XYZ, "h", "paths", F.when(F.col("q.eid") != F.col("eid"), F.col("q.tip")).alias("ends"))
    m = F.max(F.when(F.col("ends").isNotNull(), F.struct("i", F.col("ends").alias("far"))))
    if short:
        seen = Window.partitionBy("eid", "side")
        shared = shared.repartition("eid").withColumns({"next": F.lead("paths").over(seen.orderBy("i")), "m": m.over(seen)})
    else:
        shared = checkpointed(neighbouring(shared, way, order, {"next": "paths"}, ahead=True))
        shared = matched(shared, shared.groupBy(*way).agg(m.alias("m")), way)
    return shared.filter("next IS NULL OR next < paths").select(*way, "i", *XYZ, "h", F.isnull("next").alias("last"), "m").withColumn("both", F.count_if("last").over(Window.partitionBy("eid")) > 1)


def split_crossings(node: DataFrame, edge: DataFrame, path: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node, edge and path tables in which no two paths from a node have a point beyond it in common.

    node (keys, node_id, x, y, z), edge (keys, n1, n2, cost, ctvalue), path (keys,
    n1, n2, idx, x, y, z) with the points from n1 (idx 0) to n2. Points are equal
    when their coordinates are.

    * Where a path ends on another, the longer one begins there instead, with its
      cost and ctvalue as they were; of several ends the last counts.
    * Where paths part, their common part becomes an edge to a new node, with the
      least cost and the greatest ctvalue of those that run over it; the rests
      keep theirs. A node that already stands at the place is used; a new one has
      a negative id that follows from its place, and ``crossing`` is true.
    * Of edges that come to join the same two nodes the cheapest stays. Loops and
      edges without path stay as they are.
    """
    pair = edge.select(*keys, "n1", "n2", F.col("cost").cast("double").alias("cost"), F.col("ctvalue").cast("double").alias("ctvalue"))
    now = checkpointed(pair.withColumnsRenamed({"n1": "a", "n2": "b"}).withColumn("eid", F.monotonically_increasing_id()))
    block = F.floor(F.col("idx") / BLOCK).alias("block")
    packed = path.select(*keys, "n1", "n2", block, F.struct(F.col("idx").cast("long").alias("idx"), *XYZ).alias("p")).repartition(*keys, "n1", "n2").groupBy(*keys, "n1", "n2", "block").agg(F.collect_list("p").alias("points"))
    point = checkpointed(packed.join(now.select(*keys, F.col("a").alias("n1"), F.col("b").alias("n2"), F.col("eid").alias("src")), [*keys, "n1", "n2"]).select("src", "block", "points"))
    size = point.groupBy(F.col("src").alias("eid")).agg((F.sum(F.size("points")) - 1).alias("hi"))
    now = now.join(size, "eid", "left").withColumns({"src": F.col("eid"), "lo": F.lit(0).cast("long"), "back": F.lit(False)})
    now = checkpointed(_one_edge_a_pair(_upward(now), keys))
    short = point.filter("block > 0").isEmpty()
    nodes, active = checkpointed(node.select(*keys, "node_id", *XYZ).withColumn("crossing", F.lit(False))), None
    next_id = (now.agg(F.max("eid")).first()[0] or 0) + 1
    while True:
        known_edge = now.select("eid", "cost", "ctvalue", *PART, F.col("a").alias("old_a"), F.col("b").alias("old_b"))
        seen = {"far": F.when(F.col("side") == 1, F.col("old_b")).otherwise(F.col("old_a")), "n": F.col("hi") - F.col("lo") + 1, "up": (F.col("side") == 1) != F.col("back")}
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        parting = checkpointed(_parting(_half_paths(now, point, active, keys, short), keys, short).join(known_edge, "eid").withColumns(seen).withColumn("waits", F.col("both") & (rank("far") < rank("node"))))
        if parting.isEmpty():
            break
        # nodes that wait for a node at the other end of a path, and those where a path that ends within a group cuts the others
        state = checkpointed(parting.groupBy(*keys, "node").agg(F.max("waits").alias("waits"), F.max(F.col("m").isNotNull()).alias("trims")))
        of, group = [*keys, "node", "eid", "side"], [*keys, "node", "i", "h"]
        cut = parting.filter("last AND m IS NOT NULL").join(state.filter("NOT waits").select(*keys, "node"), [*keys, "node"], "left_semi")
        # elsewhere: the last point of each run of one group size
        at = parting.join(state.filter("NOT waits AND NOT trims").select(*keys, "node"), [*keys, "node"], "left_semi")
        known = nodes.groupBy(*keys, *XYZ).agg(F.min("node_id").alias("known"))
        made = -1 - F.shiftrightunsigned(F.xxhash64(*XYZ), 1)
        at = at.join(known, [*keys, *XYZ], "left").withColumn("to", F.coalesce("known", made))
        w = Window.partitionBy(*of).orderBy("i")
        at = at.withColumns({"start": F.coalesce(F.lag("i").over(w), F.lit(0).cast("long")), "from": F.coalesce(F.lag("to").over(w), F.col("node"))})
        at = checkpointed(at)

        def part(start: str, end, of: str = "") -> list:
            """The path from point start to point end of an edge seen from one of its ends."""
            lo, hi, up = (F.col(of + c) for c in ("lo", "hi", "up"))
            between = {"lo": F.when(up, lo + F.col(start)).otherwise(hi - end), "hi": F.when(up, lo + end).otherwise(hi - F.col(start)), "back": ~up}
            return [F.col(of + "src").alias("src"), *[c.alias(n) for n, c in between.items()]]

        new_nodes = checkpointed(at.filter("known IS NULL").select(*keys, F.col("to").alias("node_id"), *XYZ, F.lit(True).alias("crossing")).distinct())
        owner = F.min(F.struct("eid", "side", "start", "from", "src", "lo", "hi", "up")).alias("o")
        common = at.groupBy(*group, "to").agg(F.min("cost").alias("cost"), F.max("ctvalue").alias("ctvalue"), owner)
        none = [F.lit(None).cast("long").alias(c) for c in ("old_a", "old_b")]
        common = common.select(*keys, F.col("o.from").alias("a"), F.col("to").alias("b"), "cost", "ctvalue", *part("o.start", F.col("i"), "o."), *none, F.col("to").alias("meets"))
        olds = ["old_a", "old_b"]
        rests = at.filter("last").select(*keys, F.col("to").alias("a"), F.col("far").alias("b"), "cost", "ctvalue", *part("i", F.col("n") - 1), *olds, none[0].alias("meets"))
        shorter = cut.select(*keys, F.col("m.far").alias("a"), F.col("far").alias("b"), "cost", "ctvalue", *part("m.i", F.col("n") - 1), *olds, F.col("m.far").alias("meets"))
        new = checkpointed(_upward(common.unionByName(rests).unionByName(shorter)).withColumn("eid", F.monotonically_increasing_id() + next_id))
        # of two nodes one edge stands, so that its ends tell which one goes
        gone = new.filter("old_a IS NOT NULL").select(*keys, F.col("old_a").alias("a"), F.col("old_b").alias("b"), F.lit(True).alias("gone"))
        added = new.drop(*olds, "meets").withColumn("added", F.lit(True))
        pair = now.unionByName(added, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
        pair = pair.withColumn("left", F.max("gone").over(Window.partitionBy(*keys, "a", "b"))).filter("gone IS NULL AND (added OR left IS NULL)")
        now, nodes = checkpointed(_one_edge_a_pair(pair.select(*now.columns), keys)), nodes.unionByName(new_nodes)
        next_id = max(next_id, (new.agg(F.max("eid")).first()[0] or 0) + 1)
        # a node that changed its paths has nothing to share any more, nor more than before the node at the other end of one
        active = state.filter("waits OR trims").select(*keys, "node").union(new.filter("meets IS NOT NULL").select(*keys, "meets")).distinct()
    out = now.select(*keys, F.col("a").alias("n1"), F.col("b").alias("n2"), "cost", "ctvalue")
    ways = _points(now.filter("hi IS NOT NULL").select(*keys, F.col("a").alias("n1"), F.col("b").alias("n2"), *PART), point, short)
    return nodes, out, ways.select(*keys, "n1", "n2", F.when(F.col("back"), F.col("hi") - F.col("idx")).otherwise(F.col("idx") - F.col("lo")).alias("idx"), *XYZ)
