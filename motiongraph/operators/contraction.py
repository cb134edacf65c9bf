"""Connected components by contraction.

Numbered links are dealt to ranges of about CHUNK links first, so that nodes with
numbers close to each other meet; each task contracts its own. What is left are
links between the contracted parts, by nodes that stand in several ranges: again
by ranges if that left few, else by rounds.

In a round every node goes over to the neighbour, or itself, that comes first in
a random order of the round; equal links merge and links inside a node vanish.
What has no link left is settled and takes no part any more, so tables shrink
round by round, on a chain to a half; once the links left are counted to be at
most SMALL, one task settles them. Each round's step is kept as a table, and the
labels run back through the steps, the smallest table first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import checkpointed, few, released


#: Links that one task may settle.
SMALL = 1 << 18
#: Numbered links that a task contracts, about.
CHUNK = 1 << 19


def _met(links: pa.Table) -> pa.RecordBatch:
    """(keys, node, to) of all nodes of links (keys, u, v): the smallest each is linked with."""
    *keys, u, v = (c.combine_chunks() for c in links.columns)
    n, code = links.num_rows, np.zeros(links.num_rows, np.int64)
    for k in keys:
        d = k.dictionary_encode()
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(), return_inverse=True)[1]
    node, at = np.unique(np.concatenate([u.to_numpy(), v.to_numpy()]), return_inverse=True)
    if code.any():  # numbered by key, then node
        both, at = np.unique(np.tile(code, 2) * len(node) + at, return_inverse=True)
        node = node[both % len(node)]
    to, p, q = np.arange(len(node)), at[:n], at[n:]
    while len(p):  # p and q lead nowhere: the larger of two goes over to the smallest it meets
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while (to[to] != to).any():
            to = to[to]
        p, q = to[p], to[q]
        p, q = p[p != q], q[p != q]
    row = np.empty(len(node), np.int64)
    row[at] = np.tile(np.arange(n), 2)
    cols = [*(k.take(pa.array(row)) for k in keys), pa.array(node), pa.array(node[to])]
    return pa.RecordBatch.from_arrays(cols, [*links.column_names[:-2], "node", "to"])


def _contracted(batches, most: int):
    """_met() of every ``most`` links or a few more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield _met(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _met(pa.Table.from_batches(held))


def _settled(batches):
    """(keys, node, to) of all nodes of links (keys, u, v): the first of each component, by joining trees."""
    plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x
    up, held, schema = {}, {}, None

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for b in batches:
        schema = b.schema
        for *key, u, v in zip(*(c.to_pylist() for c in b.columns)):
            ends = []
            for x in (u, v):
                n = (*key, plain(x))
                held.setdefault(n, x)
                up.setdefault(n, n)
                ends.append(top(n))
            up[max(ends)] = min(ends)
    nodes = list(up)
    for lo in range(0, len(nodes), 10_000):
        some = nodes[lo : lo + 10_000]
        cols = [pa.array([n[k] for n in some], f.type) for k, f in enumerate(list(schema)[:-2])]
        cols += [pa.array([held[n] for n in some], schema.field("u").type), pa.array([held[top(n)] for n in some], schema.field("u").type)]
        yield pa.RecordBatch.from_arrays(cols, [*schema.names[:-2], "node", "to"])


def _order(kind: str, turn: int) -> tuple[Callable[[str], Column], Callable[[Column], Column]]:
    """The order of a round: what stands for a node in it, and the node again."""
    if kind == "bigint":  # numbers stay numbers, whose minima need no sort
        r = Random(turn).getrandbits(62) | 1
        return lambda c: F.col(c).bitwiseXOR(F.lit(r)), lambda x: x.bitwiseXOR(F.lit(r))
    return lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n")), lambda x: x["n"]


def _relabelled(links: DataFrame, step: DataFrame, keys: Sequence[str]) -> DataFrame:
    for end in ("u", "v"):
        links = links.join(step.select(*keys, F.col("node").alias(end), F.col("to").alias(f"{end}_to")), [*keys, end])
    links = links.filter("u_to <> v_to")
    return links.select(*keys, F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct()


def _by_ranges(live: DataFrame, keys: Sequence[str], kinds: str) -> DataFrame:
    """linked_labels of a stored table of numbered links, which may repeat."""
    n, most = live.count(), CHUNK
    dealt = live.coalesce(1) if n <= most else live.repartitionByRange(-(-n // most), *keys, "u", "v")
    step = dealt.mapInArrow(lambda batches: _contracted(batches, 2 * most), kinds)
    if n <= most:
        return step.withColumnRenamed("to", "label")
    # a node that stands in several ranges links the parts it went over to
    w = Window.partitionBy(*keys, "node").orderBy("to")
    step = checkpointed(step.withColumns({"least": F.min("to").over(w), "k": F.row_number().over(w)}).filter("k = 1 OR to <> least"))
    left = checkpointed(step.filter("to <> least").select(*keys, F.col("least").alias("u"), F.col("to").alias("v")).distinct())
    first, m = step.filter("k = 1").select(*keys, "node", "to"), left.count()
    if not m:
        return first.withColumnRenamed("to", "label")
    later = few(checkpointed((_by_ranges if m <= n // 4 else _by_rounds)(left, keys, kinds).withColumnsRenamed({"node": "to", "label": "later"})))
    return first.join(later, [*keys, "to"], "left").select(*keys, "node", F.coalesce("later", "to").alias("label"))


def linked_labels(links: DataFrame, keys: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """(keys, node, label) of every node of links (keys, u, v): the smallest node reachable. Loops and repeats are fine.

    stored: links is read from a table and may be read again.
    """
    kinds = ", ".join(f"{c} {links.schema[x].dataType.simpleString()}" for c, x in (*((k, k) for k in keys), ("node", "u"), ("to", "u")))
    live = links.filter("u <> v").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if links.schema["u"].dataType.simpleString() != "bigint":
        return _by_rounds(checkpointed(live.distinct()), keys, kinds)
    live = live.dropna(subset=list(keys)) if keys else live
    return _by_ranges(live if stored else checkpointed(live), keys, kinds)


def _by_rounds(live: DataFrame, keys: Sequence[str], kinds: str) -> DataFrame:
    """linked_labels of a stored table of different links."""
    least, steps = None, []
    while n := live.count():
        rank, named = _order(live.schema["u"].dataType.simpleString(), len(steps))
        both = live.select(*keys, F.col("u").alias("node"), rank("v").alias("r")).union(live.select(*keys, F.col("v").alias("node"), rank("u").alias("r")))
        to = both.groupBy(*keys, "node").agg(F.min("r").alias("r")).select(*keys, "node", named(F.least(F.col("r"), rank("node"))).alias("to"))
        if n <= SMALL:
            to = live.coalesce(1).mapInArrow(_settled, kinds)
        # in the first round each node is its own label
        step = checkpointed(to.withColumn("label", F.col("node")) if least is None else to.join(least, [*keys, "node"]))
        steps.append(step)
        now = checkpointed(_relabelled(live, step, keys))
        released(live)
        live = now
        least = step.groupBy(*keys, F.col("to").alias("node")).agg(F.min("label").alias("label"))
    final = None
    for step in reversed(steps):
        merged = step.groupBy(*keys, "to").agg(F.min("label").alias("merged"))
        if final is not None:  # those that went on have the label found later
            merged = merged.join(final.withColumnsRenamed({"node": "to", "label": "later"}), [*keys, "to"], "left").select(*keys, "to", F.coalesce("later", "merged").alias("merged"))
        final = step.select(*keys, "node", "to").join(merged, [*keys, "to"]).select(*keys, "node", F.col("merged").alias("label"))
        final = final if step is steps[0] else checkpointed(final)
    return final if final is not None else live.select(*keys, F.col("u").alias("node"), F.col("u").alias("label"))


def components(edge: DataFrame, node: DataFrame | None = None, keys: Sequence[str] = ("scan_id",), stored: bool = False) -> DataFrame:
    """(keys, node_id, component): the smallest node reachable, of the nodes of edge and node.

    stored: edge is read from a table and may be read again.
    """
    ends = edge.select(*keys, "n1", "n2")
    ends = ends if stored else checkpointed(ends)
    labels = linked_labels(ends.withColumnsRenamed({"n1": "u", "n2": "v"}), keys, stored=True).withColumnRenamed("node", "node_id")
    # linked nodes have a label; loops, ends without a key or number and the table of nodes may add others
    links = reduce(lambda p, k: p & F.col(k).isNotNull(), keys, F.col("n1") != F.col("n2"))
    ids = ends.filter(~F.coalesce(links, F.lit(False))).select(*keys, F.explode(F.array("n1", "n2")).alias("node_id"))
    if node is not None:
        ids = ids.union(node.select(*keys, "node_id"))
    elif ids.isEmpty():
        return labels.withColumnRenamed("label", "component")
    return ids.distinct().join(labels, [*keys, "node_id"], "full").select(*keys, "node_id", F.coalesce("label", "node_id").alias("component"))
