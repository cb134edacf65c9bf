"""Components contracted by ranges of numbers: against plain Python, and how many tables they write."""

from __future__ import annotations

import random

import pytest

from motiongraph.operators import contraction, graph

from .test_operators import edges


def plain_labels(links):
    up = {}

    def top(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for *key, u, v in links:
        a, b = top((*key, u)), top((*key, v))
        up[max(a, b)] = min(a, b)
    return {n: top(n)[-1] for n in list(up)}


@pytest.mark.parametrize("chunk", [3, 40, 1 << 19])
def test_labels_by_ranges(spark, monkeypatch, chunk):
    """Near numbers, numbers at random, two keys, repeats; what is left goes on by ranges or by rounds."""
    monkeypatch.setattr(contraction, "CHUNK", chunk)
    monkeypatch.setattr(contraction, "SMALL", 0)
    rng = random.Random(11)
    links = [("near", k // 150, k, k + 1) for k in range(300) if k % 37]
    links += [("far", 1, *rng.sample(range(-200, 200), 2)) for _ in range(120)] + [("hub", 2, 500, k) for k in range(90)]
    links += links[:50]
    table = spark.createDataFrame([*links, ("far", 1, 7, 7), (None, 1, 1, 2), ("far", 1, 3, None)], "a string, b int, u long, v long")
    got = contraction.linked_labels(table, ("a", "b")).collect()
    assert {(r["a"], r["b"], r["node"]): r["label"] for r in got} == plain_labels(links) and len(got) == len(plain_labels(links))


def test_few_tables(spark, monkeypatch):
    """A chain is contracted in one pass over ranges and what joins them; it took two tables a round."""
    monkeypatch.setattr(contraction, "CHUNK", 200, raising=False)
    monkeypatch.setattr(contraction, "SMALL", 0)
    made, stored = [], contraction.checkpointed
    monkeypatch.setattr(contraction, "checkpointed", lambda df: made.append(1) or stored(df))
    got = contraction.components(edges(spark, *[(k, k + 1, 1, 1) for k in range(1500)]))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 1501
    assert len(made) <= 5


def test_parts_beside_rings(spark):
    """A lone loop goes, a loop within a ring stays, edges to nodes without a place are no struts, a third piece is other."""
    place = {1: (0, 0, 9), 2: (5, 0, 9), 3: (5, 0, 4), 4: (0, 0, 4), 5: (0, 9, 4), 6: (9, 9, 0), 7: (9, 8, 0), 8: (8, 8, 0), 10: (9, 9, 9), 11: (9, 8, 9), 12: (8, 8, 9)}
    node = spark.createDataFrame([("s", k, *map(float, p)) for k, p in place.items()], "scan_id string, node_id long, x double, y double, z double")
    ways = [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (1, 1), (6, 7), (7, 8), (6, 8), (9, 9), (10, 11), (11, 12), (10, 12), (12, 13), (3, 13)]
    got = {(r["n1"], r["n2"]): r["part"] for r in graph.ring_parts(node, edges(spark, *[(a, b, 1, 1) for a, b in ways]), 1).collect()}
    rest = {(1, 1): "ring1", (2, 3): "ring1", (3, 4): "ring1", (1, 2): "ring1", (3, 13): "ring1", (12, 13): "ring1", (10, 11): "ring1", (11, 12): "ring1", (10, 12): "ring1"}
    assert got == rest | {(1, 4): "strut", (4, 5): "hook", (6, 7): "ring2", (7, 8): "ring2", (6, 8): "ring2"}
