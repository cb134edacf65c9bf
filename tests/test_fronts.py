"""Linked seeds against Dijkstra's algorithm: costs, meetings, ways and values."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from motiongraph.operators import fronts, graph

from .test_operators import edges, nodes


def nearest_seeds(near, seeds):
    """{place: (cost, seed)}: least cost, then smallest seed."""
    best, heap = {}, [(0.0, s, s) for s in seeds]
    while heap:
        d, s, p = heapq.heappop(heap)
        if p not in best:
            best[p] = (d, s)
            for q, w in near.get(p, ()):
                heapq.heappush(heap, (d + w, s, q))
    return best


def meetings(near, best):
    out = {}
    for a in near:
        for b, _ in near[a]:
            if a in best and b in best and best[a][1] < best[b][1]:
                k = best[a][1], best[b][1]
                out[k] = min(out.get(k, (1e99,)), (max(best[a][0], best[b][0]), a, b))
    return out


@pytest.mark.parametrize("seed,delta", [(1, None), (2, 1000.0)])
def test_equals_dijkstra(spark, seed, delta):
    rng = random.Random(seed)
    ways = {}
    for _ in range(900):
        a, b = rng.sample(range(300), 2)
        ways[min(a, b), max(a, b)] = float(rng.choice((0, 1, 1, 2, 5, 9, 30)))
    for k in range(400, 420):  # a long way, apart from the rest
        ways[k, k + 1] = 1.0
    seeds = sorted(rng.sample(range(300), 25)) + [400, 420, 999]
    near = {}
    for (a, b), w in ways.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best = nearest_seeds(near, seeds)
    links = graph.half_edges(edges(spark, *[(a, b, w, 1) for (a, b), w in ways.items()])).selectExpr("scan_id", "a", "b", "cost AS w")
    values = spark.createDataFrame([("s", p, float((p * 37) % 101)) for p in range(500)], "scan_id string, place long, ctvalue double")
    edge, path = fronts.link_seeds(links, nodes(spark, *seeds), delta=delta, values=values)
    got = {(r["n1"], r["n2"]): (r["cost"], r["ctvalue"]) for r in edge.collect()}
    met = meetings(near, best)
    assert {k: v[0] for k, v in got.items()} == {k: m[0] for k, m in met.items()}
    state = {r["place"]: (r["dist"], r["label"]) for r in fronts.grow(links, nodes(spark, *seeds), delta=delta).collect()}
    assert state == best
    ways_of = {}
    for r in sorted(path.collect(), key=lambda r: r["idx"]):
        ways_of.setdefault((r["n1"], r["n2"]), []).append((r["idx"], r["place"]))
    assert set(ways_of) == set(met)
    for (n1, n2), run in ways_of.items():
        assert [i for i, _ in run] == list(range(len(run)))
        run = [p for _, p in run]
        cost, a, b = met[n1, n2]
        assert run[0] == n1 and run[-1] == n2 and got[n1, n2][1] == min((p * 37) % 101 for p in run)
        k = run.index(a)
        assert run[k + 1] == b
        step = lambda p, q: ways[min(p, q), max(p, q)]
        assert sum(map(step, run[:k], run[1 : k + 1])) == best[a][0] and sum(map(step, run[k + 1 : -1], run[k + 2 :])) == best[b][0]


def test_fronts_go_on_until_they_meet(spark):
    """Seeds 24 hops apart, and a way of many cheap steps beside a dear short one."""
    ways = edges(spark, *[(i, i + 1, 1, 1) for i in range(24)], (0, 61, 500, 1), (61, 24, 500, 1))
    links = graph.half_edges(ways).selectExpr("scan_id", "a", "b", "cost AS w")
    edge, path = fronts.link_seeds(links, nodes(spark, 0, 24), delta=500.0)
    assert [(r["n1"], r["n2"], r["cost"], r["ctvalue"]) for r in edge.collect()] == [(0, 24, 12.0, None)]
    assert [r["place"] for r in path.orderBy("idx").collect()] == list(range(25))
    with pytest.raises(RuntimeError):
        fronts.link_seeds(links, nodes(spark, 0, 24), most_rounds=3)


def test_stop_at_a_share_of_the_places(spark):
    links = graph.half_edges(edges(spark, *[(i, i + 1, 1, 1) for i in range(100)])).selectExpr("scan_id", "a", "b", "cost AS w")
    state = {r["place"]: r["dist"] for r in fronts.grow(links, nodes(spark, 0), cover=0.08, delta=5.0).collect()}
    assert state == {i: float(i) for i in range(10)}
    edge, path = fronts.link_seeds(links, nodes(spark, 0, 100), cover=0.08, delta=5.0)
    assert edge.collect() == [] and path.collect() == []
    assert fronts.grow(links, nodes(spark, 5).limit(0)).collect() == []
    assert fronts.grow(links.limit(0), nodes(spark, 5)).filter(F.col("dist") == 0).count() == 1


def test_links_that_cannot_be_least_are_left_out(spark, monkeypatch):
    """Links dearer than the cheapest one from a seed to their end; equal ones stay, as the smaller seed counts."""
    e = edges(spark, (1, 5, 3, 1), (2, 5, 3, 1), (5, 6, 9, 1), (6, 7, 4, 1), (1, 7, 2, 1), (2, 6, 5, 1))
    links = graph.half_edges(e).selectExpr("scan_id", "a", "b", "cost AS w")
    real, ways = fronts.checkpointed, []
    monkeypatch.setattr(fronts, "checkpointed", lambda df: (ways.append(sorted((r["place"], r["b"]) for r in df.collect())) if df.columns == ["scan_id", "place", "b", "w"] else None, real(df))[1])
    state = {r["place"]: (r["dist"], r["label"]) for r in fronts.grow(links, nodes(spark, 1, 2)).collect()}
    assert state == {1: (0, 1), 2: (0, 2), 5: (3, 1), 6: (5, 2), 7: (2, 1)}
    assert ways[-1] == [(1, 5), (1, 7), (2, 5), (2, 6), (7, 6)]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_rounds_move_news_only(spark, monkeypatch, broadcast):
    """Links and places are dealt once: a round's one shuffle takes news to the places they are for."""
    links = graph.half_edges(edges(spark, *[(i, i + 1, 1, 1) for i in range(6)], (20, 21, 3, 1))).selectExpr("scan_id", "a", "b", "cost AS w")
    real, shuffles = fronts.checkpointed, []

    def counted(df):
        if {"place", "dist"} <= set(df.columns):
            shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(df)

    monkeypatch.setattr(fronts, "checkpointed", counted)
    monkeypatch.setattr(fronts, "FEW", 0 if broadcast == "-1" else fronts.FEW)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        state = {r["place"]: (r["dist"], r["label"], r["prev"]) for r in fronts.grow(links, nodes(spark, 0, 4, 20)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert state == {0: (0, 0, None), 1: (1, 0, 0), 2: (2, 0, 1), 3: (1, 4, 4), 4: (0, 4, None), 5: (1, 4, 4), 6: (2, 4, 5), 20: (0, 20, None), 21: (3, 20, 20)}
    assert len(shuffles) > 2 and max(shuffles[1:]) <= 1


def test_ways_longer_than_what_places_know(spark, monkeypatch):
    monkeypatch.setattr(fronts, "HELD", 3)
    ways = edges(spark, *[(i, i + 1, 1, 1) for i in range(15)], (40, 41, 2, 1))
    links = graph.half_edges(ways).selectExpr("scan_id", "a", "b", "cost AS w")
    values = spark.createDataFrame([("s", p, float(50 - p)) for p in (1, 9, 14, 40)], "scan_id string, place long, ctvalue double")
    edge, path = fronts.link_seeds(links, nodes(spark, 0, 15, 40, 41), delta=50.0, values=values)
    assert sorted((r["n1"], r["n2"], r["cost"], r["ctvalue"]) for r in edge.collect()) == [(0, 15, 7.0, 36.0), (40, 41, 0.0, 10.0)]
    rows = sorted((r["n1"], r["idx"], r["place"]) for r in path.collect())
    assert rows == [(0, i, i) for i in range(16)] + [(40, 0, 40), (40, 1, 41)]
    assert fronts.link_seeds(links, nodes(spark, 40, 41), values=values, paths=False)[1] is None
