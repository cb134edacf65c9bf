"""Components by contraction, chains by pointer doubling, two-level scans: against plain Python and numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiongraph.operators import chains, contraction, scan, signal

from .test_operators import edges, nodes


def chain_rows(walk):
    """{(n1, n2, first, last): nodes on the way}"""
    out = {}
    for r in sorted(walk.collect(), key=lambda r: r["pos"]):
        out.setdefault((r["n1"], r["n2"], r["first"], r["last"]), []).append((r["pos"], r["u"], r["v"]))
    ways = {}
    for k, hops in out.items():
        assert [h[0] for h in hops] == list(range(len(hops))) and hops[0][1] == k[0] and hops[-1][2] == k[1]
        assert all(x[2] == y[1] for x, y in zip(hops, hops[1:]))
        ways[k] = [h[1] for h in hops[1:]]
        assert not ways[k] or (ways[k][0], ways[k][-1]) == k[2:]
    return ways


def test_pop_nodes(spark):
    # a chain 1-3-2-4, a loop 4-5-6-4, a free ring 7-8-9, a single edge 4-20
    e = edges(spark, (1, 3, 1, 9), (2, 3, 2, 8), (2, 4, 3, 7), (4, 5, 1, 6), (5, 6, 1, 5), (4, 6, 1, 4), (7, 8, 1, 3), (8, 9, 1, 2), (7, 9, 1, 1), (4, 20, 5, 5))
    walk = chains.walked(e)
    assert chain_rows(walk) == {(1, 4, 3, 2): [3, 2], (4, 4, 5, 6): [5, 6], (7, 7, 8, 9): [8, 9], (4, 20, None, None): []}
    got = {(r["n1"], r["n2"]): (r["cost"], r["ctvalue"], r["n_nodes"]) for r in chains.pop_nodes(e).collect()}
    assert got == {(1, 4): (6.0, 7.0, 2), (4, 4): (3.0, 4.0, 2), (7, 7): (3.0, 1.0, 2), (4, 20): (5.0, 5.0, 0)}
    kept = spark.createDataFrame([("s", 3), ("s", 5)], "scan_id string, node_id long")
    assert set(chain_rows(chains.walked(e, kept))) == {(1, 3, None, None), (3, 4, 2, 2), (4, 5, None, None), (4, 5, 6, 6), (7, 7, 8, 9), (4, 20, None, None)}


def plain_chains(pairs):
    """Chains between nodes of another degree than 2, and cycles, by walking."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    inner = {n for n, m in near.items() if len(m) == 2 and n not in m}
    out, seen = set(), set()

    def walk(start, to):
        way, prev, at = [], start, to
        while at in inner and at != start:
            way.append(at)
            prev, at = at, next(x for x in near[at] if x != prev)
        return way, at

    for n in near:
        if n not in inner:
            for m in near[n]:
                way, end = walk(n, m)
                seen |= set(way)
                if way and (n < end or n == end and way[0] < way[-1]):
                    out.add((n, end, *way))
    for n in sorted(inner - seen):
        if n not in seen:
            way, _ = walk(n, min(near[n]))
            seen |= {n, *way}
            out.add((n, n, *way))
    return out


def test_chains_by_walking(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 900)
    pairs = set()
    for k in range(0, 600, 60):  # long chains between hubs and long cycles
        run = ids[k : k + 60]
        pairs |= {tuple(sorted(p)) for p in zip(run, run[1:])} | ({tuple(sorted((run[0], run[-1])))} if k % 120 else set())
    for _ in range(150):
        pairs.add(tuple(sorted(rng.sample(ids[600:760], 2))))
    pairs |= {tuple(sorted((ids[0], ids[600]))), tuple(sorted((ids[119], ids[601])))}
    got = {(k[0], k[1], *way) for k, way in chain_rows(chains.walked(edges(spark, *[(a, b, 1, 1) for a, b in pairs]))).items() if way}
    assert got == plain_chains(pairs)


def test_a_long_chain(spark):
    """A chain of 10,000 nodes in random numbering, and as long a cycle, in their order."""
    n = 10_000
    mixed = lambda c: F.pmod(c * 48_271, F.lit(2 * n + 1))
    k = spark.range(n)
    line = k.select(mixed(F.col("id") + 1).alias("a"), mixed(F.col("id") + 2).alias("b"))
    ring = k.select((mixed(F.col("id") + 1) + 10 * n).alias("a"), (mixed((F.col("id") + 1) % n + 1) + 10 * n).alias("b"))
    e = line.union(ring).select(F.lit("s").alias("scan_id"), F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2"), F.lit(1.0).alias("cost"), F.lit(1.0).alias("ctvalue"))
    walk = chains.walked(e)
    got = {r["n1"] > 5 * n: (r["n_nodes"], r["cost"]) for r in chains.pop_nodes(e, walk=walk).collect()}
    assert got == {False: (n - 1, float(n)), True: (n - 1, float(n))}
    rows = np.array(walk.filter(F.col("n1") < 5 * n).select("pos", "u", "v").orderBy("pos").collect())
    order = np.arange(1, n + 2) * 48_271 % (2 * n + 1)
    order = order if order[0] < order[-1] else order[::-1]
    assert (rows[:, 0] == np.arange(n)).all() and (rows[:, 1] == order[:-1]).all() and (rows[:, 2] == order[1:]).all()


def test_chain_points(spark):
    e = edges(spark, (1, 3, 1, 9), (2, 3, 2, 8), (2, 4, 3, 7))
    walk = chains.walked(e)
    got = chains.chain_points(walk, nodes(spark, 1, 2, 3, 4)).orderBy("idx").collect()
    assert [(r["n1"], r["n2"], r["idx"], r["x"]) for r in got] == [(1, 4, 0, 1.0), (1, 4, 1, 3.0), (1, 4, 2, 2.0), (1, 4, 3, 4.0)]
    # the points of the middle edge run from 2 to 3, against the chain
    rows = [("s", 2, 3, i, x, 5.0, 0.0) for i, x in enumerate((2.0, 2.2, 2.8, 3.0))]
    path = spark.createDataFrame(rows, "scan_id string, n1 long, n2 long, idx long, x double, y double, z double")
    got = chains.chain_points(walk, nodes(spark, 1, 2, 3, 4), path).orderBy("idx").collect()
    assert [r["x"] for r in got] == [1.0, 3.0, 2.8, 2.2, 2.0, 4.0] and [r["y"] for r in got] == [0.0, 0.0, 5.0, 5.0, 0.0, 0.0]


def test_midpoint_lies_on_the_chain(spark):
    e = edges(spark, *[(a, b, 1, 1) for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 7), (1, 7), (5, 8), (8, 9), (5, 9))])
    at = {1: (0, 0), 2: (0, 1), 3: (2, 1), 4: (4, 1), 5: (4, 0)}
    n = spark.createDataFrame([("s", i, *map(float, at.get(i, (50 + 9 * i, 0))), 0.0) for i in range(1, 10)], "scan_id string, node_id long, x double, y double, z double")
    assert [(r["n1"], r["n2"], r["x"], r["y"]) for r in chains.peak_valley_midpoints(e, n).collect()] == [(1, 5, 2.0, 1.0)]


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(contraction, "SMALL", small)
    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (3000, 3000)]
    label = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    got = contraction.components(edges(spark, *[(a, b, 1, 1) for a, b in pairs]), nodes(spark, 5, 9999))
    assert {r["node_id"]: r["component"] for r in got.collect()} == label | {9999: 9999}
    assert contraction.components(edges(spark, (1, 1, 1, 1))).collect()[0]["component"] == 1
    assert contraction.components(edges(spark, (1, 1, 1, 1)).limit(0)).collect() == []


@pytest.fixture(scope="module")
def long(spark):
    """One key with most of the rows, small ones, nulls, repeated values."""
    rng = np.random.default_rng(7)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.integers(0, 50, 700) / 4)] + [(f"k{i % 9}", i, float(rng.normal())) for i in range(120)]
    rows += [("one", 0, 3.0), ("none", 0, None), ("none", 1, None), (None, 0, 1.0), (None, 1, 4.0)]
    rows = [(k, i, None if k == "hot" and i % 7 == 0 else v) for k, i, v in rows]
    return rows, spark.createDataFrame(rows, "k string, i long, v double").repartition(5)


def by_key(rows):
    out = {}
    for k, i, v in rows:
        out.setdefault(k, []).append((i, v))
    return {k: sorted(x, key=lambda r: r[0]) for k, x in out.items()}


def test_running_and_neighbours(long):
    rows, df = long
    d = scan.dealt(df, ("k",), ("i",))
    got = scan.running(d, ("k",), ("i",), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("count", F.col("v"))}).collect()
    got = {(r["k"], r["i"]): (r["s"], r["m"], r["l"], r["n"]) for r in got}
    before = {(r["k"], r["i"]): (r["s"], r["l"]) for r in scan.running(d, ("k",), ("i",), {"s": ("sum", F.col("v")), "l": ("last", F.col("v"))}, exclusive=True).collect()}
    prev = {(r["k"], r["i"]): (r["p"], r["pi"]) for r in scan.neighbouring(d, ("k",), ("i",), {"p": "v", "pi": "i"}).collect()}
    nxt = {(r["k"], r["i"]): (r["p"], r["pi"]) for r in scan.neighbouring(d, ("k",), ("i",), {"p": "v", "pi": "i"}, ahead=True).collect()}
    at = {(r["k"], r["i"]): r["at"] for r in scan.numbered(df, ("k",), ("i",), "at").collect()}
    for k, run in by_key(rows).items():
        seen = []
        for n, (i, v) in enumerate(run):
            assert before[k, i] == (pytest.approx(sum(seen)) if seen else None, seen[-1] if seen else None)
            seen += [] if v is None else [v]
            assert got[k, i] == ((pytest.approx(sum(seen)), max(seen), seen[-1], len(seen)) if seen else (None, None, None, 0))
            assert at[k, i] == n
            assert prev[k, i] == ((run[n - 1][1], run[n - 1][0]) if n else (None, None))
            assert nxt[k, i] == ((run[n + 1][1], run[n + 1][0]) if n + 1 < len(run) else (None, None))


def test_quantiles(long):
    rows, df = long
    at = {"a": 0.0, "q1": 0.25, "median": 0.5, "x": 0.9, "z": 1.0}
    got = {r["k"]: tuple(r[n] for n in at) for r in scan.quantiles(df, ("k",), "v", at).collect()}
    runs = {k: [v for _, v in run if v is not None] for k, run in by_key(rows).items()}
    assert set(got) == set(runs)
    for k, vs in runs.items():
        assert got[k] == (pytest.approx(np.quantile(vs, list(at.values()))) if vs else (None,) * 5)
    every = scan.quantiles(df, (), "v", at).collect()
    assert len(every) == 1 and tuple(every[0]) == pytest.approx(np.quantile(sum(runs.values(), []), list(at.values())))


def test_resample_at_given_times(spark):
    rng = np.random.default_rng(3)
    rows, asked = [], []
    for name, n in (("a", 300), ("b", 7), ("c", 1)):
        t = np.cumsum(rng.integers(0, 3, n) * 0.5)  # repeated times
        rows += [(name, i, float(x), float(rng.normal())) for i, x in enumerate(t)]
        asked += [(name, k, float(x)) for k, x in enumerate(np.concatenate((rng.uniform(-2, t[-1] + 2, 50), t[:5])))]
    asked += [("d", 0, 1.0)]
    got = signal.resample_at(spark.createDataFrame(rows, "source string, idx long, t double, value double"), spark.createDataFrame(asked, "source string, k long, t double"))
    got = {(r["source"], r["k"]): (r["t"], r["value"]) for r in got.collect()}
    assert len(got) == len(asked)
    for name, k, x in asked:
        run = [(t, v) for s, _, t, v in rows if s == name]
        first, last = dict(reversed(run)), dict(run)
        before, after = max((t for t in last if t <= x), default=None), min((t for t in last if t > x), default=None)
        want = None
        if before == x and before is not None:
            want = last[x]
        elif before is not None and after is not None:
            want = pytest.approx(last[before] + (first[after] - last[before]) * (x - before) / (after - before))
        assert got[name, k] == (x, want)


def test_resample_over_a_length(spark):
    s = spark.createDataFrame([("a", i, i * 1.5, float(i * i)) for i in range(9)], "source string, idx long, t double, value double")
    rows = signal.resample(s, 5, t_new=6.0).orderBy("k").collect()
    assert [r["t"] for r in rows] == [0, 1.5, 3, 4.5, 6] and [r["value"] for r in rows] == pytest.approx([0, 1, 4, 9, 16])
    assert [r["k"] for r in signal.resample(s, 5, t_new=24.0).orderBy("k").collect()] == [0, 1, 2]


def test_edges_outside_chains_are_not_grouped(spark, monkeypatch):
    written = []
    monkeypatch.setattr(chains, "checkpointed", lambda df, keep=chains.checkpointed: written.append(keep(df)) or written[-1])
    e = edges(spark, *[(a, b, a + b, 50) for a in range(6) for b in range(a + 1, 6)], (5, 6, 1, 9), (6, 7, 2, 8), (7, 7, 3, 7))
    got = {(r["n1"], r["n2"]): (r["cost"], r["ctvalue"], r["n_nodes"]) for r in chains.pop_nodes(e).collect()}
    assert got == {(a, b): (a + b, 50, 0) for a in range(6) for b in range(a + 1, 6)} | {(5, 7): (3, 8, 1), (7, 7): (3, 7, 0)}
    assert written[-1].count() == 2  # only the chain's edges are written again
