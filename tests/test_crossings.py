"""Graph rewrite at parting paths: small graphs by hand, prefix trees by brute force, and what must hold of any graph."""

from __future__ import annotations

import random

import pytest

from motiongraph.operators import crossings

PATH = "scan_id string, n1 long, n2 long, idx long, x double, y double, z double"


def line(*ends):
    """Unit steps along one axis after another."""
    out = [tuple(map(float, ends[0]))]
    for e in ends[1:]:
        while out[-1] != tuple(map(float, e)):
            out.append(tuple(p + (0 if p == q else 1.0 if q > p else -1.0) for p, q in zip(out[-1], e)))
    return out


def tables(spark, cases):
    """cases: {scan: ({node: point}, [(points, cost, ctvalue)] between points of nodes)}."""
    node, edge, path = [], [], []
    for scan, (at, ways) in cases.items():
        number = {p: n for n, p in at.items()}
        node += [(scan, n, *map(float, p)) for n, p in at.items()]
        for points, cost, ct in ways:
            if number[points[0]] > number[points[-1]]:
                points = points[::-1]
            a, b = number[points[0]], number[points[-1]]
            edge.append((scan, a, b, float(cost), float(ct)))
            path += [(scan, a, b, i, *map(float, p)) for i, p in enumerate(points)]
    return (
        spark.createDataFrame(node, "scan_id string, node_id long, x double, y double, z double"),
        spark.createDataFrame(edge, "scan_id string, n1 long, n2 long, cost double, ctvalue double"),
        spark.createDataFrame(path, PATH),
    )


def lattice(seed):
    """Ways from several hubs that meet from both ends."""
    rng = random.Random(seed)
    hubs = [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0), (0.0, 9.0, 3.0)]
    at, ways, seen = {10 * k: h for k, h in enumerate(hubs)}, [], set(hubs)
    for k in range(14):
        h = rng.choice(hubs)
        corner = (rng.choice((2.0, 5.0)), h[1], h[2])
        end = (corner[0], h[1] + rng.choice((3.0, 6.0)), h[2] + k + 1.0)
        if end not in seen:
            seen.add(end)
            at[100 + k] = end
            ways.append((line(h, corner, end), rng.randint(1, 9), rng.randint(1, 9)))
    return at, [*ways, (line(hubs[0], (9, 0, 0)), 2, 2), (line(hubs[2], (0, 9, 0), (0, 0, 0)), 2, 2)]


def ends(*lines):
    return {n: p for n, p in zip((1, 2, 3, 4, 5), dict.fromkeys(p for run in lines for p in (run[0], run[-1])))}


P1, P3, P4 = line((10, 2, 0), (10, 9, 0)), line((10, 2, 0), (10, 5, 0), (13, 5, 0)), line((10, 2, 0), (10, 0, 0))
P5, P6 = line((10, 9, 0), (10, 7, 0), (13, 7, 0)), line((10, 2, 0), (10, 7, 0), (13, 7, 0))
SHORT, MID, FAR = (line((0, 0, 0), (k, 0, 0)) for k in (3, 5, 9))
K1, K2, K3 = line((0, 0, 0), (4, 0, 0), (4, 3, 0)), line((0, 0, 0), (4, 0, 0), (4, -3, 0)), line((0, 0, 0), (0, 2, 0), (4, 2, 0), (4, 0, 0))
CASES = {
    "part": (ends(P1, P3, P4), [(P1, 3, 5), (P3, 2, 4), (P4, 1, 9)]),
    "both ends": (ends(P1, P3, P5), [(P1, 3, 3), (P3, 3, 3), (P5, 3, 3)]),
    "three": (ends(P1, P3, P6), [(P1, 3, 1), (P3, 1, 2), (P6, 2, 7)]),
    "over": ({7: SHORT[0], 3: SHORT[-1], 5: MID[-1], 1: FAR[-1]}, [(SHORT, 4, 4), (MID, 2, 2), (FAR, 1, 1)]),
    "known": ({1: K1[0], 2: K1[-1], 3: K2[-1], 9: (4.0, 0.0, 0.0)}, [(K1, 3, 3), (K2, 5, 5), (K3, 9, 9)]),
    "nothing": ({1: (0.0, 0.0, 0.0), 2: (3.0, 0.0, 0.0)}, [(line((0, 0, 0), (3, 0, 0)), 1, 1)]),
    **{f"lattice {seed}": lattice(seed) for seed in range(3)},
}


@pytest.fixture(scope="module")
def rewritten(spark):
    """Of each case ({points of a way, the smaller end first: (cost, ctvalue)}, places of new nodes)."""
    node, edge, path = (list(df.orderBy(*k).collect()) for df, k in zip(crossings.split_crossings(*tables(spark, CASES)), (("node_id",), ("n1",), ("idx",))))
    out = {}
    for scan in CASES:
        place = {r["node_id"]: (r["x"], r["y"], r["z"]) for r in node if r["scan_id"] == scan}
        assert len(set(place.values())) == len(place)
        points, ways, begin = {}, {}, {}
        for r in path:
            if r["scan_id"] == scan:
                points.setdefault((r["n1"], r["n2"]), []).append((r["idx"], (r["x"], r["y"], r["z"])))
        for r in edge:
            if r["scan_id"] != scan:
                continue
            run = points.pop((r["n1"], r["n2"]))
            assert [i for i, _ in run] == list(range(len(run)))
            run = [p for _, p in run]
            assert run[0] == place[r["n1"]] and run[-1] == place[r["n2"]] and r["n1"] < r["n2"]
            ways[tuple(min(run, run[::-1]))] = (r["cost"], r["ctvalue"])
        assert not points
        for run in ways:
            for way in (run, run[::-1]):
                begin.setdefault(way[0], []).append(way[1])
        assert all(len(set(b)) == len(b) for b in begin.values())  # nothing shared
        out[scan] = ways, {(r["x"], r["y"], r["z"]) for r in node if r["scan_id"] == scan and r["crossing"]}
    return out


def test_paths_that_part(rewritten):
    ways, new = rewritten["part"]
    assert new == {(10.0, 5.0, 0.0)}
    assert sorted((len(k), *v) for k, v in ways.items()) == [(3, 1.0, 9.0), (4, 2.0, 4.0), (4, 2.0, 5.0), (5, 3.0, 5.0)]


def test_paths_that_part_at_both_ends(rewritten):
    ways, new = rewritten["both ends"]
    assert new == {(10.0, 5.0, 0.0), (10.0, 7.0, 0.0)} and len(ways) == 5


def test_three_paths_that_part_one_after_the_other(rewritten):
    ways, new = rewritten["three"]
    assert new == {(10.0, 5.0, 0.0), (10.0, 7.0, 0.0)}
    assert ways[tuple(line((10, 2, 0), (10, 5, 0)))] == (1.0, 7.0) and ways[tuple(line((10, 5, 0), (10, 7, 0)))] == (2.0, 7.0)


def test_a_path_that_runs_over_another(rewritten):
    """The longer path begins where the shorter one ends; of two the last counts."""
    assert rewritten["over"] == ({tuple(SHORT): (4.0, 4.0), tuple(MID[3:]): (2.0, 2.0), tuple(FAR[5:]): (1.0, 1.0)}, set())


def test_parting_at_a_known_node(rewritten):
    """A node that stands where paths part is used, and of two edges to it the cheaper stays."""
    ways, new = rewritten["known"]
    assert new == set() and ways == {tuple(K1[:5]): (3.0, 5.0), tuple(K1[4:]): (3.0, 3.0), tuple(K2[:3:-1]): (5.0, 5.0)}


def test_nothing_to_do(rewritten):
    assert rewritten["nothing"] == ({tuple(line((0, 0, 0), (3, 0, 0))): (1.0, 1.0)}, set())


@pytest.mark.parametrize("seed", range(3))
def test_all_steps_stay(rewritten, seed):
    steps = lambda runs: {frozenset(s) for run in runs for s in zip(run, run[1:])}
    scan = f"lattice {seed}"
    assert steps(rewritten[scan][0]) == steps([w[0] for w in CASES[scan][1]])


def test_empty_tables(spark):
    got = crossings.split_crossings(*(df.limit(0) for df in tables(spark, CASES)))
    assert [df.count() for df in got] == [0, 0, 0]


def test_points_are_stored_once(spark, monkeypatch):
    """The one table with points of whole paths is written before the rounds."""
    made, stored = [], crossings.checkpointed
    monkeypatch.setattr(crossings, "checkpointed", lambda df: made.append(df.columns) or stored(df))
    crossings.split_crossings(*tables(spark, {"three": CASES["three"]}))
    assert sum("idx" in c or "points" in c for c in made) == 1


def test_paths_of_many_blocks(spark, monkeypatch):
    """Paths longer than a block are cut and part as short ones do."""
    monkeypatch.setattr(crossings, "BLOCK", 2)
    for name in ("three", "over", "both ends"):
        node, edge, path = crossings.split_crossings(*tables(spark, {name: CASES[name]}))
        monkeypatch.setattr(crossings, "BLOCK", 256)
        want = crossings.split_crossings(*tables(spark, {name: CASES[name]}))
        monkeypatch.setattr(crossings, "BLOCK", 2)
        assert all(sorted(map(tuple, p.collect())) == sorted(map(tuple, q.collect())) for p, q in zip((node, edge, path), want))
