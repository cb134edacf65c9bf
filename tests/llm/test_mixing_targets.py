"""Targets, sizes and takes of the mix against a plain computation."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from motiongraph.llm import mixing


def _targets(sizes: dict) -> dict:
    """Water filling by hand: sources by code point, null last, weigh 5, 2, 1; a target stops at three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_and_takes(spark):
    """A hot source, a tiny one, null and empty sources, null texts, repeated rows, one very long text, a clashing column."""
    rows = [(i, "w " * (20 + i % 90), ("web", "web", "web", "book", "code")[i % 5]) for i in range(1500)]
    rows += [(5000 + i, "a b c d", None) for i in range(60)] + [(6000, "x y", ""), (6001, "one two three", "tiny"), (6002, None, "web"), (6003, " \n", "book"), (7, "same row here", "code"), (7, "same row here", "code"), (None, "no id at all", "web")]
    rows += [(7000, "long " * 4000, "book")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, size double")
    got = mixing.mix_sources(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = _targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=4)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again)
