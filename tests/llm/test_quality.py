"""The quality classifier against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from motiongraph.llm import quality

from ..conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("cells", [None, 1 << 14])
def test_good_words_in_junk_order_go(spark, cells):
    rng = random.Random(3)

    def body(bad):
        at = rng.randrange(40)
        return " ".join(f"w{rng.randrange(40) if bad else (at + k) % 40}" for k in range(80))

    kinds = [i % 4 == 0 for i in range(800)]
    docs = spark.createDataFrame([*((i, body(k)) for i, k in enumerate(kinds)), (2000, None), (2001, ""), (None, "w1 w2")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not k), 0) for i, k in enumerate(kinds) if i < 400], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, labels, cells=cells).collect()
    got = {r["doc_id"]: r["kept"] for r in rows}
    assert len(rows) == 803 and {r["doc_id"]: r["n_grams"] for r in rows}[2000] == 0
    assert sum(got[i] for i in range(400, 800) if not kinds[i]) >= 290 and sum(got[i] for i in range(400, 800) if kinds[i]) <= 5


def test_scores_by_brute_force(spark):
    """Every score, from the cells of every n-gram, counted one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = docs.toArrow()
    cells = quality.model_cells(docs)
    ids, grams = table["doc_id"].to_pylist(), {}
    for lo, n, row, cell in quality._features(table["text"].combine_chunks(), cells):
        grams |= {ids[lo + i]: Counter(cell[row == i].tolist()) for i in range(n)}
    good_ids = {r["doc_id"] for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    good, raw = Counter(), Counter()
    for i, c in grams.items():
        raw.update(c)
        good.update(c if i in good_ids else {})
    part = good.total() / raw.total()
    usual = sum(n * np.log((n + 1) / (part * raw[h] + 1)) for h, n in good.items()) / good.total()
    rows = quality.quality(docs, labels).collect()
    for r in rows:
        own = grams[r["doc_id"]]
        short = sum(n * min(np.log((good[h] - n * (r["doc_id"] in good_ids) + 1) / (part * (raw[h] - n) + 1)) - usual, 0) ** 2 for h, n in own.items())
        assert r["n_grams"] == own.total() and r["log_weight"] == pytest.approx(-short / max(own.total(), 30), rel=1e-4)
    known = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    edge = quality.best_cut(np.array([r["log_weight"] for r in rows if known.get(r["doc_id"]) is True]), np.array([r["log_weight"] for r in rows if known.get(r["doc_id"]) is False]))
    k = sum(r["log_weight"] >= edge for r in rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in sorted(rows, key=lambda r: -r["draw"])[:k]}


def test_drop_judges_rows_not_ids(spark):
    """Repeated and null ids, clashing names: a clean row that shares its id with junk stays."""
    rng = random.Random(5)

    def body(bad):
        return " ".join(f"{'junk' if bad else 'word'}{rng.randrange(50)}" for _ in range(80))

    rows = [(i, body(i % 4 == 0), "a") for i in range(400)] + [(None, body(True), "b"), (None, body(False), "b"), (0, body(False), "c"), (7, body(True), "c"), (900, None, "d"), (901, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string").withColumnRenamed("good", "text_hash")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(8, 300)] + [(None, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = [(r["doc_id"], "word" in (r["text"] or "word")) for r in quality.drop_low_quality(docs, labels).collect()]
    assert sorted(kept, key=str) == sorted([(i, True) for i in range(400) if i % 4] + [(None, True), (0, True), (900, True), (901, True)], key=str)
    assert quality.drop_low_quality(docs.limit(0), labels).columns == docs.columns
