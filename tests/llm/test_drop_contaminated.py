"""The decontamination stage judges rows, not ids."""

from __future__ import annotations

from motiongraph.llm import decontaminate


def test_clean_rows_that_share_an_id_stay(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"see {item} there", "a"), (1, "a clean text", "b"), (None, item, "c"), (None, "clean too", "d"), (2, None, "e"), (3, "", "f"), (4, "clean", "g"), (4, "clean", "g"), (5, "x " * 200_000 + item, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    got = decontaminate.drop_contaminated(docs, items)
    assert got.columns == docs.columns and sorted(r["text_hash"] for r in got.collect()) == list("bdefgg")
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == 9
