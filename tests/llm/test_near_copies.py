"""What the near-duplicate stage keeps, against brute force."""

from __future__ import annotations

import random

from motiongraph.llm import ngram_join


def _set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, repeated and null ids, empty and null texts, a very long text, clashing columns."""
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    rows = [(i, b, "x") for i, b in enumerate(base)]
    rows += [(3, base[3], "x")] * 4 + [(None, base[4], "y")] * 3
    rows += [(5, base[6] + " end", "y"), (None, base[7] + " end", "y"), (100, base[8].replace("w1", "v1", 1), "z")]
    rows += [(200, None, "z"), (200, None, "z"), (201, "", "z"), (202, " \n", "z"), (203, "two words", "z"), (204, "two words", "z")]
    long = " ".join(f"u{rng.randrange(9000)}" for _ in range(60_000))
    rows += [(300, long, "z"), (301, long + " more", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_number string")
    sets = [_set(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    want = sorted((min((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "") for i in range(len(rows)) if comp[i] == c)[1:] for c in set(comp)), key=str)
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect()), key=str) == want
    assert ngram_join.drop_near_copies(docs.limit(0)).count() == 0


def test_thue_morse_words_differ(spark):
    """Words on which every polynomial hash modulo 2**64 agrees."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(0, word), (1, other), (2, word.upper()), (3, f"x {word} y"), (4, f"x {other} y")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
