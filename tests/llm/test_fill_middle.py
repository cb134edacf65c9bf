"""Fill-in-middle against plain Python on awkward texts, its exact round trip, and the index of exceptions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motiongraph.llm import fill_middle as fm

from ..conftest import DATA, same

TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb\n", "a\nb", "é\nü€\n𝄞 x\n\nlast", "with <P> inside\nx", "x<S>", "<M>", "a<\nb<S\nc<P\n<\n", "é" * 500 + "\n" + "𝄞" * 300,
    "\r\n\r\nx\r\n", "\x00\n\x00", "long line " * 200_000 + "\n€", "ä\n" * 150_000,
]


def expected(doc_id, text, unit="line", fim=100, spm_share=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < spm_share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id\nx"), (None, None), (3, TEXTS[3]), (10**15, "a\nb\nc")]
    return rows, spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, output string, id int").repartition(3)


@pytest.mark.parametrize("unit,fim,spm", [("line", 100, 50), ("char", 100, 50), ("char", 60, 0), ("line", 0, 50), ("line", 100, 100)])
def test_equals_plain_python(docs, unit, fim, spm):
    rows, df = docs
    out = fm.fill_middle(df, unit=unit, fim_percent=fim, spm_percent=spm)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
    assert got == sorted(((i, *expected(i, t, unit, fim, spm)) for i, t in rows), key=repr)


def test_round_trip(docs):
    rows, df = docs
    back = fm.fill_middle(df).select("doc_id", fm.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted(((r.doc_id, r.t) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_other_sentinels(docs):
    rows, df = docs
    names = ("[pre]", "{suf}", "(mid)")
    out = fm.fill_middle(df, names=names)
    back = out.select("doc_id", "form", fm.restore(F.col("output"), F.col("form"), names).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r.form for r in back if r.doc_id == 8} == {"psm"} or {r.form for r in back if r.doc_id == 8} == {"spm"}
    for bad in (("<A>", "<A>", "<B>"), ("", "<A>", "<B>"), ("aba", "<A>", "<B>")):
        with pytest.raises(ValueError):
            fm.fill_middle(df, names=bad)


def test_empty_table(spark):
    assert fm.fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_sql(spark, duck):
    same(fm.op13_fill_middle(spark, f"{DATA}/sf0.001"), duck.execute(fm.OP13_SQL).df())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_index_converts_both_ways(text):
    index = fm.ExceptionIndex.of(np.frombuffer(text.encode(), np.uint8))
    assert index.n_chars == len(text)
    assert len(index.at_char) == sum(ord(c) > 127 for c in text)
    chars = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in chars])
    assert index.to_bytes(chars).tolist() == at.tolist()
    assert index.to_chars(at).tolist() == chars.tolist()
