"""Surrogates: every text is taken apart again and compared piece by piece."""

from __future__ import annotations

import regex

from motiongraph.llm import pii

from ..conftest import DATA


def _shape(s):
    return regex.sub(r"\d", "0", s)


def test_every_piece_of_every_text(spark):
    """What lies between entities stays; each entity has one surrogate of its shape, distinct and not real."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = pii.replace_pii(docs, "k").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(whole)
    find = regex.compile(pii.ANY)
    seen: dict[tuple, str] = {}
    real = {(e["kind"], e["hit"].lower()) for r in out for e in r["entities"]}
    n = 0
    for r in out:
        old, new, at, back = whole[r["doc_id"]] or "", r["text"] or "", 0, 0
        hits = list(find.finditer(old))
        assert [m[0] for m in hits] == [e["hit"] for e in r["entities"]]
        for m, e, nxt in zip(hits, r["entities"], [*hits[1:], None]):
            gap = old[at : m.start()]
            assert new[back : back + len(gap)] == gap
            back += len(gap)
            at = m.end()
            tail = old[at : nxt.start()] if nxt else old[at:]
            end = new.index(tail, back + 1) if tail and nxt else len(new) - len(tail)
            got = new[back:end]
            back = end
            n += 1
            if e["kind"] in ("ssn", "phone", "card"):
                assert _shape(got) == _shape(m[0])
                canon = (e["kind"], regex.sub(r"\D", "", m[0])[-10:] if e["kind"] == "phone" else regex.sub(r"\D", "", m[0]))
                got = regex.sub(r"\D", "", got)[-len(canon[1]) :]
            else:
                canon, got = (e["kind"], m[0].lower()), got.lower()
                assert (e["kind"], got) not in real
            assert seen.setdefault(canon, got) == got
        assert new[back:] == old[at:]
    assert n > 10 and len({(k, v) for (k, _), v in seen.items()}) == len(seen)


def test_long_chains_of_labels_and_digits(spark):
    """Texts that make patterns with repeated groups recurse; null and repeated ids; clashing columns."""
    texts = ["a@b" + ".c" * 300_000, "a@b" + ".cd" * 100_000 + " x", "1" * 400_000, "12-" * 100_000, "Mr A" + "b" * 300_000, None, ""]
    rows = [(i % 3 if i else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, e string")
    out = pii.replace_pii(docs, "k").collect()
    assert len(out) == 10 and sum(r["text"] is None for r in out) == 2
    assert sum(len(r["entities"]) for r in out) == 3  # one e-mail address, one name twice


def test_names_keep_their_parts(spark):
    docs = spark.createDataFrame([(1, "Mrs. Anna Smith met Mr. Smith and Ms Anna Jones; Mrs Smith left. +49 30 1234 5678")], "doc_id long, text string")
    text = pii.replace_pii(docs, "k").first()["text"]
    m = regex.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and Ms (\w+) (\w+); Mrs (\w+) left\. \+(\d\d) (\d\d) (\d{4}) (\d{4})", text)
    assert m and m[2] == m[3] == m[6] and m[1] == m[4] and m[2] != m[5] and m[7] == "49" and not {"Anna", "Smith", "Jones"} & set(m.groups())
