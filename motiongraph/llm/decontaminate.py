"""Benchmark decontamination by a prefix-filtered set join.

Each window of an item is a set of shingles (``gram`` consecutive words) at
known offsets. A document contains a window only if it contains every shingle,
so with the shingles ordered by rarity over all documents the necessary prefix
is one shingle, the rarest; windows with a shingle that no document has drop
out. Documents are joined to windows on that shingle alone. The shingle's offset
fixes where the window would have to stand (positional bound), which must lie
within the document (length bound), and the words there are compared one by one.

Documents send only shingles that pass a fixed-size bit table of the benchmark's
shingles, so the join's input follows the matches, not the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, read
from .wordhash import LOWER, U, alphanumeric, blocks, grams, word_hashes, words

WINDOW, GRAM = 10, 3
#: The bit table has 2**BITS cells, at most this many numbers come to the driver.
BITS = 21


def _windows(width: int, gram: int):
    """(item_id, content, m, gram hashes in order) of each window of each item."""

    def run(batches):
        lut = alphanumeric()
        for b in batches:
            for lo, hi, data, off in blocks(b.column(1)):
                starts, ends, bound = words(data, off, lut)
                wh, low = word_hashes(data, starts, ends), LOWER[data].tobytes()
                rows = []
                for i in range(hi - lo):
                    first, last = int(bound[i]), int(bound[i + 1])
                    m = min(width, last - first)
                    if m:
                        g = grams(wh[first:last], min(gram, m)).view(np.int64)
                        text = [low[s:e] for s, e in zip(starts[first:last], ends[first:last])]
                        item = b.column(0)[lo + i].as_py()
                        rows += [(item, b" ".join(text[j : j + m]).decode(), m, g[j : j + m - min(gram, m) + 1].tolist()) for j in range(last - first - m + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["item_id", "content", "m", "grams"])

    return run


def _passing(column: pa.Array, sizes: list[int], table: np.ndarray):
    """Blocks with the shingles that pass the bit table: word index and hash."""
    for lo, hi, data, off in blocks(column):
        starts, ends, bound = words(data, off, alphanumeric())
        wh = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(hi - lo), np.diff(bound))
        at, found = [], []
        for k in sizes:
            g = grams(wh, k)
            ok = np.flatnonzero(table[(g & U((1 << BITS) - 1)).astype(np.int64)])
            ok = ok[row[ok] == row[ok + k - 1]]
            at.append(ok)
            found.append(g[ok])
        yield lo, hi, data, starts, ends, bound, row, np.concatenate(at), np.concatenate(found)


def _counts(sizes: list[int], table: np.ndarray):
    def run(batches):
        for b in batches:
            for *_, g in _passing(b.column(0), sizes, table):
                if len(g):
                    h, c = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["gram", "c"])

    return run


def _candidates(sizes: list[int], table: np.ndarray, width: int):
    """For each document one row without gram, and one for each passing shingle with the words around it."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("gram", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            rid, doc, th = b.column(0), b.column(1), b.column(3)
            for lo, hi, data, starts, ends, bound, row, at, g in _passing(b.column(2), sizes, table):
                n = np.diff(bound)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([rid[lo:hi], doc[lo:hi], th[lo:hi], pa.array(n), none, none, none, pa.nulls(hi - lo, pa.list_(pa.string()))], schema=schema)
                low = LOWER[data].tobytes()
                for j in range(0, len(at), 5000):
                    w, d = at[j : j + 5000], row[at[j : j + 5000]]
                    first, last = np.maximum(w - width + 1, bound[d]), np.minimum(w + width, bound[d + 1])
                    around = [[low[s:e].decode() for s, e in zip(starts[x:y], ends[x:y])] for x, y in zip(first, last)]
                    take = pa.array(lo + d)
                    yield pa.RecordBatch.from_arrays([rid.take(take), doc.take(take), th.take(take), pa.array(n[d]), pa.array(g[j : j + 5000].view(np.int64)), pa.array(w - bound[d]), pa.array(first - bound[d]), pa.array(around, pa.list_(pa.string()))], schema=schema)

    return run


def _table(grams_: DataFrame) -> np.ndarray:
    table = np.zeros(1 << BITS, bool)
    table[[c for (c,) in grams_.select(F.col("gram").bitwiseAND((1 << BITS) - 1)).distinct().collect()]] = True
    return table


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits, and an item without words has
    no windows; an item of fewer than ``width`` words is one window. Items with
    equal windows all count; repeated documents are judged each on its own. An
    empty documents table gives an empty result, an empty benchmark no hits.
    Only id and text columns are read, so other columns cannot clash. Texts are
    read whole, in blocks; a very long one needs a few dozen times its own size.
    """
    return _judged(docs, items, id_col, text_col, item_col, item_text_col, width, gram).drop("text_hash")


def _judged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As contamination(), with the hash of each text."""
    text = docs[text_col].cast("string")
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    win = cut(items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text")).mapInArrow(_windows(width, gram), "item_id long, content string, m long, grams array<long>"), "windows")
    sizes = sorted({min(gram, m) for (m,) in win.select("m").distinct().collect()}) or [gram]
    placed = win.select("content", "m", F.posexplode("grams").alias("offset", "gram")).distinct()

    table = _table(placed)
    seen = docs.select("text").mapInArrow(_counts(sizes, table), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    rarest = placed.join(seen, "gram", "left").groupBy("content", "m").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram", "offset")).alias("p"))
    prefix = cut(rarest.filter("p.c > 0").select("content", "m", "p.gram", "p.offset"), "prefixes")

    listed = cut(docs.mapInArrow(_candidates(sizes, _table(prefix), width), "rid long, doc_id long, text_hash long, n_words long, gram long, pos long, first long, around array<string>"), "candidates")
    begin = F.col("pos") - F.col("offset")
    hits = (
        listed.filter("gram IS NOT NULL")
        .join(prefix, "gram")
        .filter((begin >= 0) & (begin + F.col("m") <= F.col("n_words")))
        .filter(F.array_join(F.expr("slice(around, cast(pos - offset - first + 1 as int), cast(m as int))"), " ") == F.col("content"))
        .select("rid", begin.alias("begin"), "m", "content")
        .distinct()
    )
    hits = cut(hits, "hits")
    line = Window.partitionBy("rid").orderBy("begin", "m")
    until = F.max(F.col("begin") + F.col("m")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        hits.select("rid", "begin", "m").distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("begin") + F.col("m") - F.greatest("begin", F.coalesce(until, F.lit(0)))))
        .groupBy("rid").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        hits.select("rid", "content").distinct()
        .join(win.select("content", "item_id").distinct(), "content")
        .select("rid", "item_id").distinct()
        .groupBy("rid").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    )
    return (
        listed.filter("gram IS NULL").select("rid", "doc_id", "text_hash", "n_words")
        .join(covered, "rid", "left")
        .join(named, "rid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "text_hash",
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their columns as they were.

    Rows are judged by id and text, so a clean row that shares its id (or has
    none) with a contaminated one stays. Nulls, repeated rows and empty tables
    are as in contamination(). Other columns pass through and may have any name.
    """
    bad = _judged(docs, items).filter("contaminated").select("doc_id", "text_hash").distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id) & (F.xxhash64(docs.text) == bad.text_hash), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(len(ws), {WINDOW}) AS m, unnest(list_transform(range(1, greatest(len(ws) - {WINDOW}, 0) + 2), lambda i: array_to_string(ws[i:i + {WINDOW} - 1], ' '))) AS content
  FROM b WHERE len(ws) > 0
), lens AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS p FROM d, lens WHERE len(ws) >= m
), h AS (
  SELECT dw.doc_id, dw.p, dw.m, bw.item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.content = array_to_string(dw.ws[dw.p:dw.p + dw.m - 1], ' ')
), w AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id)
"""
