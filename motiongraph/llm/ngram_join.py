"""N-gram Jaccard join by vertical partitioning.

Documents become sets of word shingles; equal sets form one class. A global
order of shingles, rare ones first, comes from a fixed-size count sketch over
all documents. The order is cut into fragments: a set is stored as one segment
per fragment, the overlap of a pair is counted in each fragment on its own and
the counts are summed per pair.

Pairs to count come from prefixes: two sets of Jaccard similarity t share one of
the first n - ceil(t n) + 1 shingles in the global order. All pairs of a group
of near copies would be quadratic, and components do not need them, so groups
are joined by stars: in a few rounds every set that shares a prefix shingle is
compared with one leader. Then all pairs of different components that share a
prefix shingle are looked at, block by block inside tasks; a parity bitmap of
each set gives an upper bound of their overlap, and the pairs that it cannot
rule out are counted exactly. So no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, discard, read, sweep
from .wordhash import U, mix, shingle_sets

WORDS, PERCENT = 5, 80
SKETCH_BITS, FRAGMENTS, LEAST_BITMAP = 18, 4, 256
#: Bytes of bitmaps compared at once.
BITMAPS = 1 << 22
#: A table of ids up to this many rows (8 bytes each) may be broadcast.
SMALL_ROWS = 2_000_000


def _signature(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64)], np.uint64) ^ U(len(s)))[0].astype(np.int64)) if len(s) else 0


def _parity(s: np.ndarray) -> bytes:
    """Parity bits, a power of two and at least four times the set's size: where two sets' bits differ, the sets differ."""
    width = max(LEAST_BITMAP, 1 << int(4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s % U(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Rows of parity bits at half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_BITS)).astype(np.int64)


def _order(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sort keys of the global order: count level first, then the hash."""
    return (level[_cell(s)].astype(np.uint64) << U(56)) | (s >> U(8))


def _need(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def _sets(k: int):
    """(doc_id, n, sig, bitmap) of each document and, last in each task, the task's shingle counts."""
    names = ["doc_id", "n", "sig", "bitmap", "counts"]

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            n, sig, maps = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            held, size = [], 0
            for i, s in shingle_sets(b.column(1), k):
                n[i], sig[i], maps[i] = len(s), _signature(s), _parity(s)
                held.append(_cell(s))
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sig), pa.array(maps, pa.binary()), pa.nulls(b.num_rows, pa.list_(pa.int64()))], names)
        if counts.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))], names)

    return run


def _prefixes(k: int, percent: int, level: np.ndarray, parts: int):
    """Prefix shingles as packed runs (part, [shingle, sig, n] * m): few large rows to shuffle."""

    def run(batches):
        toks, sigs, ns, seen, size = [], [], [], set(), 0

        def packed():
            tok, sig, n = np.concatenate(toks), np.repeat(sigs, [len(t) for t in toks]), np.repeat(ns, [len(t) for t in toks])
            part = (tok % U(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(part[by]) != 0, [True])))
            rows = np.stack([tok[by].view(np.int64), sig[by], n[by]], 1)
            return pa.RecordBatch.from_arrays([pa.array(part[by][edge[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], ["part", "packed"])

        for b in batches:
            for _, s in shingle_sets(b.column(0), k):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue  # a set seen in this run already has its prefix there
                seen.add(sig)
                p = len(s) - _need(len(s), percent) + 1
                toks.append(s[np.argsort(_order(s, level), kind="stable")[:p]])
                sigs.append(sig)
                ns.append(len(s))
                size += p
                if size > 1 << 18:
                    yield packed()
                    toks, sigs, ns, seen, size = [], [], [], set(), 0
        if toks:
            yield packed()

    return run


def _shared(batches):
    """Of one part, the (tok, sig, n) whose shingle stands in the prefix of two sets or more."""
    runs = [np.frombuffer(x, np.int64) for b in batches for x in b.column(1).to_pylist()]
    if not runs:
        return
    rows = np.concatenate(runs).reshape(-1, 3)
    del runs
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
    same = rows[1:, 0] == rows[:-1, 0]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    rows = rows[keep]
    for lo in range(0, len(rows), 50_000):
        r = rows[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(r[:, 2])], ["tok", "sig", "n"])


def _segments(k: int, level: np.ndarray, cuts: np.ndarray):
    """(sig, f, seg): a set cut at the pivots of the global order, each piece sorted by hash."""

    def run(batches):
        for b in batches:
            sigs, at, segs = [], [], []
            for _, s in shingle_sets(b.column(0), k):
                piece = np.searchsorted(cuts, _order(s, level), "right")
                for f in range(len(cuts) + 1):
                    sigs.append(_signature(s))
                    at.append(f)
                    segs.append(s[piece == f].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(at, pa.int32()), pa.array(segs, pa.binary())], ["sig", "f", "seg"])

    return run


def _may_link(na, nb, xor_bits, percent: int):
    """False where the parity bitmaps differ in more bits than the sets of a link can."""
    most = (na + nb - xor_bits) // 2
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _bits(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)


def _bounded(percent: int):
    """Of pairs (a, b, na, nb, map_a, map_b), those that the bitmaps do not rule out."""

    def run(batches):
        for x in batches:
            na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
            maps = x.column(4).to_pylist(), x.column(5).to_pylist()
            width = np.array([[len(m) for m in side] for side in maps]).reshape(2, -1)
            keep = np.zeros(x.num_rows, bool)
            for wa, wb in {*zip(*width.tolist())}:
                if max(wa, wb) > 2 * min(wa, wb):
                    continue  # too unlike in size
                some = np.flatnonzero((width[0] == wa) & (width[1] == wb))
                step = max(1, BITMAPS // int(max(wa, wb)))
                for at in (some[k : k + step] for k in range(0, len(some), step)):
                    left, right = (_bits([m[i] for i in at]) for m in maps)
                    left, right = _folded(left) if wa > wb else left, _folded(right) if wb > wa else right
                    keep[at] = _may_link(na[at], nb[at], np.bitwise_count(left ^ right).sum(1).astype(np.int64), percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in x.columns[:4]], ["a", "b", "na", "nb"])

    return run


def _overlaps(batches):
    """Shingles that each pair shares within one fragment."""
    for x in batches:
        c = [len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), True)) for s, t in zip(x.column(5).to_pylist(), x.column(6).to_pylist())]
        yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(c, pa.int64())], ["a", "b", "na", "nb", "f", "part"])


def _verified(pairs: DataFrame, classes: DataFrame, segments, percent: int) -> DataFrame:
    """Table of links (u, v) among distinct pairs (a, b): bitmap bound, then overlaps by fragment, summed."""
    both = (
        pairs.join(classes.selectExpr("sig AS a", "n AS na", "bitmap AS map_a"), "a")
        .join(classes.selectExpr("sig AS b", "n AS nb", "bitmap AS map_b"), "b")
        .select("a", "b", "na", "nb", "map_a", "map_b")
    )
    left = cut(both.mapInArrow(_bounded(percent), "a long, b long, na long, nb long"), "jaccard-bounded")
    seg = segments(left.selectExpr("a AS sig").union(left.selectExpr("b AS sig")).distinct())
    counted = (
        left.join(seg.selectExpr("sig AS b", "f", "seg AS seg_b"), "b")
        .join(seg.selectExpr("sig AS a", "f", "seg AS seg_a"), ["a", "f"])
        .select("a", "b", "na", "nb", "f", "seg_a", "seg_b")
        .mapInArrow(_overlaps, "a long, b long, na long, nb long, f int, part long")
        .groupBy("a", "b", "na", "nb", "f").agg(F.max("part").alias("part"))  # a repeated row brings a segment twice
        .groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("c"))
    )
    links = cut(counted.filter(f"100 * c >= {percent} * (na + nb - c)").select(F.col("a").alias("u"), F.col("b").alias("v")), "jaccard-links")
    discard(left, seg)
    return links


def _across(percent: int, block: int = 256):
    """Pairs of one shingle's sets in different components that the bitmaps do not rule out.

    A row is one member of a block pair (tok, i, j, side); both sides of a block
    pair come sorted together, so no more than two blocks are in memory.
    """

    def pairs(group):
        side, sig, n, comp = (np.array([g[c] for g in group], np.int64) for c in range(4))
        width = np.array([len(g[4]) for g in group])
        one = not side.any()  # a block with itself
        for w in np.unique(width):
            same, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            at = np.concatenate((same, twice))
            bits = _bits([group[i][4] for i in same])
            if len(twice):
                bits = np.concatenate((bits, _folded(_bits([group[i][4] for i in twice]))))
            for lo in range(0, len(same), block):
                i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, min(lo + block, len(same))), np.arange(len(at)), indexing="ij"))
                i, j = i[i < j], j[i < j]
                p, q = at[i], at[j]
                keep = (comp[p] != comp[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
                if not one:
                    keep &= side[p] != side[q]
                i, j, p, q = i[keep], j[keep], p[keep], q[keep]
                step = max(1, BITMAPS // int(w))
                for k in range(0, len(i), step):
                    c = slice(k, k + step)
                    ok = _may_link(n[p[c]], n[q[c]], np.bitwise_count(bits[i[c]] ^ bits[j[c]]).sum(1).astype(np.int64), percent)
                    u, v = sig[p[c][ok]], sig[q[c][ok]]
                    if len(u):
                        yield np.minimum(u, v), np.maximum(u, v)

    def run(batches):
        key, group, seen = None, [], set()

        def out():
            for a, b in pairs(group):
                new = [p for p in dict.fromkeys(zip(a.tolist(), b.tolist())) if p not in seen]
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new)], ["a", "b"])

        for x in batches:
            for tok, i, j, *row in zip(*(c.to_pylist() for c in x.columns)):
                if (tok, i, j) != key:
                    if len(group) > 1:
                        yield from out()
                    key, group = (tok, i, j), []
                group.append(row)
        if len(group) > 1:
            yield from out()

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, star_rounds: int = 3, block: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null and empty texts, and texts without words, have the empty set: they link
    with nothing and form components of their own, as do rows without id (their
    component_id is null unless a link gives one). Texts of fewer than ``words``
    words count as one shingle. Repeated rows and equal sets share a class and
    are compared once. Other columns are not read. An empty table gives an empty
    result. Shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    listed = cut(docs.mapInArrow(_sets(words), "doc_id long, n long, sig long, bitmap binary, counts array<long>"), "jaccard-sets")
    each = listed.filter("counts IS NULL").select("doc_id", "n", "sig")
    classes = cut(listed.filter("counts IS NULL AND n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap")), "jaccard-classes")

    # the sketch has 2**SKETCH_BITS cells however large the corpus is
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sums = listed.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("cell", "c")).groupBy("cell").agg(F.sum("c").alias("c")).filter("c > 0")
    held = sums.toArrow()
    sketch[held["cell"].to_numpy()] = held["c"].to_numpy()
    del held
    level = np.floor(np.log2(np.maximum(sketch, 1)) * 4).astype(np.uint8)  # goes with the tasks: a byte a cell
    cells = np.arange(len(sketch), dtype=np.uint64)
    order = np.sort((level.astype(np.uint64) << U(56)) | (cells << U(56 - SKETCH_BITS)))
    rank = np.lexsort((cells, level))
    mass = np.cumsum(sketch[rank])
    cuts = order[np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = cut(
        docs.select("text").mapInArrow(_prefixes(words, percent, level, parts * 8), "part int, packed binary")
        .repartition(parts, "part")
        .mapInArrow(_shared, "tok long, sig long, n long"),
        "jaccard-shared",
    )
    # of shingles with the same sets one stands for all
    group = shared.groupBy("tok").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y"))
    posts = cut(shared.join(group.groupBy("m", "x", "y").agg(F.min("tok").alias("tok")).select("tok"), "tok", "left_semi"), "jaccard-postings")
    discard(shared)
    sweep(spark)

    def segments(sigs: DataFrame) -> DataFrame:
        """Segments of the given sets, from one text of each."""
        ids = cut(sigs.join(classes, "sig").select("least").distinct(), "jaccard-wanted")
        ids = F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids
        return cut(docs.join(ids, docs.doc_id.eqNullSafe(ids.least), "left_semi").select("text").mapInArrow(_segments(words, level, cuts), "sig long, f int, seg binary"), "jaccard-segments")

    tested = labels = None

    def placed() -> DataFrame:
        """Postings of shingles that still stand in two components or more, with each set's component."""
        p = posts.withColumn("comp", F.col("sig")) if labels is None else posts.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("label", "sig")).drop("label")
        open_ = p.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter("x <> y").select("tok", "m")
        return p.join(open_, "tok")

    def verify(pairs: DataFrame) -> None:
        """Count the pairs not counted yet; new links join the components known, which stand as stars."""
        nonlocal tested, labels
        fresh = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        fresh = cut(fresh, "jaccard-pairs")
        found = _verified(fresh, classes, segments, percent)
        tested = fresh if tested is None else tested.union(fresh)
        known = labels
        if known is not None and found.isEmpty():
            discard(found)
            return  # the components stay as they are
        labels = cut(components(found if known is None else found.union(known.select("node", "label"))), "jaccard-labels")
        discard(found, *([] if known is None else [known]))
        sweep(spark)

    for turn in range(star_rounds):
        open_ = cut(placed(), "jaccard-open")
        by = F.struct(F.xxhash64(F.lit(turn), "sig").alias("r"), F.col("sig").alias("leader"), F.col("n").alias("nl"), F.col("comp").alias("cl"))
        lead = open_.groupBy("tok").agg(F.min(by).alias("l")).select("tok", "l.*")
        star = open_.join(lead, "tok").filter(f"comp <> cl AND 100 * least(n, nl) >= {percent} * greatest(n, nl)")
        verify(star.select(F.least("sig", "leader").alias("a"), F.greatest("sig", "leader").alias("b")))
        discard(open_)
    open_ = cut(placed(), "jaccard-open")
    sweep(spark)
    home = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    # shingles of one cluster mostly share their smallest set: dealt by it, a pair comes up in few tasks;
    # bitmaps join last, so that they move once
    blocked = (
        open_.join(open_.groupBy("tok").agg(F.min("sig").alias("lead")), "tok")
        .withColumn("blocks", F.ceil(F.col("m") / block))
        .join(classes.select("sig", "bitmap"), "sig")
        .withColumn("own", home)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("lead", "tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("long").alias("side"), "sig", "n", "comp", "bitmap")
        .repartition(parts, "lead", "i", "j")
        .sortWithinPartitions("tok", "i", "j")
        .drop("lead")
    )
    verify(blocked.mapInArrow(_across(percent), "a long, b long"))
    discard(open_, posts, tested)
    least = labels.join(classes, labels.node == classes.sig).groupBy("label").agg(F.min("least").alias("component"))
    of = labels.join(least, "label").select(F.col("node").alias("sig"), "component")
    return (
        each.join(classes.select("sig", "least"), "sig", "left")
        .join(of, "sig", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "least")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns as they were: one of each component.

    It is the row with the smallest id (null ids last), then the first as stored.
    Rows are numbered first, so repeated and null ids do no harm: of equal rows
    exactly one stays. Null and empty texts, and texts without words, all stay.
    Other columns pass through and may have any name; an empty table stays empty.
    """
    rid = next(n for n in ("row_number", *(f"row_number_{k}" for k in range(len(docs.columns)))) if n not in docs.columns)
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "jaccard-rows")
    classed = jaccard_components(rows, rid, text_col).withColumnRenamed("doc_id", rid).join(rows.select(rid, F.col(id_col).alias("own_id")), rid)
    best = classed.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", rid)).alias("best"))
    return rows.join(best.select(f"best.{rid}"), rid, "left_semi").select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS} - 1], ' '))) END AS sh
  FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS tok FROM s),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS hits
  FROM t x JOIN t y ON x.tok = y.tok AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c WHERE 100 * hits >= {PERCENT} * (na + nb - hits)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY ALL
"""
