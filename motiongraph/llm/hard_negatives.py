"""Hard negatives by rotated one-bit codes and deterministic intervals.

A vector o is stored as codes: the signs of o after a random rotation are a unit
vector x; with the alignment a = <o, x>, o = a x + r, and r is coded in the same
way under the next rotation. For an anchor q

    <q, o> = sum a_k <q, x_k> + <q, r>,   |<q, r>| <= |r| sqrt(|q|^2 - <q, x>^2)

as r is orthogonal to the last x (Cauchy-Schwarz). The products <q, x_k> are
popcounts of the code's bits under the bit planes of the rotated, quantised
anchor; the quantisation's error widens the interval. So every score lies within
its interval, whatever the data: what the interval rules out is out, and the
rest is scored in integers. Anchors meet all rows in blocks, once for the
positives and once for the negatives between the limits that these set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, discard, read
from .vectors import from_bytes, matrices, usable

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Codes of a vector and bits of an anchor's component.
LEVELS, PLANES = 3, 6
#: Rows and anchors of a block; anchor blocks that a task may hold.
ROWS, ANCHORS, HELD = 4096, 1024, 64
#: Anchors compared at once with a block of rows.
STRIP = 64
#: Rows scored first, for each that is wanted.
SEEDS = 4
#: Relative slack for rounding in single precision.
SLACK = 2e-5
#: Limits that every score meets.
WHOLE = np.array([[[-(1 << 63), (1 << 63) - 1]]])
#: Components beyond this are scored without codes.
LARGEST = 2.0**31


@lru_cache(maxsize=4)
def _rotations(width: int, levels: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(width))
    return np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(levels)]) if levels else np.zeros((0, width, width))


def _padded(v: np.ndarray) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, -v.shape[1] % 64 if v.shape[1] else 64)))


def codes_of(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words (n, levels, words), alignments (n, levels) and norms of what is left (n)."""
    rest = _padded(v)
    n, width = rest.shape
    words, align = np.zeros((n, levels, width // 64), np.uint64), np.zeros((n, levels))
    for k, turn in enumerate(_rotations(width, levels)):
        bits = rest @ turn.T >= 0
        words[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        x = np.where(bits, 1.0, -1.0) @ turn / np.sqrt(width)
        align[:, k] = np.einsum("ij,ij->i", rest, x)
        rest = rest - align[:, k, None] * x
    return words, align, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def planes_of(q: np.ndarray, levels: int = LEVELS, bits: int = PLANES):
    """Of each level: bit planes (n, bits, words), lowest value, step, sum of the quantised anchor, its error."""
    q = _padded(q)
    out = []
    for turn in _rotations(q.shape[1], levels):
        y = q @ turn.T
        low = y.min(1, keepdims=True)
        step = np.maximum((y.max(1, keepdims=True) - low) / ((1 << bits) - 1), 1e-30)
        u = np.clip(np.rint((y - low) / step), 0, (1 << bits) - 1).astype(np.uint8)
        near = low + step * u
        planes = np.stack([np.packbits((u >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(bits)], 1)
        out.append((planes, low, step, near.sum(1, keepdims=True), np.linalg.norm(y - near, axis=1, keepdims=True)))
    return out


def intervals(planes, norm: np.ndarray, words: np.ndarray, align: np.ndarray, left: np.ndarray, row_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of anchors and rows, and how far off they can be."""
    width = 64 * words.shape[2]
    est = np.zeros((len(norm), len(words)), np.float32)
    off = np.zeros_like(est)
    hits = np.zeros(est.shape, np.uint16 if width << planes[0][0].shape[1] < 1 << 16 else np.int64)
    both, count = np.empty(est.shape, np.uint64), np.empty(est.shape, np.uint8)
    for k, (bits, low, step, total, error) in enumerate(planes):
        hits[:] = 0
        for j in reversed(range(bits.shape[1])):  # the highest plane first, doubled as the lower ones follow
            np.left_shift(hits, 1, out=hits)
            for w in range(words.shape[2]):
                np.bitwise_and(bits[:, j, w, None], words[:, k, w], out=both)
                np.bitwise_count(both, out=count)
                np.add(hits, count, out=hits)
        ones = np.bitwise_count(words[:, k]).sum(1).astype(np.float32)
        qx = (2 * (low.astype(np.float32) * ones + step.astype(np.float32) * hits) - total.astype(np.float32)) / np.float32(np.sqrt(width))
        est += align[:, k].astype(np.float32) * qx
        off += np.abs(align[:, k]).astype(np.float32) * error.astype(np.float32)
    least = np.maximum(np.abs(qx) - error.astype(np.float32), 0)
    off += left.astype(np.float32) * np.sqrt(np.maximum((norm[:, None] ** 2).astype(np.float32) * np.float32(1 + SLACK) - least**2, 0))
    return est, off + np.float32(SLACK) * (norm[:, None] * row_norm).astype(np.float32)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows of whole doubles; beyond the range of a long they end at its ends."""
    if not len(a) or not a.shape[1]:
        return np.zeros(len(a), np.int64)
    if a.dtype == np.float32:  # chosen by the caller where sums stay exact
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    most = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if most < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for p, q in zip(a, b)], np.int64)


def _first(ok: np.ndarray, est, off, q: np.ndarray, ids: np.ndarray, comp: np.ndarray, limits: np.ndarray, k: int):
    """(anchor, slot, row, score) of the first k rows among ok with lo <= score <= hi, for each of an anchor's slots.

    limits (anchors, slots, 2). The rows that look best are scored first: the k-th of them within its limits is what
    the others must be able to reach. A pair is scored once for all slots.
    """
    top, low = est + off, est - off
    n, open_ = est.shape[1], np.zeros(ok.shape, bool)
    at = lambda mask: np.divmod(np.flatnonzero(mask), n)
    for slot in range(limits.shape[1]):
        lo, hi = limits[:, slot, 0, None], limits[:, slot, 1, None]
        may = ok & (top >= lo.astype(np.float32)) & (low <= hi.astype(np.float32))
        if n > SEEDS * k:
            guess = est.copy()
            guess[~may | (est > hi.astype(np.float32))] = -np.inf
            best = np.partition(guess, n - SEEDS * k, axis=1)[:, n - SEEDS * k, None]
            i, j = at((guess >= best) & (guess > -np.inf))
            s = scores(q[i], comp[j])
            fits = (s >= lo[i, 0]) & (s <= hi[i, 0])
            i, s = i[fits], s[fits]
            by = np.lexsort((-s, i))
            kth = by[np.arange(len(i)) - np.searchsorted(i[by], i[by], "left") == k - 1]
            least = np.full((len(q), 1), -np.inf, np.float32)
            least[i[kth], 0] = s[kth]
            may &= top >= least
        open_ |= may
    i, j = at(open_)
    v = scores(q[i], comp[j])
    out = []
    for slot in range(limits.shape[1]):
        fits = (v >= limits[i, slot, 0]) & (v <= limits[i, slot, 1])
        a, b, s = i[fits], j[fits], v[fits]
        by = np.lexsort((ids[b], -s, a))
        by = by[np.arange(len(a)) - np.searchsorted(a[by], a[by], "left") < k]
        out.append((a[by], np.full(len(by), slot), b[by], s[by]))
    return [np.concatenate(c) for c in zip(*out)]


def _packed(most: int, levels: int, bands: tuple[int, int] | None = None):
    """Blocks of up to ``most`` rows (id, label, comp) of one length, with codes where levels > 0.

    With bands (low, high percent) a row also has the scores of its positives, which become its limits lo and hi;
    missing ones have limits that nothing meets.
    """

    def limits(listed) -> np.ndarray:
        slots = max(map(len, listed), default=0)
        return np.array([[(-(-bands[0] * s // 100), bands[1] * s // 100) for s in r] + [(1, 0)] * (slots - len(r)) for r in listed], np.int64)

    def run(batches):
        for b in batches:
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, comp in matrices(b.column(2)):
                for lo in range(0, len(at), most):
                    some, c = at[lo : lo + most], np.floor(comp[lo : lo + most])
                    largest = np.abs(c).max(initial=0)
                    words, align, left = codes_of(c, levels if largest <= LARGEST else 0)
                    parts = [ids[some], labels[some], c.astype(np.int16) if largest < 2.0**15 else c, words, align, left]
                    parts.append(limits(b.column(3).take(pa.array(some)).to_pylist()) if bands else np.zeros(0))
                    yield pa.RecordBatch.from_arrays([pa.array([c.shape[1]], pa.int32()), pa.array([len(c)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], FIELDS)

    return run


FIELDS = ["dim", "n", "ids", "labels", "comp", "words", "align", "left", "limits"]
BLOCK = ", ".join(f"{name} {'int' if name in ('dim', 'n') else 'binary'}" for name in FIELDS)


def _side(b: pa.RecordBatch, i: int, prefix: str):
    get = lambda c: b.column(b.schema.get_field_index(prefix + c))[i]
    n, d = get("n").as_py(), b.column(b.schema.get_field_index("dim"))[i].as_py()
    comp = get("comp")
    kind = "i2" if len(comp.as_buffer()) == 2 * n * d else "f8"
    return n, from_bytes(get("ids"), "i8", n), from_bytes(get("labels"), "i8", n), from_bytes(comp, kind, n, d).astype(np.float64), get


def _searched(k: int, levels: int, slots: int):
    """Of joined blocks (anchors, rows): the first k same-label rows of each anchor, or with slots the first k
    different-label ones between the limits lo and hi of each of its slots."""

    def run(batches):
        for b in batches:
            for x in range(b.num_rows):
                na, a_ids, a_labels, q, anchor = _side(b, x, "a_")
                n, ids, labels, comp, row = _side(b, x, "")
                words, align, left = from_bytes(row("words"), "u8", n, -1, max(1, -(-comp.shape[1] // 64))), from_bytes(row("align"), "f8", n, -1), from_bytes(row("left"), "f8", n)
                coded = words.shape[1] > 0 and np.abs(q).max(initial=0) <= LARGEST
                row_norm = np.linalg.norm(comp, axis=1) if coded else None
                limits = from_bytes(anchor("limits"), "i8", na, -1, 2) if slots else np.tile(WHOLE, (na, 1, 1))
                exact = np.float32 if np.abs(q).max(initial=0) * np.abs(comp).max(initial=0) * comp.shape[1] < 1 << 24 else np.float64
                q_exact, comp_exact = q.astype(exact), comp.astype(exact)
                found = []
                for s in range(0, na, STRIP):
                    part = slice(s, min(s + STRIP, na))
                    if coded:
                        est, off = intervals(planes_of(q[part], levels), np.linalg.norm(q[part], axis=1), words, align, left, row_norm)
                    else:
                        est, off = np.zeros((part.stop - s, n), np.float32), np.full((part.stop - s, n), np.inf, np.float32)
                    same = a_labels[part, None] == labels
                    ok = ~same if slots else same & (a_ids[part, None] != ids)
                    i, slot, j, v = _first(ok, est, off, q_exact[part], ids, comp_exact, limits[part], k)
                    found.append((a_ids[part][i], slot, ids[j], v))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], ["anchor_id", "slot", "id", "score"])

    return run


def _tiles(anchors: DataFrame, blocks: DataFrame, n_anchors: int) -> DataFrame:
    """Each block of anchors beside each block of rows, once. Rows are dealt to groups and anchors go to every
    group; where there are many anchors, sets of HELD blocks have tasks of their own. Both sides are shuffled: Spark's
    estimate of the anchors leaves out that each is repeated for every group, so it would broadcast them."""
    groups = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = max(1, -(-n_anchors // (ANCHORS * HELD)))
    part = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    left = anchors.withColumn("set", part(sets, "ids")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnsRenamed({c: f"a_{c}" for c in anchors.columns if c != "dim"})
    right = blocks.withColumn("part", part(groups, "ids")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    return right.join(left.hint("merge"), ["dim", "set", "part"])


def _top(found: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    levels: int = LEVELS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the columns id, label and comp that picks the query set. A component x counts as
    floor(scale * x). Positives are an anchor's first rows of its label, negatives of each the first rows of another
    label whose score is from ``low`` to ``high`` percent of the positive's; higher scores first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component (also after scaling) take no part.
    Of rows with equal ids, repeated ones included, the smallest label and vector counts. Vectors of different lengths
    never meet; one without components scores 0. Very long vectors only make wider blocks. Scores beyond the range of
    a long end at its ends. An empty table, or one without anchors, gives no rows. Only the three columns are read.
    """
    comp = F.transform(vectors[vector_col].cast("array<double>"), lambda x: x * F.lit(float(scale)))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), comp.alias("comp"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("comp")))
    one = cut(rows.groupBy("id").agg(F.min(F.struct("label", "comp")).alias("v")).select("id", "v.label", "v.comp"), "negatives-vectors")
    chosen = cut(one.filter(anchor), "negatives-anchors")
    n = chosen.count()
    blocks = cut(one.mapInArrow(_packed(ROWS, levels), BLOCK), "negatives-blocks")
    packs = max(1, -(-n // ANCHORS))

    made = [one, chosen, blocks]

    def searched(anchors: DataFrame, k: int, bands: tuple[int, int] | None) -> DataFrame:
        packed = cut(anchors.repartition(packs, "id").mapInArrow(_packed(ANCHORS, 0, bands), BLOCK), "negatives-packs")
        made.append(packed)
        return _tiles(packed, blocks, n).mapInArrow(_searched(k, levels, positives if bands else 0), "anchor_id long, slot long, id long, score long")

    near = _top(searched(chosen, positives, None), ("anchor_id",), positives)
    best = cut(near.selectExpr("anchor_id", "CAST(rank - 1 AS LONG) AS slot", "id AS positive_id", "score AS positive_score"), "negatives-positives")
    made.append(best)
    listed = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    bound = chosen.join(listed.withColumnRenamed("anchor_id", "id").hint("merge"), "id").select("id", "label", "comp", "scores")
    hard = _top(searched(bound, negatives, (low, high)), ("anchor_id", "slot"), negatives)
    mined = hard.join(best.hint("merge"), ["anchor_id", "slot"]).selectExpr("anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score")
    mined = cut(mined, "negatives")
    discard(*made)
    return mined


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; labels of ids divisible by 7 move on by one."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0)


OP12_SQL = f"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS comp
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.comp, b.comp) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= {NEGATIVES}
"""
