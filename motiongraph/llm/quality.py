"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: the target from documents
labelled good, the raw one from all documents. The n-grams are words and runs of
punctuation, the bigrams of neighbours, and one backed-off bigram for a token that
repeats the one before. The models' hash cells grow with the square root of
the corpus; words and bigrams have cells of their own, so that the many bigrams
do not blur the words.
Each n-gram has the log ratio of the two models, both without the document's own
counts, so that labelled and other documents are weighed alike. The plain sum of
the ratios favours long documents and lets many good words outweigh a few very
bad ones; so the log importance weight is minus the mean square of the amounts by
which the ratios fall short of the good text's own mean. Documents are drawn without replacement in
proportion to their weights by Gumbel top-k: the k largest of log weight + noise
stay.

k is the number of documents whose log weight reaches the cut that separates
labelled good from labelled bad documents best. Weights are per n-gram, so the
noise is too: the default temperature, 0.001, is that of plain importance
resampling (1 on the summed ratios) for a document of 1,000 n-grams. It decides
among documents near the cut only, as a filter should.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read, uniform
from .wordhash import U, alphanumeric, blocks, grams, word_hashes

#: Hash of the backed-off bigram.
REPEAT = U(0x5EED)
#: A model has a power of two of hash cells for words and as many for bigrams: CELLS_PER_ROOT times the square root of
#: the corpus's bytes or more, as vocabularies grow about so; from LEAST_CELLS, and at most MOST_CELLS, which 17 TB reach (2 GB a worker).
CELLS_PER_ROOT = 32
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27
#: Cells a piece of a model holds while counts are summed.
PIECE = 1 << 12
#: The target model and the cut are fitted on at most this many labelled documents.
MOST_LABELLED = 20_000
#: Pseudo-counts that pull a cell's ratio toward 1.
PRIOR = 1.0
#: Weight of a good document against a bad one in the choice of the cut.
GOOD_WEIGHT = 3.0
#: A document's shortfall is averaged over this many n-grams at least.
LEAST_GRAMS = 30
TEMPERATURE = 0.001


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, and runs of other visible characters."""
    kind = np.zeros(256, np.int8)
    kind[33:127] = 2
    kind[alphanumeric()] = 1
    k = np.zeros(len(data) + 2, np.int8)
    k[1:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero((k[1:-1] > 0) & ((k[1:-1] != k[:-2]) | edge[:-1]))
    ends = np.flatnonzero((k[1:-1] > 0) & ((k[1:-1] != k[2:]) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _features(column: pa.Array, cells: int):
    """Blocks of (first row, rows, row of each n-gram, cell of each n-gram): words in the lower half, bigrams in the upper."""
    for lo, hi, data, off in blocks(column):
        starts, ends, bound = _tokens(data, off)
        wh = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(hi - lo), np.diff(bound))
        pair = np.flatnonzero(row[1:] == row[:-1])
        again = pair[wh[pair] == wh[pair + 1]]
        two = np.concatenate((grams(wh, 2)[pair], np.full(len(again), REPEAT)))
        cell = np.concatenate((wh % U(cells), two % U(cells) + U(cells))).astype(np.int64)
        yield lo, hi - lo, np.concatenate((row, row[pair], row[again])), cell


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _counted(cells: int):
    """Counts of the task's good documents and of all its documents, in pieces of the model: cell within the piece, counts."""

    def run(batches):
        good, raw = np.zeros(2 * cells, np.uint32), np.zeros(2 * cells, np.uint32)
        held, size = [], 0

        def flush():
            cell, flag = (np.concatenate(x) for x in zip(*held))
            for into, c in ((raw, cell), (good, cell[flag])):
                if len(c) > cells // 4:
                    into += np.bincount(c, minlength=2 * cells).astype(np.uint32)
                else:
                    np.add.at(into, c, np.uint32(1))

        for b in batches:
            flag = _flags(b.column(1))
            for lo, n, row, cell in _features(b.column(0), cells):
                held.append((cell, flag[lo : lo + n][row]))
                size += len(cell)
                if size > 1 << 20:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        at = np.flatnonzero(raw)
        edge = np.searchsorted(at, np.arange(0, 2 * cells + 1, PIECE))
        some = np.flatnonzero(np.diff(edge))
        packed = [b"".join(((at[x:y] % PIECE).astype(np.uint16).tobytes(), raw[at[x:y]].tobytes(), good[at[x:y]].tobytes())) for x, y in zip(edge[some], edge[some + 1])]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], ["piece", "packed"])

    return run


def _summed(batches):
    """Whole pieces: good and raw counts of each cell."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            m = len(x) // 10
            at = np.frombuffer(x, np.uint16, m).astype(np.int64)
            into = sums.setdefault(piece, np.zeros((2, PIECE)))
            into[1, at] += np.frombuffer(x, np.uint32, m, 2 * m)
            into[0, at] += np.frombuffer(x, np.uint32, m, 6 * m)
    for piece, (good, raw) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([good.astype(np.float32).tobytes()], pa.binary()), pa.array([raw.astype(np.float32).tobytes()], pa.binary())], ["piece", "good", "raw"])


def _scored(good: np.ndarray, raw: np.ndarray):
    """Scores by the models' counts; what a document has counted itself is taken off first."""
    cells = len(raw) // 2
    part = float(good.sum(dtype=np.float64) / max(raw.sum(dtype=np.float64), 1.0))
    held = np.flatnonzero(good)
    usual = float((good[held] * np.log((good[held] + PRIOR) / (part * raw[held] + PRIOR))).sum(dtype=np.float64) / max(good.sum(dtype=np.float64), 1.0))

    def run(batches):
        for b in batches:
            score, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            flag = _flags(b.column(2))
            for lo, n, row, cell in _features(b.column(1), cells):
                key, own = np.unique(row * len(raw) + cell, return_counts=True)
                r, c = key // len(raw), key % len(raw)
                ratio = np.log((good[c] - own * flag[lo + r] + PRIOR) / (part * (raw[c] - own) + PRIOR))
                count[lo : lo + n] = np.bincount(row, minlength=n)
                short = np.minimum(ratio - usual, 0.0)
                score[lo : lo + n] = -np.bincount(r, short * short * own, n) / np.maximum(count[lo : lo + n], LEAST_GRAMS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(count), pa.array(score)], ["doc_id", "text_hash", "n_grams", "log_weight"])

    return run


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The score that separates labelled good and bad documents best, good ones weighing GOOD_WEIGHT times as much."""
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate((good, bad)))
    right = GOOD_WEIGHT * (1 - np.searchsorted(np.sort(good), at, "left") / len(good)) + np.searchsorted(np.sort(bad), at, "left") / len(bad)
    best = int(np.argmax(right))
    return float(at[best] if best == 0 else (at[best - 1] + at[best]) / 2)


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024) -> float:
    """Exact k-th largest value of a column of doubles, by repeated histograms of ``bins`` counts."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    while hi > lo:
        width = (hi - lo) / bins
        if lo + width in (lo, hi):
            break
        part = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))
        rows = df.filter(F.col(col).between(lo, hi)).groupBy(part.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return hi


def model_cells(docs: DataFrame, text_col: str = "text") -> int:
    """Cells for words, and as many for bigrams."""
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    return min(max(1 << int(np.ceil(np.log2(CELLS_PER_ROOT * np.sqrt(max(size, 1))))), LEAST_CELLS), MOST_CELLS)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, cells: int | None = None) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_grams, log_weight, draw, kept.

    labels: (doc_id, quality, toxic); good is quality 1 and toxic 0, bad is
    anything else known, a null label counts for neither. Null and empty texts
    have weight 1 (log weight 0). Documents tied with the k-th all stay, so
    repeated rows share their fate. Without labels of both kinds everything
    stays. Rows without id take part with one shared noise value. Texts are read
    whole, in blocks; a very long one needs a few times its own size of memory.
    Only id and text are read, so other columns cannot clash; an empty table is
    fine.
    """
    text = docs[text_col].cast("string")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    known = labels.select(F.col("doc_id").cast("long"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).filter("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED), "labelled")
    flagged = docs.join(F.broadcast(sample.filter("good")), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    cells = cells or model_cells(docs)
    good, raw = np.zeros((2 * cells // PIECE, PIECE), np.float32), np.zeros((2 * cells // PIECE, PIECE), np.float32)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = flagged.select("text", "good").mapInArrow(_counted(cells), "piece int, packed binary").repartition(parts, "piece").mapInArrow(_summed, "piece int, good binary, raw binary").toArrow()  # 2 * cells / PIECE rows
    for piece, g, r in zip(counts["piece"], counts["good"], counts["raw"]):
        good[piece.as_py()], raw[piece.as_py()] = np.frombuffer(g.as_buffer(), np.float32), np.frombuffer(r.as_buffer(), np.float32)
    scores = cut(flagged.select("doc_id", "text", "good", "text_hash").mapInArrow(_scored(good.ravel(), raw.ravel()), "doc_id long, text_hash long, n_grams long, log_weight double"), "scores")
    del counts, good, raw
    fitted = scores.join(F.broadcast(sample), "doc_id").select("log_weight", "good").toArrow()  # MOST_LABELLED ids at most
    weight, is_good = fitted["log_weight"].to_numpy(), fitted["good"].to_numpy().astype(bool)
    edge = best_cut(weight[is_good], weight[~is_good])
    noise = -F.log(-F.log(F.greatest(uniform(F.lit("gumbel"), F.col("doc_id")), F.lit(1e-15))))
    drawn = scores.withColumn("draw", F.col("log_weight") + temperature * noise)
    k = scores.filter(F.col("log_weight") >= edge).count() if np.isfinite(edge) else 0
    least = kth_largest(drawn, "draw", k) if k else (float("inf") if np.isfinite(edge) else float("-inf"))
    return drawn.withColumn("kept", F.col("draw") >= least)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the draw keeps, with their columns as they were.

    Rows are judged by id and text, so a row that shares only its id (or has
    none) with a rejected one stays. Nulls, ties, repeated rows and empty tables
    are as in quality(). Other columns pass through and may have any name.
    """
    out = quality(docs, labels).filter("NOT kept").select("doc_id", "text_hash").distinct()
    return docs.join(out, docs.doc_id.eqNullSafe(out.doc_id) & (F.xxhash64(docs.text) == out.text_hash), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
