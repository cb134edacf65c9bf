"""Removal of repeated byte strings with a sparse, distributed suffix array.

The suffixes that are sorted form a cover of all positions with the property a
difference cover has: two equal strings of ``length`` bytes have a sampled
position at the same offset. Here the cover is chosen by content: the sample of a
string is its leftmost ``gram`` bytes of smallest hash, so every string has
exactly one, and equal strings the same. Sampled positions are dealt to tasks by
that hash. Within a task the contexts to the right and to the left are sorted by
naming triples of bytes, then triples of names, until one name is left; adjacent
ones are compared byte by byte. A remaining suffix (an unsampled start) is merged
in through its sample: it lies ``d`` bytes before it, and two of them agree in
``length`` bytes exactly if their samples agree in d bytes to the left and
length - d to the right.

Only samples whose hash occurs at least twice bring their bytes along. Of equal
contexts within a map task only the earliest is sent, the others are known to be
repeats; so a passage that a third of the documents share moves once a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read, sweep
from .wordhash import _BYTE, U, _power, blocks, mix

LENGTH, GRAM = 100, 32
LAST = (1 << 63) - 1
_POS = U((1 << 31) - 1)


def _samples(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Sampled position, hash, least and most distance of the starts it serves, and row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    starts_of = np.maximum(np.diff(off) - length + 1, 0)
    if not starts_of.any():
        return none, none.view(np.uint64), none, none, none
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    least = key
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: n - length + 1], least[width - reach : width - reach + n - length + 1])
    # starts of strings that lie within one document
    valid = np.ones(n - length + 1, bool)
    ends = off[1:]
    for e, b in zip(ends.tolist(), off[:-1].tolist()):
        valid[max(b, e - length + 1) : e] = False
    s = np.flatnonzero(valid)
    at = (least[s] & _POS).astype(np.int64)
    row = np.searchsorted(off, s, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((first[1:], [len(s)])) - 1
    p = at[first]
    return p, h[p], p - s[last], p - s[first], row[first]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(length: int, gram: int, parts: int):
    """Samples of all documents as packed columns (hash, doc_id, position, distances), dealt by hash."""

    def run(batches):
        held, size = [], 0

        def packed():
            h, d, p, lo, hi = (np.concatenate(x) for x in zip(*held))
            part = (h % U(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(part[by]) != 0, [True])))
            rows = [b"".join(c[by[a:b]].tobytes() for c in (h, d, p, lo, hi)) for a, b in zip(edge, edge[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[by][edge[:-1]]), pa.array(rows, pa.binary())], ["part", "packed"])

        for b in batches:
            ids = _ids(b.column(0))
            for lo, hi, data, off in blocks(b.column(1)):
                p, h, near, far, row = _samples(data, off, length, gram)
                held.append((h, ids[lo:hi][row], (p - off[row]).astype(np.uint32), near.astype(np.uint8), far.astype(np.uint8)))
                size += len(p)
                if size > 1 << 19:
                    yield packed()
                    held, size = [], 0
        if held and size:
            yield packed()

    return run


def _unpacked(blobs):
    """Columns of packed samples."""
    cols = [[], [], [], [], []]
    for x in blobs:
        m, at = len(x) // 22, 0
        for c, t in zip(cols, (np.uint64, np.int64, np.uint32, np.uint8, np.uint8)):
            w = m * np.dtype(t).itemsize
            c.append(np.frombuffer(x[at : at + w], t))
            at += w
    return [np.concatenate(c) for c in cols]


def _repeated(batches):
    """(doc_id, samples) of samples whose hash occurs twice or more; samples: packed hash, position, distances."""
    blobs = [x for b in batches for x in b.column(1).to_pylist()]
    if not blobs:
        return
    h, d, p, lo, hi = _unpacked(blobs)
    del blobs
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    by = by[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    by = by[np.lexsort((p[by], d[by]))]
    edge = np.flatnonzero(np.concatenate(([True], d[by][1:] != d[by][:-1], [True]))) if len(by) else np.zeros(1, np.int64)
    for k in range(0, len(edge) - 1, 4096):
        e = edge[k : k + 4097]
        rows = [b"".join(c[by[x:y]].tobytes() for c in (h, p, lo, hi)) for x, y in zip(e, e[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(d[by[e[:-1]]]), pa.array(rows, pa.binary())], ["id", "samples"])


OUT = "part int, packed binary, id long, th long, a long, b long"
_OUT = pa.schema([("part", pa.int32()), ("packed", pa.binary()), ("id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _found(ids, ths, a, b, part=None):
    n = len(ids)
    part = pa.nulls(n, pa.int32()) if part is None else pa.array(part.astype(np.int32))
    return pa.RecordBatch.from_arrays([part, pa.nulls(n, pa.binary()), pa.array(ids), pa.array(ths), pa.array(a), pa.array(b)], schema=_OUT)


def _contexts(length: int, parts: int):
    """Samples with the bytes around them, packed and dealt by hash; repeats within the run as ranges of bytes."""
    head = np.dtype([("h", "u8"), ("id", "i8"), ("th", "i8"), ("p", "u4"), ("lo", "u1"), ("hi", "u1"), ("n", "u2")])

    def run(batches):
        held: dict[tuple, tuple] = {}
        size = 0

        def out(rows):
            part = np.array([r[0] % parts for r in rows])
            by = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(part[by]) != 0, [True])))
            packed = []
            for x, y in zip(edge, edge[1:]):
                mine = [rows[i] for i in by[x:y]]
                packed.append(len(mine).to_bytes(4, "little") + np.array([(r[0], r[4], r[5], r[6], r[1], r[2], len(r[3])) for r in mine], head).tobytes() + b"".join(r[3] for r in mine))
            n = pa.nulls(len(packed), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(part[by[edge[:-1]]].astype(np.int32)), pa.array(packed, pa.binary()), n, n, n, n], schema=_OUT)

        for b in batches:
            ids, ths = b.column(0).to_pylist(), b.column(1).to_pylist()
            again = []
            for i, th, text, lists in zip(ids, ths, b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                for x in lists:
                    m = len(x) // 14
                    hs, ps = np.frombuffer(x[: 8 * m], np.uint64).tolist(), np.frombuffer(x[8 * m : 12 * m], np.uint32).tolist()
                    los, his = x[12 * m : 13 * m], x[13 * m :]
                    for h, p, lo, hi in zip(hs, ps, los, his):
                        hi = min(hi, p)
                        lo = max(lo, p + length - len(text))
                        if lo > hi:
                            continue  # another row with this id has the sample
                        seg = text[p - hi : p - lo + length]
                        key = (h, lo, hi, seg)
                        old = held.get(key)
                        if old is None:
                            held[key] = (i, th, p)
                            size += len(seg) + 100
                        elif old != (i, th, p):
                            later = max(old, (i, th, p))
                            held[key] = min(old, (i, th, p))
                            again.append((later[0], later[1], later[2] - hi, later[2] - lo + length))
            if again:
                x = np.array(again, np.int64)
                yield _found(x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 0] % parts)
            if size > 1 << 26:
                yield out([k + v for k, v in held.items()])
                held, size = {}, 0
        if held:
            yield out([k + v for k, v in held.items()])

    return run


def _names(rows: np.ndarray) -> np.ndarray:
    """Rank of each row of bytes: names of triples, then of triples of names, to the last."""
    m, n = rows.shape
    rows = np.concatenate((rows, np.zeros((m, -n % 3), np.uint8)), 1).astype(np.int64)
    now = (rows[:, 0::3] << 16) | (rows[:, 1::3] << 8) | rows[:, 2::3]
    while True:
        now = np.unique(now, return_inverse=True)[1].reshape(now.shape).astype(np.int64)
        if now.shape[1] == 1:
            return now[:, 0]
        now = np.concatenate((now, np.zeros((m, -now.shape[1] % 3), np.int64)), 1)
        top = int(now.max()) + 1
        a, b, c = now[:, 0::3], now[:, 1::3], now[:, 2::3]
        if top < 1 << 21:
            now = (a * top + b) * top + c
        else:  # too many names to pack: name pairs first
            now = np.unique(a * top + b, return_inverse=True)[1].reshape(a.shape) * top + c


def _agree(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order; 0 for the first."""
    out = np.zeros(len(by), np.int64)
    for k in range(1, len(by), 1 << 15):
        j = np.arange(k, min(k + (1 << 15), len(by)))
        differ = rows[by[j]] != rows[by[j - 1]]
        out[j] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _later(length: int, gram: int):
    """Ranges of bytes covered by strings that also start earlier, from all samples of some hashes."""
    head = np.dtype([("h", "u8"), ("id", "i8"), ("th", "i8"), ("p", "u4"), ("lo", "u1"), ("hi", "u1"), ("n", "u2")])
    most = length - gram

    def run(batches):
        heads, segs = [], []
        for x in batches:
            known = pa.compute.is_null(x.column(1))
            if pa.compute.any(known).as_py():
                yield x.filter(known)
            for blob in x.column(1).drop_null().to_pylist():
                m = int.from_bytes(blob[:4], "little")
                r = np.frombuffer(blob, head, m, 4)
                heads.append(r)
                segs.append(np.frombuffer(blob, np.uint8, offset=4 + m * head.itemsize))
        if not heads:
            return
        r, text = np.concatenate(heads), np.concatenate(segs)
        del heads, segs
        begin = np.cumsum(r["n"].astype(np.int64)) - r["n"]
        by = np.lexsort((r["p"], r["th"], r["id"]))  # from here on the first of a class is the earliest
        r, begin = r[by], begin[by]
        group = np.unique(r["h"], return_inverse=True)[1]
        many = np.bincount(group)[group] > 1
        r, begin, group = r[many], begin[many], group[many]
        if not len(r):
            return
        lo, hi, p = r["lo"].astype(np.int64), r["hi"].astype(np.int64), r["p"].astype(np.int64)
        mid = begin + hi  # the sample's first byte
        text = np.concatenate((text, np.zeros(length, np.uint8)))

        def side(step: int, width: int, n: np.ndarray):
            rows = np.zeros((len(r), width), np.uint8)
            for k in range(width):
                ok = k < n
                rows[ok, k] = text[(mid + k if step > 0 else mid - 1 - k)[ok]]
            order = np.lexsort((_names(rows), group))
            return order, _agree(rows, order)

        right, r_len = side(1, length, length - lo)
        left, l_len = side(-1, max(most, 1), hi)
        r_new, l_new = (np.concatenate(([True], group[o][1:] != group[o][:-1])) for o in (right, left))
        m = len(r)
        flag = np.zeros((m, most + 1), bool)
        ids = np.empty((2, m), np.int64)
        for d in range(most + 1):
            at = np.flatnonzero((lo <= d) & (d <= hi))
            if len(at) < 2:
                continue
            ids[0, right] = np.cumsum(r_new | (r_len < length - d))
            ids[1, left] = np.cumsum(l_new | (l_len < d))
            key = ids[0, at] * (m + 1) + ids[1, at]
            order = np.argsort(key, kind="stable")
            flag[at[order[1:]], d] = key[order[1:]] == key[order[:-1]]
        # runs of flagged distances are ranges of bytes
        padded = np.zeros((m, most + 3), np.int8)
        padded[:, 1:-1] = flag
        turn = np.diff(padded, axis=1)
        row, first = np.nonzero(turn == 1)
        last = np.nonzero(turn == -1)[1] - 1
        for k in range(0, len(row), 100_000):
            c = slice(k, k + 100_000)
            yield _found(r["id"][row[c]], r["th"][row[c]], p[row[c]] - last[c], p[row[c]] - first[c] + length)

    return run


def _kept(batches):
    """Digest of what is left of each text: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    for b in batches:
        out = []
        for text, lists in zip(b.column(1).fill_null("").cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            if not lists:
                out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            step = np.zeros(len(text) + 1, np.int64)
            x = np.array([(r["a"], r["b"]) for r in lists], np.int64)
            np.add.at(step, x[:, 0], 1)
            np.add.at(step, x[:, 1], -1)
            gone = np.cumsum(step)[:-1] > 0
            runs = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
            out.append((len(text), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
        cols = [b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, th, a, b): byte ranges of docs (id, th, text) covered by strings that also start earlier."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    anchors = (
        docs.select("id", "text").mapInArrow(_hashes(length, gram, parts), "part int, packed binary")
        .repartition(parts, "part")
        .mapInArrow(_repeated, "id long, samples binary")
        .groupBy("id").agg(F.collect_list("samples").alias("samples"))
    )
    anchors = cut(anchors, "suffix-samples")
    sweep(docs.sparkSession, wait=1.0)
    return (
        docs.filter(F.octet_length("text") >= length).join(anchors, "id").select("id", "th", "text", "samples")
        .mapInArrow(_contexts(length, parts), OUT)
        .repartition(parts, "part")
        .mapInArrow(_later(length, gram), OUT)
        .select("id", "th", "a", "b")
    )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty; texts shorter than ``length``
    keep everything. Rows without id come after all others (ids below 2**62), in
    the order of their texts' hashes. Rows that repeat id and text are one
    document and get the same result; rows that share only the id follow each
    other in the order of their texts' hashes. A very long text needs a few dozen
    times its own size of memory in one task. Other columns are not read; an
    empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    doc_id, th = docs[id_col].cast("long"), F.xxhash64(text)
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(1 << 62) + F.shiftrightunsigned(th, 2)).alias("id"), th.alias("th"), text.alias("text"))
    ranges = cut(repeated_ranges(docs, length, gram).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "suffix-ranges")
    sweep(docs.sparkSession, wait=1.0)
    return docs.join(ranges, ["id", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
