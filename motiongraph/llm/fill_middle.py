"""Fill-in-middle transformation by a sparse exception index.

A text is cut into units (lines or characters) and two cuts part it into prefix,
middle and suffix, which are put in another order between sentinels. Cuts are
wanted both as UTF-8 bytes, to slice, and as code points, to report spans. The
two differ only by the excess bytes of characters of several bytes, so the index
of a text holds nothing but those characters: their code-point positions and the
running sum of their excess. A cut is turned from one count into the other by
one ``searchsorted`` in it; between exceptions a span is plain arithmetic, and an
ASCII text has an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read
from .wordhash import blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
#: Bytes of output in an Arrow batch, beyond one text.
BATCH = 1 << 22


@dataclass(frozen=True)
class ExceptionIndex:
    """Characters of several bytes in one text: where they start and the excess bytes up to and with each."""

    at_char: np.ndarray
    at_byte: np.ndarray
    excess: np.ndarray
    n_bytes: int

    @classmethod
    def of(cls, data: np.ndarray) -> ExceptionIndex:
        """Index of UTF-8 bytes (a uint8 array)."""
        lead = np.flatnonzero(data >= 0xC0)
        more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
        excess = np.cumsum(more)
        return cls(lead - (excess - more), lead, excess, len(data))

    @property
    def n_chars(self) -> int:
        return self.n_bytes - (int(self.excess[-1]) if len(self.excess) else 0)

    def _before(self, places: np.ndarray, cut: np.ndarray) -> np.ndarray:
        k = np.searchsorted(places, cut, "left")  # exceptions that start before the cut
        return np.concatenate(([0], self.excess))[k]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        return chars + self._before(self.at_char, chars)

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Of byte offsets at which a character starts, or of the end."""
        return at - self._before(self.at_byte, at)


def _ends(data: np.ndarray, index: ExceptionIndex, unit: str) -> tuple[int, object]:
    """Number of units, and the byte offset after the first k of them, as a function of k."""
    if unit == "char":
        return index.n_chars, lambda k: index.to_bytes(np.asarray(k))
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    return len(ends), lambda k: np.concatenate(([0], ends))[k]


def _transformed(unit: str, fim_percent: int, spm_percent: int, names: tuple[str, str, str]):
    """Columns (text, draws) to (n, form, prefix_chars, middle_chars, output)."""
    pre, suf, mid = (s.encode() for s in names)

    def one(data: np.ndarray, h: np.ndarray):
        index, raw = ExceptionIndex.of(data), data.tobytes()
        n, end_of = _ends(data, index, unit)
        if not raw or any(s in raw for s in (pre, suf, mid)) or h[2] % 100 >= fim_percent:
            return n, "plain", None, None, raw
        lo, hi = sorted((int(h[0] % (n + 1)), int(h[1] % (n + 1))))
        at = end_of([lo, hi])
        chars = index.to_chars(at)
        p, m, s = raw[: at[0]], raw[at[0] : at[1]], raw[at[1] :]
        spm = h[3] % 100 < spm_percent
        return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), b"".join((suf, s, pre, p, mid, m) if spm else (pre, p, suf, s, mid, m))

    fields = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}

    def run(batches):
        for b in batches:
            draws = np.stack([b.column(k).to_numpy() for k in range(2, 6)], 1)
            held, first, size = [], 0, 0

            def packed(first, held):
                cols = [pa.array([r[k] for r in held], kind) for k, kind in enumerate(fields.values())]
                cols[4] = cols[4].cast(pa.string())
                return pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), *cols], ["id", *fields])

            for lo, hi, data, off in blocks(b.column(1)):
                for i in range(lo, hi):
                    held.append(one(data[off[i - lo] : off[i - lo + 1]], draws[i]))
                    size += len(held[-1][4])
                    if size > BATCH:
                        yield packed(first, held)
                        held, first, size = [], i + 1, 0
            if held:
                yield packed(first, held)

    return run


def restore(output: Column, form: Column, names: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text an output was made of; a text with a sentinel stays plain, so the first of each is the one put in."""
    pre, suf, mid = (F.lit(s) for s in names)
    p, s, m = (F.instr(output, x) for x in names)
    cut = lambda at, name, end: F.substr(output, at + F.length(name), end - at - F.length(name))
    last = F.length(output) + 1
    psm = F.concat(cut(p, pre, s), cut(m, mid, last), cut(s, suf, m))
    spm = F.concat(cut(p, pre, m), cut(m, mid, last), cut(s, suf, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    names: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """One row per input row: the id, n (units), form, prefix_chars, middle_chars, output.

    form is "psm", "spm" or "plain" (output is the text, spans are null). The draws
    are the hash of seed and id, so reruns agree, repeated rows and equal ids get
    equal cuts, and rows without id share those of an empty one. Null and empty
    texts are plain with n = 0 and an empty output. Texts are read whole, however
    long: a long one is a block of its own, of some 20 bytes a byte at most. unit
    is "line" (with its line feed; an unended last one counts) or "char". Only id
    and text are read, so other columns cannot clash; an empty table is fine. One
    pass without a shuffle.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit must be line or char")
    if len(set(names)) < 3 or any(n == "" or n[0] in n[1:] + "".join(x[1:] for x in names) for n in names):
        raise ValueError("sentinels must differ and have their first character nowhere else")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *draws)
    out = rows.mapInArrow(_transformed(unit, fim_percent, spm_percent, names), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, spans and digests of every document; the text is rebuilt from output and form by SQL functions."""
    out = fill_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS hi,
    text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} AS plain
  FROM u
), s AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(us[1:lo], ''), '') AS p, coalesce(array_to_string(us[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(us[hi + 1:], ''), '') AS s
  FROM c
)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
