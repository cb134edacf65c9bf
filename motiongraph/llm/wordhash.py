"""Array kernels over Arrow text columns: words, word hashes, shingle hashes.

They run inside Spark tasks on one Arrow batch at a time. Texts are looked at
as UTF-8 bytes in blocks of BLOCK bytes, so a batch of long texts needs little
more memory than its own bytes; a single longer text forms a block of its own,
whose arrays (some 50 bytes a byte) go when it is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)

#: Words of more bytes have a cryptographic digest.
LONG_WORD = 256
#: Bytes of text that are looked at together.
BLOCK = 1 << 19

#: Byte folding of A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def not_blank() -> np.ndarray:
    """Word bytes: all but ASCII white space."""
    lut = np.ones(256, bool)
    lut[[9, 10, 11, 12, 13, 32]] = False
    return lut


def alphanumeric() -> np.ndarray:
    """Word bytes after lower-casing: digits, letters and all bytes beyond ASCII."""
    lut = np.zeros(256, bool)
    lut[48:58] = lut[65:91] = lut[97:123] = lut[128:] = True
    return lut


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit words in which every bit depends on all."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; those of one block are kept, those of a longer text are not."""

    def run_of(base: int, m: int) -> np.ndarray:
        step = np.full(m, base, np.uint64)
        step[0] = 1
        return np.cumprod(step)

    inverse = pow(_BASE, -1, 1 << 64)
    if n > BLOCK:
        return run_of(_BASE, n), run_of(inverse, n)
    if not _powers:
        _powers.update(up=run_of(_BASE, BLOCK), down=run_of(inverse, BLOCK))
    return _powers["up"][:n], _powers["down"][:n]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    w = np.zeros(n + 2, bool)
    w[1:-1] = lut[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(w[1:-1] & (~w[:-2] | edge[:-1]))
    ends = np.flatnonzero(w[1:-1] & (~w[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word.

    Sums of powers modulo 2**64 cannot tell some words of over a thousand letters
    apart (Thue-Morse words), whatever the base; words that long are digested.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up, out=total[1:])
    found = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = LOWER[data[starts[i] : ends[i]]].tobytes()
        found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return found


def grams(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 have none."""
    m = len(wh) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h += wh[j : j + m] * _STEP[j]
    return mix(h)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct k-word shingle hashes); fewer than k words count as one shingle."""
    lut = not_blank()
    for lo, hi, data, off in blocks(column):
        starts, ends, bound = words(data, off, lut)
        wh = word_hashes(data, starts, ends)
        sh = grams(wh, k)
        for i in range(hi - lo):
            a, b = int(bound[i]), int(bound[i + 1])
            if b - a >= k:
                s = np.sort(sh[a : b - k + 1])
                yield lo + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield lo + i, grams(wh[a:b], b - a)
            else:
                yield lo + i, np.zeros(0, np.uint64)
