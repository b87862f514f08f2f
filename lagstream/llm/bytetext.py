"""NumPy kernels over the UTF-8 bytes of whole Arrow text columns: word spans and word hashes.

Bytes of 0x80 and more are parts of letters beyond ASCII, so classes of ASCII code points can be told by
bytes. A-Z are hashed as a-z. Everything runs over pieces of at most PIECE bytes cut between words, so
memory follows the piece, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x20\x09-\x0D]
NOT_SPACE = ~_SPACE
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODE[0x41:0x5B] = _CODE[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; null reads as empty. No copy without nulls."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `most` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, none across rows, and the word index where each row begins."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(buf), bool)
    before[1:] = w[:-1]
    before[edge[:-1]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = w[1:]
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
        a, z = starts[lo], ends[hi - 1]
        p, inv = _power(int(z - a) + 1)
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_CODE[buf[a:z]] * p[:z - a], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * inv[s])
        lo = hi
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct, ascending hashes of the runs of k words of one text; of fewer words, of all as one; of none, nothing."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    m = min(n, k)
    acc = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        acc = (acc + words[j:n - m + 1 + j]) * _BASE
    return np.unique(mix(acc ^ np.uint64(m)))


def texts_words(column: pa.Array, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of each text of a column, in row order."""
    buf, offsets = column_bytes(column)
    for lo, hi in row_slices(offsets):
        part, at = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, rows = word_spans(part, at, is_word)
        hashes = hash_words(part, starts, ends)
        for r in range(hi - lo):
            yield hashes[rows[r]:rows[r + 1]]
