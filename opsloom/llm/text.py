"""Word tools shared by the operators: column expressions and a numpy kernel.

A word is a maximal run of bytes other than space and 0x09-0x0D. The kernel
works on the bytes of a whole Arrow batch at once, so that no Python object
is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
BASE = np.uint64(int(_rng.integers(1, 2**62)) * 4 + 3)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 0x80 but letters and digits: words without punctuation.
IS_MARK = np.ones(256, bool)
IS_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.array_remove(parts, "")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, which: str = "base") -> np.ndarray:
    """BASE**i (or its inverse) for i <= n, modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        one = BASE if which == "base" else BASE_INV
        p = np.full(size, one, np.uint64)
        p[0] = 1
        have = _POWERS[which] = np.cumprod(p, dtype=np.uint64)
        if size > 1 << 21:
            _POWERS.pop(which)  # do not keep a table sized by one huge text
    return have


def prefix_hashes(buf: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P with P[e] - P[s] the weighted sum of buf[s:e]; see ``span_hashes``."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    if len(buf):
        np.cumsum(code[buf] * powers(len(buf))[: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def prefix_of(values: np.ndarray) -> np.ndarray:
    """As ``prefix_hashes``, for a sequence of 64-bit values such as word hashes."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), independent of its place."""
    inv = powers(len(prefix), "inverse")
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer value stands alone."""
    data, offsets = utf8_parts(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 values)."""
    word = ~separator[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row (len - n + 1 values)."""
    k = len(word_hash) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(k, np.uint64)
    for i in range(n):
        total = (total ^ word_hash[i : i + k]) * np.uint64(0x9DDFEA08EB382D69) + np.uint64(i + 1)
        total ^= total >> np.uint64(29)
    return mix(total)
