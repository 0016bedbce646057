"""Word and shingle hashes of whole Arrow text columns, computed with array operations.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. A word's hash is a polynomial over random byte codes modulo 2**64,
finished by a mixer, so equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240917)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
CODES[ord("A"):ord("Z") + 1] = CODES[ord("a"):ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_STEP, _BACK = np.uint64(_P), np.uint64(pow(_P, -1, 2**64))
#: Every ASCII byte that is no letter or digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Texts are taken together up to so many bytes, which bounds the arrays in use; a longer text goes alone.
BLOCK_BYTES = 1 << 21
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        for k, base in enumerate((_STEP, _BACK)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (n + 1 numbers)."""
    solid = ~gaps[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """One 64-bit hash for each span of data."""
    up, down = _power(len(data) + 1)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(codes[data] * up[:-1], dtype=np.uint64, out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of each text's first word; offsets start at 0 of data."""
    starts, ends, at = word_spans(data, offsets)
    return span_hashes(data, starts, ends), at


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i:i + n]
    return mix(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; fewer words make one shingle, none an empty set."""
    data, offsets = utf8(column)
    for i, j in blocks(offsets):
        lo = offsets[i]
        h, at = words(data[lo:offsets[j]], offsets[i:j + 1] - lo)
        grams = shingles(h, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                yield np.unique(grams[a:b - k + 1])
            elif b > a:
                yield shingles(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
