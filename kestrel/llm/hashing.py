"""Vectorised word splitting and hashing over UTF-8 bytes (numpy).

Helpers that run inside Spark tasks on one bounded chunk of documents.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_COEF = _RNG.integers(0, 2**63, 512, dtype=np.uint64) * U64(2) + U64(1)
_PIECE = 1 << 20

#: ASCII white space: space and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, _PIECE + 4096)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_bounds(data: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACE):
    """Start and end byte offsets of all words; no word crosses a document end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[ends] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, in pieces of about 1 MB so that memory is bounded."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(stops, lo + _PIECE, "right")))
        hi = int(stops[j - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, stops[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * _COEF[511])
        i = j
    return out


def gram_hashes(words: np.ndarray, size: int, at: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
    """Hash of the ``size`` consecutive word hashes that start at each position
    (all positions with ``size`` words left, or those in ``at``)."""
    n = len(words) - size + 1
    if n <= 0 or (at is not None and len(at) == 0):
        return np.zeros(0, np.uint64)
    total = np.zeros(n if at is None else len(at), np.uint64)
    for j in range(size):
        part = words[j: j + n] if at is None else words[at + j]
        total += part * _COEF[(salt * 64 + j) % 500]
    return mix(total + U64(salt + 1))


def groups(ends: np.ndarray, limit: int):
    """Ranges [i, j) of whole documents with about ``limit`` bytes together."""
    i, n = 0, len(ends)
    while i < n:
        start = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield i, j
        i = j


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one byte array and the end offset of every row
    (a null is empty); rows' bytes lie back to back."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets[1:] - offsets[0]
