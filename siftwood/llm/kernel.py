"""Vectorised word and window hashing over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_PINV = pow(_P, -1, 1 << 64)
_PIECE = 1 << 21
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            steps = np.full((2, n), [[_P], [_PINV]], np.uint64)
            steps[:, 0] = 1
            _pow, _inv = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def doc_slices(offs: np.ndarray, limit: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word of each document and the total); words end at documents' ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, from prefix sums of a polynomial; long buffers go in pieces cut between words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        piece = data[base : int(ends[j - 1])]
        pw, inv = _powers(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * pw[: len(piece)], dtype=np.uint64)])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(w) - k + 1, np.uint64)
        m = 0x9E3779B97F4A7C15
        for i in range(k):
            total += w[i : len(w) - k + 1 + i] * np.uint64(m)
            m = m * 0xD1342543DE82EF95 % (1 << 64)
        return mix(total)


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes by prefix sums; for large k."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.empty(len(w) - k + 1, np.uint64)
        step = _PIECE
        for a in range(0, len(out), step):
            part = w[a : a + step + k - 1]
            pw, inv = _powers(len(part) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * pw[: len(part)], dtype=np.uint64)])
            n = len(part) - k + 1
            out[a : a + n] = mix((sums[k:] - sums[:n]) * inv[:n])
        return out


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
