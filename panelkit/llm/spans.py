"""Vectorised byte-span kernels shared by the text operators.

A text column arrives in Arrow batches as one UTF-8 buffer plus offsets.  The
helpers below find words or pieces of *all* texts of a batch at once with numpy
and give every span a 64-bit hash, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: ``[\x20\x09-\x0D]``
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


_COEF = np.zeros(0, np.uint64)


def _table(n: int) -> np.ndarray:
    """Odd pseudo-random coefficients by place in a span (a fixed sequence)."""
    global _COEF
    if len(_COEF) < n:
        z = np.arange(1, max(n, 4096, 2 * len(_COEF)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _COEF = mix64(z) | np.uint64(1)
    return _COEF


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a 64-bit sum over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, last_row, bytes, offsets)`` for runs of rows of about
    ``limit`` bytes (one row at least).  Nulls read as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type)
    _, ob, db = col.buffers()
    off = np.frombuffer(ob, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()  # else a reused worker keeps its largest batch


def span_hash(data: np.ndarray, starts: np.ndarray, inside: np.ndarray | None = None,
              twice: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each span ``[starts[i], starts[i+1])``; bytes with
    ``inside`` false do not count (they must follow the counted ones).  With
    ``twice`` also a second one, of other coefficients of the bytes, as a check."""
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return (none, none) if twice else none
    a = int(starts[0])
    s = starts - a
    d = data[a:]
    lens = np.diff(np.append(s, len(d)))
    pos = np.arange(len(d), dtype=np.int32 if len(d) < 1 << 31 else np.int64)
    pos -= np.repeat(s.astype(pos.dtype), lens)
    c = _table(int(lens.max()))[pos]
    v = d.astype(np.uint64)
    v += np.uint64(1)
    if inside is not None:
        v *= inside[a:]
    c *= v
    h = mix64(np.add.reduceat(c, s))
    if not twice:
        return h
    v += np.uint64(0x51)
    c *= v
    return h, np.add.reduceat(c, s)


class Words:
    """Words of a slice of texts: runs of bytes where ``sep`` is false."""

    def __init__(self, data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
        self.data, self.off, self.n_docs = data, off, len(off) - 1
        self.inside = inside = ~sep[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < len(data)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        #: word index of each text's first word, and one past the last
        self.first = np.searchsorted(self.starts, off)

    @property
    def ends(self) -> np.ndarray:
        nxt = np.append(self.starts[1:], len(self.data))
        run = np.append(0, np.cumsum(self.inside, dtype=np.int64))
        return self.starts + run[nxt] - run[self.starts]

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.inside)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every ``k`` consecutive entries of ``h``
    (length ``len(h) - k + 1``), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = None
    done, size, block = 0, 1, h
    while True:
        if k & size:
            part = block[done: done + n]
            out = part.copy() if out is None else mix64(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += size
        size *= 2
        if size > k:
            return out
        half = size // 2
        m = len(block) - half
        block = mix64(block[:m] * np.uint64(0xA0761D6478BD642F) + block[half: half + m])


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``width`` consecutive entries."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size, y = 1, x
    while 2 * size <= width:
        y = f(y[: len(y) - size], y[size:])
        size *= 2
    return f(y[:n], y[width - size: width - size + n])


def window_ok(first: np.ndarray, n_windows: int, k: int) -> np.ndarray:
    """True for window starts whose ``k`` words lie in one text."""
    ok = np.ones(n_windows, bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1): b] = False
    return ok


def ragged(off: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices that read ``[off[i], off[i] + lens[i])`` one after another."""
    total = int(lens.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(off - (np.cumsum(lens) - lens), lens)
    return out
