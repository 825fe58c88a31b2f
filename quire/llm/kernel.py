"""Vectorised access to the text of Arrow batches.

Words are runs of bytes other than space and the control characters 9 to 13.
All of those are single bytes in UTF-8, so words can be found in the encoded
text, without decoding it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are tokenised at once; a longer text is taken alone.
PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Returns freed memory to the system, as a worker that waits for its next task needs none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each number of bytes up to eight, the mask of that many low bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string array."""
    column = strings(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows that hold about `limit` bytes."""
    at, data = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, at[row : end + 1] - at[row], data[at[row] : at[end]]
        row = end


class Words:
    """The words of some texts: byte spans, and hashes if asked for."""

    def __init__(self, at: np.ndarray, data: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data = _LOWER[data] if lower else data
        word = ~_SPACE[self.data]
        n = len(word)
        edge = np.zeros(n + 1, bool)
        edge[at[at <= n]] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~word[:-1]
            after[-1], after[:-1] = True, ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:n]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        #: Words of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.start, at)
        self.word = word
        if hashed:
            self.hash = hashes(self.data, self.start, self.end)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each span: the sum of its blocks of eight bytes, each mixed with its place, mixed with the length.

    Blocks are mixed one by one, so no two words of a language of few letters collide by construction, as they may
    under a hash that is linear in the bytes.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    raw = np.ascontiguousarray(windows[np.repeat(start, blocks) + 8 * place]).view("<u8").reshape(-1)
    raw &= _LOW[np.minimum(np.repeat(size, blocks) - 8 * place, 8)]
    total = np.add.reduceat(mix(raw + (place.astype(np.uint64) + np.uint64(1)) * _STEP), first)
    return mix(total + size.astype(np.uint64) * _STEP)


def chained(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, ... `size` words from each word on (short at the end)."""
    out = [mix(words + np.uint64(1))]
    for k in range(1, size):
        prior = out[-1][: max(0, len(words) - k)]
        out.append(mix(prior * np.uint64(0x2545F4914F6CDD1D) + words[k : k + len(prior)] + np.uint64(k + 1)))
    return out


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes: `size` words each, or the whole of a shorter text."""
    runs = chained(words.hash, size)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[-1][a : b - size + 1])
        elif b > a:
            yield runs[b - a - 1][a : a + 1]
        else:
            yield np.zeros(0, np.uint64)
