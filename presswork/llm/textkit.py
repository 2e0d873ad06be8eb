"""NumPy work on the bytes of Arrow string columns: one pass over many texts at a time.

All hashes are polynomial prefix sums over a random value for each byte, so the hash of any stretch of
bytes takes two look-ups. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240917).integers(0, 2**64, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 21, 1 << int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the information of each value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any stretch [start, end) of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end) + (end - start).astype(np.uint64) * _M2)

    def rolling(self, width: int) -> np.ndarray:
        """A quick hash of each stretch of this width."""
        x = (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]
        return (x ^ (x >> np.uint64(32))) * _M1


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts and the last one ends. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), at


def pieces(column: pa.Array, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes: first row, last row + 1, their bytes, where each row starts in them."""
    data, at = bytes_of(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (stretch without white space), and the row it is in. Words never cross rows."""
    inner = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inner[:-1]
    start = np.flatnonzero(inner & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inner[1:]
    end = np.flatnonzero(inner & (~after | edge[1:])) + 1
    row = np.searchsorted(at, start, "right") - 1
    return start, end, row


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours; as long as x, less width - 1."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x
