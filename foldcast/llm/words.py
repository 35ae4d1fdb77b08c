"""Words and word hashes of Arrow text columns, computed on whole buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
# Workers live on between tasks; memory of finished batches goes back to the system at once.
pa.set_memory_pool(pa.system_memory_pool())
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20_240_517).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((int(_ODD), pow(int(_ODD), -1, 2**64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and n + 1 offsets into it; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, dtype=np.int64)
    if len(edges) == 0:
        edges = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def row_blocks(edges: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row makes a range of its own."""
    first, n = 0, len(edges) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """The words of some rows: where each starts and ends, its row, its hash, and each row's first word."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, lower: bool) -> None:
        data = _LOWER[data] if lower else data
        n = len(data)
        space = _SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[edges] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = space[:-1], space[1:]
        self.start = np.flatnonzero(~space & (before | cut[:-1]))
        self.end = np.flatnonzero(~space & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, edges)
        self.row = np.repeat(np.arange(len(edges) - 1), np.diff(self.first))
        self.hash = np.zeros(len(self.start), dtype=np.uint64)
        self.data = data
        # Prefix sums of byte codes times powers of an odd number; a word's hash does not depend on where it stands.
        at = 0
        while at < len(self.start):
            upto = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BLOCK_BYTES, "right")))
            a, b = self.start[at], self.end[upto - 1]
            power, inverse = _power_tables(int(b - a))
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[a:b]] * power, out=sums[1:])
            s, e = self.start[at:upto] - a, self.end[at:upto] - a
            self.hash[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD)
            at = upto

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and row of every window of ``size`` words inside one row."""
        n = len(self.hash) - size + 1
        if n <= 0:
            none = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=np.uint64), none, none
        inside = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        total = np.zeros(n, dtype=np.uint64)
        weight = 1
        for k in range(size):
            weight = weight * 0xD6E8FEB86659FD93 % 2**64
            total += self.hash[k : k + n] * np.uint64(weight)
        return mix(total[inside]), inside, self.row[inside]


def batch_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Words of a text column, some rows at a time."""
    data, edges = text_buffer(column)
    for first, last in row_blocks(edges):
        yield first, last, Words(data[edges[first] : edges[last]], edges[first : last + 1] - edges[first], lower)
    release_memory()


def release_memory() -> None:
    """Let the C library return freed pages, where it can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
