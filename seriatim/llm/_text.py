"""Vectorised views of Arrow text columns: bytes, words, windows and their 64-bit hashes.

Everything here works on one bounded slice of an Arrow batch at a time (``slices``), so memory inside a
task follows ``SLICE_BYTES`` or the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: For work that sums up each slice before it goes on.
COUNT_BYTES = 1 << 20
#: White space as the word contract has it: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, in two independent families; FOLDED gives A-Z the values of a-z.
BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = BYTE.copy()
FOLDED[:, 0x41:0x5B] = BYTE[:, 0x61:0x7B]
BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASE)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, family: int = 0, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**n modulo 2**64 (or of its inverse)."""
    got = _powers.get((family, inverse))
    if got is None or len(got) <= n:
        size = 1 << max(12, int(n).bit_length())
        got = np.full(size + 1, (INVERSE if inverse else BASE)[family], np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[family, inverse] = got
    return got[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def hashed(text: str, table: np.ndarray = BYTE, family: int = 0) -> int:
    """The hash that ``Prefix.spans`` gives the same bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(Prefix(raw, table, family).spans(np.array([0]), np.array([len(raw)]))[0])


class Prefix:
    """Prefix sums of a polynomial hash, from which the hash of any span of ``raw`` follows."""

    def __init__(self, raw: np.ndarray, table: np.ndarray = BYTE, family: int = 0):
        self.family, self.n = family, len(raw)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(table[family][raw] * powers(self.n, family)[: self.n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * powers(self.n, self.family, True)[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` bytes, by start."""
        n = max(0, self.n - width + 1)
        h = (self.sums[width : width + n] - self.sums[:n]) * powers(self.n, self.family, True)[:n]
        return mixed(h + np.uint64((width * 0x9FB21C651E98DF25) % (1 << 64)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into row ranges of about ``limit`` bytes of text each; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of each text of a slice: their byte spans, text number and hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = BYTE):
        self.raw, self.offsets = raw, offsets
        solid = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        first, last = solid.copy(), solid.copy()
        if len(raw):
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)  # number of the first word of each text, and one more
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = Prefix(raw, table).spans(self.start, self.end)


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows first[i] .. first[i+1]-1, also where that range is empty."""
    total = np.zeros((len(first) - 1, *values.shape[1:]), np.result_type(values, np.float64) if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        total[some] = np.add.reduceat(values, first[some], axis=0)
    return total
