"""Numpy views of Arrow text columns: words, their hashes, and documents in bounded pieces.

Everything here works on UTF-8 bytes of many documents at once, so Python runs a few dozen numpy calls for
each chunk of about a megabyte and no statement for each word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.values = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64)]))
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of any slice of a byte array in constant time each (polynomial modulo 2**64 over random byte values)."""

    def __init__(self, data: np.ndarray):
        self._fill(_BYTE[data])

    @classmethod
    def over(cls, hashes: np.ndarray) -> Rolling:
        """The same for an array of hashes instead of bytes."""
        made = cls.__new__(cls)
        made._fill(hashes)
        return made

    def _fill(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * _UP.upto(self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _DOWN.upto(self.n + 1)[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """One hash for each slice of this width."""
        if self.n < width:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * _DOWN.upto(self.n - width + 1))


def runs_hash(items: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _U(_BASE) + items[k : k + n]
    return mix(out)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each document's offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(a, b - a)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not space, tab, line feed, vertical tab, form feed or carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, lower-case letters and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``inside`` bytes of a document, and each document's offsets in those."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    held = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = held.copy()
    start[1:] &= ~held[:-1] | edge[1:-1]
    end = held.copy()
    end[:-1] &= ~held[1:] | edge[1:-1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, off)


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each led by as many underscores as it takes to differ from all ``taken`` ones in any case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out
