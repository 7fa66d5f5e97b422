"""Words and their hashes from Arrow text columns, in numpy, without a Python step per word.

Hashes are polynomials over the bytes modulo 2**64, taken from one running sum, then mixed. They depend
on the content alone, so every worker gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)
#: Fixed by the seed, hence equal on every machine.
BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _ROOT, U), np.full(size, _ROOT_INVERSE, U)
        up[0] = down[0] = 1
        _powers.clear()  # one size at a time
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span of ``data``."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * _power(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * _power(len(c))[1][start])


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of whole texts of ``most`` bytes, or one longer text. Null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, b"" if pa.types.is_binary(column.type) else "")
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    width = np.int64 if kind == pa.large_binary() else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (and one past the last)."""
    n = len(data)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[1:-1]
        at = at[(at > 0) & (at < n)]
        first[at] = inside[at]
        last[at - 1] = inside[at - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the words' index by text."""
    starts, ends, at = words(data, offsets)
    return span_hash(sums(LOWER[data]), starts, ends), at


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every ``size`` consecutive words, in order; a text of fewer words, but not none, is one shingle."""
    h, at = word_hashes(data, offsets)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    parts = []
    if len(h) >= size:
        keep = text[: len(h) - size + 1] == text[size - 1 :]
        value = np.zeros(len(keep), U)
        for j in range(size):
            value = value * U(_ROOT) + h[j : len(h) - size + 1 + j]
        parts.append((text[: len(keep)][keep], mix(value[keep] + U(size))))
    for k in range(1, size):
        rows = np.flatnonzero(n == k)
        value = np.zeros(len(rows), U)
        for j in range(k):
            value = value * U(_ROOT) + h[at[rows] + j]
        parts.append((rows, mix(value + U(k))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def distinct_sets(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their index by text."""
    order = np.argsort(value)  # equal values are the same, so only the texts need a stable sort, a radix sort if few
    text, value = text[order], value[order]
    order = np.argsort(text.astype(np.uint16) if n <= 1 << 16 else text, kind="stable")
    text, value = text[order], value[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[keep], np.searchsorted(text[keep], np.arange(n + 1))
