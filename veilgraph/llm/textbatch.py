"""Vectorised views of Arrow text batches, shared by the operators of this subpackage.

Spark partitions and shuffles the work; these helpers only turn one Arrow batch of whole
texts into numpy arrays (word boundaries, word hashes, n-gram hashes).  Batches are cut into
slices of bounded bytes, so memory follows the longest single text, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xD1B54A32D192ED03)
_BASE2_INV = np.uint64(pow(int(_BASE2), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over bytes: True outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of words split at ASCII white space.
SPACE_WORDS = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of lower-cased alphanumeric words; every byte of a non-ASCII character belongs to a word.
ALNUM_WORDS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span; equal content gives equal hashes anywhere."""
    base, inverse = (_BASE2, _BASE2_INV) if second else (_BASE, _BASE_INV)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=prefix[1:])
    inv = _powers(inverse, len(values) + 1)
    out = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Words:
    """Words of some whole documents: byte spans, owning row and 64-bit content hash."""

    data: np.ndarray
    rows: int
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1 offsets into the words
    hash: np.ndarray | None

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]; a word never crosses a text boundary."""
    n = len(data)
    inside = table[data]
    begin = inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begin[edges] |= inside[edges]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | begin[1:]
        start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    first = np.searchsorted(start, offsets)
    value = span_hash(data.astype(np.uint64) + np.uint64(1), start, end) if hashed else None
    return Words(data, len(offsets) - 1, start, end, first, value)


def gram_hash(words: Words, n: int, second: bool = False) -> np.ndarray:
    """Hash of the n words from each word on; entries that would cross a text end are garbage (see gram_ok)."""
    count = len(words.start)
    at = np.arange(max(count - n + 1, 0))
    return span_hash(words.hash, at, at + n, second)


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without nulls: a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a large_string array, offsets from 0."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes of text: (rows, bytes, offsets)."""
    column = strings(batch.column(batch.schema.get_field_index(text)))
    data, offsets = raw(column)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of values cut at offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
