"""Vectorised text primitives shared by the operators of this folder.

All of them work on the UTF-8 buffer of an Arrow string column, a few MB at a time, so the cost per
word is a few numpy passes instead of a Python call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import settle, shared_folder

U64 = np.uint64
SLICE_BYTES = 2_000_000

_rng = np.random.default_rng(20240229)
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)
FOLDED_HASH = BYTE_HASH.copy()
FOLDED_HASH[65:91] = BYTE_HASH[97:123]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither a letter nor a digit; bytes of longer characters are letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair, independent of where it lies: prefix sums of value * base**i."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts])


class Words:
    """Words of some documents: starts and ends in the buffer, and for document i the words first[i]:first[i+1]."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK):
        self.buf, self.offsets = buf, offsets
        inside = ~separators[buf]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = offsets[:-1]
        before[edges[edges < len(buf)]] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = offsets[1:] - 1
        after[lasts[lasts >= offsets[:1]]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, table: np.ndarray = BYTE_HASH) -> np.ndarray:
        return range_hash(table[self.buf], self.starts, self.ends)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Splits a batch into runs of whole documents of about `limit` bytes: (rows, UTF-8 buffer, offsets)."""
    column = batch.column(batch.schema.get_field_index(text))
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def binary(buf: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose value i is buf[offsets[i]:offsets[i+1]]."""
    data = buf if isinstance(buf, bytes) else np.ascontiguousarray(buf).tobytes()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def int_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets, np.int32)), pa.array(values, kind))


def text_key(text: str | Column = "text") -> Column:
    """64-bit hash of a text. With doc_id it identifies a document: rows equal in both are one document."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def row_schema(rows: DataFrame, more: str) -> T.StructType:
    """The column `row` of rows, of whatever type, and the columns that `more` tells of."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(more)])


__all__ = ["Words", "binary", "int_lists", "longs", "mix", "powers", "range_hash", "row_schema", "settle", "shared_folder", "slices", "text_key"]
