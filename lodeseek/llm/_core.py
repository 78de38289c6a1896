"""Vectorised text kernels that the operators of this subpackage share.

Texts stay in Arrow buffers: words, lines and n-grams are found and hashed with numpy over the bytes of a whole
slice of rows, so no Python object is made per word. A word is a maximal run of ASCII letters and digits and of
bytes of non-ASCII characters, in lower case. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodeseek.session import prepare

U = np.uint64
SLICE = 1 << 20  # bytes of text worked on at once
ROWS = 4095  # rows worked on at once

_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * SLICE:
            _powers[str(base)] = have
    return have


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def strings(column: pa.Array) -> pa.Array:
    """A large_string array in which null is the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, most: int = SLICE, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end
        at = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice, and where each row begins and ends in them."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut where rows end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(mask)]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each buf[start:end] that doesn't depend on where it stands."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(buf)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    terms = BYTE[buf]
    terms *= _power(_BASE, n + 1)[:n]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INV, n + 1)[starts] + (ends - starts).astype(U))


class Words:
    """Word hashes of a slice of rows; words of row r are hashes[first[r]:first[r + 1]]."""

    def __init__(self, texts: pa.Array):
        self.buf, self.offsets = raw(pc.utf8_lower(texts))
        self.starts, self.ends = runs(WORD[self.buf], self.offsets)
        self.hashes = hash_runs(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams in order, and the first of each row; a row of 1 to n - 1 words has one, of all its words."""
        return grams(self.hashes, self.first, n)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(have, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], have)
    short = np.repeat(counts < n, have)
    padded = np.concatenate([hashes, np.zeros(n, U)])
    out = np.zeros(len(at), U)
    last = np.repeat(first[1:], have) if short.any() else None
    for k in range(n):
        term = padded[at + k]
        if last is not None:
            term[at + k >= last] = 0
        out += term * U((2 * k + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1) | 1)
    return mix(out + U(n)), begin


def each(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(work, schema)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts."""
    for batch in batches:
        texts = strings(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(texts):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """The ids of a batch without nulls (callers filter them)."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def table(schema: pa.Schema | None = None, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def pack(values: np.ndarray, begin: np.ndarray, width: int) -> pa.Array:
    """Binary array of rows values[begin[r]:begin[r + 1]] of items of ``width`` bytes."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * width).astype(np.int32)), pa.py_buffer(data)])


def known(df: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator reads, without rows that lack the first of them."""
    return df.select(*names).where(df[names[0]].isNotNull())
