"""Words of Arrow text columns as numpy arrays: bounds, 64-bit hashes, n-gram hashes.

A word is a run of characters other than space and the control characters 9 to 13. Everything is computed over a whole
block of texts at once; a block holds about two million bytes, or one text if that is longer.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 2_000_000
U = np.uint64
NGRAM = U(0xC2B2AE3D27D4EB4F)
SEED = 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(9, 14)]] = True
def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the bounds of its rows; nulls are empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], (bounds - bounds[0]).astype(np.int64)


def span_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Spans that follow each other as numbers, equal where the bytes are equal, and the bytes of each number."""
    spans = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def joined_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and their bounds there."""
    total = np.concatenate([[0], np.cumsum(end - start)])
    return data[np.repeat(start - total[:-1], end - start) + np.arange(total[-1])], total


def hash_of(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each byte string, the same in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in distinct.to_pylist()), np.uint64, len(distinct))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same in every task.

    Up to 16 bytes the first and the last eight, which are all of them, are mixed in turn: up to eight bytes different spans of
    one length have different hashes. Longer spans, of which a text has few, go through a hash function of their own.
    """
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    missing = np.maximum(8 - size, 0).astype(np.uint64) * U(8)
    # in two steps, as a shift by all 64 bits is none
    first = eight[start] << (missing >> U(1)) << (missing - (missing >> U(1)))
    last = np.where(size > 8, eight[np.maximum(end - 8, 0)], U(0))
    out = mix(mix(first + size.astype(np.uint64) * NGRAM) ^ last)
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = data.tobytes()
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], SEED) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return out


class Words:
    """Words of a block of texts: byte bounds, row number and hash of each, in order.

    `gap` tells the bytes that no word has; with `lower` the letters A to Z count as a to z.
    """

    def __init__(self, column: pa.Array, gap: np.ndarray = IS_SPACE, lower: bool = False):
        self.data, self.bounds = string_bytes(column)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data | np.uint8(32), self.data)
        self.rows = len(column)
        solid = ~gap[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        # a text's first and last bytes bound a word whatever its neighbours in the block are
        filled = self.bounds[:-1] < self.bounds[1:]
        head, tail = self.bounds[:-1][filled], self.bounds[1:][filled] - 1
        first[head], last[tail] = solid[head], solid[tail]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, self.bounds)  # of each row's words
        self.count = np.diff(self.offsets)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self._solid = solid

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """A hash of each word, for comparing words of different blocks."""
        return span_hash(self.data, self.start, self.end)

    @functools.cached_property
    def coded(self) -> tuple[np.ndarray, pa.Array]:
        return span_codes(self.data[self._solid], np.concatenate([[0], np.cumsum(self.end - self.start)]))

    @property
    def code(self) -> np.ndarray:
        """A number of each word, equal where the bytes are equal in this block."""
        return self.coded[0]

    @property
    def distinct(self) -> pa.Array:
        """The bytes of each number."""
        return self.coded[1]


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values, by doubling: len(h) - n + 1 of them, rows not regarded."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, size, have = None, 0, h
    width, factor = 1, int(NGRAM)
    while True:
        if n & width:
            if out is None:
                out, size = have, width
            else:
                m = len(h) - size - width + 1
                out = have[:m] * U(pow(int(NGRAM), size, 1 << 64)) + out[width : width + m]
                size += width
        width *= 2
        if width > n:
            return mix(out[: len(h) - n + 1] + U(n))
        m = len(have) - width // 2
        have = have[:m] * U(factor) + have[width // 2 :]
        factor = factor * factor % (1 << 64)


def row_ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n-gram that lies in one row."""
    h = ngram_hash(words.hash, n)
    inside = words.row[: len(h)] == words.row[n - 1 :] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    return h[at], at


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `size` bytes together."""
    if not batch.num_rows:
        return
    _, bounds = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def positional(df: DataFrame) -> tuple[DataFrame, list[str], list[T.StructField]]:
    """`df` with its columns named by place, so that no name of theirs meets one of an operator; names and fields in order."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    return df.toDF(*names), names, fields


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, releasing memory after every batch that it reads and at its end."""

    def read(batches):
        for batch in batches:
            yield batch
            release()

    def lean_run(batches):
        yield from run(read(batches))
        release()

    return lean_run


def map_texts(df: DataFrame, column: str, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              size: int = BLOCK_BYTES) -> DataFrame:
    """`fn` over blocks of rows of about `size` bytes of text; it gets and returns Arrow record batches."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, column, size):
                made = fn(part)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(lean(run), schema)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values, where row i has values[offsets[i]:offsets[i+1]]; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
