"""Words, hashes and byte blocks of Arrow text columns, computed with numpy inside tasks.

All helpers work on a block: the UTF-8 bytes of some consecutive rows laid end
to end, with one offset per row. Blocks are small, so the memory a task needs
does not depend on the size of its partition, only on its longest text.
"""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 19
U64 = np.uint64
ODD = 0x9E3779B97F4A7C15  # odd, so powers of it can be undone modulo 2**64
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: two rounds of multiply and shift."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(ODD))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


# [^\x20\x09-\x0D]+ and, after lower-casing A-Z, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SPACED_WORDS = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LETTER_WORDS = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse for i < n, kept between blocks."""
    if len(_powers[0]) < n:
        for k, base in enumerate((ODD, ODD_INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Block:
    """Rows first..last of a batch: their bytes and where each row starts."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray  # one more than rows

    @property
    def rows(self) -> int:
        return self.last - self.first


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if column.type == pa.large_string() else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows of at most ``limit`` bytes together; a longer row is alone."""
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def tidy(run):
    """A function of batches that gives freed memory back to the system when it ends.

    Python workers are kept for later stages, so what they hold on to adds up.
    """

    @functools.wraps(run)
    def each(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return each


def small_batches(spark: SparkSession) -> None:
    """Let tasks get texts in batches of bounded bytes: rows can be very long, and the
    session's own limit is a number of rows only. A lower limit that is set stays."""
    for name, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        size = int(re.sub(r"\D", "", now or "") or 0)
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


@dataclass
class Words:
    """Words of a block in order: byte range, row, and 64-bit hash."""

    begin: np.ndarray
    end: np.ndarray
    row_starts: np.ndarray  # index of each row's first word; one more than rows
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.row_starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_starts) - 1), self.counts())


def words(block: Block, members: np.ndarray, fold: np.ndarray | None = LOWER) -> Words:
    """Maximal runs of bytes in ``members``, lower-cased (A-Z) unless ``fold`` is None; none crosses rows."""
    n = len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(block.rows + 1, np.int64), np.zeros(0, U64))
    inside = members[block.data]
    edges = np.empty(n + 1, bool)
    edges[0] = edges[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edges[1:n])
    edges[block.starts] = True  # a row's start always cuts
    cuts = np.flatnonzero(edges)
    is_word = inside[cuts[:-1]]
    begin, end = cuts[:-1][is_word], cuts[1:][is_word]
    up, down = powers(n + 1)
    values = BYTE_VALUES[block.data if fold is None else fold[block.data]]
    values *= up[:n]
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))
    return Words(begin, end, np.searchsorted(begin, block.starts), hashes)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``size``-word shingle, by row; a shorter row, if it
    has any word, gives its whole sequence as one. Repeats within a row remain."""
    counts, h = found.counts(), found.hashes
    row_of = found.rows()
    full = max(len(h) - size + 1, 0)
    out = np.zeros(full, U64)
    for k in range(size):
        out = (out + h[k : k + full]) * U64(ODD)
    same = row_of[:full] == row_of[size - 1 : size - 1 + full] if full else np.zeros(0, bool)
    out, rows = mixed(out[same]), row_of[:full][same]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        at, left = found.row_starts[short], counts[short].astype(U64)
        extra += left
        for k in range(size - 1):
            more = counts[short] > k
            extra[more] = (extra[more] + h[at[more] + k]) * U64(ODD)
        out, rows = np.concatenate([out, mixed(extra)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def shingle_sets(block: Block, members: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, and where each row starts."""
    h, rows = shingles(words(block, members), size)
    starts = np.searchsorted(rows, np.arange(block.rows + 1))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], np.searchsorted(rows[keep], np.arange(block.rows + 1))


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each row's values; 0 for a row without any."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]
