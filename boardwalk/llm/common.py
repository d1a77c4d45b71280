"""What several operators of this subpackage share: bytes of Arrow texts, hashes of words and lines,
and how a query gets its table.

Hashes are polynomials over a table of random 64-bit values, taken modulo 2**64 and mixed; a span's
hash comes from two entries of one running sum, so whole batches are hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.session import tune

_RANDOM = np.random.default_rng(20240229)
_TABLE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 2**64)
# white space of a word pattern [^\x20\x09-\x0D]+ as a table over bytes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BATCH_BYTES = 1 << 19

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, size: int) -> np.ndarray:
    have = _powers[name]
    while len(have) < size:
        step = np.uint64(pow(base, len(have), 2**64))
        have = _powers[name] = np.concatenate([have, have * step])
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some texts of an Arrow column as one byte array with a start and an end for each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def spans(self, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are not ``blank``, cut at text borders."""
        size = len(self.data)
        solid = np.zeros(size + 2, bool)
        solid[1:-1] = ~blank[self.data]
        border = np.zeros(size + 1, bool)
        border[self.offsets] = True
        begins = solid[1:] & (~solid[:-1] | border)
        ends = solid[:-1] & (~solid[1:] | border)
        return np.flatnonzero(begins[:size]), np.flatnonzero(ends)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each text the place of its first word (one more at the end)."""
        starts, ends = self.spans(_SPACE)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts between line feeds, empty ones included, as for words."""
        feeds = np.flatnonzero(self.data == 10)
        texts = np.searchsorted(self.offsets, feeds, side="right") - 1
        counts = np.bincount(texts, minlength=len(self.offsets) - 1) + 1
        first = np.concatenate([[0], np.cumsum(counts)])
        starts = np.empty(first[-1], np.int64)
        ends = np.empty(first[-1], np.int64)
        starts[first[:-1]] = self.offsets[:-1]
        ends[first[1:] - 1] = self.offsets[1:]
        at = np.arange(len(feeds)) + texts
        ends[at] = feeds
        starts[at + 1] = feeds + 1
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes: equal bytes, equal hash, wherever they stand."""
        size = len(self.data)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * _power("up", _BASE, size), out=total[1:])
        inverse = _power("down", _INVERSE, size + 1)
        length = (ends - starts).astype(np.uint64)
        return mix((total[ends] - total[starts]) * inverse[starts] + length)


def text_parts(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut an Arrow text column into runs of rows of about ``limit`` bytes; a text is never cut.

    Null counts as the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        low, high = offsets[start], offsets[stop]
        yield start, stop, Texts(data[low:high], offsets[start:stop + 1] - low)
        start = stop


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` neighbours in a row, in order."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(width):
        out += values[k:k + count] * np.uint64(pow(_BASE, k + 1, 2**64))
    return mix(out)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table, whatever else it holds, in a session with bounded Arrow batches."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that others cannot clash with what it adds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def wide_enough(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer parts than the cluster has cores, so that costly work per row
    is not held in a few tasks; a scan with enough parts is left alone."""
    context = df.sparkSession.sparkContext
    cores = context.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def list_of_long(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), as_long(values))
