"""Short runs of bytes of texts, for the Python stage of ``operators.substrings``.

A run of up to ``RUN`` bytes is one number, its bytes in order from the low end. Sets of runs are bits
of a fixed size: a run outside the set may pass, one inside always does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN = 8
# bytes of text that are looked at in one go, so that eight bytes for each stay in a core's cache
BLOCK = 1 << 15
# up to this power of two a set is spread to a byte for each run, which is looked up in one step
SPREAD_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, filled up behind the last, and where each begins and ends."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.zeros(offsets[-1] - offsets[0] + RUN, np.uint8)
    if held is not None:
        data[:-RUN] = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _runs(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The run of full length at each place."""
    return np.array(np.ndarray(len(data) - RUN, "<u8", data, strides=(1,))[start:stop])


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def _slots(runs: np.ndarray, bits: int) -> np.ndarray:
    return (runs * _MIX) >> np.uint64(64 - bits)


def _lists(rows: np.ndarray, runs: np.ndarray, count: int) -> pa.ListArray:
    """The different runs of each row."""
    order = np.lexsort((runs, rows))
    rows, runs = rows[order], runs[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (runs[1:] != runs[:-1])
    rows, runs = rows[fresh], runs[fresh]
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.view(np.int64)))


def own_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Add the runs a pattern may be known by; a short pattern is its own run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _bytes(batch.column(column))
        length = np.diff(offsets)
        number = np.where(length > RUN, length - RUN + 1, 1)
        rows = np.repeat(np.arange(len(length)), number)
        at = offsets[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number)
        runs = _runs(np.concatenate([data, np.zeros(RUN, np.uint8)]), 0, len(data))[at]
        short = length[rows] < RUN
        runs[short] &= np.array([_mask(s) for s in range(RUN)])[length[rows][short]]
        yield pa.RecordBatch.from_arrays([*batch.columns, _lists(rows, runs, len(length))], [*batch.schema.names, "_grams"])


def set_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A task's runs (lists of them in the only column) as words of a set that have a bit."""
    words = np.zeros(max(1 << bits >> 6, 1), np.uint64)
    for batch in batches:
        slots = _slots(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), bits)
        np.bitwise_or.at(words, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
    seen = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(words[seen].view(np.int64))], ["word", "held"])


def held_runs(
    batches: Iterator[pa.RecordBatch], column: str, words: np.ndarray, bits: int, sizes: list[int]
) -> Iterator[pa.RecordBatch]:
    """Texts that hold runs of a set, with these."""
    spread = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little").view(bool) if bits <= SPREAD_BITS else None
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _bytes(batch.column(column))
        rows, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for start in range(0, len(data) - RUN, BLOCK):
            whole = _runs(data, start, start + BLOCK)
            for size in sizes:
                short = whole & _mask(size) if size < RUN else whole
                slots = _slots(short, bits)
                if spread is None:
                    in_set = (words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)
                else:
                    in_set = spread.take(slots.view(np.int64))
                at = np.flatnonzero(in_set)
                of = np.searchsorted(offsets, at + start, side="right") - 1
                inside = at + start + size <= offsets[of + 1]
                rows.append(of[inside])
                runs.append(short[at[inside]])
        rows, runs = np.concatenate(rows), np.concatenate(runs)
        found = pa.RecordBatch.from_arrays(
            [*batch.columns, _lists(rows, runs, batch.num_rows)], [*batch.schema.names, "_grams"])
        yield found.filter(pa.array(np.bincount(rows, minlength=batch.num_rows) > 0))
