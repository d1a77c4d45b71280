"""Line dedup by content-defined chunks of lines.

Lines with words count, blank ones lie between them. A rolling hash over the hashes of ``ROLLED``
neighbouring lines gives each line a value, and a line is a boundary if its value is the least of
some window of ``WINDOW`` words (the end of a text is one as well). A chunk runs from a boundary to
the first later one that leaves it ``MIN_WORDS`` words or more; where that is one line of at most
``LONE_WORDS`` words, the shortest chunk of several lines from there counts too. Boundaries depend
on the lines around them alone, so they shift with a passage: any passage of over 50 words holds a
whole chunk that all its copies share (windows that hang over its ends reach ``WINDOW - 1`` words and
a line into it, and between boundaries lie fewer than ``WINDOW`` words or one line).

A chunk found in more than one document is compared, byte by byte, with its first occurrence (in the
order of doc_id and line). It then grows line by line, on both sides, as long as digests of 128 bits
of the next lines agree, over lines that begin within ``REACH`` words; that covers what lies between
the last shared chunk and the end of a passage. Runs of several lines, and single lines of more than
``LONE_WORDS`` words, are removed, with the blank lines inside them. The first occurrence always stays. A chunk is compared
with its first occurrence only: where that stands in another text than the rest of a passage, the passage's other chunks still go, but up
to ``MIN_WORDS + WINDOW`` words and a line at its ends may stay.

No text is shuffled to find repeats: chunk hashes are counted, the repeated ones set bits of a
filter of fixed size, and a second pass emits the content of the chunks that pass the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import _BASE, _INVERSE, Texts, _power, as_long, mix, text_parts
from boardwalk.session import stored

MIN_WORDS = 20
LONE_WORDS = 50  # a single line counts if it has more words
WINDOW = 7
ROLLED = 2
REACH = 64
FILTER_BITS = 1 << 26
_DIGEST = 16  # bytes


def boundaries(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which lines have the least value in some window of ``WINDOW`` words that holds their first.

    ``place`` is the number of words before a line; of equal values the last one is the least.
    The nearest smaller values on both sides must be more than ``WINDOW`` words apart.
    """
    size = len(values)
    left, right = place - WINDOW, place + WINDOW  # as far as it matters
    for step in range(min(WINDOW, size - 1), 0, -1):
        smaller = values[:-step] <= values[step:]
        left[step:] = np.where(smaller, np.maximum(place[:-step], place[step:] - WINDOW), left[step:])
        smaller = values[step:] < values[:-step]
        right[:-step] = np.where(smaller, np.minimum(place[step:], place[:-step] + WINDOW), right[:-step])
    return right - left > WINDOW


def chunks(texts: Texts) -> dict[str, np.ndarray]:
    """Chunks of all texts: number of the text, place of the first line and of the line after the
    last one among all lines with words, and hash; next to them those lines: from and to which byte,
    number in their text, words before them, and the first line of each text."""
    line_from, line_to, first = texts.lines()
    starts, _, _ = texts.words()
    words = np.searchsorted(starts, line_to) - np.searchsorted(starts, line_from)
    filled = np.flatnonzero(words)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))[filled]
    number = filled - first[text_of]
    line_from, line_to = line_from[filled], line_to[filled]
    word_sum = np.concatenate([[0], np.cumsum(words[filled])])
    lines = texts.hashes(line_from, line_to)
    border = np.searchsorted(text_of, np.arange(len(first)))
    size = len(lines)
    hash_sum = np.zeros(size + 1, np.uint64)
    np.cumsum(lines * _power("up", _BASE, size), out=hash_sum[1:])
    inverse = _power("down", _INVERSE, size + 1)

    def rolled(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((hash_sum[stop] - hash_sum[start]) * inverse[start] + (stop - start).astype(np.uint64))

    every = np.arange(size)
    value = rolled(every, np.minimum(every + ROLLED, border[text_of + 1]))
    # texts lie further apart than a window
    cut = np.concatenate([boundaries(value, word_sum[:-1] + text_of * (WINDOW + 1)), [True]])
    cut[border] = True
    at = np.flatnonzero(cut)
    begin = at[:-1]
    ends = border[text_of[begin] + 1]
    until = at[np.minimum(np.searchsorted(word_sum[at], word_sum[begin] + MIN_WORDS), len(at) - 1)]
    # the next boundary, for a line that does not count alone
    alone = (until - begin == 1) & (word_sum[until] - word_sum[begin] <= LONE_WORDS)
    further = at[np.minimum(np.searchsorted(at, until[alone], side="right"), len(at) - 1)]
    start = np.concatenate([begin, begin[alone]])
    stop = np.concatenate([until, further])
    ends = np.concatenate([ends, ends[alone]])
    fits = (stop <= ends) & (stop > start) & (word_sum[stop] - word_sum[start] >= MIN_WORDS)
    fits[len(begin):] &= stop[len(begin):] > until[alone]
    start, stop = start[fits], stop[fits]
    return {"text": text_of[start], "start": start, "stop": stop, "hash": rolled(start, stop), "number": number,
            "line_from": line_from, "line_to": line_to, "words": word_sum, "border": border}


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, _, texts in text_parts(batch.column(1)):
            own = chunks(texts)
            ids = batch.column(0).take(pa.array(own["text"] + begin))
            line = own["number"][own["start"]]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(line.astype(np.int32)), as_long(own["hash"])], ["doc_id", "line", "hash"])


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A bit set of ``FILTER_BITS`` bits with the bit of every hash: 8 MB at most reach the driver."""
    place = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    words = (hashes.select(F.shiftright(place, 6).cast("int").alias("word"),
                           F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_BITS}) % 64 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.word.to_numpy()] = words.bits.to_numpy()
    return out.view(np.uint64)


_FOUND = ("doc_id long, row_key long, line int, stop int, n_words int, n_lines int, hash long, content binary, "
          "before binary, before_at array<int>, after binary, after_at array<int>")


def _found_chunk(texts: Texts, own: dict[str, np.ndarray], start: int, stop: int, text: int) -> tuple:
    """Lines, counts and bytes of a chunk, and digests and numbers of the lines on both sides."""
    words, number = own["words"], own["number"]
    content = [texts.data[own["line_from"][k]:own["line_to"][k]].tobytes() for k in range(start, stop)]
    low = max(int(np.searchsorted(words, words[start] - REACH, side="right")) - 1, int(own["border"][text]))
    high = min(int(np.searchsorted(words, words[stop] + REACH)), int(own["border"][text + 1]))
    before, after = range(start - 1, low - 1, -1), range(stop, high)

    def digests(places: range) -> bytes:
        return b"".join([hashlib.blake2b(texts.data[own["line_from"][k]:own["line_to"][k]].tobytes(),
                                         digest_size=_DIGEST).digest() for k in places])

    return (int(number[start]), int(number[stop - 1]) + 1, int(words[stop] - words[start]), stop - start,
            b"\n".join(content), digests(before), [int(number[k]) for k in before],
            digests(after), [int(number[k]) + 1 for k in after])


def _contents(bits: np.ndarray):
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
             pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, texts in text_parts(batch.column(1)):
                own = chunks(texts)
                at = own["hash"].view(np.int64) % FILTER_BITS
                hit = np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                made = [_found_chunk(texts, own, *place) for place in zip(
                    own["start"][hit].tolist(), own["stop"][hit].tolist(), own["text"][hit].tolist())]
                rows = pa.array(own["text"][hit] + begin)
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), *columns[:4], as_long(own["hash"][hit]),
                     *columns[4:]],
                    ["doc_id", "row_key", "line", "stop", "n_words", "n_lines", "hash", "content",
                     "before", "before_at", "after", "after_at"])

    return run


def _agreeing(one: str, other: str) -> Column:
    """How many digests agree from the start of two rows of them."""
    count = f"cast(least(octet_length({one}), octet_length({other})) div {_DIGEST} as int)"
    part = f"substring({{}}, {_DIGEST} * n - {_DIGEST - 1}, {_DIGEST})"
    unlike = f"filter(sequence(1, {count}), n -> {part.format(one)} <> {part.format(other)})"
    return F.expr(f"if({count} = 0, 0, coalesce(array_min({unlike}) - 1, {count}))")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """``(doc_id, row_key, spans)``: lines from ``first`` to before ``stop`` that repeat other
    documents, for each document that has any. ``row_key`` is the hash of its text."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                            F.xxhash64("text").alias("row_key")).filter("doc_id IS NOT NULL")
    seen = slim.mapInArrow(_hashes, "doc_id long, line int, hash long")
    first = stored(seen.groupBy("hash").agg(
        F.min(F.struct("doc_id", "line")).alias("first"), F.max("doc_id").alias("other"))
        .filter("first.doc_id <> other")
        .select("hash", F.col("first.doc_id").alias("keeper"), F.col("first.line").alias("keeper_line")))
    found = stored(slim.mapInArrow(_contents(_filter_of(first)), _FOUND))
    # only hashes and places meet here; content is read again for what is compared
    keepers = (found.join(first, "hash").filter("doc_id = keeper AND line = keeper_line")
               .groupBy("hash").agg(F.min(F.struct("doc_id", "row_key", "content", "before", "after")).alias("k")))
    others = (found.join(keepers, "hash").filter("doc_id <> k.doc_id").filter("content = k.content")
              .withColumn("up", _agreeing("before", "k.before")).withColumn("down", _agreeing("after", "k.after"))
              .filter((F.col("n_lines") + F.col("up") + F.col("down") > 1) | (F.col("n_words") > LONE_WORDS))
              .select("doc_id", "row_key", F.expr("if(up = 0, line, before_at[up - 1])").alias("first"),
                      F.expr("if(down = 0, stop, after_at[down - 1])").alias("stop")))
    return others.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))


def _passing(bits: np.ndarray, wanted: bool):
    """Rows whose last column, a hash, has its bit set, or has it not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy() % FILTER_BITS
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) == 1
            yield batch.filter(pa.array(hit == wanted))

    return run


def _cut(width: int, text_at: int, names: list[str]):
    """Of ``width`` columns and spans: those columns with the text cut, and two counts of lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at).to_pylist(), batch.column(width).to_pylist()
            total, gone = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for k, own in enumerate(spans):
                if texts[k] is None:
                    continue
                total[k] = texts[k].count("\n") + 1
                if own is None:
                    continue
                lines = texts[k].split("\n")
                keep = np.ones(len(lines), bool)
                for span in own:
                    keep[span["first"]:span["stop"]] = False
                gone[k] = len(lines) - int(keep.sum())
                texts[k] = "\n".join([line for line, stays in zip(lines, keep.tolist()) if stays])
            columns = [*batch.columns[:width], pa.array(total), pa.array(gone)]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _counted(documents: DataFrame) -> DataFrame:
    """Columns ``c0, c1, ...`` of ``documents`` in order, the text cut, with ``n_lines, n_removed``."""
    names = documents.columns
    own = [f"c{k}" for k in range(len(names))]
    doc_id, text = own[names.index("doc_id")], own[names.index("text")]
    spans = stored(repeated_spans(documents))
    # texts that keep all their lines are not shuffled: a filter of fixed size tells most of them
    bits = _filter_of(spans.select(F.xxhash64("doc_id", "row_key").alias("hash")))
    keyed = documents.toDF(*own).withColumn("hash", F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(text)))
    touched = keyed.mapInArrow(_passing(bits, True), keyed.schema)
    untouched = keyed.mapInArrow(_passing(bits, False), keyed.schema)
    same = (F.col(doc_id) == F.col("doc_id")) & (F.xxhash64(text) == F.col("row_key"))
    kind = spans.schema["spans"].dataType
    rows = touched.join(spans, same, "left").select(*own, "spans").unionByName(
        untouched.select(*own, F.lit(None).cast(kind).alias("spans")))
    fields = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(own, documents.schema))
    return rows.mapInArrow(_cut(len(own), names.index("text"), [*own, "n_lines", "n_removed"]),
                           f"{fields}, n_lines long, n_removed long")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """All rows and columns of ``documents``, ``text`` without repeated passages, and the counts
    ``_n_lines`` (before) and ``_n_removed`` as the last two columns, whatever the others are called.

    Null texts stay null and count no line; a text may become empty. Repeats within one document
    stay. Rows with equal id and text count as one document and are cut alike; rows with a null id
    are neither cut nor compared. An empty table gives an empty one. Long texts are read whole.
    """
    return _counted(documents).toDF(*documents.columns, "_n_lines", "_n_removed")


def without_repeats(documents: DataFrame, least_words: int = 0) -> DataFrame:
    """``documents`` with its own columns; ``n_chars``, where there is one, follows the new text.

    Rows that lost lines and have fewer than ``least_words`` words left go; all others stay.
    """
    names = documents.columns
    cut = _counted(documents)
    text = f"c{names.index('text')}"
    if least_words:
        left = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
        cut = cut.filter((F.col("n_removed") == 0) | (left >= least_words))
    if "n_chars" in names:
        of = f"c{names.index('n_chars')}"
        cut = cut.withColumn(of, F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(of))
                             .cast(documents.schema["n_chars"].dataType))
    return cut.drop("n_lines", "n_removed").toDF(*names)
