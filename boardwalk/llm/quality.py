"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over all trusted documents (label 1), one
over all documents. A document's score is the mean of
log(p_trusted / p_raw) over its n-grams. The threshold is the cut between the labelled classes that
keeps ``KEEP_SHARE`` of the trusted rows or more and rejects most of the others; every document is
held against it.

Both tables have ``BUCKETS`` entries whatever the corpus, so they may go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm import labelled
from boardwalk.llm.common import _SPACE, Texts, mix, narrow, text_parts, windows
from boardwalk.session import stored

GRAM = 4
BUCKETS = 1 << 16
WINDOW = 5
KEEP_SHARE = 0.995
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of ``_BASE_FIELDS`` for each text."""
    data, count = texts.data, len(texts.offsets) - 1
    starts, ends, first = texts.words()
    blank = _SPACE[data]
    whole = (data & 0xC0) != 0x80
    line_from, line_to, line_first = texts.lines()
    worded = np.searchsorted(starts, line_from) < np.searchsorted(starts, line_to)
    of_line = np.repeat(np.arange(count), np.diff(line_first))[worded]
    keys = mix(texts.hashes(line_from[worded], line_to[worded]) + of_line.astype(np.uint64))
    _, kept = np.unique(keys, return_index=True)
    fresh = np.ones(len(keys), bool)
    fresh[kept] = False
    return {
        "n_words": np.diff(first), "word_chars": _per_text(~blank & whole, texts.offsets),
        "n_symbols": _per_text(_SYMBOL[data], texts.offsets),
        "n_dup_lines": np.bincount(of_line[fresh], minlength=count),
        "n_repeat_words": _repeat_words(texts.hashes(starts, ends), first),
    }


def _repeat_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in windows that their text holds twice or more."""
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = windows(words, WINDOW)
    if not len(grams):
        return np.zeros(len(first) - 1, np.int64)
    inside = np.flatnonzero(texts[:len(grams)] == texts[WINDOW - 1:])
    keys = mix(grams[inside] + texts[inside].astype(np.uint64))
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = inside[counts[which] > 1]
    edge = np.zeros(len(words) + WINDOW, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.cumsum(edge)[:len(words)] > 0
    return np.bincount(texts[covered], minlength=len(first) - 1)


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and the text it belongs to; none spans two texts."""
    data = texts.data.astype(np.uint32)
    count = len(data) - GRAM + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.zeros(count, np.uint32)
    for k in range(GRAM):
        packed = (packed << np.uint32(8)) | data[k:k + count]
    bucket = (packed * np.uint32(2654435761)) >> np.uint32(16)
    of = np.repeat(np.arange(len(texts.offsets) - 1), np.diff(texts.offsets))
    inside = of[:count] == of[GRAM - 1:]
    return bucket[inside].astype(np.int64), of[:count][inside]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, one row for each bucket seen."""
    raw = np.zeros(BUCKETS, np.int64)
    trusted = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        label = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        for start, _, texts in text_parts(batch.column(0)):
            bucket, of = _grams(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = label[start + of] == 1
            trusted += np.bincount(bucket[own], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(trusted[seen])],
                                     ["bucket", "raw", "trusted"])


def ratios(documents: DataFrame, known: DataFrame) -> np.ndarray:
    """log(p_trusted / p_raw) of every bucket, add-one smoothed; zeros if nothing is trusted."""
    rows = labelled.with_label(narrow(documents, "doc_id", "text"), known).select("text", "label")
    counts = (rows.mapInArrow(_count_grams, "bucket long, raw long, trusted long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas())
    raw, trusted = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts.bucket] += counts.raw
    trusted[counts.bucket] += counts.trusted
    if trusted.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def score(documents: DataFrame, table: np.ndarray) -> DataFrame:
    """All columns of ``documents`` replaced by ``doc_id``, the base counts and ``llr``.

    A text without an n-gram has ``llr`` 0. Null texts count as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_parts(batch.column(1)):
                counts = base_counts(texts)
                bucket, of = _grams(texts)
                number = np.bincount(of, minlength=stop - start)
                total = np.bincount(of, table[bucket], minlength=stop - start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start),
                     *[pa.array(counts[f].astype(np.int64)) for f in _BASE_FIELDS],
                     pa.array(total / np.maximum(number, 1))],
                    ["doc_id", *_BASE_FIELDS, "llr"])

    kind = narrow(documents, "doc_id").schema[0].dataType.simpleString()
    fields = ", ".join(f"{f} long" for f in _BASE_FIELDS)
    return narrow(documents, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}, llr double")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def threshold(scored: DataFrame, known: DataFrame, keep: float = KEEP_SHARE, step: float = 0.005) -> float:
    """The cut that rejects most rows labelled 0 while keeping ``keep`` of those labelled 1.

    Scores are counted in steps, so the driver sees a histogram, not rows. Without labels of either
    kind, nothing is rejected. Ties go to the lower cut, which lies halfway between two seen scores.
    """
    rows = (labelled.with_label(scored, known, "inner").filter(~base_failed())
            .groupBy(F.floor(F.col("llr") / F.lit(step)).alias("bin"))
            .agg(F.sum((F.col("label") == 1).cast("long")).alias("good"),
                 F.sum((F.col("label") == 0).cast("long")).alias("bad")).toPandas().sort_values("bin"))
    good, bad = rows.good.sum(), rows.bad.sum()
    best, cut = 0.0, -np.inf
    if not good or not bad:
        return cut
    lost = won = 0
    bins = list(rows.itertuples(index=False))
    for at, following in zip(bins, bins[1:]):
        lost, won = lost + at.good, won + at.bad
        gain = won / bad - lost / good
        if lost <= (1 - keep) * good and gain > best:
            # halfway to the next score seen
            best, cut = gain, (at.bin + 1 + following.bin) / 2 * step
    return float(cut)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``llr`` and ``kept`` of every row of ``documents``.

    All labelled rows count, for the ratios and for the cut.
    Repeated rows are judged each for itself; null texts have no words and fail the base rules.
    """
    known = stored(labelled.known(labels, "quality"))
    scored = stored(score(documents, ratios(documents, known)))
    cut = threshold(scored, known)
    return (scored.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(cut))))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that pass, with their columns. Rows are judged where they stand, so
    rows with equal or null ids cannot be mixed up and no text is shuffled."""
    known = stored(labelled.known(labels, "quality"))
    table = ratios(documents, known)
    own = labelled.with_label(narrow(documents, "doc_id", "text"), known, "inner")
    cut = threshold(stored(score(own, table)), known)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_parts(batch.column(names.index("text"))):
                counts = base_counts(texts)
                bucket, of = _grams(texts)
                number = np.maximum(np.bincount(of, minlength=stop - start), 1)
                llr = np.bincount(of, table[bucket], minlength=stop - start) / number
                failed = (counts["n_words"] < MIN_WORDS) | (
                    100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                yield batch.slice(start, stop - start).filter(pa.array(~failed & (llr >= cut)))

    return documents.mapInArrow(run, documents.schema)
