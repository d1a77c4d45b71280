"""Toxicity: a weighted lexicon, learned from labelled rows, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digit or symbol
substitutions become the Latin letter (``1`` and ``l`` both become ``i``, as a reader may mean
either), and what is no letter or digit becomes one space. The lexicon holds folded words and word
beginnings with the log-odds of a document that holds them being labelled toxic. A hit inside an
exception phrase does not count.

The sum of a text's weights is divided by 1 + ln(1 + words); the score is s / (s + cut), where the
cut lies between the classes of the training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm import labelled
from boardwalk.llm.common import narrow
from boardwalk.session import stored

# Letters of other scripts that look like Latin ones, and substitutions.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ℓ": "i",
}
_SUBSTITUTED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i"}
_INVISIBLE = "­​‌‍⁠﻿"
# Phrases in which a word of abuse is none.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "pathetic fallacy", "the idiot by dostoevsky")

_FOLD = str.maketrans({
    **_LOOK_ALIKE, **_SUBSTITUTED, **{c: None for c in _INVISIBLE},
    **{chr(0xFF41 + k): "i" if c == "l" else c for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")},
})
_TRAILING = re.compile(r"[$@]+(?!\w)")
_BREAK = re.compile(r"[\W_]+")

BEGINNINGS = range(3, 11)
LEAST_TOXIC_SHARE = 0.002  # of the toxic training rows must hold an entry
LEAST_TOXIC_ROWS = 3
LEAST_EVIDENCE = 0.0  # beyond what the best of that many chance entries would show
LEAST_OWN_ROWS, LEAST_OWN_SHARE = 2, 0.001  # toxic rows an entry must hold that no better one does
LEAST_COMPANY = 8
NEARLY_ALL = 0.95
LEAST_RATIO = 20.0  # how much more often toxic rows hold an entry than others do


def fold(text: str) -> str:
    """Folded words between single spaces, with one space at either end."""
    text = text.lower()
    if "$" in text or "@" in text:
        text = _TRAILING.sub(" ", text)
    return f" {_BREAK.sub(' ', text.translate(_FOLD)).strip()} "


def _features(folded: str) -> set[str]:
    """Words (with a closing space) and beginnings (without), each after an opening space."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for size in BEGINNINGS:
            if size > len(word):
                break
            out.add(f" {word[:size]}")
    return out


def _counted(label: int, among: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["entry", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == label:
                    found = _features(fold(text or ""))
                    counts.update(found if among is None else found & among)
                    if len(counts) > 300_000:
                        yield rows()
        yield rows()

    return run


def lexicon(training: DataFrame) -> dict[str, float]:
    """Entries and weights from ``(text, label)`` rows.

    An entry is in enough toxic rows, and ``LEAST_RATIO`` times as often there as elsewhere. Of
    nested beginnings the shortest such one stands for all, made longer as long as that loses hardly
    a row. The support bounds the number of entries, so the lexicon may pass the driver.
    """
    sizes = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(LEAST_TOXIC_ROWS, LEAST_TOXIC_SHARE * toxic)

    def count(label: int, among: frozenset | None) -> DataFrame:
        return (training.mapInArrow(_counted(label, among), "entry string, n long")
                .groupBy("entry").agg(F.sum("n").alias("n")))

    bad = {r["entry"]: r["n"] for r in count(1, None).filter(F.col("n") >= least).toLocalIterator()}
    good = {r["entry"]: r["n"] for r in count(0, frozenset(bad)).collect()}
    weights = {}
    evidence = np.log(len(bad) + 1) + LEAST_EVIDENCE
    for entry, n in bad.items():
        if _evidence(n, good.get(entry, 0), toxic, clean) < evidence:
            continue
        ratio = (n + 0.5) / (toxic + 1) / ((good.get(entry, 0) + 0.5) / (clean + 1))
        if ratio >= LEAST_RATIO:
            weights[entry] = float(np.log(ratio))
    return _needed(training, _closed(weights, bad), toxic)


def _needed(training: DataFrame, weights: dict[str, float], toxic: int) -> dict[str, float]:
    """The entries that explain toxic rows no better entry explains.

    Copies of one toxic text make all of its words look toxic. So entries are taken by the number of
    toxic rows they hold that no taken entry holds, as long as there are some; then those that occur
    beside ``LEAST_COMPANY`` different sets of taken entries, which copies do not. Rows with the same
    entries are counted by Spark; each set of entries comes to the driver once, with its count.
    """
    if not weights:
        return {}
    names = sorted(weights)
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for name, k in place.items():
            machine.add_word(name, k)
        machine.make_automaton()
        for batch in batches:
            found = [sorted({k for _, k in machine.iter(fold(text or ""))})
                     for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if label == 1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["entries"])

    sets = training.mapInArrow(run, "entries array<int>").groupBy("entries").agg(F.count(F.lit(1)).alias("n"))
    open_rows = {frozenset(r["entries"]): r["n"] for r in sets.toLocalIterator()}
    least = max(LEAST_OWN_ROWS, LEAST_OWN_SHARE * toxic)
    every_row, taken = open_rows, set()
    while open_rows:
        counts: Counter = Counter()
        for row, n in open_rows.items():
            counts.update(dict.fromkeys(row, n))
        # ties go to the heavier entry, then to the first in order
        best = max(counts, key=lambda k: (counts[k], weights[names[k]], -k), default=None)
        if best is None or counts[best] < least:
            break
        taken.add(best)
        open_rows = {row: n for row, n in open_rows.items() if best not in row}
    company: dict[int, set] = {}
    for row in every_row:
        for k in row - taken:
            company.setdefault(k, set()).add(row & taken)
    taken |= {k for k, sets in company.items() if len(sets) >= LEAST_COMPANY}
    return {names[k]: weights[names[k]] for k in sorted(taken)}


def _evidence(bad: int, good: int, toxic: int, clean: int) -> float:
    """Bound on -log of the chance that so large a share of an entry's rows is toxic by accident."""
    share, expected = bad / (bad + good), toxic / (toxic + clean)
    if share <= expected:
        return 0.0
    other = (1 - share) * np.log((1 - share) / (1 - expected)) if share < 1 else 0.0
    return (bad + good) * (share * np.log(share / expected) + other)


def _closed(weights: dict[str, float], rows: dict[str, int]) -> dict[str, float]:
    """The outermost entries, each replaced by the longest one found in nearly as many rows."""
    kept: dict[str, float] = {}
    below: dict[str, list[str]] = {}
    for entry in sorted(weights):
        parents = [entry[:k] for k in range(len(entry) - 1, 0, -1) if entry[:k] in weights]
        if parents:
            below.setdefault(parents[-1], []).append(entry)
        else:
            below.setdefault(entry, [])
    for root, inner in below.items():
        best = root
        for entry in inner:
            if rows[entry] >= NEARLY_ALL * rows[root] and len(entry) > len(best):
                best = entry
        kept[best] = weights[best]
    return kept


def automaton(weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    """Entries with their weight, exception phrases with None."""
    machine = ahocorasick.Automaton()
    for entry, weight in weights.items():
        machine.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        folded = fold(phrase)
        machine.add_word(folded, (len(folded), None))
    machine.make_automaton()
    return machine


def weight_of(folded: str, machine: ahocorasick.Automaton) -> float:
    """Sum of the weights of all hits that no exception phrase covers."""
    hits, covers = [], []
    for end, (size, weight) in machine.iter(folded):
        (covers if weight is None else hits).append((end - size + 1, end, weight))
    return sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in covers))


def raw_score(text: str | None, machine: ahocorasick.Automaton) -> float:
    folded = fold(text or "")
    total = weight_of(folded, machine)
    return total / (1.0 + np.log1p(folded.count(" ") - 1)) if total else 0.0


def scores(documents: DataFrame, weights: dict[str, float], cut: float, *carried: str,
           exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """The ``carried`` columns with ``score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(weights, exceptions)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(0)):
                out[k] = raw_score(text.as_py(), machine)
            out = out / (out + cut)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*carried, "score"])

    picked = documents.select("text", *carried)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[1:])
    return picked.mapInArrow(run, f"{fields}, score double")


def cut_of(training: DataFrame, weights: dict[str, float]) -> float:
    """The raw score with fewest wrong training rows on either side; half of the smallest hit if
    nothing else is known. Raw scores are counted in steps."""
    step = 0.01
    # with a cut of 1, score = s / (s + 1)
    raw = F.col("score") / (F.lit(1.0) - F.col("score"))
    rows = (scores(training, weights, 1.0, "label").select("label", F.floor(raw / F.lit(step)).alias("bin"))
            .groupBy("bin").agg(F.sum((F.col("label") == 1).cast("long")).alias("bad"),
                                F.sum((F.col("label") == 0).cast("long")).alias("good"))
            .toPandas().sort_values("bin"))
    wrong = int(rows.good.sum())
    best, cut = wrong, step / 2
    bins = list(rows.itertuples(index=False))
    for k, (at, bad, good) in enumerate(bins):
        wrong += int(bad) - int(good)
        if wrong < best:
            following = bins[k + 1].bin if k + 1 < len(bins) else at + 1
            best, cut = wrong, (at + 1 + following) / 2 * step
    return float(max(cut, step / 2))


def fit(documents: DataFrame, labels: DataFrame, learn_from=None) -> tuple[dict[str, float], float]:
    """Lexicon and cut from all labelled documents. Without labels of both kinds the lexicon is
    empty and every score 0."""
    known = stored(labelled.known(labels, "toxic", learn_from))
    training = stored(labelled.with_label(narrow(documents, "doc_id", "text"), known, "inner").select("text", "label"))
    weights = lexicon(training)
    return weights, cut_of(training, weights) if weights else 1.0


def held_out():
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % F.lit(5) == F.lit(0), F.lit(False))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; rows held out teach nothing.

    Null and empty texts score 0; repeated rows score alike.
    """
    weights, cut = fit(documents, labels, learn_from=~held_out())
    scored = scores(documents, weights, cut, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that score below one half, with their columns."""
    weights, cut = fit(documents, labels)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(weights)
        for batch in batches:
            kept = [raw_score(t.as_py(), machine) < cut for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
