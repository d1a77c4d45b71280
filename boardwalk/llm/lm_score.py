"""Scores of texts by a causal self-attention model over subword ids, trained in numpy.

Words (lower-case A-Z) are counted over all training texts; the distinct ones are split into
subwords by a public tokenizer, each with its leading space, so a text is the ids of its words and an
end id. Subwords fall into classes: frequent ones alone, others by k-means over what stands beside
them. The model gives log P(class | ids before) by one layer of masked attention on top of a class
bigram, and P(id | class) from counts. The bigram is counted, and the attention trained, on windows
that tile all ids of all training texts, the latter by rounds of local training in each task whose
parameters are averaged; a window takes part in one round.

A text is scored in windows of ``WINDOW`` ids that overlap, so each id is scored once with at least
``WINDOW - STRIDE`` ids before it, if there are as many. The probability of a word is a mixture of
three (``SHARES``): its share among all training words; the class of its first id in context times
its share among training words that begin with an id of this class; and what the model gives its
ids and that a new word starts after them. Words without a training occurrence are one more word of
the first two, as in the base score.

Counts of the ``HOT`` most frequent words travel with the code; occurrences of other words meet their
counts in a join. Tables of the model are bounded by the vocabulary of the tokenizer.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.bpe import CACHED, Memo, load_ranks
from boardwalk.session import stored

WINDOW, STRIDE = 32, 24
WIDTH = 16
ALONE, GROUPS = 64, 32  # classes of single ids; groups of word starts, and as many of other ids
FEATURES = 64
ROUNDS, BATCH, RATE = 3, 64, 0.01
HOT = 1 << 18
SHARES = (0.15, 0.65, 0.2)
_CHUNK = 64  # windows scored at once
_HEAD = 3  # 16-bit places before a word's ids that hold its count
_NO_COUNT = (1 << 48) - 1


def held_out(modulus: int = 7, rest: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % F.lit(modulus) == F.lit(rest), F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered: these methods of bytes know ASCII only."""
    return (text or "").encode().lower().split()


class Subwords:
    """Ids of a word with a leading space; the end id follows the vocabulary."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.starts = np.zeros(self.size, bool)
        self.starts[[rank for content, rank in ranks.items() if content[:1] == b" "]] = True
        self.starts[self.end] = True
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode())


@functools.lru_cache(maxsize=2)
def subwords_of(path: str, pattern: str) -> Subwords:
    """Built once in a worker process."""
    return Subwords(path, pattern)


# counts ------------------------------------------------------------------------------------------

def count_words(training: DataFrame, most: int = 400_000) -> DataFrame:
    """``(word, n)`` over all texts, counted within tasks before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > most:
                    yield rows()
        yield rows()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _neighbours(path: str, pattern: str):
    """Per task: how often an id stands before or after ids of a feature bucket within words, and how
    often it occurs (feature -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(path, pattern)
        beside = np.zeros((subwords.size, 2 * FEATURES), np.float32)
        single, opening, kinds = np.zeros((3, subwords.size), np.int64)
        for batch in batches:
            flat, lengths = [], []
            for word in batch.column(0).to_pylist():
                ids = subwords(word)
                flat += ids
                lengths.append(len(ids))
            if not flat:
                continue
            ids = np.array(flat)
            weight = np.repeat(batch.column(1).to_numpy(), lengths)
            of = np.repeat(np.arange(len(lengths)), lengths)
            np.add.at(single, ids, weight)
            opens = np.cumsum(lengths) - lengths
            np.add.at(opening, ids[opens], batch.column(1).to_numpy())
            np.add.at(kinds, ids[opens], 1)
            inner = np.flatnonzero(of[1:] == of[:-1])
            left, right, heavy = ids[inner], ids[inner + 1], weight[inner]
            np.add.at(beside, (right, left * 31 % FEATURES), heavy)
            np.add.at(beside, (left, FEATURES + right * 31 % FEATURES), heavy)
        row, column = np.nonzero(beside)
        rows, columns, numbers = [row], [column], [beside[row, column].astype(np.int64)]
        for code, counts in ((-1, single), (-2, opening), (-3, kinds)):
            used = np.flatnonzero(counts)
            rows.append(used)
            columns.append(np.full(len(used), code))
            numbers.append(counts[used])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in (rows, columns, numbers)], ["id", "feature", "n"])

    return run


class Vocabulary:
    """Class of each id, log P(id | class), and the words that begin with each class."""

    def __init__(self, counts: np.ndarray, beside: np.ndarray, starts: np.ndarray, end: int,
                 opening: np.ndarray, kinds: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        alone = [int(i) for i in order[:ALONE] if counts[i] and i != end] + [end]
        self.of = np.full(len(counts), -1, np.int64)
        self.of[alone] = np.arange(len(alone))
        size = len(alone)
        for kind in (True, False):
            own = np.flatnonzero((self.of < 0) & (starts == kind))
            self.of[own] = size + _groups(beside[own], counts[own])
            size += GROUPS
        self.size = size
        self.end = int(self.of[end])
        self.starts = np.zeros(size, bool)
        np.logical_or.at(self.starts, self.of, starts)
        total = np.bincount(self.of, counts + 1.0, size)
        # words that begin with a class, occurrences and kinds, and one for all unseen
        self.words = np.bincount(self.of, opening + kinds, size) + 1.0
        self.inside = np.log((counts + 1.0) / total[self.of]).astype(np.float32)


def _groups(beside: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Spherical k-means of ids by the square roots of what stands beside them, weighted by count."""
    if not len(counts):
        return np.zeros(0, np.int64)
    points = np.sqrt(beside + 1e-3)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centers = points[np.argsort(-counts, kind="stable")[:GROUPS]].copy()
    for _ in range(8):
        own = np.argmax(points @ centers.T, axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, own, points * (counts[:, None] + 1e-6))
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(length > 0, total / np.maximum(length, 1e-12), centers)
    return np.argmax(points @ centers.T, axis=1)


# model -------------------------------------------------------------------------------------------

NAMES = ("embed", "place", "ask", "key", "value", "out")


def initial(classes: int, seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shapes = {"embed": (classes, WIDTH), "place": (WINDOW, WIDTH), "ask": (WIDTH, WIDTH), "key": (WIDTH, WIDTH),
              "value": (WIDTH, WIDTH), "out": (WIDTH, classes)}
    scale = {"embed": 0.5, "place": 0.1, "ask": 0.25, "key": 0.25, "value": 0.25, "out": 0.02}
    return {n: (draw.normal(size=shapes[n]) * scale[n]).astype(np.float32) for n in NAMES}


_MASK = np.triu(np.full((WINDOW, WINDOW), -np.inf, np.float32), 1)


def forward(model: dict, bigram: np.ndarray, before: np.ndarray,
            wanted: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Unnormalised exp(logits) of the next class at every place (or the ``wanted`` ones) of windows
    ``before``, and what the gradient needs. Logits stay small (a log bigram and a low-rank term), so
    no maximum is taken."""
    rows = len(before)
    x = (model["embed"][before] + model["place"]).reshape(rows * WINDOW, WIDTH)
    ask, key, value = (
        (x @ model[n]).reshape(rows, WINDOW, WIDTH) for n in ("ask", "key", "value"))
    heed = np.matmul(ask, key.transpose(0, 2, 1))
    heed *= np.float32(WIDTH ** -0.5)
    np.clip(heed, -30, 30, out=heed)
    heed += _MASK
    np.exp(heed, out=heed)
    total = heed.sum(axis=2, keepdims=True)
    mixed = np.matmul(heed, value) / total
    hidden = x + mixed.reshape(rows * WINDOW, WIDTH)
    last = before.reshape(-1)
    logits = (hidden if wanted is None else hidden[wanted]) @ model["out"]
    logits += bigram[last if wanted is None else last[wanted]]
    np.exp(logits, out=logits)
    return logits, (x, ask, key, value, heed, total, hidden)


def gradient(model: dict, bigram: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-probability of ``after`` (-1: not counted) and its gradient."""
    rows = len(before)
    odds, (x, ask, key, value, heed, total, hidden) = forward(model, bigram, before)
    target = after.reshape(-1)
    live = np.flatnonzero(target >= 0)
    odds /= odds.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(odds[live, target[live]], 1e-30)).mean()
    odds[live, target[live]] -= 1
    odds[target < 0] = 0
    odds /= max(len(live), 1)
    grad = {"out": hidden.T @ odds}
    d_hidden = odds @ model["out"].T
    d_mixed = d_hidden.reshape(rows, WINDOW, WIDTH)
    share = heed / total
    d_share = np.matmul(d_mixed, value.transpose(0, 2, 1))
    d_heed = share * (d_share - (d_share * share).sum(axis=2, keepdims=True)) * np.float32(WIDTH ** -0.5)
    flat = lambda a: a.reshape(rows * WINDOW, WIDTH)
    d_ask, d_key = flat(np.matmul(d_heed, key)), flat(np.matmul(d_heed.transpose(0, 2, 1), ask))
    d_value = flat(np.matmul(share.transpose(0, 2, 1), d_mixed))
    grad |= {"ask": x.T @ d_ask, "key": x.T @ d_key, "value": x.T @ d_value}
    d_x = d_hidden + d_ask @ model["ask"].T + d_key @ model["key"].T + d_value @ model["value"].T
    grad["place"] = d_x.reshape(rows, WINDOW, WIDTH).sum(axis=0)
    grad["embed"] = np.zeros_like(model["embed"])
    np.add.at(grad["embed"], before.reshape(-1), d_x)
    return float(loss), grad


class Adam:
    def __init__(self, model: dict, rate: float = RATE):
        self.rate, self.step = rate, 0
        self.first = {n: np.zeros_like(p) for n, p in model.items()}
        self.second = {n: np.zeros_like(p) for n, p in model.items()}

    def __call__(self, model: dict, grad: dict) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for n, g in grad.items():
            self.first[n] += 0.1 * (g - self.first[n])
            self.second[n] += 0.001 * (g * g - self.second[n])
            model[n] = (model[n] - rate * self.first[n] / (np.sqrt(self.second[n]) + 1e-8)).astype(np.float32)


def _pack(model: dict) -> np.ndarray:
    return np.concatenate([model[n].ravel() for n in NAMES])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for n in NAMES:
        out[n] = flat[at:at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def _training_windows(path: str, pattern: str, classes: np.ndarray, end: int):
    """The windows of each text: classes of ``WINDOW`` ids in a row and of the id before them, until
    all ids and the end id are in one; -1 fills up the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(path, pattern)
        memo = Memo(lambda word: classes[subwords(word)].astype(np.int16).tobytes(), CACHED // 5)
        last = np.int16(end).tobytes()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                known = np.frombuffer(b"".join([*map(memo.__getitem__, words_of(text.as_py())), last]), np.int16)
                own = np.full((-(-len(known) // WINDOW), WINDOW + 1), -1, np.int16)
                inner = np.full(len(own) * WINDOW, -1, np.int16)
                inner[:len(known)] = known
                own[:, 1:] = inner.reshape(-1, WINDOW)
                own[0, 0], own[1:, 0] = end, own[:-1, -1]
                rows.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["windows"])

    return run


def _as_windows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, WINDOW + 1).astype(np.int64)


def _pairs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            rows = _as_windows(batch.column(0))
            left, right = rows[:, :-1].ravel(), rows[:, 1:].ravel()
            live = (left >= 0) & (right >= 0)
            total += np.bincount(left[live] * size + right[live], minlength=size * size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    return run


def _train(model: dict, bigram: np.ndarray, number: int):
    """Local training of one round: its windows, one pass; emits parameters times windows seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {n: p.copy() for n, p in model.items()}
        step, seen = Adam(own, RATE / (1 + number)), 0
        waiting = np.zeros((0, WINDOW + 1), np.int64)
        for batch in batches:
            rows = _as_windows(batch.column(0))
            waiting = np.concatenate([waiting, rows[number::ROUNDS]])
            while len(waiting) >= BATCH:
                now, waiting = waiting[:BATCH], waiting[BATCH:]
                before = np.maximum(now[:, :-1], 0)
                _, grad = gradient(own, bigram, before, now[:, 1:])
                step(own, grad)
                seen += BATCH
        if len(waiting):
            _, grad = gradient(own, bigram, np.maximum(waiting[:, :-1], 0), waiting[:, 1:])
            step(own, grad)
            seen += len(waiting)
        if seen:
            flat = _pack(own).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), seen))], ["k", "value", "seen"])

    return run


def fit_model(windows: DataFrame, size: int) -> tuple[dict, np.ndarray]:
    """Parameters and the log class bigram. ``windows`` is read once for the bigram and once a round."""
    model = initial(size)
    pairs = windows.mapInArrow(_pairs(size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size * size)
    counts[pairs.pair.to_numpy()] = pairs.n.to_numpy()
    counts = counts.reshape(size, size)
    # what follows anything, as the prior of what follows one class
    prior = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * size)
    counts = counts + 8 * prior
    bigram = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    for number in range(ROUNDS):
        found = (windows.mapInArrow(_train(model, bigram, number), "k long, value double, seen long")
                 .groupBy("k").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas())
        if len(found):
            flat = _pack(model).astype(np.float64)
            flat[found.k.to_numpy()] = found.value.to_numpy()
            model = _unpack(flat, model)
    return model, bigram


# scoring -----------------------------------------------------------------------------------------

def score_ids(classes: np.ndarray, bounds: np.ndarray, model: dict, bigram: np.ndarray,
              vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each id of some texts (``bounds``: where each begins, and the end): log P(class), and the
    log of the probability that a word starts there."""
    size = np.diff(bounds)
    more = np.maximum(-(-(size - WINDOW) // STRIDE), 0)
    text = np.repeat(np.arange(len(size)), more + 1)
    number = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    begin = bounds[text] + number * STRIDE
    stop = np.minimum(begin + WINDOW, bounds[text + 1])
    first = np.where(number == 0, begin, begin + WINDOW - STRIDE)  # scored from here
    log_class = np.zeros(len(classes), np.float32)
    log_start = np.zeros(len(classes), np.float32)
    before = np.concatenate([[vocabulary.end], classes[:-1]])
    before[bounds[:-1]] = vocabulary.end
    starts = vocabulary.starts.astype(np.float32)
    reach = np.arange(WINDOW)
    for low in range(0, len(begin), _CHUNK):
        at = begin[low:low + _CHUNK, None] + reach
        inside = at < stop[low:low + _CHUNK, None]
        at = np.where(inside, at, begin[low:low + _CHUNK, None])
        wanted = np.flatnonzero((inside & (at >= first[low:low + _CHUNK, None])).ravel())
        odds, _ = forward(model, bigram, before[at], wanted)
        place = at.ravel()[wanted]
        total = np.log(odds.sum(axis=1))
        log_class[place] = np.log(odds[np.arange(len(odds)), classes[place]]) - total
        log_start[place] = np.log(odds @ starts) - total
    return log_class, log_start


def _add_up(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Scorer:
    """Scores of a list of texts. Words that are not hot are returned apart, with the model's part."""

    def __init__(self, subwords: Subwords, vocabulary: Vocabulary, model: dict, bigram: np.ndarray,
                 hot: dict[bytes, int], train_tokens: int, distinct: int, train_docs: int):
        self.vocabulary, self.model, self.bigram = vocabulary, model, bigram
        self.below = train_tokens + distinct + 1
        self.train_docs = train_docs

        def value(word: bytes) -> bytes:
            count = hot.get(word, _NO_COUNT)
            head = [count & 0xFFFF, count >> 16 & 0xFFFF, count >> 32]
            return np.array(head + subwords(word), "<u2").tobytes()

        self.memo = Memo(value, CACHED)
        self.end_value = np.array([train_docs & 0xFFFF, train_docs >> 16 & 0xFFFF, train_docs >> 32, subwords.end],
                                  "<u2").tobytes()

    def __call__(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        get, values, sizes, rare_words = self.memo.__getitem__, [], [], []
        lists = [words_of(t) for t in texts]
        for words in lists:
            values += map(get, words)
            values.append(self.end_value)
            sizes.append(len(words) + 1)
        stream = np.frombuffer(b"".join(values), "<u2")
        length = np.fromiter(map(len, values), np.int64, len(values)) // 2
        head = np.cumsum(length) - length
        count = stream[head].astype(np.int64) | stream[head + 1].astype(np.int64) << 16 | stream[head + 2].astype(np.int64) << 32
        is_id = np.ones(len(stream), bool)
        for k in range(_HEAD):
            is_id[head + k] = False
        ids = stream[is_id].astype(np.int64)
        word_at = np.concatenate([[0], np.cumsum(length - _HEAD)])
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        log_class, log_start = score_ids(self.vocabulary.of[ids], word_at[text_at], self.model, self.bigram, self.vocabulary)
        total = _add_up(log_class + self.vocabulary.inside[ids], word_at)
        ends = text_at[1:] - 1
        opening = log_start[word_at[:-1]].astype(np.float64)
        following = np.concatenate([opening[1:], [0.0]])
        following[ends] = 0.0
        own = (total - opening + following) / np.log(10)  # log10 of the model's part
        rare = count == _NO_COUNT
        known = np.where(rare, 0, count)
        base = np.where(rare, 0.0, np.log10((known + 1) / self.below))
        first = word_at[:-1]
        by_class = (log_class[first] - log_start[first]) / np.log(10) - np.log10(self.vocabulary.words[self.vocabulary.of[ids[first]]])
        mixed = mix(own, by_class, known, self.below)
        mixed[rare] = 0.0
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.flatnonzero(rare)
        for k, words in enumerate(lists):
            low, high = np.searchsorted(place, [text_at[k], text_at[k + 1]])
            rare_words.append([words[p - text_at[k]] for p in place[low:high].tolist()])
        return {"n_tokens": np.array(sizes), "n_known": np.bincount(text[~rare & (known > 0)], minlength=len(texts)),
                "base": _add_up(base, text_at), "score": _add_up(mixed, text_at),
                "rare_words": rare_words, "rare_at": np.searchsorted(place, text_at), "rare_own": own[place], "rare_class": by_class[place]}


def mix(own: np.ndarray, by_class: np.ndarray, count: np.ndarray, below: float) -> np.ndarray:
    """log10 of the mixture: ``own`` is log10 of the model's part, ``by_class`` of the class in context
    over the words that begin with it, ``count`` the word's training occurrences."""
    overall, of_class, model = SHARES
    return np.log10((count + 1) * (overall / below + of_class * 10.0 ** by_class) + model * 10.0 ** own)


def score(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows held out teach nothing. Null and empty texts are one end token. Rows with a null id are
    training rows; repeated rows count and are scored each for itself. Without training rows every
    count is 0 and the model is uniform over what its first parameters give.
    """
    subwords = Subwords(path, pattern)
    slim = documents.select("doc_id", "text", held_out().alias("held_out"))
    training = slim.filter(~F.col("held_out"))
    counts = stored(count_words(training))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
    docs = training.count()
    tokens, distinct = sums["n"] + docs, sums["words"] + (docs > 0)
    hot = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(HOT).toLocalIterator()}

    beside = counts.mapInArrow(_neighbours(path, pattern), "id long, feature long, n long")
    found = beside.groupBy("id", "feature").agg(F.sum("n").alias("n")).toPandas()
    near = np.zeros((subwords.size, 2 * FEATURES), np.float32)
    beside_rows = found[found.feature >= 0]
    near[beside_rows.id, beside_rows.feature] = beside_rows.n
    single, opening, kinds = np.zeros((3, subwords.size))
    for code, numbers in ((-1, single), (-2, opening), (-3, kinds)):
        own = found[found.feature == code]
        numbers[own.id] = own.n
    single[subwords.end] = opening[subwords.end] = docs
    kinds[subwords.end] = docs > 0
    vocabulary = Vocabulary(single, near, subwords.starts, subwords.end, opening, kinds)

    windows = stored(training.select("text").mapInArrow(
        _training_windows(path, pattern, vocabulary.of, vocabulary.end), "windows binary"))
    model, bigram = fit_model(windows, vocabulary.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(subwords_of(path, pattern), vocabulary, model, bigram, hot, tokens, distinct, docs)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, size = [], 0
                while low + len(texts) < batch.num_rows and size < 200_000:
                    texts.append(batch.column(1)[low + len(texts)].as_py())
                    size += len(texts[-1] or "")
                got = scorer(texts)
                rare = pa.array([[xxhash.xxh64_intdigest(w, 42) - (1 << 64 if xxhash.xxh64_intdigest(w, 42) >> 63 else 0)
                                  for w in ws] for ws in got["rare_words"]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)), batch.column(2).slice(low, len(texts)),
                     pa.array(got["n_tokens"].astype(np.int64)), pa.array(got["n_known"].astype(np.int64)),
                     pa.array(got["base"]), pa.array(got["score"]), rare,
                     *[pa.ListArray.from_arrays(pa.array(got["rare_at"], pa.int32()), pa.array(got[n].astype(np.float32)))
                       for n in ("rare_own", "rare_class")]],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "own", "by_class"])
                low += len(texts)

    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = stored(slim.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, "
             "words array<long>, own array<float>, by_class array<float>").withColumn("row", F.monotonically_increasing_id()))
    return _with_rare(scored, counts, tokens, distinct)


def _with_rare(scored: DataFrame, counts: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """Adds what the words outside the hot list contribute, by a join with their counts."""
    below = F.lit(float(tokens + distinct + 1))
    rare = (scored.filter(F.size("words") > 0)
            .select("row", F.explode(F.arrays_zip("words", "own", "by_class")).alias("x"))
            .select("row", F.col("x.words").alias("word"), "x.own", "x.by_class"))
    known = counts.select(F.xxhash64("word").alias("word"), "n")
    count = F.coalesce("n", F.lit(0))
    overall, of_class, model = map(F.lit, SHARES)
    ten = lambda c: F.pow(F.lit(10.0), F.col(c).cast("double"))
    mixed = F.log10((count + 1) * (overall / below + of_class * ten("by_class")) + model * ten("own"))
    added = (rare.join(known, "word", "left").groupBy("row").agg(
        F.sum((count > 0).cast("long")).alias("more_known"),
        F.sum(F.log10((count + 1) / below)).alias("more_base"), F.sum(mixed).alias("more_score")))
    zero = F.lit(0)
    return scored.drop("words", "own", "by_class").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"))
