"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of full length are sequences of their own. The others are dealt into blocks of about
``BLOCK`` pieces; each block is one packing problem, solved by ``ISLANDS`` populations that work
apart. A solution is a list of bins. Crossover injects the best filled bins of one parent whole into
the other, drops the bins that hold a duplicate, and best-fits the displaced documents, largest
first. Between epochs each island's best solution migrates to the next island of its block, by a
join. A block, its populations and its islands are rows of bounded size; nothing passes the driver.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boardwalk.llm.bpe import CACHED, Memo, as_bytes
from boardwalk.session import stored

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
INJECTED = 0.4  # share of the donor's bins that crossover may inject
END_ID = 0

# white space for str.split, but not for the tokenizer
_NOT_SPACE = re.compile("[\x1c-\x1f]")


# a sign before a stop or comma that ends a word: the tokenizer takes them as one part
_SIGNS_IN_A_ROW = re.compile("[%s][.,][ \n]" % "".join(
    re.escape(chr(k)) for k in range(256) if unicodedata.category(chr(k))[0] not in "LN"
    and (not chr(k).isspace() or _NOT_SPACE.match(chr(k)))))

# Fixed value: how the tokenizer file splits text; and the letters its byte-level step writes bytes as
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _split(word: str) -> list[str]:
    return ["".join([_LETTER[b] for b in part.encode()]) for part in _SPLIT.findall(word)]


class WordIds:
    """Ids of a text by a tokenizer whose pre-tokenizer drops white space and never looks across it:
    the ids of a text are those of its words, so each word is encoded once.

    Words of the first 256 code points go straight to the tokenizer's model: there its normalizer
    only lowers letters. All others, and those with a special token, go through the tokenizer. A word
    of ASCII letters is one part of its own letters.

    Texts of the first 256 code points are lowered as a whole, and full stops and commas behind a letter
    or digit are words of their own, as the tokenizer cuts there as well: so fewer words are rare.
    """

    def __init__(self, path: str, limit: int = CACHED):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters_special = any(t.isalpha() for t in self.special)
        self.memo = Memo(self._one, limit)

    def _one(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and not self.letters_special:
            return as_bytes([t.id for t in self.model.tokenize(word.lower())])
        if max(word, default="a") < "\u0100" and not any(t in word for t in self.special):
            ids = [t.id for part in _split(word.lower()) for t in self.model.tokenize(part)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return as_bytes(ids)

    def _apart(self, text: str) -> str:
        """``text``, lowered and with stops and commas apart where that does not change its ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if any([t in text for t in self.special]):
            return text
        text = text.lower()
        if _SIGNS_IN_A_ROW.search(text):
            return text
        for sign in ".,":
            for space in " \n":
                text = text.replace(sign + space, f" {sign}{space}")
        return text

    def __call__(self, text: str) -> bytes:
        text = self._apart(text)
        words = text.split(" ") if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.memo.__getitem__, words))


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row of ``documents``.

    A document is the ids of its text (null: none) and the end id. Longer ones are cut at multiples
    of ``capacity``. Repeated rows give repeated pieces.
    """
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer_path)
        for batch in batches:
            rows, which = [], []
            for k, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    which.append(k)
                    rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            made = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(made[:, 0].astype(np.int32)),
                 *[pa.array(np.ascontiguousarray(made[:, k])) for k in (1, 2, 3)]], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Room:
    """Open bins by free space."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))

    def put(self, item: int) -> None:
        """Best fit: the fullest bin with enough room, else a new one."""
        need = self.lengths[item]
        at = bisect_left(self.free, (need, -1))
        if at == len(self.free):
            self.bins.append([item])
            left, k = self.capacity - need, len(self.bins) - 1
        else:
            left, k = self.free.pop(at)
            self.bins[k].append(item)
            left -= need
        if left:
            insort(self.free, (left, k))


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    room = Room(bins if bins is not None else [], lengths, capacity)
    for item in items:
        room.put(item)
    return room.bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then a larger sum of squared fills."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(mother: list[list[int]], father: list[list[int]], lengths: list[int], capacity: int,
              draw: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``father`` in ``mother``, the displaced documents fitted in anew."""
    ranked = sorted(father, key=lambda b: -sum(lengths[i] for i in b))
    pool = ranked[:max(1, int(len(ranked) * INJECTED))]
    injected = draw.sample(pool, max(1, len(pool) // 2))
    inside = {i for b in injected for i in b}
    clean = [list(b) for b in mother if inside.isdisjoint(b)]
    displaced = [i for b in mother if not inside.isdisjoint(b) for i in b if i not in inside]
    # the emptiest bins give up their documents as well, or no bin would ever go away
    clean.sort(key=lambda b: sum(lengths[i] for i in b))
    spare = max(1, len(clean) // 50)
    displaced += [i for b in clean[:spare] for i in b]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, capacity, [list(b) for b in injected] + clean[spare:])


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, generations: int,
           draw: random.Random) -> list[list[list[int]]]:
    """The population after some generations, best first. An empty one is founded by best fit in
    decreasing and in random order. It ends early when no packing can have fewer bins."""
    least = math.ceil(sum(lengths) / capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    if not population:
        population = [best_fit(order, lengths, capacity)]
        while len(population) < POPULATION and -len(population[0]) != -least:
            # near-decreasing order: sizes shaken by a tenth
            shaken = sorted(order, key=lambda i: -lengths[i] * draw.uniform(0.9, 1.1))
            population.append(best_fit(shaken, lengths, capacity))
    ranked = sorted(((fitness(p, lengths, capacity), k, p) for k, p in enumerate(population)),
                    key=lambda x: x[0], reverse=True)
    serial = len(ranked)
    for _ in range(generations):
        if len(ranked[0][2]) <= least or len(ranked) < 2:
            break
        a, b = draw.sample(range(len(ranked)), 2)
        child = crossover(ranked[a][2], ranked[b][2], lengths, capacity, draw)
        ranked.append((fitness(child, lengths, capacity), serial, child))
        serial += 1
        ranked.sort(key=lambda x: x[0], reverse=True)
        ranked = ranked[:POPULATION]
    return [p for _, _, p in ranked]


def _encoded(bins: list[list[int]], size: int) -> list[int]:
    """Bin number of each item."""
    out = [0] * size
    for k, members in enumerate(bins):
        for i in members:
            out[i] = k
    return out


def _decoded(numbers: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


_STATE = "block long, island int, lengths array<int>, population array<array<int>>"


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                draw = random.Random(f"{row['block']}/{row['island']}/{epoch}")
                found = evolve(row["lengths"], [_decoded(p) for p in row["population"]], capacity, GENERATIONS, draw)
                made = row | {"population": [_encoded(p, len(row["lengths"])) for p in found]}
                yield pa.RecordBatch.from_pylist([made], schema=batch.schema)

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``rows`` (any columns, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every row gets a place, equal rows included; places of a sequence have no gaps.
    """
    rows = stored(rows.withColumn("piece_id", F.monotonically_increasing_id()))
    loose = rows.filter(F.col("length") < capacity).select("piece_id", F.col("length").cast("int").alias("length"))
    blocks = max(1, math.ceil(loose.count() / block))
    # piece_id is unique, so no value of the data can fill one block
    dealt = loose.withColumn("block", F.pmod(F.xxhash64("piece_id"), F.lit(blocks)))
    item = F.struct("piece_id", "length")
    gathered = stored(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")))
    state = gathered.select(
        "block", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"),
        F.col("items.length").alias("lengths"), F.lit(None).cast("array<array<int>>").alias("population"))
    state = state.withColumn("population", F.coalesce("population", F.array().cast("array<array<int>>")))
    for epoch in range(EPOCHS):
        if epoch:
            guests = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"),
                                  F.slice("population", 1, 1).alias("guest"))
            state = state.join(guests, ["block", "island"]).select(
                "block", "island", "lengths", F.concat("population", "guest").alias("population"))
        dealt_out = state.repartition(max(1, min(blocks * ISLANDS, 2000)), "block", "island")
        state = stored(dealt_out.mapInArrow(_epoch(capacity, epoch), _STATE))
    best = (state.select("block", F.col("population")[0].alias("bins"))
            .groupBy("block").agg(F.min_by("bins", F.array_max("bins")).alias("bins")))
    placed = (gathered.join(best, "block")
              .select("block", F.explode(F.arrays_zip(F.col("items"), F.col("bins"))).alias("x"))
              .select("block", "x.items.piece_id", "x.items.length", F.col("x.bins").alias("bin"))
              .groupBy("block", "bin").agg(F.sort_array(F.collect_list(F.struct("piece_id", "length"))).alias("own")))
    offsets = (placed.select((F.col("block") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"),
                             F.posexplode("own").alias("k", "one"), F.col("own.length").alias("sizes"))
               .select("sequence_id", "one.piece_id",
                       F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0).cast("long"),
                                   lambda a, x: a + x).alias("offset")))
    full = rows.filter(F.col("length") >= capacity)
    alone = full.select(*full.columns, (-F.col("piece_id") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = rows.filter(F.col("length") < capacity).join(offsets, "piece_id").select(*alone.columns)
    return shared.unionByName(alone).drop("piece_id")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every row of ``documents``."""
    return pack(pieces(documents, tokenizer_path, capacity), capacity)
