"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles (one shingle of all words if it has fewer).
Equal shingles of a document are told apart by an occurrence label. Each of ``SKETCHES`` samples
takes the ``SAMPLED`` labelled shingles with the smallest hashes and keeps them in text order; two
documents with an equal sample are candidates. As order counts, collisions follow edit similarity.
A text of at most ``SAMPLED`` shingles links only with texts that have one shingle more or less, else
the same ones. Such pairs are found exactly: by the sequence of all shingles of the shorter, which
is that of the longer with one left out.

Two texts link if a banded alignment of their shingles, at most (n + m) / 9 off the diagonal, finds
s = matched / (n + m - matched) >= 0.8. No such pair needs a wider band.

Equal texts are one class before anything is compared. In a bucket of up to ``SMALL`` texts all
pairs are verified. A larger bucket is not expanded into pairs. First all its members are
verified against one leader, the member that meets most others in buckets. What is left is found
exactly, and only between classes that are still apart:

* The members of such buckets are dealt by their rarest shingles and by classes of sizes. Texts that
  link share one of the ``n / 5 + 1`` first of each in any common order of shingles, of the ``n / 9 + 1``
  first if they have the same size; with the rarest first, most have no partner there. A member that
  could only link with shorter texts than its bucket holds leaves it. (Rarity comes from counts in a
  table of fixed size, which can only cost work.)
* Where still too many texts outside the largest class of a bucket meet, they get a leader
  again, and are dealt by (leader, difference). Let D be the shingles that only one of two texts has;
  a link has D <= (|A| + |B|) / 9. If A links with B, and B not with the leader L, then A and B share
  a shingle that L lacks, unless A is shorter than L and B only just beyond L's reach; then they lack
  one of L's in common. Either is among the first ``n / 4 + 1`` of its kind in any common order, on
  both sides (as many would have to be shared otherwise). Again those that fewest members have, or
  lack, go first, and a shingle that one text alone holds is no key.

Shingles or differences before the first that two texts share are in one of them only. So its place
bounds the sizes of partners, and pairs beyond the bounds of either are not verified.

Every link between members of a bucket is then within a class, without a cap and without all pairs.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Texts, as_long, list_of_long, mix, text_parts, windows
from boardwalk.llm.components import components
from boardwalk.session import shared_folder, stored

SHINGLE = 5
SKETCHES = 40
SAMPLED = 6
SIMILARITY = 0.8
SMALL = 8
LATER = 3
NARROWED = 2  # times that members too large for the shortest of their bucket go
BROADCAST_IDS = 1_000_000  # ids of candidates, 8 bytes each; more of them are joined by a shuffle
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS  # shingle counts, at most one row each to the driver

_FACTORS = np.random.default_rng(7).integers(0, 2**64, SKETCHES, dtype=np.uint64) | np.uint64(1)
_SIZES = np.unique((1.1 ** np.arange(300)).astype(np.int64))  # where classes of sizes begin
_REORDERED = 0  # the difference that stands for "same shingles as the leader in another order"


def shingles(texts: Texts) -> list[np.ndarray]:
    """Labelled shingle hashes of each text in text order."""
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends)
    grams = windows(words, SHINGLE)
    out = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= SHINGLE:
            own = grams[low:high - SHINGLE + 1]
        elif high > low:
            own = windows(words[low:high], int(high - low))
        else:
            own = grams[:0]
        out.append(_labelled(own))
    return out


def _labelled(own: np.ndarray) -> np.ndarray:
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(own) else np.zeros(0, bool)
    if not same.any():
        return own
    place = np.arange(len(own))
    begin = np.maximum.accumulate(np.where(same, 0, place))
    label = np.empty(len(own), np.uint64)
    label[order] = (place - begin).astype(np.uint64)
    return np.where(label > 0, mix(own + label * np.uint64(0x9E3779B97F4A7C15)), own)


def sketch(own: np.ndarray) -> np.ndarray:
    """Hashes of the ordered samples; short texts have exact ones."""
    if len(own) <= SAMPLED:
        return _exact(own)
    chosen = np.empty((SKETCHES, SAMPLED), np.int64)
    for k, factor in enumerate(_FACTORS):
        hashed = own * factor
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        chosen[k] = np.argpartition(hashed, SAMPLED - 1)[:SAMPLED]
    chosen.sort(axis=1)
    out = mix(_in_order(own[chosen]) + np.arange(SKETCHES, dtype=np.uint64))
    return np.append(out, _exact(own)) if len(own) == SAMPLED + 1 else out


def _in_order(rows: np.ndarray) -> np.ndarray:
    """A hash of each row's values in order."""
    total = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        total = mix(total + column)
    return total


def _exact(own: np.ndarray) -> np.ndarray:
    """Hashes of all shingles (of at most ``SAMPLED``), and of all but each one, where a text of so
    many could link. With two more than ``SAMPLED`` = 6 the similarity is 6 / 8 at best."""
    size = len(own)
    out = _in_order(own[None, :])[:size <= SAMPLED]
    if 10 * (size - 1) >= 8 * size:
        rest = np.array([[k for k in range(size) if k != left] for left in range(size)])
        out = np.append(out, _in_order(own[rest]))
    return mix(out + np.uint64(SKETCHES))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, texts in text_parts(batch.column(1)):
            starts, ends, first = texts.words()
            words = texts.hashes(starts, ends)
            keys = np.zeros((2, stop - start), np.uint64)
            parts, sizes, keys_of = [], *np.zeros((2, stop - start), np.int64)
            for k, own in enumerate(shingles(texts)):
                if len(own):
                    inner = words[first[k]:first[k + 1]]
                    place = np.arange(1, len(inner) + 1, dtype=np.uint64)
                    keys[0, k] = mix(inner + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    keys[1, k] = mix(inner * np.uint64(3) + place * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                    parts.append(sketch(own))
                    sizes[k], keys_of[k] = len(own), len(parts[-1])
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            bounds = np.concatenate([[0], np.cumsum(keys_of)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, stop - start), as_long(keys[0]), as_long(keys[1]),
                 pa.array(sizes), list_of_long(flat, bounds)],
                ["doc_id", "key_a", "key_b", "n", "sketch"])


def matched(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence with all matches within the band: bit-parallel, one addition and a
    few logical operations on n-bit numbers per element of ``y``."""
    band = (len(x) + len(y)) // 9
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    front = int(differ[0]) if len(differ) else short
    x, y = x[front:], y[front:]
    short = min(len(x), len(y))
    if not short:
        return front
    differ = np.flatnonzero(x[::-1][:short] != y[::-1][:short])
    back = int(differ[0]) if len(differ) else short
    x, y = x[:len(x) - back], y[:len(y) - back]
    places: dict[int, int] = {}
    for i, value in enumerate(x.tolist()):
        places[value] = places.get(value, 0) | (1 << i)
    size = len(x)
    ones = (1 << size) - 1
    row = ones
    for j, value in enumerate(y.tolist()):
        match = places.get(value)
        if match is None:
            continue
        low = max(j - band, 0)
        match &= ((1 << (j + band + 1)) - 1) >> low << low
        hit = row & match
        row = ((row + hit) | (row - hit)) & ones
    return front + back + size - row.bit_count()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sequences link."""
    total = len(x) + len(y)
    if 10 * min(len(x), len(y)) < 8 * max(len(x), len(y)):
        return False
    if 9 * len(np.setxor1d(x, y, assume_unique=True)) > total:
        return False
    return 9 * matched(x, y) >= 4 * total


def differences(leader: np.ndarray, own: np.ndarray, link: bool, shortest: int,
                counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a member of a large bucket is dealt by: shingles the leader lacks, and shingles of the
    leader it lacks, where that matters. ``shortest``: shingles of the bucket's shortest member;
    ``counts``: texts that hold a shingle, by slot."""
    added, _, missing, _ = placed_differences(leader, own, link, shortest, counts)
    return added, missing


def placed_differences(leader: np.ndarray, own: np.ndarray, link: bool, shortest: int,
                       counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with the place of each among all of its kind, by rank."""
    added = np.setdiff1d(own, leader, assume_unique=True)
    missing = np.setdiff1d(leader, own, assume_unique=True)
    apart = len(added) + len(missing)
    beyond = 9 * apart - len(leader) - len(own)
    close = not link and beyond <= 8 * (len(leader) - max(shortest, 0.8 * len(own)))
    # same shingles in another order: no difference to share
    moved = np.full(int(4 * apart <= len(own)), _REORDERED, np.uint64)
    if len(own) >= len(leader) and not close:
        missing = missing[:0]
    often = counts[_slot(added)].astype(int)
    first = _first(added, often, len(own))
    added_at = np.flatnonzero(often[first] > 1)  # once: no other text holds it
    added = added[first[added_at]]
    missing = missing[_first(missing, -counts[_slot(missing)].astype(int), len(own))]
    return np.append(added, moved), np.append(added_at, np.zeros(len(moved), int)), missing, np.arange(len(missing))


def _first(values: np.ndarray, rank: np.ndarray, own: int) -> np.ndarray:
    """Places of the first ``own / 4 + 1`` values by rank, equal ones in hash order."""
    return np.lexsort((mix(values), rank))[:own // 4 + 1]


_CHECKED = "a long, b long, large boolean, n long, short boolean, linked boolean, added array<long>, missing array<long>, added_at array<int>, missing_at array<int>"


def _verify(batches: Iterator[pa.RecordBatch], counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``a, b, large, shortest, text_a, text_b`` to the columns of ``_CHECKED``; without ``counts`` no
    differences."""
    for batch in batches:
        for start, stop, texts in text_parts(batch.column(4)):
            rows = stop - start
            left = shingles(texts)
            right = [s for _, _, t in text_parts(batch.column(5).slice(start, rows)) for s in shingles(t)]
            part = batch.slice(start, rows)
            links, dealt_by = np.zeros(rows, bool), []
            none = (np.zeros(0, np.uint64), np.zeros(0, int)) * 2
            for k, (x, y, large, shortest) in enumerate(
                    zip(left, right, part.column(2).to_pylist(), part.column(3).to_pylist())):
                links[k] = linked(x, y)
                dealt = large and counts is not None
                dealt_by.append(placed_differences(x, y, links[k], shortest, counts) if dealt else none)
            added, added_at, missing, missing_at = zip(*dealt_by)
            bounds = [np.concatenate([[0], np.cumsum([len(p) for p in parts])]) for parts in (added, missing)]
            places = [pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))
                      for own, parts in zip(bounds, (added_at, missing_at))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([len(y) for y in right], pa.int64()),
                 pa.array([len(y) < len(x) for x, y in zip(left, right)], pa.bool_()), pa.array(links),
                 list_of_long(np.concatenate(added), bounds[0]), list_of_long(np.concatenate(missing), bounds[1]), *places],
                ["a", "b", "large", "n", "short", "linked", "added", "missing", "added_at", "missing_at"])


def _candidates(buckets: DataFrame, small: int) -> DataFrame:
    """``a, b, large, shortest`` from ``key, id, n, root``: pairs of different classes where few members
    are outside the bucket's largest class (``a < b``), else leader and member (large)."""
    # one shuffle serves the counts of classes, the sizes and the join with them
    buckets = buckets.repartition("key")
    parts = buckets.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("c"), F.min("n").alias("n"),
        *[F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark_{k}") for k in range(2)])
    rank = F.least(F.col("c"), F.lit(1 << 40)) * F.lit(1 << 20) + F.pmod(F.xxhash64("root"), F.lit(1 << 20))
    sizes = parts.groupBy("key").agg(
        F.sum("c").alias("size"), F.max("c").alias("largest"), F.max_by("root", rank).alias("main"), F.min("n").alias("shortest"),
        *[F.bit_xor(f"mark_{k}").alias(f"mark_{k}") for k in range(2)])
    # texts that share one shingle often share more: of buckets with the same members, by 128 bits, one stays
    apart = (sizes.filter("size > largest").groupBy("mark_0", "mark_1", "size")
             .agg(F.min(F.struct("key", "largest", "main", "shortest")).alias("one")).select("size", "one.*"))
    rows = stored(_of_buckets(buckets, sizes, apart).withColumn("open", F.col("root") != F.col("main")))
    few = rows.filter(F.col("size") - F.col("largest") <= small)
    direct = _direct(few).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"), F.lit(False).alias("large"),
                                 F.lit(0).cast("long").alias("shortest")).distinct()
    many = rows.filter(F.col("size") - F.col("largest") > small)
    met = many.groupBy("id").agg(F.sum("size").alias("met"))
    # ties by a hash, so that the leader does not depend on the order of rows
    rank = F.least(F.col("met"), F.lit(1 << 40)) * F.lit(1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    leaders = many.select("key", "id").join(met, "id").groupBy("key").agg(F.max_by("id", rank).alias("leader"))
    stars = many.join(leaders, "key").filter("id <> leader").groupBy(
        F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.lit(True).alias("large"), F.min("shortest").alias("shortest"))
    return direct.unionByName(stars.select("a", "b", "large", "shortest"))


def _of_buckets(buckets: DataFrame, sizes: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows of the buckets that stay. Where keys bound the sizes of partners, the widest bounds a member has
    in buckets of the same members count, as any of these may hold the first shingle that two texts share."""
    if "reach" not in buckets.columns:
        return buckets.join(apart, "key")
    marks = ["mark_0", "mark_1", "size"]
    same = sizes.filter("size > largest").select(F.col("key").alias("any_key"), *marks).join(
        sizes.select("key", *marks[:2]).join(apart, "key"), marks)
    rows = buckets.withColumnRenamed("key", "any_key").join(same.drop(*marks[:2]), "any_key")
    fixed = ["key", "id", "n", "root", "size", "largest", "main", "shortest"]
    return rows.groupBy(*fixed).agg(F.max("reach").alias("reach"), F.min("least").alias("least"))


def _direct(few: DataFrame) -> DataFrame:
    """Members of small buckets, ``id``, and open members they may link with, ``x``; repeated where texts
    share several buckets."""
    bounds = ["reach", "least"] if "reach" in few.columns else []
    asking = few.filter("open").select("key", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("root").alias("x_root"),
                                       *[F.col(c).alias(f"x_{c}") for c in bounds])
    met = few.join(asking, "key").filter(
        # a link needs sizes within the similarity of each other; of two open members one asks
        "root <> x_root AND 10 * least(n, x_n) >= 8 * greatest(n, x_n) AND (NOT open OR x < id)")
    return met.filter("n BETWEEN x_least AND x_reach AND x_n BETWEEN least AND reach") if bounds else met


def _roots(reps: DataFrame, texts_of: DataFrame, small: int) -> DataFrame:
    """``(id, root)`` of the representatives (``id, n, sketch``) that link with any other.

    What a round checked is one more folder of one table, and classes are merged by their roots, so
    neither plans nor work grow with the number of rounds.
    """
    spark = reps.sparkSession
    buckets = reps.select("id", "n", F.explode("sketch").alias("key"), F.col("id").alias("root"))
    texts = roots = checked = counts = None
    folders: list[str] = []
    while True:
        # later buckets are precise enough for more pairs a member; with the limit twice as high every
        # round, the number of rounds grows with the logarithm of what is left
        pairs = _candidates(buckets, small if checked is None else LATER * small << len(folders) - 1)
        if checked is not None:
            # leaders of the first round count as new: its members have been dealt by rarity instead
            known = checked.filter("NOT large OR round > 0").select("a", "b", "large")
            pairs = pairs.join(known, ["a", "b", "large"], "left_anti")
        pairs = stored(pairs)
        if pairs.isEmpty():
            return roots if roots is not None else reps.select("id", F.col("id").alias("root")).limit(0)
        if texts is None:
            # later rounds only meet documents of the first one's buckets
            ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
            near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
            texts = stored(texts_of.join(near, "id", "left_semi"))
        a, b = (texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        rows = pairs.join(b, "b").join(a, "a").select("a", "b", "large", "shortest", "text_a", "text_b")
        number = len(folders)
        folders.append(f"{shared_folder(spark)}/near-dup-{uuid.uuid4().hex}")
        rows.mapInArrow(functools.partial(_verify, counts=counts), _CHECKED).withColumn(
            "round", F.lit(number)).write.parquet(folders[-1])
        checked = spark.read.schema(f"{_CHECKED}, round int").parquet(*folders)
        roots = _merged(roots, spark.read.parquet(folders[-1]).filter("linked").select("a", "b"))
        placed = _placed(checked.filter("large"), roots)
        if number == 0:
            # members of the first round are dealt by rarity, those of later ones by differences
            own = _beside_open(placed, texts)
            counts = _counts(own)
            buckets = stored(_by_rarity(own, counts, roots))
        else:
            buckets = stored(_by_difference(placed.filter("round > 0"), number))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes with some more links."""
    if roots is None:
        return components(links)
    of = {s: roots.select(F.col("id").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    ends = stored(links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct())
    if ends.isEmpty():
        return roots
    higher = components(ends)
    up = higher.select(F.col("id").alias("root"), F.col("root").alias("upper"))
    moved = roots.join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("root"))
    return stored(moved.unionByName(higher.join(roots, "id", "left_anti")))


def _placed(checked: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaders and members with their classes so far. ``open``: not of the leader's class."""
    of = {s: roots.select(F.col("id").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    return checked.join(of["a"], "a", "left").join(of["b"], "b", "left").select(
        "a", F.col("b").alias("id"), "n", "short", "round", "added", "missing", "added_at", "missing_at",
        F.coalesce("root_b", "b").alias("root"), (F.coalesce("root_b", "b") != F.coalesce("root_a", "a")).alias("open"))


def _beside_open(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, open, text`` of all that share a leader with an open member. Of two members in different
    classes at least one is open."""
    leaders = placed.filter("open").select("a").distinct()
    members = placed.join(leaders, "a", "left_semi").select("id", "open")
    ids = members.unionByName(leaders.select(F.col("a").alias("id"), F.lit(False).alias("open")))
    return stored(texts.join(ids.groupBy("id").agg(F.max("open").alias("open")), "id").select("id", "text", "open"))


def _counts(own: DataFrame) -> np.ndarray:
    """In how many texts a shingle of a slot is, up to 255."""
    found = own.mapInArrow(_count_shingles, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(SLOTS, np.uint8)
    counts[found.slot.to_numpy()] = np.minimum(found.c.to_numpy(), 255)
    return counts


def _by_rarity(own: DataFrame, counts: np.ndarray, roots: DataFrame) -> DataFrame:
    """Buckets of the rarest shingles, where an open member meets another class."""
    rows = own.select("id", "text", "open").mapInArrow(_rarest(counts), "id long, open boolean, n long, reach long, key long")
    rows = stored(rows.join(roots, "id", "left").select("key", "id", "n", "reach", "open", F.coalesce("root", "id").alias("root")))
    for _ in range(NARROWED):
        crowd = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                        F.max("open").alias("any_open"), F.min("n").alias("shortest"))
        rows = stored(rows.join(crowd.filter("any_open AND low <> high").select("key", "shortest"), "key")
                      .filter("reach >= shortest").drop("shortest"))
    return rows.drop("open").withColumn("least", F.expr("(4 * n + 4) div 5"))


def _slot(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int32)
    for batch in batches:
        for _, _, texts in text_parts(batch.column(1)):
            for own in shingles(texts):
                counts[_slot(own)] += 1  # a text counts once for a slot
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), pa.array(counts[seen].astype(np.int64))], ["slot", "c"])


def _rarest(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_parts(batch.column(1)):
                which, sizes, reaches, keys = [], [], [], []
                for k, own in enumerate(shingles(texts)):
                    dealt, reach = rare_keys(own, counts[_slot(own)])
                    which += [start + k] * len(dealt)
                    sizes += [len(own)] * len(dealt)
                    reaches.append(reach)
                    keys.append(dealt)
                which = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(2).take(which), pa.array(sizes, pa.int64()),
                     pa.array(np.concatenate(reaches)), as_long(np.concatenate(keys))], ["id", "open", "n", "reach", "key"])

    return run


def rare_keys(own: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a text's rarest shingles for each class of sizes its partners may have, and the size of
    the largest partner of each key.

    Texts of n and m shingles that link share 4 (n + m) / 9 of them, so the first they share, by
    rarity, has so many less one behind it in both: at place p, m <= (5 n - 9 p) / 4.
    """
    n = len(own)
    order = np.lexsort((own, often))[:n // 5 + 1]
    place = np.flatnonzero(often[order] > 1)  # once: no other text holds it
    values, reach = own[order[place]], (5 * n - 9 * place) // 4
    class_of = np.searchsorted(_SIZES, reach, side="right")
    mine, least = np.searchsorted(_SIZES, [n, -(-4 * n // 5)], side="right")
    keys, reaches = [values[:0]], [reach[:0]]
    for other in range(least, int(class_of.max(initial=0)) + 1):
        fit = class_of >= other
        both = int(min(mine, other)) * len(_SIZES) + int(max(mine, other)) + 1
        keys.append(mix(values[fit] + np.uint64(both * 0x9E3779B97F4A7C15 % 2**64)))
        reaches.append(reach[fit])
    return np.concatenate(keys), np.concatenate(reaches).astype(np.int64)


def _by_difference(placed: DataFrame, number: int) -> DataFrame:
    """Members by (leader, difference), where a link between classes may still be missing and a
    member is new this round. Leaders without a new or without an open member have been dealt with."""
    asked = placed.groupBy("a").agg(F.max("round").alias("last"), F.max("open").alias("any_open"))
    placed = placed.join(asked.filter(F.col("any_open") & (F.col("last") == number)).select("a"), "a", "left_semi")

    def by(kind: str) -> DataFrame:
        # the first added one that two texts share has all before it in one of them only, and the other
        # lacks that many less than it has more; the first missing one likewise, the other way round
        reach, least = ("(5 * n - 9 * at) div 4", "(4 * n + 4) div 5") if kind == "added" else ("5 * n div 4", "(4 * n + 9 * at + 4) div 5")
        return (placed.select("a", "id", "n", "short", "root", "open", "round", F.explode(F.arrays_zip(kind, f"{kind}_at")).alias("one"))
                .select("*", F.col(f"one.{kind}").alias("value"), F.col(f"one.{kind}_at").alias("at"))
                .select(F.xxhash64(F.lit(kind), "a", "value").alias("key"), "id", "n", "root", "open", "round",
                        (F.lit(kind == "added") | F.col("short")).alias("fit"),
                        F.expr(reach).alias("reach"), F.expr(least).alias("least")))

    rows = by("added").unionByName(by("missing"))
    keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("open").alias("any_open"),
                                   F.max("fit").alias("fit"), F.max("round").alias("last"))
    keys = keys.filter(F.expr("low <> high AND any_open AND fit") & (F.col("last") == number)).select("key")
    return rows.join(keys, "key", "left_semi").groupBy("key", "id", "n", "root").agg(
        F.max("reach").alias("reach"), F.min("least").alias("least"))


def classes(documents: DataFrame, small: int = SMALL) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``documents``.

    ``class_id`` is the smallest ``doc_id`` reachable by links, and ``kept`` marks that document.
    Equal word sequences link. Texts without a word (null, empty, blank) link with nothing. Rows
    with a null ``doc_id`` have a null class and are kept. Repeated rows share a class; of rows with
    one id and several texts the smallest class counts.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    known = slim.filter("doc_id IS NOT NULL")
    rows = stored(known.mapInArrow(
        _sketches, "doc_id long, key_a long, key_b long, n long, sketch array<long>"))
    key = ["key_a", "key_b"]
    reps = stored(rows.filter("n > 0").groupBy(*key).agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    roots = _roots(reps, known.select(F.col("doc_id").alias("id"), "text"), small)
    same = rows.filter("n > 0").join(reps.select(*key, "id"), key).select("doc_id", "id").distinct()
    own = (same.join(roots, "id", "left").groupBy("doc_id")
           .agg(F.min(F.coalesce("root", "id")).alias("class_id")))
    result = rows.select("doc_id").join(own, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    nameless = slim.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return result.unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``documents``; one row for each kept id."""
    judged = stored(classes(documents))
    dropped = judged.filter(~F.col("kept")).select("doc_id").distinct()
    left = documents.join(dropped, "doc_id", "left_anti").select(*documents.columns)
    repeated = judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return left
    named = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(left.filter("doc_id IS NULL"))
