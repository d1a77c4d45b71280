"""What each filter of a chain removes, in every order the chain could have.

A text is reduced to one number, whose bits say which filters it fails. Spark counts these masks per
part, so a part, however large, is at most 2**n rows. From them a decision diagram is built: a level
tests one filter, an edge leads to the texts that pass or fail it, and equal subgraphs are one node
that carries the counts of the texts below it. The path of passes from the root down is a chain of
filters in the diagram's order: each of its nodes gives one step, the node's fail edge what that step
removes. All orders come from one diagram by swapping neighbouring levels, one swap for each order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import narrow

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_COUNTS = ("n", "good", "toxic")
_STEP = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _STEP)


class Diagram:
    """A decision diagram over failure masks whose leaves are tuples of counts.

    ``order`` is the filter (bit number) of each level. A node is (pass child, fail child); below the
    last level stand the leaves. Nodes are kept once per content, and every path visits every level.
    """

    def __init__(self, filters: int, masks: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(filters))
        self.nodes: list[tuple[int, int] | None] = []  # None: a leaf
        self.weight: list[tuple[int, ...]] = []
        self._known: dict = {}
        nothing = (0,) * width
        below = [self._leaf(masks.get(self._mask(path), nothing)) for path in range(1 << filters)]
        for _ in range(filters):
            below = [self._node(a, b) for a, b in zip(below[::2], below[1::2])]
        self.root = below[0]

    def _mask(self, path: int) -> int:
        """A path holds the first level in its highest bit; in a mask, filter k is bit k."""
        last = len(self.order) - 1
        return sum(1 << k for level, k in enumerate(self.order) if path >> (last - level) & 1)

    def _leaf(self, counts: tuple[int, ...]) -> int:
        return self._kept(("leaf", counts), None, counts)

    def _node(self, passed: int, failed: int) -> int:
        weight = tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed]))
        return self._kept((passed, failed), (passed, failed), weight)

    def _kept(self, key, node, weight) -> int:
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.nodes)
            self.nodes.append(node)
            self.weight.append(weight)
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one."""
        self.root = self._swapped(self.root, level, {})
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def _swapped(self, node: int, level: int, done: dict[int, int]) -> int:
        if node not in done:
            passed, failed = self.nodes[node]
            if level:
                done[node] = self._node(self._swapped(passed, level - 1, done), self._swapped(failed, level - 1, done))
            else:
                (a, b), (c, d) = self.nodes[passed], self.nodes[failed]
                done[node] = self._node(self._node(a, c), self._node(b, d))
        return done[node]

    def passes(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
        """Per level: its filter, the counts that pass all filters so far, the counts this one
        removes, and the node of the removed."""
        node = self.root
        for k in self.order:
            passed, failed = self.nodes[node]
            yield k, self.weight[passed], self.weight[failed], failed
            node = passed

    def all_passed(self, node: int) -> tuple[int, ...]:
        """Counts below a node that pass all filters of the levels below it."""
        while self.nodes[node] is not None:
            node = self.nodes[node][0]
        return self.weight[node]


def _neighbour_swaps(count: int) -> Iterator[int]:
    """Levels to swap so that every order of ``count`` things is met once (plain changes)."""
    places, facing = list(range(count)), [-1] * count
    while True:
        moving = [k for k in places if 0 <= places.index(k) + facing[k] < count
                  and places[places.index(k) + facing[k]] < k]
        if not moving:
            return
        k = max(moving)
        at = places.index(k)
        to = at + facing[k]
        places[at], places[to] = places[to], places[at]
        for other in range(k + 1, count):
            facing[other] = -facing[other]
        yield min(at, to)


def audit_part(masks: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, *_STEP) for every order of the filters, from counts (rows, good, toxic)
    per failure mask."""
    diagram = Diagram(len(filters), masks, len(_COUNTS))
    swaps = _neighbour_swaps(len(filters))
    rows, total = [], [0] * len(filters)
    fails = {}
    # the filter tested first removes all it fails, and those that pass all others fail it alone
    alone = {}
    while True:
        steps = list(diagram.passes())
        first, _, (failing, *_), below = steps[0]
        fails[first], alone[first] = failing, diagram.all_passed(below)[0]
        name = "".join(filters[k] for k in diagram.order)
        for number, (k, kept, removed, _) in enumerate(steps, 1):
            total[k] += removed[0]
            rows.append((name, number, k, kept[0], *removed))
        level = next(swaps, None)
        if level is None:
            break
        diagram.swap(level)
    return [(name, step, kept, gone, fails[k] - gone, alone[k], good, toxic, total[k])
            for name, step, k, kept, gone, good, toxic in rows]


def _failures(text: Column) -> Column:
    """Mask of the filters A to D, which need nothing but the text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    checks = F.transform(F.array(words), lambda w: (
        F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
        + F.when(F.size(F.array_distinct(w)).cast("long") * 100 < F.size(w).cast("long") * MIN_DISTINCT, 2).otherwise(0)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return (
        F.get(checks, F.lit(0))
        + F.when(capitals * 100 > F.length(text).cast("long") * MAX_CAPITALS, 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    )


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part and failure mask, and those labelled so.

    The text is read once, where it lies; only ids, masks and digests are moved. A text that a
    smaller id has as well fails E. Equal texts have equal masks, so it is enough to count the rows
    of a digest and part and to tell those of the smallest id apart, which partial aggregation does
    before a shuffle: a text that a third of all rows share is a row per task and part.
    """
    text = F.coalesce("text", F.lit(""))
    rows = narrow(documents, "doc_id", "text", "source").select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), _failures(text).alias("fails"))
    marks = narrow(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("int").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("toxic"))
    zero = F.lit(0)
    known = rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "fails", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    # rows of one id are together already, for the join
    per_id = known.groupBy("doc_id", "part", "digest", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    counts = [F.col("n"), F.col("n") * F.col("good"), F.col("n") * F.col("toxic")]
    own = F.struct("doc_id", *[c.alias(name) for name, c in zip(_COUNTS, counts)])
    no_id = F.col("doc_id").isNull()
    groups = per_id.groupBy("digest", "part", "fails").agg(
        F.min(F.when(~no_id, own)).alias("least"),
        *[F.sum(c).alias(name) for name, c in zip(_COUNTS, counts)],
        *[F.sum(F.when(no_id, c).otherwise(0)).alias(f"free_{name}") for name, c in zip(_COUNTS, counts)])
    smallest = groups.groupBy("digest").agg(F.min("least.doc_id").alias("doc_id"))
    first = F.col("least.doc_id") == F.col("doc_id")
    passing = [F.col(f"free_{c}") + F.when(first, F.col(f"least.{c}")).otherwise(0) for c in _COUNTS]
    twice = 1 << FILTERS.index("E")
    split = F.array(
        F.struct(F.col("fails").alias("mask"), *[p.alias(c) for c, p in zip(_COUNTS, passing)]),
        F.struct((F.col("fails") + twice).alias("mask"), *[(F.col(c) - p).alias(c) for c, p in zip(_COUNTS, passing)]))
    return (groups.join(smallest, "digest").select("part", F.explode(split).alias("m")).filter("m.n > 0")
            .groupBy("part", "m.mask").agg(*[F.sum(f"m.{c}").alias(c) for c in _COUNTS]))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step, with what that step keeps and removes.

    Parts are the values of ``source``; null is the empty string. Null texts count as empty. Every
    row counts, repeated ones too; rows of one id and text do not fail E for each other, and a null
    id is neither smaller than any nor has a smaller one, nor a label. An id with several label rows is good, or
    toxic, if one of them says so. Extra columns are not read; no rows give no rows.
    """
    parts = masks(documents, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", *_COUNTS)).alias("masks"))  # at most 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audit_part({m["mask"]: tuple(m[c] for c in _COUNTS) for m in listed})
                columns = [pa.array(c) for c in zip(*rows)]
                columns[1] = columns[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows)), *columns], ["part", "filter_order", "step", *_STEP])

    return parts.mapInArrow(run, _OUT)
