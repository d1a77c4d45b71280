"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes belong to the ``OVERLAP`` nearest of the clusters found in a bounded
sample. Clusters that lie next to each other make a region, and a node goes once to each region that
holds one of its clusters; what a region needs is then in one task. There each cluster is a block, or
overlapping blocks of ``BLOCK`` nodes; in every block each node's nearest candidates are robust-pruned
to short adjacency lists, and the lists of all blocks of the region are united. Every node of the
region is searched in that graph: greedy search from the medoids of its blocks and from itself, then
range expansion over everything near enough. A search that comes near to nodes of a region its own
node is not in goes on there. Each pair found is verified in double precision, so recall is the only
thing that is approximate. It is audited within the operator: the nodes of all ids divisible by
``AUDITED`` are compared with every node by brute force. While too few of their links were found, the
graph is built again with twice the overlap, and what it finds is added.

Disk: vectors keep their type and move once to be one node each, and once to their regions, in
``WAVES`` parts of the regions; shuffle files go when a step is stored. Lists, neighbours and searches
stay in their task, so none of them is ever written.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import mix
from boardwalk.llm.components import components
from boardwalk.session import stored

COSINE = 0.9
SAMPLE = 20_000  # vectors that clusters are fitted on
CLUSTER = 1_000  # mean nodes of a cluster
MOST_CLUSTERS = 2_000  # bounds the broadcast centroids; larger tables get more blocks a cluster
OVERLAP = 3
BLOCK = 2_048
CANDIDATES = 48
DEGREE = 24
ALPHA = 1.2
BEAM = 24
AT_ONCE = 8  # nodes of the beam that are expanded together
SLACK = 0.05  # range expansion passes through nodes that are this much too far
AUDITED = 100  # ids divisible by this are the queries of the audit
AUDIT_BLOCK = 10_000  # audit queries, on average, that travel to the tasks of one job
TARGET = 0.95  # recall below which the graph is built again
REGION = (4, 24)  # clusters of mean size in a region, of a small and of a large table
REGIONS = 128  # beyond that many regions they grow, so that each wave has tasks for many cores
LARGEST = 100_000  # nodes in a task, about; beyond that a region is dealt into parts that search each other
WAVES = 8  # parts, at most, in which the regions of a table are searched one after the other
WAVE_MB = 64  # of vectors in a wave, at least
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

HELD, ASKED, BOTH = 0, 1, 2  # a row's part in a search: a node, a query, or both
PLACES = "region int, part int, asked int, id long, vector array<{}>, clusters array<int>, role int, starts array<long>"


def _settled(df: DataFrame) -> DataFrame:
    """``stored``; the shuffle files it took go at its end, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(df)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def _nodes(vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct comparable vectors of one length as ``(id, key, vector)``, and which rows they stand for
    as ``(vec_id, id)``."""
    rows = vectors.filter(F.size("embedding") == size)
    nodes = _settled(rows.groupBy("key").agg(F.min("vec_id").alias("id"), F.first("embedding").alias("vector")))
    members = rows.select("vec_id", "key").distinct().join(nodes.select("key", "id"), "key").select("vec_id", "id")
    return nodes, _settled(members.distinct())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
        names, lists = batch.columns
        # zeros have no sign here, so that equal vectors have equal bytes; nulls are no numbers
        values = lists.flatten().to_numpy(zero_copy_only=False) + 0.0
        ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)]))
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[ends]
        some = np.concatenate([[0], np.cumsum(values != 0)])[ends]
        fine = np.flatnonzero((odd[1:] == odd[:-1]) & (some[1:] > some[:-1]))
        keys = [hashlib.sha256(values[ends[k]:ends[k + 1]].tobytes()).digest() for k in fine]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(fine)), pa.array(keys, pa.binary()), lists.take(pa.array(fine))],
            names=["vec_id", "key", "embedding"])


def comparable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, key, embedding`` of the vectors that can link: not null, without null or non-finite
    components, not zero, with an id. ``key`` is equal for equal vectors only. Floats stay floats."""
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.mapInArrow(_pack, f"vec_id long, key binary, embedding array<{kind}>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centroids(nodes: DataFrame, count: int) -> np.ndarray:
    """Unit centroids of clusters by a few rounds of k-means over a bounded sample, chosen by hash."""
    drawn = F.xxhash64("id")
    if count > 4 * SAMPLE:
        # about twice the sample stays, so that not every task sends one to be ordered
        few = nodes.filter(drawn < int((2 * SAMPLE / count - 0.5) * 2.0**64))
        nodes = few if few.count() >= SAMPLE else nodes
    sample = _unit(_matrix(nodes.orderBy(drawn).limit(SAMPLE).select("vector").toArrow()["vector"]))
    clusters = max(1, min(MOST_CLUSTERS, math.ceil(count / CLUSTER), len(sample)))
    centers = sample[:clusters].copy()
    for _ in range(8):
        own = np.argmax(sample @ centers.T, axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(length > 0, total / np.maximum(length, 1e-30), centers)
    return centers


def _nearest(unit: np.ndarray, centers: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centers of each vector, nearest first."""
    similar = unit @ centers.T
    if count < len(centers):
        top = np.argpartition(-similar, count - 1, axis=1)[:, :count]
    else:
        top = np.broadcast_to(np.arange(len(centers)), similar.shape)
    order = np.argsort(-np.take_along_axis(similar, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def _assign(centers: np.ndarray, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = min(overlap, len(centers))
        for batch in batches:
            if batch.num_rows:
                own = _nearest(_unit(_matrix(batch.column("vector"))), centers, near)
                lists = _lists(own.ravel(), np.arange(0, own.size + 1, near), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), lists],
                                                 names=["id", "vector", "clusters"])

    return run


def regions(centers: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """Region of each cluster: the heaviest region is halved at the middle of its nodes, along the
    direction its centroids spread most in, until there are ``count``."""
    groups = [np.arange(len(centers))]
    loads = [float(sizes.sum())]
    while len(groups) < min(count, len(centers)):
        k = max((k for k, g in enumerate(groups) if len(g) > 1), key=loads.__getitem__)
        group = groups[k]
        spread = centers[group] - centers[group].mean(axis=0)
        group = group[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
        total = np.cumsum(sizes[group])
        cut = 1 + int(np.argmin(np.abs(total[:-1] - total[-1] / 2)))
        groups[k:k + 1] = [group[:cut], group[cut:]]
        loads[k:k + 1] = [float(total[cut - 1]), float(total[-1] - total[cut - 1])]
    out = np.zeros(len(centers), np.int32)
    for k, group in enumerate(groups):
        out[group] = k
    return out


def _deal(region_of: np.ndarray, parts: np.ndarray, chosen: np.ndarray, asked: bool):
    """Rows of the regions that are ``chosen``: a node is held by one part of each of its regions. With
    ``asked`` it is a query too, in every part, so the node travels with each part that asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.sort(region_of[_matrix(batch.column("clusters"))], axis=1)
            first = np.ones(places.shape, bool)
            first[:, 1:] = places[:, 1:] != places[:, :-1]
            rows, at = np.nonzero(first & chosen[places])
            region = places[rows, at]
            count = parts[region].astype(np.int64)
            names = batch.column("id").to_numpy()[rows]
            own = (mix(names.view(np.uint64)) % count.astype(np.uint64)).astype(np.int64)
            if asked:
                again = np.repeat(np.arange(len(rows)), count)
                other = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                far = np.flatnonzero(other != own[again])
                pick = np.concatenate([again, again[far]])
                part = np.concatenate([own[again], other[far]])
                asker = np.concatenate([other, own[again[far]]])
                role = np.concatenate([np.where(other == own[again], BOTH, HELD), np.full(len(far), ASKED)])
            else:
                pick, part, asker, role = np.arange(len(rows)), own, np.zeros(len(rows)), np.full(len(rows), HELD)
            take = pa.array(rows[pick])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int32()) for x in (region[pick], part, asker.astype(np.int32))]
                + [batch.column(n).take(take) for n in ("id", "vector", "clusters")]
                + [pa.array(role, pa.int32()), pa.nulls(len(pick), pa.list_(pa.int64()))],
                names=["region", "part", "asked", "id", "vector", "clusters", "role", "starts"])

    return run


def robust_prune(unit: np.ndarray) -> list[np.ndarray]:
    """Adjacency of each vector: its nearest candidates, without those that a nearer kept one covers
    (``ALPHA`` times nearer to it), both ways, and all reachable from the medoid."""
    count = len(unit)
    single = unit.astype(np.float32)
    width = min(CANDIDATES, count - 1)
    pairs = [np.zeros(0, np.int64)]  # a * count + b
    for low in range(0, count if width > 0 else 0, 256):
        similar = single[low:low + 256] @ single.T
        rows = np.arange(len(similar))
        similar[rows, rows + low] = -2
        top = np.argpartition(-similar, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(similar, top, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        candidates, far = np.take_along_axis(top, order, axis=1), 1.0 - np.take_along_axis(own, order, axis=1)
        near = single[candidates]
        between = 1.0 - near @ near.transpose(0, 2, 1)
        alive = np.ones(candidates.shape, bool)
        taken = np.zeros(candidates.shape, bool)
        for c in range(width):
            taken[:, c] = alive[:, c] & (taken.sum(axis=1) < DEGREE)
            alive &= (ALPHA * between[:, c] > far) | ~taken[:, c, None]
        of, at = np.nonzero(taken)
        a, b = of + low, candidates[of, at]
        pairs += [a * count + b, b * count + a]
    a, b = np.divmod(np.unique(np.concatenate(pairs)), max(1, count))
    ends = np.searchsorted(a, np.arange(count + 1))
    out = [b[ends[k]:ends[k + 1]] for k in range(count)]
    seen = np.zeros(count, bool)
    fresh = np.array([medoid(unit)])
    while True:
        while len(fresh):
            seen[fresh] = True
            fresh = np.unique(np.concatenate([out[k] for k in fresh.tolist()]))
            fresh = fresh[~seen[fresh]]
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return out
        # tie what is apart to the nearest node that is not
        inside = np.flatnonzero(seen)
        other = int(rest[0])
        best = int(inside[np.argmax(single[inside] @ single[other])])
        out[best], out[other] = np.union1d(out[best], [other]), np.union1d(out[other], [best])
        fresh = np.array([other])


def medoid(unit: np.ndarray) -> int:
    return int(np.argmax(unit @ unit.mean(axis=0)))


def range_search(query: np.ndarray, unit: np.ndarray, near: list[np.ndarray], starts: list[int],
                 least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with a cosine of ``least - SLACK`` or more, and their cosines: best-first search with a beam
    from ``starts``, then expansion of all that is within ``SLACK`` of the range."""
    seen = np.zeros(len(unit), bool)
    last = np.empty(len(unit), np.int64)  # of a node that is met several times, the last one counts
    fresh = np.array(sorted(set(starts)))
    waiting: list[tuple[float, int]] = []
    best: list[float] = []
    hits: list[int] = []
    scores: list[float] = []
    while True:
        seen[fresh] = True
        similar = unit[fresh] @ query
        if len(best) >= BEAM:
            worth = similar > min(best[0], least - SLACK - 1e-12)
            fresh, similar = fresh[worth], similar[worth]
        for n, s in zip(fresh.tolist(), similar.tolist()):
            if s >= least - SLACK:
                hits.append(n)
                scores.append(s)
            if s >= least - SLACK or len(best) < BEAM or s > best[0]:
                heapq.heappush(waiting, (-s, n))
                if len(best) < BEAM:
                    heapq.heappush(best, s)
                else:
                    heapq.heappushpop(best, s)
        fresh = fresh[:0]
        while not len(fresh):
            # a few of the nearest at a time
            turn: list[np.ndarray] = []
            while waiting and len(turn) < AT_ONCE:
                score = waiting[0][0]
                if -score < least - SLACK and len(best) >= BEAM and -score < best[0]:
                    break
                turn.append(near[heapq.heappop(waiting)[1]])
            if not turn:
                return np.array(hits, np.int64), np.array(scores)
            fresh = np.concatenate(turn)
            fresh = fresh[~seen[fresh]]
            last[fresh] = np.arange(len(fresh))
            fresh = fresh[last[fresh] == np.arange(len(fresh))]


def _blocks(unit: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The blocks of a cluster, by the places of its nodes: all of it, or overlapping neighbourhoods of
    about ``BLOCK`` nodes. One that is larger still comes as several blocks."""
    if len(unit) <= BLOCK:
        yield [np.arange(len(unit))]
        return
    single = unit.astype(np.float32)
    count = math.ceil(2 * len(unit) / BLOCK)
    centers = single[np.linspace(0, len(unit) - 1, count).astype(np.int64)].copy()
    for _ in range(4):
        own = np.argmax(single @ centers.T, axis=1)
        for c in range(count):
            if (own == c).any():
                mean = single[own == c].mean(axis=0)
                centers[c] = mean / max(float(np.linalg.norm(mean)), 1e-30)
    own = _nearest(single, centers, 2)
    for c in range(count):
        block = np.flatnonzero((own == c).any(axis=1))
        pieces = math.ceil(len(block) / BLOCK)
        if pieces:
            yield [block[k::pieces] for k in range(pieces)]


def _graph(unit: np.ndarray, clusters: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[int]]]:
    """United adjacency lists of all blocks of all clusters, and for each node the medoids it is searched from."""
    lists: list[list[np.ndarray]] = [[] for _ in range(len(unit))]
    starts: list[list[int]] = [[] for _ in range(len(unit))]
    for members in clusters:
        for block in _blocks(unit[members]):
            from_here = []
            for piece in block:
                piece = members[piece]
                for node, own in zip(piece.tolist(), robust_prune(unit[piece])):
                    lists[node].append(piece[own])
                from_here.append(int(piece[medoid(unit[piece])]))
            for node in members[np.concatenate(block)].tolist():
                starts[node] += from_here
    return [np.unique(np.concatenate(n)) if n else np.zeros(0, np.int64) for n in lists], starts


_FOUND = ["id", "found", "root", "region", "vector", "clusters"]


def _search(region_of: np.ndarray):
    """Searches of one (part of a region, part that asks): linked ids of each node and the smallest id it is
    linked to here over any chain, either end of a link having one row; and, with a region, searches to go on there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("id")
        role = table["role"].to_numpy()
        held, queries = table.filter(pa.array(role != ASKED)), table.filter(pa.array(role != HELD))
        if not held.num_rows or not queries.num_rows:
            return
        ids, first = np.unique(held["id"].to_numpy(), return_index=True)
        unit, clusters = _unit(_matrix(held["vector"]))[first], _matrix(held["clusters"])[first]
        here = table["region"][0].as_py()
        inside = [np.flatnonzero((clusters == c).any(axis=1)) for c in np.unique(clusters).tolist() if region_of[c] == here]
        near, starts = _graph(unit, inside)
        every = sorted({s for own in starts for s in own})
        names, asks = queries["id"].to_numpy(), queries["starts"]
        own_clusters = _matrix(queries["clusters"])
        query_units = _unit(_matrix(queries["vector"]))
        ahead: list[tuple[int, int, np.ndarray]] = []
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, name in enumerate(names.tolist()):
            given = asks[k].as_py()
            at = np.searchsorted(ids, np.array([name] if given is None else given, np.int64))
            at = [p for p, n in zip(at.tolist(), [name] if given is None else given) if p < len(ids) and ids[p] == n]
            begin = at if given is not None and at else at + starts[at[0]] if at else every
            hits, scores = range_search(query_units[k], unit, near, begin, COSINE)
            other = ids[hits] != name
            hits, scores = hits[other], scores[other]
            linked = ids[hits[scores >= COSINE]]
            if len(linked):
                src.append(np.full(len(linked), name))
                dst.append(linked)
            if given is None and len(hits):
                places = region_of[clusters[hits]]
                away = ~np.isin(places, region_of[own_clusters[k]])
                for region in np.unique(places[away]).tolist():
                    through = np.flatnonzero((places == region).any(axis=1))
                    through = through[np.argsort(-scores[through], kind="stable")[:BEAM]]
                    ahead.append((k, region, ids[hits[through]]))
        yield from _rows(np.concatenate(src), np.concatenate(dst), table.schema)
        for low in range(0, len(ahead), 10_000):
            some = ahead[low:low + 10_000]
            rows = queries.take(pa.array([k for k, _, _ in some])).combine_chunks()
            ends = np.cumsum([0] + [len(through) for _, _, through in some])
            yield pa.RecordBatch.from_arrays(
                [rows["id"].combine_chunks(), _lists(np.concatenate([x[2] for x in some]), ends, pa.int64()),
                 pa.nulls(len(some), pa.int64()), pa.array([x[1] for x in some], pa.int32()),
                 rows["vector"].combine_chunks(), rows["clusters"].combine_chunks()], names=_FOUND)

    return run


def _rows(src: np.ndarray, dst: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Links as one row for each node that has any, in the order of ids."""
    ids = np.unique(np.concatenate([src, dst]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    codes = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
    a, b = np.divmod(codes, max(1, len(ids)))
    ends = np.searchsorted(a, np.arange(len(ids) + 1))
    root = np.full(len(ids), -1)
    for node in range(len(ids)):
        if root[node] >= 0:
            continue
        root[node] = node
        stack = [node]
        while stack:
            k = stack.pop()
            fresh = b[ends[k]:ends[k + 1]]
            fresh = fresh[root[fresh] < 0]
            root[fresh] = node
            stack += fresh.tolist()
    low = 0
    while low < len(ids):
        # a batch has a million links, or one node
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 20), side="right")) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[low:high]), _lists(ids[b[ends[low]:ends[high]]], ends[low:high + 1] - ends[low], pa.int64()),
             pa.array(ids[root[low:high]]), pa.nulls(high - low, pa.int32()),
             *(pa.nulls(high - low, schema.field(n).type) for n in _FOUND[4:])], names=_FOUND)
        low = high


def links(nodes: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``(id, found, root)`` per node and region: linked ids, and the smallest of them all here. Both ends of a
    link have it."""
    count = nodes.count()
    if not count:
        return nodes.select("id", F.array("id").alias("found"), F.col("id").alias("root"))
    centers = centroids(nodes, count)
    kind = nodes.schema["vector"].dataType.elementType.simpleString()
    assigned = _settled(nodes.select("id", "vector").mapInArrow(
        _assign(centers, overlap), f"id long, vector array<{kind}>, clusters array<int>"))
    sizes = np.zeros(len(centers), np.int64)
    for row in assigned.select(F.explode("clusters").alias("c")).groupBy("c").count().collect():
        sizes[row[0]] = row[1]
    share = min(REGION[1], max(REGION[0], count // (REGIONS * CLUSTER)))
    region_of = regions(centers, sizes, math.ceil(count / (share * CLUSTER)))
    loads = np.bincount(region_of, weights=sizes)
    parts = np.maximum(1, np.ceil(loads / LARGEST)).astype(np.int64)
    mb = sizes.sum() * centers.shape[1] * (4 if kind == "float" else 8) / 2**20
    waves = int(min(WAVES, len(loads), max(1, math.ceil(mb / WAVE_MB))))
    turn = np.argsort(np.argsort(-loads, kind="stable"), kind="stable") % waves  # regions of all sizes in each wave
    columns = PLACES.format(kind)

    def searched(rows: DataFrame, groups: int) -> DataFrame:
        # more partitions than groups, so that few of them share one; a number given is not coalesced
        dealt = rows.repartition(max(1, min(2 * groups, 2_000)), "region", "part", "asked").groupBy("region", "part", "asked")
        return _settled(dealt.applyInArrow(
            _search(region_of), f"id long, found array<long>, root long, region int, vector array<{kind}>, clusters array<int>"))

    found = [searched(assigned.mapInArrow(_deal(region_of, parts, turn == w, True), columns), int((parts[turn == w] ** 2).sum()))
             for w in range(waves)]
    ahead = found[0]
    for part in found[1:]:
        ahead = ahead.unionByName(part)
    ahead = ahead.filter(F.col("region").isNotNull())
    wanted = np.zeros(len(loads), bool)
    wanted[[r[0] for r in ahead.select("region").distinct().collect()]] = True
    for w in range(waves):
        chosen = wanted & (turn == w)
        if chosen.any():
            held = assigned.mapInArrow(_deal(region_of, parts, chosen, False), columns)
            asked = ahead.filter(F.col("region").isin(np.flatnonzero(chosen).tolist())).select(
                "region", F.explode(F.sequence(F.lit(0), F.lit(int(parts.max()) - 1))).alias("part"), F.lit(0).alias("asked"),
                "id", "vector", "clusters", F.lit(ASKED).alias("role"), F.col("found").alias("starts"))
            found.append(searched(held.unionByName(asked), int(parts[chosen].sum())))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("root").isNotNull()).select("id", "found", "root")


def _near_counts(names: np.ndarray, wanted: np.ndarray):
    """Per part of the nodes, how many links of all queries together lie in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vector")))
            for low in range(0, len(names), 512):
                total += int((unit @ wanted[low:low + 512].T >= COSINE).sum())
            total -= int(np.isin(names, batch.column("id").to_numpy()).sum())  # each query and itself
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return run


def _audited(members: DataFrame) -> DataFrame:
    return members.filter(F.col("vec_id") % AUDITED == 0).select("id").distinct()


def audit(nodes: DataFrame, members: DataFrame, pairs: DataFrame) -> float:
    """Recall of ``pairs`` (id, other): the share of the links between different vectors, with one end
    an audited node, that are among them. Brute force goes over all nodes, in blocks of queries."""
    queries = _settled(_audited(members).join(nodes.select("id", "vector"), "id"))
    blocks = math.ceil(queries.count() / AUDIT_BLOCK)
    links_of = 0
    for number in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        if len(block):
            count = _near_counts(block["id"].to_numpy(), _unit(_matrix(block["vector"])))
            links_of += nodes.select("id", "vector").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    if not links_of:
        return 1.0
    both = pairs.union(pairs.select("other", "id")).join(queries.select("id"), "id", "left_semi")
    # at the very limit the two ways to multiply may round apart
    return min(1.0, both.distinct().count() / links_of)


def audited_links(nodes: DataFrame, members: DataFrame, overlap: int) -> tuple[DataFrame, float]:
    """``links``, with more overlap until the audit is content or every node is in every cluster, and
    the recall at the end."""
    most = min(MOST_CLUSTERS, math.ceil(nodes.count() / CLUSTER))
    found = links(nodes, overlap)
    while True:
        # both ends of a link have it, so the rows of audited nodes tell all
        own = found.join(_audited(members), "id", "left_semi")
        recall = audit(nodes, members, own.select("id", F.explode("found").alias("other")))
        if recall >= TARGET or overlap >= most:
            return found, recall
        overlap *= 2
        found = found.unionByName(links(nodes, overlap))


def near_duplicates(embeddings: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` of every row of ``embeddings``. ``recall`` is what
    the audit measured over all vectors of the same length; null for those that link with nothing.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths link. Equal vectors link. Rows that repeat an id with an equal
    vector count as one vector. A null id has a null component, no links, and is kept.
    """
    ready = comparable(embeddings)
    sizes = [r[0] for r in ready.select(F.size("embedding")).distinct().collect()]
    parts = []
    for size in sizes:
        nodes, members = _nodes(ready, size)
        found, recall = audited_links(nodes, members, overlap)
        copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
        # both ends of a link have it; a copied node counts as often as it stands
        whole = _settled(found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")))
        more = copies.filter("copies > 1").select(F.col("id").alias("other"), (F.col("copies") - 1).alias("more"))
        more = (whole.select("id", F.explode("found").alias("other")).join(more, "other")
                .groupBy("id").agg(F.sum("more").alias("more")))
        linked = whole.select("id", F.size("found").alias("far")).join(more, "id", "left").select(
            "id", (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        roots = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")))
        own = copies.join(linked, "id", "left").join(roots.withColumnRenamed("root", "component"), "id", "left")
        parts.append(members.join(own, "id").select(
            "vec_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"), F.lit(recall).alias("recall")))
    everything = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not parts:
        out = everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                F.lit(None).cast("double").alias("recall"))
    else:
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        known = known.groupBy("vec_id").agg(
            F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.min("recall").alias("recall"))
        out = everything.join(known, "vec_id", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"), "recall")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("vec_id", "n_links", "component_id", kept, "recall")
