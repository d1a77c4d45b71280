"""Centroid clustering of integer vectors, with Orchard's search for the nearest centroid.

Each centroid has the list of all others, nearest first. A vector walks the list of its best centroid
so far; a closer one takes over with its own list, and centroids met before are not computed again.
The walk stops where the list passes twice the vector's distance to its best centroid, strictly: by
the triangle inequality everything behind is farther, so nothing that could win or tie is left out.

All arithmetic is on integers, hence exact: results do not depend on partitions or order. A round is
one pass over the vectors; a task sends one partial sum per centroid, and only centroids and those
sums are ever in the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import narrow
from boardwalk.session import stored

SIZE, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
LARGEST = 1 << 27  # bound of an integer component: 64 squared differences then fit in 63 bits
_BLOCK = 8192  # vectors that walk together


def kept_vectors(embeddings: DataFrame, *, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: vectors of exactly ``size`` finite components as integers floor(scale * x).

    A vector that is null, of another length or holds a null, NaN or infinite component is left out.
    A component beyond ``LARGEST`` after scaling is an error, as squared distances would not fit.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(x, lambda v: F.abs(v.cast("double")) * scale <= LARGEST)
    whole = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")))
    return (narrow(embeddings, "vec_id", "embedding")
            .filter((F.size(x) == size) & F.coalesce(finite, F.lit(False)))
            .select("vec_id", whole.cast("array<bigint>").alias("x")))


def _starts(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors whose ids hash smallest; ties by components, vectors without an id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(count).collect()
    return np.array([r.x for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


class Orchard:
    """Sorted neighbour lists of some centroids, and the search in them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        count = len(centroids)
        apart = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        # itself first, whatever duplicates there are, so that a list is the others from place 1 on
        apart[np.arange(count), np.arange(count)] = -1
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.computed = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector (of equals the smaller) and its squared
        distance."""
        parts = [self._walk(vectors[k:k + _BLOCK]) for k in range(0, len(vectors), _BLOCK)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _distance(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        self.computed += len(vectors)
        difference = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", difference, difference)

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, size = len(vectors), len(self.centroids)
        best = np.zeros(count, np.int64)
        distance = self._distance(vectors, best)
        seen = np.zeros((count, size), bool)
        seen[:, 0] = True
        place = np.ones(count, np.int64)
        active = np.arange(count)
        while len(active):
            active = active[place[active] < size]
            # twice the distance, squared, is four times the squared distance
            near = self.apart[best[active], place[active]]
            active = active[near // 4 + (near % 4 > 0) <= distance[active]]
            other = self.order[best[active], place[active]]
            place[active] += 1
            new = ~seen[active, other]
            rows, other = active[new], other[new]
            seen[rows, other] = True
            found = self._distance(vectors[rows], other)
            closer = (found < distance[rows]) | ((found == distance[rows]) & (other < best[rows]))
            rows, other = rows[closer], other[closer]
            best[rows], distance[rows], place[rows] = other, found[closer], 1
        return best, distance


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid that has any."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), size)
            best, _ = orchard.nearest(x)
            counts += np.bincount(best, minlength=len(centroids))
            order = np.argsort(best, kind="stable")
            present, first = np.unique(best[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(x[order], first)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))],
            ["cluster", "n", "total"])

    parts = vectors.select("x").mapInArrow(run, "cluster long, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)]
    ).collect()
    return {r.cluster: (r.n, [int(r[f"s{k}"]) for k in range(size)]) for r in rows}


def fit(vectors: DataFrame, *, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after ``rounds`` rounds of assignment and replacement by floor(sum / number); one
    without vectors stays. Fewer than ``count`` vectors give as many centroids as there are vectors."""
    centroids = _starts(vectors, count, seed)
    if not len(centroids):
        return centroids
    for _ in range(rounds):
        for number, (n, total) in _sums(vectors, centroids).items():
            centroids[number] = [s // n for s in total]
    return centroids


def _hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector; distances are squared."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    size = centroids.shape[1] if len(centroids) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids) if len(centroids) else None
        for batch in batches:
            if len(batch):
                best, distance = orchard.nearest(_vectors(batch.column(1), size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _looked_up(values: list, kind: str) -> Column:
    """The value of a row's cluster, from a short list in the plan."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))


def cluster(embeddings: DataFrame, *, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
            size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """One row for each vector that ``kept_vectors`` keeps: ``vec_id, cluster, distance``, the summed
    distance of its cluster and of all, and a hash of its centroid.

    Repeated rows count each; equal vectors get equal clusters; a null id is kept and starts no
    centroid before all others; an empty table gives an empty one. Other columns are not read.
    """
    vectors = stored(kept_vectors(embeddings, size=size, scale=scale))
    centroids = fit(vectors, count=count, rounds=rounds, seed=seed)
    assigned = stored(assign(vectors, centroids))
    per_cluster = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster")
                   .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    if not per_cluster:
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
                               F.lit("").alias("centroid_sha256"))
    numbers = range(len(centroids))
    return assigned.select(
        "*", _looked_up([per_cluster.get(k, 0) for k in numbers], "long").alias("cluster_inertia"),
        F.lit(sum(per_cluster.values())).cast("long").alias("inertia"),
        _looked_up([_hash(centroids[k]) for k in numbers], "string").alias("centroid_sha256"))
