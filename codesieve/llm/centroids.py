"""Centroid clustering in whole numbers, with Orchard's search for the nearest centroid.

For each centroid the others are listed from the nearest to the farthest. A vector walks the list of
the centroid it holds; whenever it meets a closer one it goes on with that one's list, and centroids
it has measured are marked. By the triangle inequality nothing better can follow once a listed
centroid lies strictly more than twice as far from the held one as the vector does.

Components are floor(scale * x), so sums and distances are exact and do not depend on how rows are
dealt to tasks. A round sends one row per task and centroid through the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import staged

#: Components up to this size keep the squared distance of 64 of them below 2^62.
MOST_COMPONENT = 1 << 27
#: Vectors that walk at once in a task.
WALKERS = 1 << 14


@dataclass(frozen=True)
class Neighbours:
    """centres[k], order[k]: the other centroids from the nearest, gap[k]: their squared distances."""

    centres: np.ndarray
    order: np.ndarray
    gap: np.ndarray


def neighbours(centres: np.ndarray) -> Neighbours:
    k = len(centres)
    order, gap = np.zeros((k, max(k - 1, 0)), np.int64), np.zeros((k, max(k - 1, 0)), np.int64)
    for c in range(k):
        apart = ((centres - centres[c]) ** 2).sum(1)
        near = np.argsort(apart, kind="stable")
        order[c] = near = near[near != c]
        gap[c] = apart[near]
    return Neighbours(centres, order, gap)


def orchard(vectors: np.ndarray, lists: Neighbours) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number on ties, and squared distance of each vector."""
    n, k = len(vectors), len(lists.centres)
    held, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    distance = ((vectors - lists.centres[0]) ** 2).sum(1)
    marked = np.zeros((n, k), bool)
    marked[:, 0] = True
    walking = np.arange(n)
    while len(walking) and k > 1:
        walking = walking[place[walking] < k - 1]
        h, at = held[walking], place[walking]
        # gap > 4 * distance, without the product, which may not fit
        walking = walking[(lists.gap[h, at] - 1) // 4 < distance[walking]]
        h, at = held[walking], place[walking]
        place[walking] += 1
        met = lists.order[h, at]
        new = ~marked[walking, met]
        ask, met = walking[new], met[new]
        marked[ask, met] = True
        found = ((vectors[ask] - lists.centres[met]) ** 2).sum(1)
        closer = (found < distance[ask]) | (found == distance[ask]) & (met < held[ask])
        jump = ask[closer]
        held[jump], distance[jump], place[jump] = met[closer], found[closer], 0
    return held, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _walk(batch: pa.RecordBatch, dims: int, lists: Neighbours) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for first in range(0, batch.num_rows, WALKERS):
        vectors = _matrix(batch.column("v").slice(first, WALKERS), dims)
        yield first, vectors, *orchard(vectors, lists)


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component, null unless there are ``dims`` finite ones."""
    number = F.transform(vector, lambda x: x.cast("double"))
    whole = (F.size(vector) == dims) & F.forall(
        number, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.when(whole, F.transform(number, lambda x: F.floor(x * F.lit(float(scale)))))


def _first_centres(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    rows = (vectors.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256).alias("h"), "v")
            .orderBy("h", "v").limit(k).collect())
    return np.array([r["v"] for r in rows], np.int64)


def _next_centres(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without any stays."""
    k, dims = centres.shape
    sent = vectors.sparkSession.sparkContext.broadcast(neighbours(centres))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for _, rows, held, _ in _walk(batch, dims, sent.value):
                count += np.bincount(held, minlength=k)
                for c in np.unique(held):
                    total[c] += rows[held == c].sum(0)  # at most WALKERS x 2^27
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_pydict({
                "c": pa.array([c] * dims, pa.int32()), "i": pa.array(range(dims), pa.int32()),
                "n": pa.array([count[c]] * dims, pa.int64()),
                "s": pa.array([str(x) for x in total[c]], pa.string())})

    parts = vectors.select("v").mapInArrow(sums, "c int, i int, n long, s string")
    whole = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    out = centres.copy()
    for r in whole.collect():  # one row per centroid and component
        out[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(rows: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding",
            dims: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector.

    Kept are vectors of ``dims`` components, none null, NaN or infinite. Centroids start as the k
    kept vectors of smallest SHA-256 of seed and id (null id: ``null``; ties by components), fewer if
    there are fewer. Each round takes the nearest centroid of every vector and then the floor of the
    mean; a last search follows. Repeated rows count each; an empty table gives no row. A vector
    with a component beyond 2^27 in size has distances no long holds: it is returned with null
    columns and takes no part. Inertias that no long holds are null. Other columns are left alone.
    """
    spark = rows.sparkSession
    kept = staged(rows.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dims, scale).alias("v"))
                  .where("v IS NOT NULL"), "vectors")
    far = F.exists("v", lambda x: ~x.between(-MOST_COMPONENT, MOST_COMPONENT))
    vectors = kept.where(~far)
    centres = _first_centres(vectors, k, seed)
    names = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in names.split(", ")]
    if not len(centres):
        return kept.select("id", *nothing)
    for _ in range(rounds):
        centres = _next_centres(vectors, centres)
    sent = spark.sparkContext.broadcast(neighbours(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, held, distance in _walk(batch, dims, sent.value):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(rows)), pa.array(held, pa.int32()), pa.array(distance)],
                    ["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    found = staged(vectors.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    fits = lambda x: x if x < 1 << 63 else None
    inertia = fits(sum(int(r["s"]) for r in sums))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    # One row per centroid, k in all.
    about = spark.createDataFrame(
        [(r["cluster"], fits(int(r["s"])), inertia, hashes[r["cluster"]]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    near = found.join(F.broadcast(about), "cluster").select("id", *[c.split()[0] for c in names.split(", ")])
    return near.unionByName(kept.where(far).select("id", *nothing))
