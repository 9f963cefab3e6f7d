"""k-means in integers, with the nearest centroid found by the threshold algorithm.

For every dimension the centroids are sorted by their value. A vector walks each of these lists
outward from its own value, all dimensions in step, so it meets the centroids of a dimension from
near to far, and takes the exact distance to each centroid at the first meeting. A centroid that
it has not met anywhere is, in every dimension, at least as far as the next entry of that list; so
once the squared distances to these entries sum to more than the best exact distance, no other
centroid can win or tie, and the walk ends.

Tasks send sums per centroid, never vectors. Nothing is shuffled but these sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.session import stored

#: Components are multiplied by this and rounded down.
SCALE = 64
#: Largest component after that: squared distances of 64 such components fit a long.
LARGEST = 1 << 26
#: Vectors that walk together.
TOGETHER = 512

_FAR = 1 << 29
_LONG_MAX = (1 << 63) - 1


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def whole(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow column in integers, one a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    # A double above 2**1018 becomes infinite here, and is clipped like any other large one.
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64).reshape(-1, dims)


class CentroidLists:
    """The centroids and, for every dimension, their list sorted by value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        count, dims = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable")
        # Entry 0 and the last one stand for the ends of a list.
        self.values = np.full((count + 2, dims), _FAR, np.int64)
        self.values[0] = -_FAR
        self.values[1:-1] = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid (the smallest of equally near ones) and its squared distance."""
        number, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        for a in range(0, len(vectors), TOGETHER):
            number[a : a + TOGETHER], distance[a : a + TOGETHER] = self._walk(vectors[a : a + TOGETHER])
        return number, distance

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, dims = self.centroids.shape
        column = np.arange(dims)
        best = np.full(len(vectors), _LONG_MAX)
        number = np.full(len(vectors), count)
        right = np.empty(vectors.shape, np.int64)
        for d in range(dims):
            right[:, d] = 1 + np.searchsorted(self.values[1:-1, d], vectors[:, d])
        left, met = right - 1, np.zeros((len(vectors), count), bool)
        rows, x = np.arange(len(vectors)), vectors
        for _ in range(count):
            below, above = x - self.values[left, column], self.values[right, column] - x
            frontier = np.minimum(below, above)
            on = (frontier * frontier).sum(axis=1) <= best[rows]
            if not on.all():
                rows, x, met, left, right, below, above = (y[on] for y in (rows, x, met, left, right, below, above))
                if not len(rows):
                    break
            down = below <= above
            entry = self.order[np.where(down, left, right) - 1, column]
            left, right = left - down, right + ~down
            new = np.zeros(met.shape, bool)
            new[np.arange(len(rows))[:, None], entry] = True
            new &= ~met
            met |= new
            who, which = np.nonzero(new)
            gap = x[who] - self.centroids[which]
            exact = np.full(met.shape, _LONG_MAX)
            exact[who, which] = (gap * gap).sum(axis=1)
            at = exact.argmin(axis=1)
            got = exact[np.arange(len(rows)), at]
            better = (got < best[rows]) | ((got == best[rows]) & (at < number[rows]))
            best[rows[better]], number[rows[better]] = got[better], at[better]
        return number, best


def _sums_of(lists: CentroidLists, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cluster, n, sums): what a task's vectors add to each cluster."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(lists.centroids)
        n, total = np.zeros(count, np.int64), np.zeros((count, dims), np.int64)
        for batch in batches:
            vectors = whole(batch.column(0), dims)
            number, _ = lists.nearest(vectors)
            n += np.bincount(number, minlength=count)
            np.add.at(total, number, vectors)
        there = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(there, pa.int32()), "n": pa.array(n[there]), "sums": pa.array(total[there].tolist(), pa.list_(pa.int64()))})

    return sums


def _assigned(lists: CentroidLists, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = lists.nearest(whole(batch.column(1), dims))
            yield pa.record_batch({"vec_id": batch.column(0), "cluster": pa.array(number, pa.int32()), "distance": pa.array(distance)})

    return assign


def first_centroids(kept: DataFrame, count: int, dims: int) -> np.ndarray:
    """The `count` vectors whose identifier has the smallest sha256, in this order.

    Vectors under one identifier follow each other by their components; those without come last.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "vector").orderBy(F.asc_nulls_last("digest"), "vector").limit(count)
    return whole(first.select("vector").toArrow().column(0), dims)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; an empty one stays where it is."""
    dims = centroids.shape[1]
    parts = kept.select("vector").mapInArrow(_sums_of(CentroidLists(centroids), dims), "cluster int, n long, sums array<long>")
    # Sums are exact: as decimals they cannot overflow, whatever the number of rows.
    added = [F.sum(F.element_at("sums", d + 1).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    found = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        found[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dims)]
    return found


def clusters(vectors: DataFrame, count: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector.

    Kept are vectors with exactly `dims` components, none null or non-finite; a null vector is not.
    Components count as floor(64 * x); beyond 2**20 either way they count as 2**20, so that distances
    fit a long. Repeated rows are rows of their own, also as first centroids: of equal centroids
    the one with the smallest number takes all. With fewer kept vectors than `count`, there are as many centroids as
    vectors; with none, or an empty table, the result is empty. An identifier may be null or
    repeat. Inertia above a long is null. Other columns are not looked at.

    The table is read once for each round and twice more; `count` centroids and their sums are
    all that reaches the driver.
    """
    kept = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")).filter(usable(F.col("vector"), dims))
    kind = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    centroids = first_centroids(kept, count, dims)
    if not len(centroids):
        rows, totals = vectors.sparkSession.createDataFrame([], kind), {}
    else:
        for _ in range(rounds):
            centroids = moved(kept, centroids)
        rows = stored(kept.mapInArrow(_assigned(CentroidLists(centroids), dims), kind), "assigned")
        sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
        totals = {r["cluster"]: int(r["s"]) for r in sums}

    def long(value: int) -> Column:
        return F.lit(value if value <= _LONG_MAX else None).cast("long")

    def of_cluster(values: list[Column], none: str) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None).cast(none)

    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([long(totals.get(k, 0)) for k in range(len(centroids))], "long").alias("cluster_inertia"),
        long(sum(totals.values())).alias("inertia"),
        of_cluster([F.lit(d) for d in digests], "string").alias("centroid_sha256"),
    )
