"""Ball k-means on integer vectors: clusters are balls, and members are compared with neighbours that can reach them alone.

A cluster is a ball around its centroid with its farthest member as radius. A member at distance d from its own centroid
can be as near to another only if the two centroids are at most 2 d apart. So:

1. Neighbours of a ball are the centroids within twice its radius; each pass bounds the radii by those of the pass
   before plus how far each centroid has moved, so no pass over the vectors is spent on them.
2. Members nearer to their centroid than half the way to its nearest neighbour are the stable core and stay.
3. The rest lies in annuli, one beyond the half-way distance of each neighbour, nearest first; members of the k-th annulus are
   compared exactly with the first k neighbours and no others.

All comparisons are of squared distances in integers, ties included. Vectors and their clusters are a table in the shared
folder, written again in each pass, so a lost executor costs a read. What a pass sends to the driver is one sum for each
cluster; what it gets are the centroids and their neighbours, whose number does not depend on the input.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors with a component as large as this after scaling are left out, and up to ``_SAFE`` 64 bits hold squared distances.
LARGEST = 1 << 31
_SAFE = 1 << 26
#: The largest value of a bigint, which stands for distances beyond it.
_MOST = (1 << 63) - 1
#: Vectors whose differences are held at once.
_ROWS = 4096


@dataclass
class Balls:
    """``centroids`` (k rows), and of each ball the neighbours by distance (``near``) and their squared distances (``apart``)."""

    centroids: np.ndarray
    near: list[np.ndarray]
    apart: list[np.ndarray]

    @classmethod
    def around(cls, centroids: list[list[int]], radii: list[float]) -> Balls:
        """``radii``: upper bounds of the members' distances to their centroids."""
        c, near, apart = np.array(centroids, object), [], []
        for i, own in enumerate(c):
            squares = ((c - own) ** 2).sum(1)
            reach = [j for j in range(len(c)) if j != i and math.sqrt(squares[j]) <= 2 * radii[i] * (1 + 1e-9) + 1e-6]
            reach.sort(key=lambda j: (squares[j], j))
            near.append(np.array(reach, np.int64))
            apart.append(np.array([min(squares[j], 4 * _MOST) for j in reach], object))
        return cls(_exact(c), near, apart)

    def assigned(self, vectors: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smaller number) and its squared distance, from the clusters before."""
        if max(_largest(vectors), _largest(self.centroids)) > _SAFE:
            vectors = vectors.astype(object)
        best, squares = clusters.copy(), np.empty(len(vectors), object if vectors.dtype == object else np.int64)
        for i in np.unique(clusters).tolist():
            mine = np.flatnonzero(clusters == i)
            own = squares[mine] = self._squares(vectors[mine], i)
            # The core is all for which no neighbour is within reach; the k-th annulus is where k are.
            edges = self.apart[i]
            annulus = np.searchsorted(edges.astype(np.float64) * (1 - 1e-12), 4.0 * own.astype(np.float64), "right")
            for k, j in enumerate(self.near[i].tolist()):
                outer = mine[annulus > k]
                if not len(outer):
                    break
                other = self._squares(vectors[outer], j)
                closer = (other < squares[outer]) | ((other == squares[outer]) & (j < best[outer]))
                best[outer[closer]], squares[outer[closer]] = j, other[closer]
        return best, squares

    def _squares(self, vectors: np.ndarray, j: int) -> np.ndarray:
        out = np.empty(len(vectors), vectors.dtype)
        for a in range(0, len(vectors), _ROWS):
            out[a : a + _ROWS] = ((vectors[a : a + _ROWS] - self.centroids[j]) ** 2).sum(1)
        return out


def _largest(values: np.ndarray) -> int:
    return int(abs(values).max()) if values.size else 0


def _exact(values: np.ndarray) -> np.ndarray:
    """64-bit integers where squared distances fit, else Python's."""
    return values.astype(np.int64) if _largest(values) <= _SAFE else values


def integer_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for vectors of ``size`` finite components below ``LARGEST``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("x")).where(F.size("x") == size)
    scaled = F.transform("x", lambda x: x * scale)
    # The floor lies in -LARGEST .. LARGEST - 1 exactly where the product does; nulls, NaN and infinities do not.
    usable = F.forall("x", lambda x: F.coalesce((x * scale >= -LARGEST) & (x * scale < LARGEST), F.lit(False)))
    return rows.where(usable).select("vec_id", F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def _start(rows: DataFrame, k: int) -> list[list[int]]:
    named = rows.select("v", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("name"))
    return [list(r.v) for r in named.orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()]


def _pass(state: DataFrame, balls: Balls, size: int) -> DataFrame:
    """vec_id, v, cluster, distance: every vector in its nearest ball."""

    def assign(batches):
        for batch in batches:
            v = batch.column(1)
            matrix = v.flatten().to_numpy().astype(np.int64).reshape(-1, size)
            best, squares = balls.assigned(matrix, batch.column(2).to_numpy().astype(np.int64))
            distance = pa.array(squares, pa.int64()) if squares.dtype != object else pa.array([min(x, _MOST) for x in squares.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(best, pa.int32()), distance], names=["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(assign, "vec_id bigint, v array<int>, cluster int, distance bigint")


def _sums(state: DataFrame, size: int) -> list:
    """cluster, n, farthest and the sums of its components: one row a cluster, summed in each task first."""
    parts = [F.sum(F.get("v", F.lit(c)).cast("bigint")).alias(f"s{c}") for c in range(size)]
    return state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("farthest"), *parts).collect()


def _moved(centroids: list[list[int]], sums: list, size: int) -> tuple[list[list[int]], list[float]]:
    """The next centroids, floor(sum / count) by component, and an upper bound of each one's radius; empty ones stay."""
    after, radii = [list(c) for c in centroids], [0.0] * len(centroids)
    for r in sums:
        after[r.cluster] = [r[f"s{c}"] // r.n for c in range(size)]
        shift = math.sqrt(sum((a - b) ** 2 for a, b in zip(after[r.cluster], centroids[r.cluster], strict=True)))
        radii[r.cluster] = math.inf if r.farthest >= _MOST else math.sqrt(r.farthest) + shift
    return after, radii


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters of integer vectors, exactly as comparing every vector with every centroid would give them.

    Vectors with other than ``size`` components, or with a null or non-finite one, are left out; a component x becomes
    floor(scale * x). The first centroids are the ``k`` vectors with the least sha256 of ``1:<vec_id>``. Each round assigns
    every vector to the nearest centroid (ties: the smaller number) and moves centroids to floor(sum / count); after the last
    one vectors are assigned once more. Returns vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 (of the components as decimals joined by commas).

    Rows that repeat are vectors of their own; of rows that share an id, the lesser vector is taken first as a centroid, and
    null ids come last. With fewer than ``k`` vectors there are as many centroids. A vector with a component of 2^31 or
    more after scaling is left out too; distances and inertias beyond a bigint are its largest value. An empty table
    gives no rows; other columns are ignored.
    """
    kept = written(integer_vectors(vectors, size, scale, id_col, vector_col), "vectors")
    centroids = _start(kept, k)
    state, balls = kept.withColumn("cluster", F.lit(0)), Balls.around(centroids, [math.inf] * len(centroids))
    for _ in range(rounds if centroids else 0):
        state = written(_pass(state, balls, size), "balls")
        centroids, radii = _moved(centroids, _sums(state, size), size)
        balls = Balls.around(centroids, radii)
    state = written(_pass(state, balls, size).drop("v"), "clusters")
    inertia = {r[0]: int(r[1]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    told = [(i, min(inertia.get(i, 0), _MOST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        _of_cluster([t[1] for t in told], "bigint").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), _MOST)).cast("bigint").alias("inertia"),
        _of_cluster([t[2] for t in told], "string").alias("centroid_sha256"),
    )


def _of_cluster(values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
