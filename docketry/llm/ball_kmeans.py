"""K-means whose clusters are balls: a vector is compared only with centroids that its ball's place allows.

A ball is the members of one cluster in one Arrow batch, with the cluster's new centroid as its centre and the
largest distance among them as its radius. A centroid further from the centre than twice the radius can be nearest
to no member, so only the others are neighbours. Neighbours stand in order of their distance from the centre; a
member nearer to the centre than half the way to the first neighbour is in the stable core and keeps its cluster
without a comparison. The rest lies in annuli: in the k-th one, exactly the k nearest neighbours are compared.
All of it is arithmetic on whole numbers, so results equal those of a comparison with every centroid.

Each round reads the stored vectors with their clusters once and writes them with the new ones, together with a row
of sums for each cluster and batch; these rows are added up by cluster, and k rows come to the driver. Vectors are
never shuffled. A round's table is deleted when the next one stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import discard, materialize, quoted

#: Whole numbers up to this size give squared distances below 2^63 for up to 1024 components.
LARGEST = 1 << 25
#: Up to this size, sums of products are exact in doubles too (for up to 1024 components).
_EXACT = 1 << 19

STATE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
    T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("part", T.StringType()),
])


def quantised(vectors: DataFrame, size: int, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of vectors with exactly ``size`` components, none null or not finite; others go."""
    good = (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = lambda x: F.when(F.abs(x) > LARGEST, F.raise_error(F.lit("a component is too large for whole squared distances"))).otherwise(x.cast("int"))
    plain = vectors.select(F.col(quoted(key)).cast("bigint").alias("vec_id"), F.col(quoted(column)).alias("v")).where(good)
    return plain.select("vec_id", F.transform("v", lambda x: far(F.floor(F.lit(float(scale)) * x.cast("double")))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors with the smallest sha256 of ``salt`` and vec_id; without vec_id last, repeated ids by their components."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("_order", order).orderBy(F.asc_nulls_last("_order"), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x) x (rows of c)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        x, c = x.astype(float), c.astype(float)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def assign(x: np.ndarray, old: np.ndarray | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, number of distances computed) of each row of ``x``; of equal distances the smaller number.

    ``old``: the clusters of the round before; None compares with every centroid.
    """
    if old is None:
        d = _squares(x, centroids)
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best], d.size
    cluster, distance, compared = old.copy(), np.zeros(len(x), np.int64), len(x)
    between = _squares(centroids, centroids)
    for c in np.unique(old):
        members = np.flatnonzero(old == c)
        own = _squares(x[members], centroids[c : c + 1])[:, 0]
        distance[members] = own
        # a neighbour can win or tie only where 2 d(x, c) >= d(c, neighbour): in squares, 4 own >= between
        near = np.flatnonzero(between[c] <= 4 * own.max())
        near = near[near != c]
        near = near[np.argsort(between[c][near], kind="stable")]
        annulus = np.searchsorted(between[c][near], 4 * own, "right")  # so many neighbours can matter; 0: stable core
        for count in np.unique(annulus[annulus > 0]):
            ring = np.flatnonzero(annulus == count)
            rivals = np.sort(np.append(near[:count], c))
            d = _squares(x[members[ring]], centroids[rivals])
            best = d.argmin(1)
            cluster[members[ring]], distance[members[ring]] = rivals[best], d[np.arange(len(ring)), best]
            compared += len(ring) * int(count)
    return cluster, distance, compared


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _round(vectors: DataFrame, centroids: np.ndarray, seen: bool) -> DataFrame:
    """Rows of part "v" (vectors with their clusters) and of part "s" (sums of a cluster in a batch), stored."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), size)
            cluster, distance, compared = assign(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64) if seen else None, centroids)
            order = np.argsort(cluster, kind="stable")
            there, first = np.unique(cluster[order], return_index=True)
            n, m, longs, ints = len(x), len(there), pa.list_(pa.int64()), pa.list_(pa.int32())
            # of each cluster: its vectors, their distances' sum, the distances computed (told by the batch's first), the sums of components
            sums = np.concatenate([np.diff(np.append(first, n))[:, None], np.add.reduceat(distance[order], first)[:, None], np.where(np.arange(m) == 0, compared, 0)[:, None], np.add.reduceat(x[order], first, axis=0)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v").cast(ints), pa.array(cluster, pa.int32()), pa.array(distance), pa.nulls(n, longs), pa.array(["v"] * n)], STATE.names)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, ints), pa.array(there, pa.int32()), pa.nulls(m, pa.int64()), lists, pa.array(["s"] * m)], STATE.names)

    return materialize(vectors.mapInArrow(run, STATE), partition_by=("part",))


def _sums(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """n, inertia and sums of each cluster, and the number of distances computed: k rows of size + 3 numbers come to the driver."""
    total = np.zeros((k, size + 3), np.int64)
    for r in state.where("part = 's'").select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        total[r.cluster, r["at"]] = r.x
    return total[:, 0], total[:, 1], total[:, 3:], int(total[:, 2].sum())


def cluster(vectors: DataFrame, k: int, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:", counts: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept vector of ``vectors`` (vec_id, embedding).

    Vectors with another number of components than ``size``, or with a component that is null or not finite, are
    left out; rows with a null or repeated vec_id are rows of their own. Components become floor(scale * x); one
    beyond ``LARGEST`` is an error. With fewer than k vectors there are as many centroids as vectors. An empty
    cluster keeps its centroid. ``counts`` gets the number of distances computed in each round.
    """
    whole = quantised(vectors, size, scale)
    centroids = first_centroids(whole, k, salt)
    result = T.StructType([*STATE.fields[:1], *STATE.fields[2:4], T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], result)
    state = None
    for number in range(rounds + 1):
        source = whole if state is None else state.where("part = 'v'")
        after = _round(source, centroids, state is not None)
        if state is not None:
            discard(state)
        state = after
        n, inertia, sums, compared = _sums(state, len(centroids), size)
        if counts is not None:
            counts.append(compared)
        if number < rounds:
            centroids = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
    told = [(i, int(inertia[i]), int(inertia.sum()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    of_cluster = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows, whatever the number of vectors
    return state.where("part = 'v'").select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select(*result.names)
