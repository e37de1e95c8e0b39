"""A stored index of vectors: coarse centroids, residual codes in files by centroid, and an exact second look.

Centroids are fitted on a bounded sample; every vector is indexed. A vector lies in the list of the centroid that it is
most similar to; its code is what the centroid leaves of it, a byte a component. A search reads the codes of the lists
nearest to its queries, keeps the best few of each query, and ranks these by the vectors themselves. Queries are a DataFrame
of any size: queries and codes meet by list, block by block. ``exact`` compares every vector itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.sources.tables import shared_folder, written

#: Vectors that the centroids are fitted on at most (those with the smallest hash of their key), and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 8
#: Vectors of a block of codes, and queries of a block of queries, at most.
BLOCK, QUERY_BLOCK = 1024, 128


@dataclass
class Index:
    """``codes``: blocks by list; ``vectors``: key and embedding by list."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _valid(vectors: DataFrame, key: str, column: str, size: int) -> DataFrame:
    good = F.col("_key").isNotNull() & (F.size("_v") == size) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("bigint").alias("_key"), F.col(column).cast("array<double>").alias("_v")).where(good)


def fit(vectors: DataFrame, lists: int, size: int, key: str = "_key", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of at most ``lists`` lists, by spherical k-means on at most ``sample`` vectors."""
    rows = vectors.orderBy(F.xxhash64(key), key).limit(sample).select("_v").toPandas()["_v"]
    x = _unit(np.array(rows.tolist(), float).reshape(len(rows), size))
    centroids = x[:lists]
    if not len(x):
        return centroids
    for _ in range(ROUNDS):
        nearest = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where(np.abs(sums).sum(1, keepdims=True) > 0, _unit(sums), centroids)
    return centroids


def build(vectors: DataFrame, key: str, column: str, size: int = 64, lists: int = 64, sample: int = SAMPLE, path: str | None = None) -> Index:
    """An index of every vector with ``size`` components, none null or not finite, and a whole number as its key; others are left out.

    A list with a great many vectors lies in several partitions and files, since rows are dealt by list and key.
    """
    spark = vectors.sparkSession
    path = path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    plain = _valid(vectors, key, column, size)
    centroids = fit(plain, lists, size, sample=sample)
    index = Index(spark, path, centroids)
    if not len(centroids):
        spark.createDataFrame([], "key bigint, embedding array<double>, list int").write.parquet(f"{path}/vectors")
        spark.createDataFrame([], "keys array<bigint>, codes binary, scale double, list int").write.parquet(f"{path}/codes")
        return index

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = (_unit(_matrix(batch.column("_v"), size)) @ centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_v"), pa.array(nearest, pa.int32())], ["key", "embedding", "list"])

    dealt = plain.mapInArrow(assigned, "key bigint, embedding array<double>, list int").repartitionByRange("list", "key").sortWithinPartitions("list", "key")
    dealt.write.partitionBy("list").parquet(f"{path}/vectors")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("list").to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            cuts = [c for a, b in zip(runs, [*runs[1:], len(at)]) for c in range(a, b, BLOCK)]
            x = _unit(_matrix(batch.column("embedding"), size))
            keys, codes, scales = [], [], []
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                left = x[a:b] - centroids[at[a]]
                scale = max(float(np.abs(left).max()), 1e-12) / 127
                keys.append(batch.column("key")[a:b].to_pylist())
                codes.append(np.rint(left / scale).astype(np.int8).tobytes())
                scales.append(scale)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(scales, pa.float64()), pa.array(at[cuts], pa.int32())], ["keys", "codes", "scale", "list"])

    # files keep the order of the sort, so a batch has long runs of a list
    stored = index.vectors.select("key", "embedding", "list")
    stored.mapInArrow(coded, "keys array<bigint>, codes binary, scale double, list int").write.partitionBy("list").parquet(f"{path}/codes")
    return index


def _queries(index: Index, queries: DataFrame, key: str, column: str, probes: int) -> DataFrame:
    """list, qkeys and qs: each query in the blocks of the lists that it looks into."""
    centroids, size = index.centroids, index.centroids.shape[1]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("_v"), size))
                near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
                own = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column("_key").take(own), batch.column("_v").take(own)], ["list", "qkey", "q"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("list").to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            cuts = [c for a, b in zip(runs, [*runs[1:], len(at)]) for c in range(a, b, QUERY_BLOCK)]
            x, ends = _unit(_matrix(batch.column("q"), size)), [*cuts[1:], len(at)]
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts], pa.int32()), pa.array([batch.column("qkey")[a:b].to_pylist() for a, b in zip(cuts, ends)], pa.list_(pa.int64())), pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["list", "qkeys", "qs"])

    rows = _valid(queries, key, column, size).mapInArrow(probed, "list int, qkey bigint, q array<double>")
    return rows.repartitionByRange("list", "qkey").sortWithinPartitions("list").mapInArrow(packed, "list int, qkeys array<bigint>, qs binary")


def _best(scored: DataFrame, score: str, n: int) -> DataFrame:
    by = Window.partitionBy("qkey").orderBy(F.desc(score), "key")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def candidates(index: Index, queries: DataFrame, key: str, column: str, probes: int, n: int) -> DataFrame:
    """qkey, key and list of the n best of each query by codes, from the ``probes`` nearest lists."""
    centroids, size = index.centroids, index.centroids.shape[1]
    asked = written(_queries(index, queries, key, column, probes))
    lists = [r.list for r in asked.select("list").distinct().collect()]  # at most as many as centroids

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, keys, codes, scale, qkeys, qs = (batch.column(c)[i] for c in ("list", "keys", "codes", "scale", "qkeys", "qs"))
                keys, qkeys = np.array(keys.as_py()), np.array(qkeys.as_py())
                q = np.frombuffer(qs.as_py()).reshape(len(qkeys), size)
                code = np.frombuffer(codes.as_py(), np.int8).reshape(len(keys), size)
                score = (q @ centroids[at.as_py()])[:, None] + (q @ code.T.astype(float)) * scale.as_py()
                top = np.argsort(-score, axis=1, kind="stable")[:, :n]
                row = np.repeat(np.arange(len(qkeys)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qkeys[row]), pa.array(keys[top.ravel()]), pa.array(np.full(len(row), at.as_py()), pa.int32()), pa.array(score[row, top.ravel()])], ["qkey", "key", "list", "score"])

    pairs = index.codes.where(F.col("list").isin(lists)).join(asked, "list")
    return _best(pairs.mapInArrow(met, "qkey bigint, key bigint, list int, score double"), "score", n).select("qkey", "key", "list")


def search(index: Index, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", probes: int = 8, again: int = 8, exact: bool = False) -> DataFrame:
    """qkey, key, similarity (six digits) and rank: the k vectors most similar to each query, of equals the smaller key.

    ``again`` times k candidates of each query are ranked by their vectors. ``exact`` makes every vector a candidate.
    Keys of the index are unique; similarity with a vector of length 0 is 0.
    """
    size = index.centroids.shape[1] if index.centroids.size else 1
    own = _valid(queries, key, column, size).select(F.col("_key").alias("qkey"), F.col("_v").alias("q"))
    if not len(index.centroids):
        return own.select("qkey", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank")).limit(0)
    if exact:
        return _best(_all(index, queries, key, column, k), "similarity", k)
    found = candidates(index, queries, key, column, probes, k * again)
    lists = [r.list for r in found.select("list").distinct().collect()]
    met = found.join(index.vectors.where(F.col("list").isin(lists)), ["list", "key"]).join(own, "qkey")
    similarity = lambda a, b: F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x)))
    return _best(met.select("qkey", "key", F.coalesce(F.round(similarity(F.col("embedding"), F.col("q")), 6), F.lit(0.0)).alias("similarity")), "similarity", k)


def _all(index: Index, queries: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """qkey, key and similarity of the k best of each block of vectors, every query against every vector in blocks."""
    size = index.centroids.shape[1]
    asked = written(_queries(index, queries, key, column, len(index.centroids)))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("list").to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            cuts = [c for a, b in zip(runs, [*runs[1:], len(at)]) for c in range(a, b, BLOCK)]
            ends, x = [*cuts[1:], len(at)], _matrix(batch.column("embedding"), size)
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts], pa.int32()), pa.array([batch.column("key")[a:b].to_pylist() for a, b in zip(cuts, ends)], pa.list_(pa.int64())), pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["list", "keys", "xs"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, qkeys = (np.array(batch.column(c)[i].as_py()) for c in ("keys", "qkeys"))
                x, q = (np.frombuffer(batch.column(c)[i].as_py()).reshape(-1, size) for c in ("xs", "qs"))
                score = np.round(q @ _unit(x).T, 6)
                top = np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)[:, :k]
                row = np.repeat(np.arange(len(qkeys)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qkeys[row]), pa.array(keys[top.ravel()]), pa.array(score[row, top.ravel()])], ["qkey", "key", "similarity"])

    blocks = index.vectors.select("key", "embedding", "list").mapInArrow(blocked, "list int, keys array<bigint>, xs binary")
    return blocks.join(asked, "list").mapInArrow(met, "qkey bigint, key bigint, similarity double")
