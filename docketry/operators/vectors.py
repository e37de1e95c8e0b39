"""Vector search and centroids on array columns, JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int, column: str = "embedding", key: str = "vec_id", least: float | None = None) -> DataFrame:
    """The k most similar rows: each task keeps k, the driver's plan merges them."""
    scored = vectors.withColumn("similarity", F.round(cosine(F.col(column), F.array(*map(F.lit, query))), 6))
    return (scored if least is None else scored.where(F.col("similarity") >= least)).orderBy(F.desc("similarity"), key).limit(k)


def centroids(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """The mean vector of each group: partial means by position."""
    each = vectors.select(group, F.posexplode(column).alias("position", "value"))
    means = each.groupBy(group, "position").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda x: x["mean"]).alias("centroid"))


def filtered(vectors: DataFrame, must: dict | None = None, ranges: dict[str, tuple] | None = None, should: dict[str, list] | None = None) -> DataFrame:
    """Vectors that pass every equality and range, and one at least of the values of ``should``; before any distance is computed."""
    for column, value in (must or {}).items():
        vectors = vectors.where(F.col(column) == value)
    for column, (low, high) in (ranges or {}).items():
        vectors = vectors if low is None else vectors.where(F.col(column) >= low)
        vectors = vectors if high is None else vectors.where(F.col(column) <= high)
    if should:
        vectors = vectors.where(reduce(lambda a, b: a | b, (F.col(c).isin(*values) for c, values in should.items())))
    return vectors
