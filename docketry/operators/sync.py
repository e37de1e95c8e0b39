"""Syncing two copies of a table: digests of days and key ranges in a tree, and a descent that reads only what differs.

A digest is the number of rows and two sums of their hashes, so it does not depend on the order of rows or files, and digests of
parts add up. ``stored`` writes a table by day with its digests beside it; two such tables are compared from the
root down by their digests, and rows are read from the days that differ alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key ranges of a day; a day's difference is looked for in so many parts.
RANGES = 16
_DIGEST = ("n", "one", "two")


def digests(df: DataFrame, day: str, key: str) -> DataFrame:
    """day, range, n, one and two: the digest of each day's rows by range of the key's hash. Column order does not count; a null day is a day."""
    columns = sorted(c for c in df.columns if c != day)
    row = lambda seed: F.xxhash64(F.lit(seed), *(F.col(c) for c in columns), *(F.col(c).isNull() for c in columns)).cast("decimal(38,0)")
    return df.groupBy(F.col(day).alias("day"), F.pmod(F.xxhash64(key), F.lit(RANGES)).alias("range")).agg(F.count("*").alias("n"), F.sum(row(1)).alias("one"), F.sum(row(2)).alias("two"))


def level(tree: DataFrame, *keys) -> DataFrame:
    """Digests of a coarser level: those of its parts added up."""
    return tree.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _DIGEST))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    both = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)) if keys else F.lit(True)
    met = a.withColumn("_a", F.lit(1)).alias("a").join(b.withColumn("_b", F.lit(1)).alias("b"), both, "full_outer")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _DIGEST))
    return met.where(~same | F.col("_a").isNull() | F.col("_b").isNull()).select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys))


def stored(df: DataFrame, day: str, key: str, path: str) -> None:
    """Write a table by day, and its digests, a few rows a day."""
    df.withColumn("_day", F.col(day)).repartition("_day").write.partitionBy("_day").parquet(f"{path}/rows")
    digests(df, day, key).write.parquet(f"{path}/digests")


def changed_days(spark: SparkSession, ours: str, theirs: str, month: str = "yyyy-MM") -> list:
    """The days whose rows differ in two stored tables, by descent: all, then months, then days of months that differ.

    Days come to the driver, one value each; no rows are read, only digests.
    """
    trees = []
    for path in (ours, theirs):
        tree = spark.read.parquet(f"{path}/digests")
        trees.append(tree.withColumn("month", F.coalesce(F.date_format("day", month), F.lit("none"))))
    tops = [tuple(t.agg(*(F.sum(c).alias(c) for c in _DIGEST)).first()) for t in trees]
    if tops[0] == tops[1]:
        return []
    months = [r.month for r in differing(*(level(t, "month") for t in trees), ["month"]).collect()]
    days = differing(*(level(t.where(F.col("month").isin(months)), "month", "day") for t in trees), ["month", "day"])
    return sorted((r.day for r in days.collect()), key=lambda x: (x is None, str(x)))


def changed_rows(spark: SparkSession, ours: str, theirs: str, key: str) -> DataFrame:
    """key, day and state (new, changed, gone) of theirs against ours, reading the rows of the key ranges of days that differ."""
    days = changed_days(spark, ours, theirs)
    chosen = F.col("_day").isin([d for d in days if d is not None])
    chosen = chosen | F.col("_day").isNull() if None in days else chosen
    trees = [spark.read.parquet(f"{p}/digests").where(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False))) for p in (ours, theirs)]
    ranges = [r.range for r in differing(*(level(t, "range") for t in trees), ["range"]).collect()] if days else []  # RANGES at most
    sides = []
    for path, name in ((ours, "_a"), (theirs, "_b")):
        rows = spark.read.parquet(f"{path}/rows").where(chosen & F.pmod(F.xxhash64(key), F.lit(RANGES)).isin(ranges))
        columns = sorted(c for c in rows.columns if c != "_day")
        sides.append(rows.select(F.col(key), F.col("_day").alias(f"{name}_day"), F.xxhash64(*(F.col(c) for c in columns), *(F.col(c).isNull() for c in columns)).alias(name)))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return sides[0].join(sides[1], key, "full_outer").select(key, F.coalesce("_b_day", "_a_day").alias("day"), state.alias("state")).where("state is not null")


def copy_days(spark: SparkSession, ours: str, theirs: str) -> list:
    """Replace the days of ours that differ by theirs, files and digests; a second call finds nothing to do. The days that were copied."""
    days = changed_days(spark, ours, theirs)
    if not days:
        return days
    own = F.col("_day").isin([d for d in days if d is not None]) | (F.col("_day").isNull() if None in days else F.lit(False))
    kept = spark.read.parquet(f"{theirs}/rows").where(own)
    held = spark.read.parquet(f"{ours}/rows").where(own).select("_day").distinct()
    gone = [r["_day"] for r in held.join(kept.select("_day").distinct(), held["_day"].eqNullSafe(kept["_day"]), "left_anti").collect()]
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(f"{ours}/rows")
    for day in gone:  # days that theirs has no rows of
        name = "__HIVE_DEFAULT_PARTITION__" if day is None else str(day)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{ours}/rows/_day={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # the digests come last: after a crash before this the same days are copied again
    spark.read.parquet(f"{theirs}/digests").write.mode("overwrite").parquet(f"{ours}/digests")
    return days


class Batches:
    """A ledger of finished batches: a batch that is there is not run again, so a rerun writes nothing twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "batch string, rows bigint")

    def run(self, batch: str, work: Callable[[], DataFrame], target: str) -> bool:
        """Write the rows of ``work`` to the batch's own folder of ``target`` and note it; False if that was done before.

        The folder is overwritten, so a batch that died half way leaves nothing behind when it runs again.
        """
        if not self.done().where(F.col("batch") == batch).isEmpty():
            return False
        folder = f"{target}/batch={batch}"
        work().write.mode("overwrite").parquet(folder)
        rows = self.spark.read.parquet(folder).count()
        self.spark.createDataFrame([(batch, rows)], "batch string, rows bigint").write.mode("append").parquet(self.path)
        return True
