"""Counters and histograms as monitoring rules use them: increases across resets, rates over windows, quantiles from buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds step: what a counter grew by since the sample before; after a reset, all that it has. Null for a series' first.

    Samples of a series are compared within each day, and a day's first with the last of the days before, so that
    a series of any length is dealt over its days. Of samples at one moment the largest counts last.
    """
    day = samples.withColumn("_day", F.to_date(ts))
    ends = day.groupBy(*series, "_day").agg(F.max_by(value, F.struct(ts, value)).alias("_end"))
    # a row for each day of a series
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*series).orderBy("_day"))).select(*series, "_day", "_before")
    own = F.lag(value).over(Window.partitionBy(*series, "_day").orderBy(ts, value))
    joined = day.withColumn("_own", own).join(ends, [*series, "_day"])
    before = F.coalesce("_own", "_before")
    grown = F.when(before.isNotNull(), F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)))
    return joined.select(*samples.columns, grown.alias("step"))


def rates(samples: DataFrame, series: list[str], width: str, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """series, start, increase and rate (a second) of each window with two samples of a series at least.

    The increase is between a window's first and last sample, carried on to its ends as monitoring systems do: by the
    distance to an end, where that is below 1.1 times the mean distance of samples, else by half of the mean; before
    the first sample never further than to where the counter would have been 0.
    """
    windowed = steps(samples, series, ts, value).withColumn("_w", F.window(ts, width, slide or width))
    first, last = F.min_by(F.struct(F.col(value).alias("v"), "step"), F.struct(ts, value)), F.max(ts)
    each = windowed.groupBy(*series, "_w").agg(F.count("*").alias("_n"), F.min(ts).alias("_a"), last.alias("_b"), first.alias("_first"), F.sum("step").alias("_steps"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    grown = F.coalesce(F.col("_steps"), F.lit(0.0)) - F.coalesce(F.col("_first.step"), F.lit(0.0))
    told = each.where("_n > 1").select(*series, "_w", "_n", seconds("_a").alias("_x"), seconds("_b").alias("_y"), seconds("_w.start").alias("_s"), seconds("_w.end").alias("_e"), F.col("_first.v").alias("_v"), grown.alias("_grown"))
    span = (F.col("_y") - F.col("_x")).alias("_span")
    told = told.select("*", span).where("_span > 0")
    mean = F.col("_span") / (F.col("_n") - 1)
    near = lambda gap: F.when(gap >= mean * 1.1, mean / 2).otherwise(gap)
    to_zero = F.when((F.col("_grown") > 0) & (F.col("_v") >= 0), F.col("_span") * F.col("_v") / F.col("_grown"))
    begin, end = F.least(near(F.col("_x") - F.col("_s")), to_zero), near(F.col("_e") - F.col("_y"))
    increase = F.col("_grown") * (F.col("_span") + begin + end) / F.col("_span")
    return told.select(*series, F.col("_w.start").alias("start"), increase.alias("increase"), (increase / (F.col("_e") - F.col("_s"))).alias("rate"))


def bucketed(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """keys and buckets: an array of (le, n), n values at most le, by rising bounds and infinity at the end. Histograms of parts can be added up."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("_all")]
    every = [(b, f"_b{i}") for i, b in enumerate(bounds)] + [(float("inf"), "_all")]
    return df.groupBy(*keys).agg(*counts).select(*keys, F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(c).cast("double").alias("n")) for b, c in every)).alias("buckets"))


def added(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms with the same bounds as one for each of ``keys``."""
    each = histograms.select(*keys, F.explode("buckets").alias("b")).groupBy(*keys, F.col("b.le").alias("le")).agg(F.sum("b.n").alias("n"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("buckets"))  # as many as bounds


def quantile(buckets: Column, q: float) -> Column:
    """The q-quantile of a histogram: where the bucket that holds it has it, if values are even inside.

    The lowest bucket begins at 0, or is its bound where that is not above 0; beyond the last finite bound that bound is
    the answer. Null without values.
    """
    total = F.element_at(buckets, -1)["n"]
    rank = total * q
    at = F.size(F.filter(buckets, lambda b: b["n"] < rank)) + 1  # the first bucket that reaches the rank
    own, before = F.element_at(buckets, at), F.get(buckets, at - 2)
    low = F.when(at == 1, F.lit(0.0)).otherwise(before["le"])
    under = F.when(at == 1, F.lit(0.0)).otherwise(before["n"])
    inside = low + (own["le"] - low) * (rank - under) / (own["n"] - under)
    return F.when(total > 0, F.when(at >= F.size(buckets), F.get(buckets, F.size(buckets) - 2)["le"]).when((at == 1) & (own["le"] <= 0), own["le"]).otherwise(F.when(own["n"] > under, inside).otherwise(own["le"])))
