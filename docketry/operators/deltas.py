"""Totals kept up to date by signed changes: every change of a line is a row with +1 or -1, and sums of these are the state.

Sums and counts can take a change back, maxima cannot, so the state has a count of the lines in each status and the
totals' status follows at the end. Changes may come in any order and in any batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("lines", "open_lines", "subtotal", "paid")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that differ, with sign: how many more of a row ``new`` has than ``old``, below 0 where it has fewer.

    Repeated rows count, and a changed row is a row less and a row more; nulls equal nulls. No key is needed.
    """
    both = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    return both.groupBy(*old.columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def contributions(signed: DataFrame, invoice: Column, price: Column, paid: Column, is_open: Column) -> DataFrame:
    """invoice and what each signed row adds to its state."""
    sign = F.col("sign").cast("decimal(9,0)")
    return signed.select(invoice.alias("invoice"), F.col("sign").cast("bigint").alias("lines"), F.when(is_open, F.col("sign")).otherwise(0).cast("bigint").alias("open_lines"), (sign * price).cast("decimal(28,4)").alias("subtotal"), (sign * paid).cast("decimal(28,4)").alias("paid"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several, or of a state and contributions; an invoice without lines is gone."""
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more)
    summed = every.groupBy("invoice").agg(*(F.sum(c).cast("bigint" if c.endswith("lines") else "decimal(28,4)").alias(c) for c in STATE))
    return summed.where("lines <> 0 or subtotal <> 0 or paid <> 0 or open_lines <> 0")


def totals(state: DataFrame, tax_rate: str = "0.20") -> DataFrame:
    """invoice, subtotal, tax, total, paid and status (paid, sent, draft, overdue) of a state."""
    subtotal, paid = F.col("subtotal").cast("decimal(28,2)"), F.round("paid", 2).cast("decimal(28,2)")
    tax = F.round(subtotal * F.lit(tax_rate).cast("decimal(4,2)"), 2)
    draft = F.col("open_lines") > 0
    status = F.when(paid >= subtotal + tax, "paid").when((F.col("paid") > 0) & draft, "sent").when(draft, "draft").otherwise("overdue")
    return state.where("lines > 0").select("invoice", subtotal.alias("subtotal"), tax.alias("tax"), (subtotal + tax).alias("total"), paid.alias("paid"), status.alias("status"))
