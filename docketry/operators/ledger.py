"""Credit movements one after another: a debit that would overdraw is refused and changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators import folds

MOVED = "struct<success:boolean,balance_before:bigint,balance_after:bigint>"


def _judge(balance: int, amount: int | None) -> tuple[int, bool]:
    """The balance after a movement, and whether it took place; a null amount moves nothing and is refused."""
    if amount is None or balance + min(amount, 0) < 0:
        return balance, False
    return balance + amount, True


def movements(requests: DataFrame, user: str, order: list[Column], amount: Column, balances: DataFrame | None = None, balance: str = "balance") -> DataFrame:
    """Adds success, balance_before and balance_after to each request of a user in order; amounts are whole cents, debits below 0.

    ``balances``: user and the opening balance, 0 for others; one row a user. What a debit may do depends on every earlier
    request, so no window's sum can tell; the requests are folded in a sorted order, and no user's are held in memory.
    Give a total order. Requests without a user are those of one user.
    """
    opened = requests.withColumn("_opening", F.lit(0).cast("bigint"))
    if balances is not None:
        opened = requests.join(balances.select(user, F.col(balance).cast("bigint").alias("_opening")), user, "left").withColumn("_opening", F.coalesce("_opening", F.lit(0)))

    def step(now: int | None, values: list) -> tuple[int, list[dict]]:
        out = []
        for change, opening in zip(*values):
            before = opening if now is None else now
            now, moved = _judge(before, change)
            out.append({"success": moved, "balance_before": before, "balance_after": now})
        return now, out

    done = folds.folded(opened, [user], order, [amount.cast("bigint"), F.col("_opening")], step, None, "bigint", "_moved", MOVED)
    return done.select(*requests.columns, "_moved.*")


def totals(moved: DataFrame, user: str, order: Column, amount: Column) -> DataFrame:
    """user, balance, earned, spent and refused of the movements that ``movements`` judged."""
    done = F.when(F.col("success"), amount)
    return moved.groupBy(user).agg(F.max_by("balance_after", order).alias("balance"), F.coalesce(F.sum(F.when(done > 0, done)), F.lit(0)).alias("earned"), F.coalesce(F.sum(F.when(done < 0, -done)), F.lit(0)).alias("spent"), F.count_if(~F.col("success")).alias("refused"))
