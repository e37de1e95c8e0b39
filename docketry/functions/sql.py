"""The monetary rules as SQL functions of a session: scalars, and tables that a query can join to laterally."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docketry.functions.money import DISCOUNTS, LAST_STEP, MARKUP, STEPS

_MARKUP = " ".join(f"WHEN '{t}' THEN {p}" for t, p in MARKUP.items())
_DISCOUNT = " ".join(f"WHEN volume >= {least} THEN {percent}" for least, percent in DISCOUNTS)
_STEP = " ".join(f"WHEN n <= {most} THEN {price}BD" for most, price in STEPS)

#: name: (parameters, result, expression or query)
SCALARS = {
    "usd_to_credits": ("usd DECIMAL(18,6)", "BIGINT", "greatest(1, CAST(ceil(usd * 100) AS BIGINT))"),
    "tier_price": ("cost DECIMAL(18,6), tier STRING", "DECIMAL(18,6)", f"CAST(round(cost * (100 + CASE tier {_MARKUP} ELSE 0 END) / 100, 6) AS DECIMAL(18,6))"),
    "volume_discount": ("volume DOUBLE", "INT", f"CASE {_DISCOUNT} ELSE 0 END"),
    "step_price": ("n BIGINT", "DECIMAL(9,5)", f"CASE {_STEP} ELSE {LAST_STEP}BD END"),
    "invoice_number": ("day DATE, place BIGINT", "STRING", "concat('INV-', year(day), '-', lpad(CAST(place AS STRING), 6, '0'))"),
    "billing_rate": ("own DECIMAL(12,2), standard DECIMAL(12,2)", "DECIMAL(12,2)", "coalesce(own, standard, 0)"),
}
TABLES = {
    # what a request would do to a balance
    "check_balance": ("balance DECIMAL(18,2), amount DECIMAL(18,2)", "has_credits BOOLEAN, current_balance DECIMAL(18,2), reason STRING", "SELECT ok, b, CASE WHEN ok THEN 'Sufficient balance' ELSE 'Insufficient credits' END FROM (SELECT coalesce(coalesce(balance, 0) >= amount, false) AS ok, coalesce(balance, 0) AS b)"),
    # parts of a price: the discount of a volume and what is left to pay
    "discounted": ("price DECIMAL(18,2), volume DOUBLE", "percent INT, off DECIMAL(18,2), due DECIMAL(18,2)", f"SELECT p, CAST(round(price * p / 100, 2) AS DECIMAL(18,2)), CAST(price - round(price * p / 100, 2) AS DECIMAL(18,2)) FROM (SELECT CASE {_DISCOUNT} ELSE 0 END AS p)"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; they are expressions that Catalyst inlines, and end with the session."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {body}")
