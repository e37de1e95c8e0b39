"""Monetary rules as Columns on decimals, and procedural dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark-up in per cent by tier; discount by yearly or monthly volume; steps of unit prices.
MARKUP = {"free": 0, "startup": 30, "business": 50, "enterprise": 40, "internal": 0}
DISCOUNTS = ((1000, 15), (500, 10), (250, 5))
STEPS = ((10_000, "0.00714"), (20_000, "0.00690"), (30_000, "0.00667"), (50_000, "0.00643"))
LAST_STEP = "0.00238"
# Days to appeal by procedure, appeal and act.
DEADLINES = {
    "cpc:appeal:decision": 30, "cpc:appeal:ruling": 15, "cpc:cassation:decision": 30, "cpc:cassation:ruling": 30,
    "gpc:appeal:decision": 20, "gpc:appeal:ruling": 10, "gpc:cassation:decision": 20, "gpc:cassation:ruling": 20,
    "cac:appeal:decision": 30, "cac:appeal:ruling": 15, "cac:cassation:decision": 30, "cac:cassation:ruling": 30,
    "crpc:appeal:decision": 30, "crpc:appeal:ruling": 7, "crpc:cassation:decision": 3, "crpc:cassation:ruling": 3,
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def annual_claim(amount: Column, days: Column) -> Column:
    """Three per cent a year."""
    return F.round(amount.cast("decimal(18,2)") * F.lit(3).cast("decimal(3,0)") * days.cast("decimal(9,0)") / F.lit(36500).cast("decimal(5,0)"), 2)


def tier_price(cost: Column, tier: Column) -> Column:
    return F.round(cost.cast("decimal(18,6)") * (100 + F.coalesce(_lookup(MARKUP, tier), F.lit(0))).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)"), 6)


def volume_discount(volume: Column) -> Column:
    """Per cent off."""
    out = F.when(F.lit(False), 0)
    for least, percent in DISCOUNTS:
        out = out.when(volume >= least, percent)
    return out.otherwise(0)


def credits(usd: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(usd.cast("decimal(18,6)") * 100)).cast("bigint")


def step_price(running_count: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("decimal(9,5)"))
    for most, price in STEPS:
        out = out.when(running_count <= most, F.lit(price).cast("decimal(9,5)"))
    return out.otherwise(F.lit(LAST_STEP).cast("decimal(9,5)"))


def line_amount(minutes: Column, rate: Column) -> Column:
    """Hours are rounded first, so that amount is quantity times rate."""
    hours = F.round(minutes.cast("decimal(12,0)") / F.lit(60).cast("decimal(2,0)"), 2).cast("decimal(10,2)")
    return F.round(hours * rate.cast("decimal(12,2)"), 2)


def deadline(start: Column, procedure: Column, appeal: Column, act: Column) -> Column:
    """Null for a combination that the table lacks."""
    return F.date_add(start, _lookup(DEADLINES, F.concat_ws(":", procedure, appeal, act)))


def parse_date(text: Column) -> Column:
    """Dates written DD.MM.YYYY, YYYY-MM-DD or DDMMYYYY; null for others."""
    forms = ((r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{8}$", "ddMMyyyy"))
    return F.coalesce(*(F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f)).cast("date")) for p, f in forms))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, F.nullif(whole, F.lit(0))), digits)


def invoice_status(paid: Column, total: Column, status: Column) -> Column:
    """Status after a payment: paid once payments reach the total with tax; a draft that was paid in part is sent; else as it was."""
    return F.when(paid >= total, "paid").when((status == "draft") & (paid > 0), "sent").otherwise(status)


# Monthly spending from which a tier is advised; cost of a token by embedding model, and of others.
ADVISED_TIERS = (("free", 0), ("startup", 100), ("business", 500))
TOKEN_COST = {"voyage-multilingual-2": "0.00000012", "voyage-3-multilingual": "0.00000006", "voyage-3": "0.00000006", "voyage-3-lite": "0.00000002", "voyage-finance-2": "0.00000012", "voyage-law-2": "0.00000012"}
# Tokens and registry calls of an estimate by the depth of reasoning.
BUDGETS = {"quick": (1000, 1), "standard": (3000, 2), "deep": (5000, 5)}


def advised_tier(monthly: Column) -> Column:
    """Nothing spent: free; under 100: startup; under 500: business; else enterprise."""
    return F.when(monthly == 0, "free").when(monthly < 100, "startup").when(monthly < 500, "business").otherwise("enterprise")


def monthly_revenue(daily: Column, tier: Column, days: int = 30) -> Column:
    """struct(cost, price, profit, margin) of a month of so many days; the margin is the tier's mark-up in per cent."""
    cost = daily.cast("decimal(18,6)") * F.lit(days).cast("decimal(3,0)")
    price = tier_price(cost, tier)
    return F.struct(cost.cast("double").alias("cost"), price.cast("double").alias("price"), (price - cost).cast("double").alias("profit"), F.coalesce(_lookup(MARKUP, tier), F.lit(0)).alias("margin"))


def token_cost(model: Column, tokens: Column) -> Column:
    return tokens.cast("decimal(18,0)") * F.coalesce(_lookup(TOKEN_COST, model), F.lit("0.00000012")).cast("decimal(9,8)")


def cost_estimate(tool: Column, query_length: Column, budget: Column, registry_calls: Column, search_calls: Column) -> Column:
    """struct(tokens, registry_calls, search_calls, total) of a call before it runs, at the unit prices of the month's counts so far."""
    tokens = F.coalesce(_lookup({k: v[0] for k, v in BUDGETS.items()}, budget), F.lit(0)) + F.floor(query_length / 4).cast("int")
    searching = tool.contains("search")
    calls = F.coalesce(_lookup({k: v[1] for k, v in BUDGETS.items()}, budget), F.lit(0)) + searching.cast("int")
    more = F.when(searching, 5).otherwise(0)
    total = tokens.cast("double") / 1000 * 0.002 + calls * step_price(registry_calls).cast("double") + more * step_price(search_calls).cast("double")
    return F.struct(tokens.alias("tokens"), calls.alias("registry_calls"), more.alias("search_calls"), F.round(total, 6).alias("total"))


def timer_minutes(seconds: Column) -> Column:
    return F.ceil(seconds / 60).cast("int")


def relative_range(text: Column, as_of: Column) -> Column:
    """struct(date_from, warning) of ``last N years`` or ``last N months`` before a day; ends of months are clamped."""
    t = F.lower(F.trim(text))
    n = lambda unit: F.regexp_extract(t, rf"last\s+(\d+)\s+{unit}s?", 1)
    months = F.coalesce(F.nullif(n("year"), F.lit("")).cast("int") * 12, F.nullif(n("month"), F.lit("")).cast("int"))
    return F.struct(F.add_months(as_of, -months).alias("date_from"), F.when(text.isNotNull() & months.isNull(), "unsupported").alias("warning"))


def fresh(checked: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(checked > as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def impact_score(cases: Column) -> Column:
    return F.least(cases / 100.0, F.lit(1.0))
