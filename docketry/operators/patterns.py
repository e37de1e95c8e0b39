"""What court reasonings of a topic have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.legal import ladder

# Words that tell how a case ended; phrases that weaken or carry a claim; reasons of a refusal.
ENDINGS = {"consumer_won": ("задоволено", "позивач виграв"), "rejected": ("відмовлено", "відхилено"), "partial": ("частково",)}
RISKS = ("недостатньо доказів", "не доведено", "пропущено строк", "не відповідає")
ARGUMENTS = ("доведено", "підтверджено", "відповідає вимогам", "має право")
REASONS = (("недостатньо", "Недостатньо доказів"), ("пропущено", "Пропущено строк позовної давності"), ("не відповідає", "Не відповідає вимогам закону"))
# Categories and levels of a risk phrase; confidence of a pattern by the number of its rows.
RISK_CATEGORIES = (("legal_risk", ("доказ", "строк")), ("financial_risk", ("сума", "платіж")), ("compliance_issue", ("вимог",)))
RISK_LEVELS = (("high", ("недостатньо доказів", "пропущено строк")), ("medium", ("не доведено",)))
TIERS = ((20, 0.9), (10, 0.7), (5, 0.5))
#: Rows of a topic that make a pattern, and the share of them that an article's mentions must reach.
LEAST_ROWS, SHARE = 3, 0.3


def _any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in phrases))


def ending(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return ladder([(name, _any(t, words)) for name, words in ENDINGS.items()], "unknown")


def tier(count: Column) -> Column:
    return F.coalesce(*(F.when(count >= least, value) for least, value in TIERS), F.lit(0.3))


def common_articles(rows: DataFrame, topic: str) -> DataFrame:
    """topic and law_articles: those whose mentions over all rows are at least three tenths of the rows, as written."""
    sizes = rows.groupBy(topic).agg(F.count("*").alias("n"))
    each = rows.select(topic, F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?iu)ст\.\s*\d+"), F.lit(0))).alias("article"))
    counted = each.groupBy(topic, "article").agg(F.count("*").alias("c")).join(sizes, topic).where(F.col("c") >= F.ceil(F.col("n") * SHARE))
    return counted.groupBy(topic).agg(F.array_sort(F.collect_list("article")).alias("law_articles"))


def case_patterns(rows: DataFrame, topic: str) -> DataFrame:
    """topic, frequency, law_articles, outcome, confidence, risk_factors and success_arguments of topics with three rows or more.

    ``rows``: doc_id, text and the topic. The outcome is the most frequent one (of equals the one of the smallest
    doc_id); an unknown one counts as rejected. Phrases stand in the order of their lists.
    """
    t = F.lower(F.coalesce("text", F.lit("")))
    held = [F.max(t.contains(p)).alias(f"_p{i}") for i, p in enumerate((*RISKS, *ARGUMENTS))]
    size = rows.groupBy(topic).agg(F.count("*").alias("frequency"), *held).where(F.col("frequency") >= LEAST_ROWS)
    ends = rows.groupBy(topic, ending(F.col("text")).alias("_end")).agg(F.count("*").alias("_c"), F.min("doc_id").alias("_first"))
    best = ends.groupBy(topic).agg(F.max_by("_end", F.struct("_c", -F.col("_first"))).alias("_end"))
    found = lambda names, start: F.array_compact(F.array(*(F.when(F.col(f"_p{start + i}"), p) for i, p in enumerate(names))))
    met = size.join(best, topic).join(common_articles(rows, topic), topic, "left")
    outcome = F.when(F.col("_end") == "unknown", "rejected").otherwise(F.col("_end"))
    return met.select(topic, "frequency", F.coalesce("law_articles", F.array().cast("array<string>")).alias("law_articles"), outcome.alias("outcome"), tier(F.col("frequency")).alias("confidence"), found(RISKS, 0).alias("risk_factors"), found(ARGUMENTS, len(RISKS)).alias("success_arguments"))


def failure_reasons(rows: DataFrame, topic: str) -> DataFrame:
    """topic, reason and n: why claims of a topic were refused, over the rows that tell of a refusal."""
    refused = rows.where(_any(F.lower("text"), ENDINGS["rejected"]))
    reasons = F.array_compact(F.array(*(F.when(F.col("text").contains(word), reason) for word, reason in REASONS)))
    return refused.select(topic, F.explode(reasons).alias("reason")).groupBy(topic, "reason").agg(F.count("*").alias("n"))


def risk_findings(sections: DataFrame, factors: tuple[str, ...] = RISKS) -> DataFrame:
    """A row for each section and risk phrase in it, with its category, level and the section's first 200 characters."""
    t = F.lower("text")
    found = F.array_compact(F.array(*(F.when(t.contains(f.lower()), f) for f in factors)))
    each = sections.select("*", F.explode(found).alias("factor"))
    name = F.lower("factor")
    return each.withColumns({"category": ladder([(c, _any(name, parts)) for c, parts in RISK_CATEGORIES], "other"), "risk_level": ladder([(r, _any(name, parts)) for r, parts in RISK_LEVELS], "low"), "quote": F.substring("text", 1, 200)})
