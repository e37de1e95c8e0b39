"""Chains of decisions, the standing of a precedent, and citations between cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import cases as C
from docketry.functions import legal as L

CITING = (r"\d+/\d+/\d{4}", r"(?iu)справа\s+№\s*\d+", r"(?iu)рішення\s+№\s*\d+")


def case_chain(numbers: DataFrame, decisions: DataFrame) -> DataFrame:
    """number and every decision whose case number is one of the number's forms, each once, with its kind and instance.

    ``numbers``: number (repeated ones count once); ``decisions``: doc_id, case_number, title, court, chamber, form,
    decided, resolution, snippet. An equi join on the forms; rows without doc_id are left out.
    """
    forms = numbers.select("number").distinct().select("number", F.explode(L.case_number_variations(F.col("number"))).alias("case_number"))
    rows = decisions.where("doc_id is not null").dropDuplicates(["doc_id"])
    instance = L.instance(F.col("court"), F.col("chamber"), F.col("title"), F.col("snippet"))
    met = forms.join(rows, "case_number").withColumn("instance", instance)
    kind = C.document_type(F.col("form"), F.col("title"), F.col("snippet"))
    court = F.coalesce(F.nullif("court", F.lit("")), C.court_of_snippet(F.col("snippet")))
    return met.select("number", "doc_id", "case_number", kind.alias("document_type"), "instance", L.instance_level(F.col("instance")).alias("level"), court.alias("court"), "decided", C.effect(F.col("resolution")).alias("effect"))


def chain_summary(chain: DataFrame) -> DataFrame:
    """number, documents, and counts by instance and by kind of document."""
    by = lambda name, test: F.count_if(test).alias(name)
    instance, kind = F.col("instance"), F.col("document_type")
    return chain.groupBy("number").agg(
        F.count("*").alias("documents"), by("first_instance", instance == "Перша інстанція"), by("appeal", instance == "Апеляція"), by("cassation", instance.contains("Касація")),
        by("grand_chamber", instance == "Велика Палата ВС"), by("decisions", kind.isin("Рішення", "Вирок")), by("rulings", kind == "Постанова"), by("orders", kind.contains("Ухвала")),
    )


def by_instance(chain: DataFrame) -> DataFrame:
    """number, bucket (instance without its chamber) and its documents in order of date; empty buckets have no row."""
    listed = F.array_sort(F.collect_list(F.struct("decided", "doc_id")))
    return chain.groupBy("number", C.bucket(F.col("instance")).alias("bucket")).agg(F.transform(listed, lambda x: x["doc_id"]).alias("doc_ids"))


def precedent_status(numbers: DataFrame, decisions: DataFrame) -> DataFrame:
    """number, target_doc_id, status, confidence, affecting (structs, highest court first) and chain_length of each distinct number.

    The target is the decision of the lowest known instance: the earliest, or the latest where the case has documents
    of unknown instance; where all are unknown, the earliest. Decisions of higher instances with a known effect affect
    it; the highest and latest decides. A number without decisions is unknown with confidence 0.5.
    """
    chain = case_chain(numbers, decisions)
    day = F.coalesce(F.datediff(F.to_date("decided"), F.lit("1970-01-01").cast("date")), F.lit(-(10**6)))
    placed = chain.withColumn("_day", day)
    known = F.when(F.col("level") > 0, F.struct("level", -F.col("_day"), "doc_id"))
    # the chain is made, moved and sorted once: what is known of a number stands beside each of its decisions
    case = Window.partitionBy("number")
    stats = placed.select(
        "*", F.count("*").over(case).cast("bigint").alias("chain_length"), (F.min("level").over(case) == 0).alias("_odd"), F.min_by(F.struct("doc_id", "level"), F.struct("level", "_day", "doc_id")).over(case).alias("_early"),
        F.min_by(F.struct("doc_id", "level"), known).over(case).alias("_late"),
    )
    target = F.when(F.col("_odd"), F.coalesce("_late", "_early")).otherwise(F.col("_early"))
    aimed = stats.withColumn("_target", target)
    above = (F.col("level") > F.greatest(F.lit(1), F.col("_target.level"))) & F.col("effect").isNotNull()
    order = F.struct("level", "_day", "doc_id")
    one = F.struct(-F.col("level"), -F.col("_day"), "doc_id", "instance", "court", "decided", F.col("effect.outcome"), F.col("effect.effect"))
    judged = aimed.groupBy("number").agg(
        F.first("chain_length").alias("chain_length"), F.first("_target")["doc_id"].alias("target_doc_id"),
        F.max_by(F.when(above, F.struct("effect.effect", "level")), F.when(above, order)).alias("_top"), F.array_sort(F.collect_list(F.when(above, one))).alias("_all"),
    )
    met = numbers.select("number").distinct().join(judged, "number", "left")
    status = F.when(F.col("_top").isNotNull(), C.status_of(F.col("_top.effect"))).when(F.col("chain_length") > 1, "valid").otherwise("unknown")
    shown = F.transform(F.coalesce("_all", F.array().cast(judged.schema["_all"].dataType)), lambda x: F.struct(*(x[f] for f in ("doc_id", "instance", "court", "decided", "outcome", "effect"))))
    out = met.withColumn("status", status)
    return out.select("number", "target_doc_id", "status", C.confidence(F.col("status"), F.coalesce("_top.level", F.lit(0))).alias("confidence"), shown.alias("affecting"), F.coalesce("chain_length", F.lit(0)).alias("chain_length"))


def citations(texts: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, cited (as written), place, context and citation_type of every mention of a case in a text."""
    found = F.concat(*(L.places(F.col(text), p) for p in CITING))
    each = texts.select(id_, text, F.explode(found).alias("m")).select(id_, F.col("m.match").alias("cited"), F.col("m.place").alias("place"), L.around(F.col(text), F.col("m.place")).alias("context"))
    return each.withColumn("citation_type", L.citation_type(F.col("context")))


def resolved(mentions: DataFrame, documents: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Links from a document to the one that carries the cited number: the smallest id, by an equi join on the number."""
    names = documents.where("case_number is not null").groupBy("case_number").agg(F.min(id_).alias("to_id"))
    return mentions.join(names, F.col("cited") == F.col("case_number")).select(F.col(id_).alias("from_id"), "to_id", "citation_type", "context", "place")


def saved_citations(links: DataFrame) -> DataFrame:
    """One row for each from_id, to_id and citation_type: the last mention's context."""
    return links.groupBy("from_id", "to_id", "citation_type").agg(F.max_by("context", "place").alias("context"))


def local_status(numbers: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """number, status and chain_length by the stored links to the documents of exactly that number; confidence 0.6, or 0.5 if there are none."""
    named = documents.where("case_number is not null").select(F.col("case_number").alias("number"), F.col("doc_id").alias("to_id"))
    met = links.join(named, "to_id").groupBy("number").agg(F.count("*").alias("n"), F.max(F.col("citation_type") == "overrules").alias("over"), F.max(F.col("citation_type") == "distinguishes").alias("apart"))
    out = numbers.select("number").distinct().join(met, "number", "left")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("over"), "explicitly_overruled").when(F.col("apart"), "questioned").otherwise("valid")
    return out.select("number", status.alias("status"), F.when(F.col("n").isNull(), 0.5).otherwise(0.6).alias("confidence"), F.coalesce("n", F.lit(0)).alias("chain_length"))
