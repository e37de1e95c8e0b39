"""The engine's operators under the names of a legal assistant's tools; each takes and returns DataFrames.

``TOOLS[name]`` is a function; its parameters are the tool's. Tables are parameters too, never globals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import answers as A
from docketry.functions import legal as L
from docketry.functions import money as M
from docketry.functions.sections import sections
from docketry.operators import cases as O
from docketry.operators import graphs as G
from docketry.operators import patterns as P
from docketry.operators import relational as R
from docketry.operators import vectors as V
from docketry.plans.index import similar_facts
from docketry.plans.lookups import attendance, of_faction, positions_of, supreme_court
from docketry.plans.reporting import portfolio_level, risk_scores

TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f):
    TOOLS[f.__name__] = f
    return f


@tool
def classify_intent(questions: DataFrame) -> DataFrame:
    return questions.withColumns({"intent": A.intent(F.col("question")), "service": A.service(F.col("question"))})


@tool
def validate_response(answers: DataFrame, known_cases: DataFrame) -> DataFrame:
    return A.validated(answers, known_cases)


@tool
def check_precedent_status(numbers: DataFrame, decisions: DataFrame) -> DataFrame:
    return O.precedent_status(numbers, decisions)


@tool
def get_case_documents_chain(numbers: DataFrame, decisions: DataFrame, group_by_instance: bool = True) -> DataFrame:
    chain = O.case_chain(numbers, decisions)
    return O.by_instance(chain) if group_by_instance else chain


@tool
def get_court_decision(decisions: DataFrame, doc_id) -> DataFrame:
    return decisions.where(F.col("doc_id") == doc_id)


@tool
def extract_document_sections(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(sections(F.col("text"))).alias("s")).select("doc_id", "s.*")


@tool
def analyze_case_pattern(reasonings: DataFrame, topic: str = "topic") -> DataFrame:
    return P.case_patterns(reasonings, topic)


TOOLS["analyze_legal_patterns"] = analyze_case_pattern


@tool
def count_cases_by_party(cases: DataFrame, columns: list[str], party: str, date: str | None = None, date_from=None, date_to=None, key: str = "doc_id") -> DataFrame:
    found = R.contains_text(cases, columns, party)
    return (R.between(found, date, date_from, date_to) if date else found).agg(F.countDistinct(key).alias("total"))


@tool
def get_citation_graph(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    return G.neighbourhood(edges, start, depth)


@tool
def get_similar_reasoning(vectors: DataFrame, question: list[float], limit: int = 10, must: dict | None = None, ranges: dict | None = None, should: dict | None = None, least: float | None = None) -> DataFrame:
    return V.nearest(V.filtered(vectors, must, ranges, should), question, limit, least=least)


TOOLS["semantic_search"] = get_similar_reasoning


@tool
def search_supreme_court_practice(decisions: DataFrame, procedure_code: str | None = None, grand_chamber: bool = False, query: str | None = None) -> DataFrame:
    found = supreme_court(decisions, procedure_code, grand_chamber)
    return found if query is None else found.where(L.has_all_words(F.col("text"), query))


@tool
def compare_practice_pro_contra(documents: DataFrame, query: str, mark: str) -> DataFrame:
    """Texts on a question, those that have the mark and those that do not."""
    found = documents.where(L.has_all_words(F.col("text"), query))
    return found.withColumn("side", F.when(F.lower("text").contains(mark.lower()), "pro").otherwise("contra"))


@tool
def find_similar_fact_pattern_cases(facts: DataFrame, texts: DataFrame, limit: int = 10) -> DataFrame:
    return R.first_per(similar_facts(facts, texts), ["fact_id"], [F.desc("hits"), F.asc("doc_id")], limit)


@tool
def calculate_procedural_deadlines(events: DataFrame) -> DataFrame:
    """``events``: event_date, procedure, appeal, act."""
    return events.withColumn("due", M.deadline(F.col("event_date"), F.col("procedure"), F.col("appeal"), F.col("act")))


@tool
def calculate_monetary_claims(claims: DataFrame) -> DataFrame:
    """``claims``: amount, date_from, date_to."""
    return claims.withColumn("claim", M.annual_claim(F.col("amount"), F.datediff("date_to", "date_from")))


@tool
def get_legislation_articles(articles: DataFrame, rada_id: str, numbers: list[str] | None = None) -> DataFrame:
    found = articles.where(F.col("is_current") & (F.col("rada_id") == rada_id))
    return found if numbers is None else found.where(F.col("article_number").isin(*numbers))


@tool
def get_legislation_article(articles: DataFrame, references: DataFrame) -> DataFrame:
    """The current article that each reference (column reference, free text) names."""
    named = references.withColumn("_r", L.law_reference(F.col("reference"))).select("reference", "_r.rada_id", F.col("_r.article").alias("article_number"))
    return named.join(articles.where("is_current"), ["rada_id", "article_number"])


@tool
def search_legislation(articles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    hits = L.occurrences(F.col("full_text"), query).alias("relevance")
    return articles.select("*", hits).where("relevance > 0").orderBy(F.desc("relevance"), "rada_id", "article_number").limit(limit)


TOOLS["search_legislation_text"] = TOOLS["find_relevant_law_articles"] = search_legislation


@tool
def get_legislation_structure(articles: DataFrame) -> DataFrame:
    return articles.where("is_current").groupBy("rada_id", "chapter").agg(F.count("*").alias("articles"))


@tool
def bulk_review_runner(sections_: DataFrame) -> DataFrame:
    return P.risk_findings(sections_)


@tool
def risk_scoring(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return risk_scores(findings, key)


@tool
def generate_dd_report(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return portfolio_level(risk_scores(findings, key))


@tool
def compare_documents(pairs: DataFrame) -> DataFrame:
    """``pairs``: doc_id, old, new."""
    each = pairs.select("doc_id", F.explode(L.word_changes(F.col("old"), F.col("new"))).alias("c")).select("doc_id", "c.*")
    return each.withColumn("importance", L.change_importance(F.col("text")))


@tool
def get_document(documents: DataFrame, doc_id) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


@tool
def list_documents(documents: DataFrame, sort_by: str | None = None, columns: dict[str, str] | None = None, descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    column = (columns or {}).get(sort_by or "", "doc_id")
    return R.with_total(documents, [F.desc(column) if descending else F.asc(column), F.asc("doc_id")], offset, limit)


@tool
def store_document(stored: DataFrame, new: DataFrame, keep_if_null: tuple[str, ...] = (), merge: tuple[str, ...] = ()) -> DataFrame:
    return R.upsert(stored, new, ["doc_id"], keep_if_null, merge)


@tool
def search_entities(entities: dict[str, DataFrame], columns: list[str], text: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Entities of several registries (kind: table with record and ``columns``) in the order of the kinds, newest first."""
    arms = [R.contains_text(df, columns, text).select(F.lit(i).alias("_arm"), F.lit(kind).alias("kind"), "record", *columns) for i, (kind, df) in enumerate(entities.items())]
    both = arms[0]
    for arm in arms[1:]:
        both = both.unionByName(arm)
    return R.page(both, [F.asc("_arm"), F.desc("record")], offset, limit).drop("_arm")


TOOLS["search_business_entities"] = search_entities


@tool
def get_by_edrpou(keys: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """record and kind: the first registry that has it."""
    return R.first_kind(keys, "record", entities)


TOOLS["lookup_by_edrpou"] = get_by_edrpou


@tool
def search_registry(rows: DataFrame, equal: dict | None = None, columns: list[str] | None = None, text: str | None = None, order: str = "record", offset: int = 0, limit: int = 50) -> DataFrame:
    """Any flat registry by equal values and a part of a text."""
    found = R.conjunction(rows, **(equal or {}))
    return R.page(R.contains_text(found, columns, text) if columns and text else found, [F.asc(order)], offset, limit)


for _name in ("notaries", "court_experts", "arbitration_managers", "debtors", "enforcement_proceedings", "bankruptcy_cases", "special_forms", "forensic_methods", "legal_acts", "administrative_units", "streets", "beneficiaries", "parliament_bills", "court_sessions", "echr_practice"):
    TOOLS[f"search_{_name}"] = search_registry


@tool
def get_deputy_info(members: DataFrame, name: str | None = None, faction: str | None = None) -> DataFrame:
    found = R.contains_text(members, ["name"], name) if name else members
    return of_faction(found, faction) if faction else found


@tool
def analyze_voting_record(votes: DataFrame, member_id: str | None = None) -> DataFrame:
    rows = positions_of(votes)
    return attendance(rows if member_id is None else rows.where(F.col("member_id") == member_id))


@tool
def get_statistics(entities: DataFrame, groups: list[str], top: int = 10) -> DataFrame:
    return entities.groupBy(*groups).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *groups).limit(top)
