"""Questions and answers of a legal assistant: what is asked for, and whether an answer is founded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.legal import ladder

# Intents in order; each rule is a list of alternatives, an alternative a tuple of parts that all stand in the question.
# With the intent: the domains that are searched and the sections that are read.
INTENTS = (
    ("supreme_court_position", (("позиці",), ("позиция",), ("правов",), ("вс", "виснов"), ("верховн",)), ("court",), ("COURT_REASONING",)),
    ("procedural_deadlines", (("строк",), ("поновлен",), ("пропуск",)), ("court", "npa"), ("COURT_REASONING", "DECISION", "LAW_REFERENCES")),
    ("admissibility_and_formal_requirements", (("без рух",), ("повернен",), ("без розгляд",), ("закритт",)), ("court", "npa"), ("COURT_REASONING", "DECISION", "LAW_REFERENCES")),
    ("jurisdiction_and_competence", (("підсудн",), ("юрисдикц",), ("підвідомч",)), ("court", "npa"), ("COURT_REASONING", "LAW_REFERENCES")),
    ("evidence_and_standards", (("доказ",), ("належн",), ("допустим",), ("експертиз",), ("електронн",)), ("court", "npa"), ("FACTS", "COURT_REASONING")),
    ("interim_measures", (("забезпечен", "позов"), ("забезпечен", "доказ")), ("court", "npa"), ("COURT_REASONING", "LAW_REFERENCES")),
    ("amounts_and_costs", (("пеня",), ("інфляц",), ("3%",), ("судов", "витрат")), ("court", "npa"), ("AMOUNTS", "COURT_REASONING")),
    ("two_sided_practice", (("за/проти",), ("дві ліні",), ("две лини",), ("неоднорід",)), ("court",), ("COURT_REASONING", "DECISION")),
    ("parliament_search", tuple((w,) for w in ("депутат", "народн", "парламент", "верховна рада", "верховної ради", "верховну раду", "голосуванн", "голосован", "законопроект", "законопроєкт", "фракці", "фракци", "комітет", "комитет")), ("parliament",), None),
    ("registry_search", (*((w,) for w in ("єдрпоу", "едрпоу", "эдрпоу", "бенефіціар", "бенефициар", "реєстр підприємств", "реестр предприятий", "підприємств", "предприяти", "засновник", "учредител", "боржник", "должник")), ("юридичн", "особ"), ("юридическ", "лиц")), ("registry",), None),
    ("consumer_penalty_delay", (("споживач",), ("затримка",), ("доставка",)), ("court", "npa"), None),
    ("tax_dispute", (("податк",), ("налог",)), ("court", "npa"), None),
    ("labor_dispute", (("прац",), ("трудов",)), ("court", "echr"), None),
)
USUAL_SECTIONS = ("COURT_REASONING", "DECISION")
# What a question says of the procedure, the court and the wanted form; of codes and forms the last named in this order holds.
CODES = ("цпк", "гпк", "кас", "кпк")
COURTS = (("GrandChamber", ("велика палата", "вп")), ("SC", ("верховн", "вс ", " кцс", " кгс", " ккc", " ккс")), ("cassation", ("касац",)), ("appeal", ("апеляц",)), ("first_instance", ("перша інстанц", "первая инстанц")))
OUTPUTS = (("чеклист", "чеклист"), ("таблиця", "таблиц"), ("порівняння", "порівня"), ("підбірка", "підбірк"))
# Services by what a question looks like.
SERVICES = (("workflow_automation", r"(?iu)workflow|інтеграц|integration"), ("document_vault", r"(?iu)vault|сховищ|хранилищ"), ("due_diligence", r"(?iu)due\s*diligence|dd\b|перевірк|провер|m&a"))
# Names of court levels: whole names, then parts of names.
LEVEL_NAMES = (("GrandChamber", ("grandchamber", "grand_chamber", "grand chamber", "вп"), ("велика палата", "вп вс")), ("SC", ("sc", "вс"), ("supreme", "верхов", "кцс", "кгс", "кас", "ккс")), ("cassation", ("cassation",), ("касац",)), ("appeal", ("appeal",), ("апеляц",)), ("first_instance", ("first_instance",), ("перша інстанц", "первая инстанц")))
SECTION_TYPES = ("FACTS", "CLAIMS", "LAW_REFERENCES", "COURT_REASONING", "DECISION", "AMOUNTS")


def _any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def intent(question: Column) -> Column:
    """struct of what a question asks for: intent, domains, sections, and the slots that it names."""
    q = F.lower(F.coalesce(question, F.lit("")))
    tests = [(name, reduce(lambda a, b: a | b, (reduce(lambda x, y: x & y, (q.contains(p) for p in parts)) for parts in rules))) for name, rules, *_ in INTENTS]
    chosen = ladder(tests, "general_search")
    lists = lambda k, usual: F.coalesce(F.try_element_at(F.create_map(*(x for row in INTENTS for x in (F.lit(row[0]), F.array(*map(F.lit, row[k] or usual))))), chosen), F.array(*map(F.lit, usual)))
    code = F.coalesce(*(F.when(q.contains(c), c.upper()) for c in reversed(CODES)))
    output = F.coalesce(*(F.when(q.contains(part), name) for name, part in reversed(OUTPUTS)))
    return F.struct(
        chosen.alias("intent"), F.lit(0.6).alias("confidence"), lists(2, ("court",)).alias("domains"), lists(3, USUAL_SECTIONS).alias("sections"), code.alias("procedure_code"), ladder([(n, _any(q, p)) for n, p in COURTS]).alias("court_level"),
        output.alias("desired_output"), _any(q, ("пеня", "штраф")).alias("penalty"), q.contains("інфляц").alias("inflation"), _any(q, ("3%", "три відсотк", "три проц")).alias("three_percent"), (q.contains("судов") & q.contains("витрат")).alias("legal_fees"),
    )


def service(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return ladder([(name, q.rlike(pattern)) for name, pattern in SERVICES], "legal_research")


def court_level(value: Column) -> Column:
    """A court level in its own spelling, or null for what names none."""
    v = F.lower(F.trim(value))
    # "cassation" holds the Cyrillic short name of no court, so whole names of later levels come first where they differ
    return ladder([(name, v.isin(*whole) | _any(v, parts)) for name, whole, parts in LEVEL_NAMES])


def section_types(values: Column) -> Column:
    """Known section types of a list in their own spelling, the usual two if none is known."""
    named = F.transform(values, lambda v: F.upper(F.trim(v)))
    known = F.filter(named, lambda v: v.isin(*SECTION_TYPES))
    return F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, known).otherwise(F.array(*map(F.lit, USUAL_SECTIONS)))


def has_source(claim: Column, sources: Column) -> Column:
    """Whether a claim names one of its sources, or speaks of a source at all where there are any."""
    some = F.size(F.coalesce(sources, F.array().cast("array<string>"))) > 0
    return some & (F.exists(sources, lambda s: claim.contains(s)) | claim.contains("джерело") | claim.contains("посилання"))


def validated(answers: DataFrame, known_cases: DataFrame) -> DataFrame:
    """answer_id, claims, unsourced, invalid (mentions of cases that nobody knows), is_valid and confidence.

    ``answers``: answer_id, answer, sources (array); ``known_cases``: case_number. Claims are sentences of more than
    20 characters; an answer without claims is valid with confidence 1. Cited numbers meet the known ones in a join.
    """
    sentences = F.filter(F.split("answer", "[.!?]+"), lambda s: F.length(F.trim(s)) > 20)
    each = answers.select("answer_id", "sources", F.posexplode(sentences).alias("n", "claim")).withColumn("sourced", F.coalesce(has_source(F.col("claim"), F.col("sources")), F.lit(False)))
    cited = each.select("answer_id", F.explode(F.regexp_extract_all("claim", F.lit(r"\d+/\d+/\d{4}"), F.lit(0))).alias("case_number"))
    wrong = cited.join(known_cases.select("case_number").distinct(), "case_number", "left_anti").groupBy("answer_id").agg(F.count("*").alias("invalid"))
    counts = each.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(~F.col("sourced")).alias("unsourced"))
    met = answers.select("answer_id").join(counts, "answer_id", "left").join(wrong, "answer_id", "left").na.fill(0)
    share = lambda c: 1 - F.col(c) / F.col("claims")
    confidence = F.when(F.col("claims") == 0, 1.0).otherwise(F.round((share("unsourced") + share("invalid")) / 2, 6))
    return met.select("answer_id", "claims", "unsourced", "invalid", ((F.col("unsourced") == 0) & (F.col("invalid") == 0)).alias("is_valid"), confidence.alias("confidence"))
