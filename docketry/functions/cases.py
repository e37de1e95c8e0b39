"""Decisions of a case as Columns: kind of document, effect on the decision below, what a search needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.legal import ladder

# What a resolution says and its effect on the decision under review; the first that holds decides.
# Each rule: groups of which every one must have a phrase in the text.
EFFECTS = (
    ("залишено без змін", "upheld", (("залишити без змін", "залишено без змін"),)),
    ("відмовлено у задоволенні скарги", "upheld", (("відмовити",), ("апеляці", "скарг"))),
    ("скасовано та направлено на новий розгляд", "remanded", (("скасув",), ("направ", "нов"))),
    ("скасовано", "overruled", (("скасув",),)),
    ("змінено", "modified", (("змінити", "змінено"),)),
    ("частково задоволено", "modified", (("частков",), ("задовольн",))),
    ("провадження закрито", "closed", (("закрити провадження", "закрито провадження"),)),
    ("задоволено", "overruled", (("задовольн",),)),
    ("відмовлено", "upheld", (("відмов",),)),
)
# Kinds of documents by their form, and by words of the title or snippet where no form is given.
FORMS = (("Постанова", "постанова"), ("Рішення", "рішення"), ("Ухвала", "ухвала"), ("Вирок", "вирок"), ("Окрема ухвала", "окрема"))
TITLES = ("Постанова", "Рішення", "Ухвала", "Окрема думка")
# Chambers by what a text calls them.
CHAMBER_MARKS = (
    ("ВП ВС", ("велика палата", "вп вс", "великої палати верховного суду")), ("КЦС", ("кцс", "касаційний цивільний суд")), ("КГС", ("кгс", "касаційний господарський суд")),
    ("КАС", ("кас", "касаційний адміністративний суд")), ("ККС", ("ккс", "касаційний кримінальний суд")),
)
# What a status means for the cited decision, by the effect of the highest court.
STATUS = {"overruled": "explicitly_overruled", "remanded": "explicitly_overruled", "modified": "limited", "closed": "limited", "upheld": "valid"}
# Confidence of a status by the level of the court that decided: (status, ((least level, confidence), ...)).
CONFIDENCE = (("explicitly_overruled", ((3, 0.95), (2, 0.85), (0, 0.75))), ("limited", ((3, 0.90), (2, 0.80), (0, 0.70))), ("valid", ((3, 0.90), (0, 0.80))))
# Terms that a search for similar facts looks for, and kinds of disputes by words that stand together.
LEGAL_TERMS = (
    "заборгованість", "стягнення", "позов", "договір", "лізинг", "неустойка", "відшкодування", "розірвання", "виконання", "зобов'язання", "порушення",
    "відповідальність", "збитки", "штраф", "пеня", "сплата", "оплата", "послуги", "товар",
)
DISPUTES = (("стягнення заборгованості", ("стягнення", "заборгованост")), ("розірвання договору", ("розірвання договору",)), ("відшкодування збитків", ("відшкодування збитків",)))


def _any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in phrases))


def effect(text: Column) -> Column:
    """struct(outcome, effect) of a resolution, or null."""
    t = F.lower(text)
    out = F.lit(None).cast("struct<outcome:string,effect:string>")
    for name, kind, groups in reversed(EFFECTS):
        out = F.when(reduce(lambda a, b: a & b, (_any(t, g) for g in groups)), F.struct(F.lit(name).alias("outcome"), F.lit(kind).alias("effect"))).otherwise(out)
    return out


def document_type(form: Column, title: Column, snippet: Column) -> Column:
    form, title, snippet = (F.coalesce(c, F.lit("")) for c in (F.lower(form), title, snippet))
    return ladder([*((kind, form.contains(mark)) for kind, mark in FORMS), *((kind, title.contains(kind) | snippet.contains(kind)) for kind in TITLES)], "Невідомо")


def chamber(text: Column) -> Column:
    """The chamber that a text names; short names count as words (``кас`` begins every cassation court's name)."""
    t = F.lower(text)
    word = lambda m: t.rlike(rf"(?<![\p{{L}}\p{{N}}]){m}(?![\p{{L}}\p{{N}}])") if len(m) == 3 else t.contains(m)
    return ladder([(name, reduce(lambda a, b: a | b, map(word, marks))) for name, marks in CHAMBER_MARKS])


def court_of_snippet(snippet: Column) -> Column:
    """The court that a snippet names behind the words for "in case no." and the case's number, up to a tag; else null."""
    behind = F.regexp_extract(snippet, r"(?isu)по справі №(.*)", 1)
    number = F.regexp_extract(behind, r"\d+/\d+/\d\S*", 0)
    rest = F.substring(behind, F.instr(behind, number) + F.length(number), F.length(behind))
    return F.when(number != "", F.nullif(F.trim(F.split_part(F.trim(rest), F.lit("<"), F.lit(1))), F.lit("")))


def status_of(effect_: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), effect_), F.lit("unknown"))


def confidence(status: Column, level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, steps in CONFIDENCE:
        for least, value in steps:
            out = out.when((status == name) & (level >= least), value)
    return out.otherwise(0.5)


def bucket(instance: Column) -> Column:
    """The instance without its chamber."""
    return F.when(instance.startswith("Касація"), "Касація").otherwise(instance)


def search_terms(text: Column) -> Column:
    """struct(articles, keywords, dispute, query, essence): what a search for similar facts asks for."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?iu)(?:ст\.|статт[іяє]|article)\s*(\d+(?:\.\d+)?)"), F.lit(1))
    words = F.filter(F.array(*map(F.lit, LEGAL_TERMS)), lambda w: t.contains(w))
    dispute = ladder([(name, reduce(lambda a, b: a & b, (t.contains(p) for p in parts))) for name, parts in DISPUTES])
    query = F.concat_ws(" ", dispute, F.array_join(F.slice(words, 1, 5), " "))
    return F.struct(F.slice(F.array_distinct(found), 1, 10).alias("articles"), F.slice(words, 1, 15).alias("keywords"), dispute.alias("dispute"), F.trim(query).alias("query"), F.coalesce(dispute, F.lit("загальний спір")).alias("essence"))
