"""Case chains, precedents, citations and patterns, on fixtures written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import answers as A
from docketry.functions import cases as C
from docketry.functions import legal as L
from docketry.operators import cases as O
from docketry.operators import patterns as P
from docketry.plans.fixtures import ANSWERS, DECISIONS, LEVELS, NUMBERS, QUESTIONS, REASONING, TEXTS
from docketry.plans.registry import query

# the rules of the reference as SQL, written from their description and not from the Columns
_FORMS = r"""list_distinct(list_filter(CASE WHEN regexp_matches({n}, '^\d+/\d+/\d{{2,4}}(-[а-яіїєґА-ЯІЇЄҐ])?$') THEN
  [{n}, p || short || suffix, p || long || suffix, p || short, p || long] ELSE [{n}] END, lambda x: x IS NOT NULL))"""
_VARIATIONS = rf"""variations AS (
  SELECT number, unnest({_FORMS.format(n="number")}) AS case_number FROM (
    SELECT number, p, suffix, CASE WHEN length(y) = 4 THEN right(y, 2) ELSE y END AS short, CASE WHEN length(y) = 2 THEN (CASE WHEN CAST(y AS INT) < 50 THEN '20' ELSE '19' END) || y ELSE y END AS long
    FROM (SELECT number, regexp_extract(number, '^(\d+/\d+/)', 1) AS p, regexp_extract(number, '^\d+/\d+/(\d{{2,4}})', 1) AS y, regexp_extract(number, '(-[а-яіїєґА-ЯІЇЄҐ])$', 1) AS suffix FROM (SELECT DISTINCT number FROM {NUMBERS.sql}))))"""
_INSTANCE = r"""CASE
  WHEN contains(h, 'велика палата') OR contains(h, 'вп вс') THEN 'Велика Палата ВС' WHEN contains(h, 'кцс') OR contains(h, 'касаційний цивільний') THEN 'Касація (КЦС ВС)'
  WHEN contains(h, 'кгс') OR contains(h, 'касаційний господарський') THEN 'Касація (КГС ВС)' WHEN contains(h, 'кас ') OR contains(h, 'касаційний адміністративний') THEN 'Касація (КАС ВС)'
  WHEN contains(h, 'ккс') OR contains(h, 'касаційний кримінальний') THEN 'Касація (ККС ВС)' WHEN contains(c, 'велика палата') OR contains(c, 'вп вс') THEN 'Велика Палата ВС'
  WHEN contains(c, 'касаці') OR contains(c, 'верховн') THEN 'Касація' WHEN contains(c, 'апеляці') THEN 'Апеляція' WHEN contains(c, 'окружний') OR contains(c, 'районний') OR contains(c, 'міськ') THEN 'Перша інстанція'
  WHEN regexp_matches(c, 'господарський суд .*(області|міста)|цивільний суд .*(області|міста)|адміністративний суд') THEN 'Перша інстанція'
  WHEN contains(t, 'касаці') THEN 'Касація' WHEN contains(t, 'апеляці') THEN 'Апеляція' ELSE 'Невідомо' END"""
_OUTCOME = r"""CASE
  WHEN contains(r, 'залишити без змін') OR contains(r, 'залишено без змін') THEN 'залишено без змін' WHEN contains(r, 'відмовити') AND (contains(r, 'апеляці') OR contains(r, 'скарг')) THEN 'відмовлено у задоволенні скарги'
  WHEN contains(r, 'скасув') AND (contains(r, 'направ') OR contains(r, 'нов')) THEN 'скасовано та направлено на новий розгляд' WHEN contains(r, 'скасув') THEN 'скасовано' WHEN contains(r, 'змінити') OR contains(r, 'змінено') THEN 'змінено'
  WHEN contains(r, 'частков') AND contains(r, 'задовольн') THEN 'частково задоволено' WHEN contains(r, 'закрити провадження') OR contains(r, 'закрито провадження') THEN 'провадження закрито'
  WHEN contains(r, 'задовольн') THEN 'задоволено' WHEN contains(r, 'відмов') THEN 'відмовлено' END"""
_TYPE = r"""CASE
  WHEN contains(f, 'постанова') THEN 'Постанова' WHEN contains(f, 'рішення') THEN 'Рішення' WHEN contains(f, 'ухвала') THEN 'Ухвала' WHEN contains(f, 'вирок') THEN 'Вирок' WHEN contains(f, 'окрема') THEN 'Окрема ухвала'
  WHEN contains(ti, 'Постанова') OR contains(s, 'Постанова') THEN 'Постанова' WHEN contains(ti, 'Рішення') OR contains(s, 'Рішення') THEN 'Рішення' WHEN contains(ti, 'Ухвала') OR contains(s, 'Ухвала') THEN 'Ухвала'
  WHEN contains(ti, 'Окрема думка') OR contains(s, 'Окрема думка') THEN 'Окрема думка' ELSE 'Невідомо' END"""
_CHAIN = rf"""{_VARIATIONS}, d AS (
  SELECT DISTINCT doc_id, case_number, decided, coalesce(title, '') AS ti, coalesce(snippet, '') AS s, lower(coalesce(title, '')) AS t, lower(coalesce(chamber, '')) AS h, lower(coalesce(nullif(court, ''), snippet, '')) AS c, court, lower(coalesce(form, '')) AS f, lower(resolution) AS r FROM {DECISIONS.sql}
), chain AS (
  SELECT *, CASE instance WHEN 'Велика Палата ВС' THEN 4 WHEN 'Апеляція' THEN 2 WHEN 'Перша інстанція' THEN 1 WHEN 'Невідомо' THEN 0 ELSE 3 END AS level FROM (
    SELECT v.number, d.doc_id, d.case_number, {_TYPE} AS document_type, {_INSTANCE} AS instance, {_OUTCOME} AS outcome, d.decided,
      coalesce(nullif(d.court, ''), nullif(trim(regexp_extract(s, '(?i)по справі №.*?\d+/\d+/\d+[^\s]*\s+(.+?)(?:<|$)', 1)), '')) AS court
    FROM variations v JOIN d ON v.case_number = d.case_number)
)"""
_EFFECT = "CASE WHEN outcome IN ('залишено без змін', 'відмовлено у задоволенні скарги', 'відмовлено') THEN 'upheld' WHEN outcome = 'скасовано та направлено на новий розгляд' THEN 'remanded' WHEN outcome IN ('скасовано', 'задоволено') THEN 'overruled' WHEN outcome IN ('змінено', 'частково задоволено') THEN 'modified' WHEN outcome = 'провадження закрито' THEN 'closed' END"


@query("txt12_case_number_forms", f"WITH {_VARIATIONS} SELECT number, case_number FROM variations")
def case_number_forms(spark, d):
    return NUMBERS.frame(spark, d).distinct().select("number", F.explode(L.case_number_variations(F.col("number"))).alias("case_number"))


@query("grf5_case_chain", f"WITH {_CHAIN} SELECT number, doc_id, document_type, instance, court, decided, outcome, {_EFFECT} AS effect FROM chain")
def case_chain(spark, d):
    chain = O.case_chain(NUMBERS.frame(spark, d), DECISIONS.frame(spark, d))
    return chain.select("number", "doc_id", "document_type", "instance", "court", "decided", "effect.outcome", "effect.effect")


@query("agg35_chain_summary", f"WITH {_CHAIN} SELECT number, count(*) AS documents, count(*) FILTER (level = 1) AS first_instance, count(*) FILTER (level = 2) AS appeal, count(*) FILTER (level = 3) AS cassation, count(*) FILTER (level = 4) AS grand_chamber, count(*) FILTER (document_type IN ('Рішення', 'Вирок')) AS decisions, count(*) FILTER (document_type = 'Постанова') AS rulings, count(*) FILTER (contains(document_type, 'Ухвала')) AS orders FROM chain GROUP BY 1")
def chain_summary(spark, d):
    return O.chain_summary(O.case_chain(NUMBERS.frame(spark, d), DECISIONS.frame(spark, d)))


@query("col11_instance_buckets", f"WITH {_CHAIN} SELECT number, CASE WHEN level = 3 THEN 'Касація' ELSE instance END AS bucket, string_agg(doc_id, ',' ORDER BY decided, doc_id) AS doc_ids FROM chain GROUP BY 1, 2")
def instance_buckets(spark, d):
    return O.by_instance(O.case_chain(NUMBERS.frame(spark, d), DECISIONS.frame(spark, d))).select("number", "bucket", F.concat_ws(",", F.transform("doc_ids", lambda x: x.cast("string"))).alias("doc_ids"))


@query("grf3_precedent_status", f"""WITH {_CHAIN}, ranked AS (
  SELECT *, min(level) OVER (PARTITION BY number) AS lowest, row_number() OVER (PARTITION BY number ORDER BY level, decided, doc_id) AS early, row_number() OVER (PARTITION BY number ORDER BY level = 0, level, decided DESC, doc_id) AS late, max(level) OVER (PARTITION BY number) AS highest FROM chain
), target AS (SELECT number, doc_id, greatest(level, 1) AS level FROM ranked WHERE CASE WHEN lowest = 0 AND highest > 0 THEN late = 1 ELSE early = 1 END
), above AS (
  SELECT c.*, {_EFFECT} AS effect, row_number() OVER (PARTITION BY c.number ORDER BY c.level DESC, c.decided DESC, c.doc_id DESC) AS n FROM chain c JOIN target t ON c.number = t.number AND c.level > t.level WHERE outcome IS NOT NULL
), top AS (SELECT number, effect, level FROM above WHERE n = 1
), listed AS (SELECT number, string_agg(doc_id || ':' || effect, ',' ORDER BY level DESC, decided DESC, doc_id) AS affecting FROM above GROUP BY 1
), judged AS (
  SELECT n.number, t.doc_id AS target_doc_id, (SELECT count(*) FROM chain c WHERE c.number = n.number) AS chain_length, top.level, coalesce(l.affecting, '') AS affecting,
    CASE WHEN top.effect IN ('overruled', 'remanded') THEN 'explicitly_overruled' WHEN top.effect IN ('modified', 'closed') THEN 'limited' WHEN top.effect = 'upheld' THEN 'valid' WHEN (SELECT count(*) FROM chain c WHERE c.number = n.number) > 1 THEN 'valid' ELSE 'unknown' END AS status
  FROM (SELECT DISTINCT number FROM {NUMBERS.sql}) n LEFT JOIN target t ON t.number = n.number LEFT JOIN top ON top.number = n.number LEFT JOIN listed l ON l.number = n.number
) SELECT number, target_doc_id, status, affecting, chain_length, CASE status WHEN 'explicitly_overruled' THEN CASE WHEN level >= 3 THEN 0.95 WHEN level = 2 THEN 0.85 ELSE 0.75 END WHEN 'limited' THEN CASE WHEN level >= 3 THEN 0.9 WHEN level = 2 THEN 0.8 ELSE 0.7 END WHEN 'valid' THEN CASE WHEN level >= 3 THEN 0.9 ELSE 0.8 END ELSE 0.5 END::DOUBLE AS confidence FROM judged""")
def precedent_status(spark, d):
    found = O.precedent_status(NUMBERS.frame(spark, d), DECISIONS.frame(spark, d))
    return found.withColumn("affecting", F.concat_ws(",", F.transform("affecting", lambda a: F.concat_ws(":", a["doc_id"], a["effect"]))))


_MENTIONS = f"""m AS (
  SELECT doc_id, text, unnest(regexp_extract_all(text, '\\d+/\\d+/\\d{{4}}')) AS cited, generate_subscripts(regexp_extract_all(text, '\\d+/\\d+/\\d{{4}}'), 1) AS n, string_split_regex(text, '\\d+/\\d+/\\d{{4}}') AS gaps, regexp_extract_all(text, '\\d+/\\d+/\\d{{4}}') AS found FROM {TEXTS.sql}
), placed AS (
  SELECT doc_id, text, cited, CAST(list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n - 1], lambda x: length(x))), 0) AS INT) AS place FROM m
  UNION ALL SELECT doc_id, text, regexp_extract(text, '(?i)справа\\s+№\\s*\\d+'), strpos(text, regexp_extract(text, '(?i)справа\\s+№\\s*\\d+')) - 1 FROM {TEXTS.sql} WHERE regexp_matches(text, '(?i)справа\\s+№\\s*\\d+')
  UNION ALL SELECT doc_id, text, regexp_extract(text, '(?i)рішення\\s+№\\s*\\d+'), strpos(text, regexp_extract(text, '(?i)рішення\\s+№\\s*\\d+')) - 1 FROM {TEXTS.sql} WHERE regexp_matches(text, '(?i)рішення\\s+№\\s*\\d+')
), cited AS (SELECT doc_id, cited, place, substr(text, greatest(place - 100, 0) + 1, place + 100 - greatest(place - 100, 0)) AS context FROM placed
), typed AS (SELECT *, CASE WHEN contains(lower(context), 'не погоджується') OR contains(lower(context), 'відступає') THEN 'distinguishes' WHEN contains(lower(context), 'скасовано') OR contains(lower(context), 'відмінено') THEN 'overrules' WHEN contains(lower(context), 'посилається') OR contains(lower(context), 'з посиланням') THEN 'references' ELSE 'follows' END AS citation_type FROM cited)"""


@query("txt6_citations", f"WITH {_MENTIONS} SELECT doc_id, cited, place, context, citation_type FROM typed")
def citations(spark, d):
    return O.citations(TEXTS.frame(spark, d))


_LINKS = f"{_MENTIONS}, links AS (SELECT t.doc_id AS from_id, n.to_id, citation_type, context, place FROM typed t JOIN (SELECT case_number, min(doc_id) AS to_id FROM {TEXTS.sql} GROUP BY 1) n ON n.case_number = t.cited)"


@query("jn11_resolved_citations", f"WITH {_LINKS} SELECT from_id, to_id, citation_type, place FROM links")
def resolved_citations(spark, d):
    return O.resolved(O.citations(TEXTS.frame(spark, d)), TEXTS.frame(spark, d)).drop("context")


@query("snk9_saved_citations", f"WITH {_LINKS} SELECT from_id, to_id, citation_type, arg_max(context, place) AS context FROM links GROUP BY 1, 2, 3")
def saved_citations(spark, d):
    return O.saved_citations(O.resolved(O.citations(TEXTS.frame(spark, d)), TEXTS.frame(spark, d)))


@query("grf4_local_status", f"""WITH {_LINKS}, numbers AS (SELECT DISTINCT number FROM {NUMBERS.sql} UNION SELECT case_number FROM {TEXTS.sql} WHERE case_number IS NOT NULL), s AS (SELECT DISTINCT from_id, to_id, citation_type FROM links), met AS (SELECT t.case_number AS number, s.* FROM s JOIN {TEXTS.sql} t ON t.doc_id = s.to_id)
  SELECT n.number, CASE WHEN count(m.to_id) = 0 THEN 'unknown' WHEN count(*) FILTER (citation_type = 'overrules') > 0 THEN 'explicitly_overruled' WHEN count(*) FILTER (citation_type = 'distinguishes') > 0 THEN 'questioned' ELSE 'valid' END AS status, CASE WHEN count(m.to_id) = 0 THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence, count(m.to_id) AS chain_length FROM numbers n LEFT JOIN met m ON m.number = n.number GROUP BY 1""")
def local_status(spark, d):
    texts = TEXTS.frame(spark, d)
    links = O.saved_citations(O.resolved(O.citations(texts), texts))
    numbers = NUMBERS.frame(spark, d).union(texts.where("case_number is not null").select("case_number"))
    return O.local_status(numbers, links, texts)


@query("jn12_citing_cases", f"WITH {_LINKS} SELECT l.citation_type, l.from_id, f.case_number AS from_case FROM (SELECT DISTINCT from_id, to_id, citation_type FROM links) l JOIN {TEXTS.sql} f ON f.doc_id = l.from_id WHERE l.to_id IN (SELECT doc_id FROM {TEXTS.sql} WHERE case_number LIKE '%757/123/2023')")
def citing_cases(spark, d):
    """What cites the case 757/123/2023 of every group."""
    texts = TEXTS.frame(spark, d)
    links = O.saved_citations(O.resolved(O.citations(texts), texts))
    wanted = texts.where("case_number LIKE '%757/123/2023'").select(F.col("doc_id").alias("to_id"))
    return links.join(wanted, "to_id", "left_semi").join(texts.select(F.col("doc_id").alias("from_id"), F.col("case_number").alias("from_case")), "from_id").select("citation_type", "from_id", "from_case")


@query("txt13_outcome_rules", f"SELECT doc_id, CASE WHEN contains(r, 'частков') THEN 'partial' WHEN contains(r, 'задовольн') THEN 'allowed' WHEN contains(r, 'відмов') THEN 'denied' WHEN contains(r, 'скасув') AND (contains(r, 'направ') OR contains(r, 'нов')) THEN 'remand' WHEN contains(r, 'скасув') THEN 'cancelled' END AS outcome FROM (SELECT DISTINCT doc_id, lower(resolution) AS r FROM {DECISIONS.sql})")
def outcome_rules(spark, d):
    return DECISIONS.frame(spark, d).select("doc_id", L.outcome(F.col("resolution")).alias("outcome")).distinct()


@query("txt17_chamber", f"SELECT DISTINCT doc_id, CASE WHEN contains(h, 'велика палата') OR contains(h, 'вп вс') OR contains(h, 'великої палати верховного суду') THEN 'ВП ВС' WHEN regexp_matches(h, '(^| )кцс( |$)') OR contains(h, 'касаційний цивільний суд') THEN 'КЦС' WHEN regexp_matches(h, '(^| )кгс( |$)') OR contains(h, 'касаційний господарський суд') THEN 'КГС' WHEN regexp_matches(h, '(^| )кас( |$)') OR contains(h, 'касаційний адміністративний суд') THEN 'КАС' WHEN regexp_matches(h, '(^| )ккс( |$)') OR contains(h, 'касаційний кримінальний суд') THEN 'ККС' END AS chamber FROM (SELECT doc_id, lower(coalesce(nullif(chamber, ''), title)) AS h FROM {DECISIONS.sql})")
def chambers(spark, d):
    return DECISIONS.frame(spark, d).select("doc_id", C.chamber(F.coalesce(F.nullif("chamber", F.lit("")), "title")).alias("chamber")).distinct()


@query("txt9_law_articles", f"SELECT doc_id, array_to_string(list_distinct(list_transform(regexp_extract_all(text, '(?i)ст\\.\\s*\\d+'), lambda m: trim(regexp_replace(m, '\\s+', ' ', 'g')))), '|') IS NOT NULL AS found, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)ст\\.\\s*\\d+'), lambda m: trim(regexp_replace(m, '\\s+', ' ', 'g'))))) AS n FROM {REASONING.sql}")
def law_articles(spark, d):
    return REASONING.frame(spark, d).select("doc_id", F.lit(True).alias("found"), F.size(L.law_articles(F.col("text"))).cast("bigint").alias("n"))


_TERMS_SQL = "['заборгованість', 'стягнення', 'позов', 'договір', 'лізинг', 'неустойка', 'відшкодування', 'розірвання', 'виконання', 'зобов''язання', 'порушення', 'відповідальність', 'збитки', 'штраф', 'пеня', 'сплата', 'оплата', 'послуги', 'товар']"


@query("txt27_search_terms", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)(?:ст\\.|статт[іяє]|article)\\s*(\\d+(?:\\.\\d+)?)', 1))), ',') AS articles, array_to_string(list_filter({_TERMS_SQL}, lambda w: contains(lower(text), w)), ',') AS keywords,
  CASE WHEN contains(lower(text), 'стягнення') AND contains(lower(text), 'заборгованост') THEN 'стягнення заборгованості' WHEN contains(lower(text), 'розірвання договору') THEN 'розірвання договору' WHEN contains(lower(text), 'відшкодування збитків') THEN 'відшкодування збитків' ELSE 'загальний спір' END AS essence
  FROM (SELECT doc_id, text FROM {REASONING.sql} UNION ALL VALUES (100, 'Стягнення заборгованості за договором, пеня'), (101, 'Розірвання договору лізингу за статтею'), (102, 'відшкодування збитків, стаття 22.1'))""")
def search_terms(spark, d):
    more = spark.createDataFrame([(100, "Стягнення заборгованості за договором, пеня"), (101, "Розірвання договору лізингу за статтею"), (102, "відшкодування збитків, стаття 22.1")], "doc_id int, text string")
    t = REASONING.frame(spark, d).select("doc_id", "text").unionByName(more).select("doc_id", C.search_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join(F.array_sort("t.articles"), ",").alias("articles"), F.array_join("t.keywords", ",").alias("keywords"), "t.essence")


_PATTERN = f"r AS (SELECT doc_id, topic, text, lower(text) AS t FROM {REASONING.sql})"


@query("grf6_case_patterns", f"""WITH {_PATTERN}, n AS (SELECT topic, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 3), a AS (
    SELECT topic, m, count(*) AS c FROM (SELECT topic, unnest(regexp_extract_all(text, '(?i)ст\\.\\s*\\d+')) AS m FROM r) GROUP BY 1, 2), articles AS (SELECT a.topic, string_agg(m, '|' ORDER BY m) AS law_articles FROM a JOIN n ON a.topic = n.topic WHERE c >= ceil(n * 0.3) GROUP BY 1
  ), o AS (SELECT topic, CASE WHEN contains(t, 'задоволено') OR contains(t, 'позивач виграв') THEN 'consumer_won' WHEN contains(t, 'відмовлено') OR contains(t, 'відхилено') THEN 'rejected' WHEN contains(t, 'частково') THEN 'partial' ELSE 'unknown' END AS outcome, min(doc_id) AS first, count(*) AS c FROM r GROUP BY 1, 2
  ), best AS (SELECT topic, CASE WHEN outcome = 'unknown' THEN 'rejected' ELSE outcome END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, first) AS k FROM o) WHERE k = 1)
  SELECT n.topic, n.n AS frequency, coalesce(law_articles, '') AS law_articles, outcome, CASE WHEN n.n < 5 THEN 0.3 WHEN n.n < 10 THEN 0.5 WHEN n.n < 20 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence,
    array_to_string(list_filter(['недостатньо доказів', 'не доведено', 'пропущено строк', 'не відповідає'], lambda k: (SELECT bool_or(contains(r.t, k)) FROM r WHERE r.topic = n.topic)), '|') AS risk_factors,
    array_to_string(list_filter(['доведено', 'підтверджено', 'відповідає вимогам', 'має право'], lambda k: (SELECT bool_or(contains(r.t, k)) FROM r WHERE r.topic = n.topic)), '|') AS success_arguments
  FROM n LEFT JOIN articles ON articles.topic = n.topic JOIN best ON best.topic = n.topic""".replace("lambda k: (SELECT bool_or(contains(r.t, k)) FROM r WHERE r.topic = n.topic)", "lambda k: contains(n.every, k)").replace("n AS (SELECT topic, count(*) AS n FROM r", "n AS (SELECT topic, count(*) AS n, string_agg(t, '#') AS every FROM r"))
def case_patterns(spark, d):
    found = P.case_patterns(REASONING.frame(spark, d), "topic")
    return found.select("topic", "frequency", *(F.array_join(c, "|").alias(c) for c in ("law_articles", "risk_factors", "success_arguments")), "outcome", "confidence")


@query("agg25_failure_reasons", f"WITH {_PATTERN}, bad AS (SELECT * FROM r WHERE contains(t, 'відмовлено') OR contains(t, 'відхилено')), e AS (SELECT topic, doc_id, unnest(list_filter([CASE WHEN contains(text, 'недостатньо') THEN 'Недостатньо доказів' END, CASE WHEN contains(text, 'пропущено') THEN 'Пропущено строк позовної давності' END, CASE WHEN contains(text, 'не відповідає') THEN 'Не відповідає вимогам закону' END], lambda x: x IS NOT NULL)) AS reason FROM bad) SELECT topic, reason, count(*) AS n FROM e GROUP BY 1, 2")
def failure_reasons(spark, d):
    return P.failure_reasons(REASONING.frame(spark, d), "topic")


@query("txt30_risk_findings", f"""WITH {_PATTERN}, k(factor) AS (VALUES ('недостатньо доказів'), ('не доведено'), ('пропущено строк'), ('не відповідає')) SELECT doc_id, factor,
  CASE WHEN contains(factor, 'доказ') OR contains(factor, 'строк') THEN 'legal_risk' WHEN contains(factor, 'сума') OR contains(factor, 'платіж') THEN 'financial_risk' WHEN contains(factor, 'вимог') THEN 'compliance_issue' ELSE 'other' END AS category,
  CASE WHEN factor IN ('недостатньо доказів', 'пропущено строк') THEN 'high' WHEN factor = 'не доведено' THEN 'medium' ELSE 'low' END AS risk_level FROM r, k WHERE contains(t, factor)""")
def risk_findings(spark, d):
    return P.risk_findings(REASONING.frame(spark, d)).select("doc_id", "factor", "category", "risk_level")


@query("txt25_answer_validation", f"""WITH c AS (SELECT answer_id, unnest(list_filter(string_split_regex(answer, '[.!?]+'), lambda s: length(trim(s)) > 20)) AS claim, string_split(coalesce(nullif(sources, ''), '#'), '|') AS sources, sources IS NOT NULL AND sources <> '' AS has_sources FROM {ANSWERS.sql}
  ), j AS (SELECT answer_id, claim, has_sources AND (len(list_filter(sources, lambda s: contains(claim, s))) > 0 OR contains(claim, 'джерело') OR contains(claim, 'посилання')) AS sourced FROM c
  ), cites AS (SELECT answer_id, unnest(regexp_extract_all(claim, '\\d+/\\d+/\\d{{4}}')) AS x FROM j
  ), inv AS (SELECT answer_id, count(*) AS n FROM cites WHERE x NOT IN (SELECT case_number FROM {TEXTS.sql} WHERE case_number IS NOT NULL) GROUP BY 1
  ), t AS (SELECT a.answer_id, count(j.answer_id) AS claims, count(*) FILTER (NOT sourced) AS unsourced, coalesce(max(inv.n), 0) AS invalid FROM {ANSWERS.sql} a LEFT JOIN j ON j.answer_id = a.answer_id LEFT JOIN inv ON inv.answer_id = a.answer_id GROUP BY 1)
  SELECT *, unsourced = 0 AND invalid = 0 AS is_valid, CASE WHEN claims = 0 THEN 1.0 ELSE round(((1 - unsourced / claims) + (1 - invalid / claims)) / 2, 6) END::DOUBLE AS confidence FROM t""")
def answer_validation(spark, d):
    return A.validated(ANSWERS.frame(spark, d).withColumn("sources", F.split(F.nullif("sources", F.lit("")), r"\|")), TEXTS.frame(spark, d).select("case_number"))


_INTENT = """CASE
  WHEN contains(q, 'позиці') OR contains(q, 'позиция') OR contains(q, 'правов') OR (contains(q, 'вс') AND contains(q, 'виснов')) OR contains(q, 'верховн') THEN 'supreme_court_position'
  WHEN contains(q, 'строк') OR contains(q, 'поновлен') OR contains(q, 'пропуск') THEN 'procedural_deadlines'
  WHEN contains(q, 'без рух') OR contains(q, 'повернен') OR contains(q, 'без розгляд') OR contains(q, 'закритт') THEN 'admissibility_and_formal_requirements'
  WHEN contains(q, 'підсудн') OR contains(q, 'юрисдикц') OR contains(q, 'підвідомч') THEN 'jurisdiction_and_competence'
  WHEN regexp_matches(q, 'доказ|належн|допустим|експертиз|електронн') THEN 'evidence_and_standards'
  WHEN contains(q, 'забезпечен') AND (contains(q, 'позов') OR contains(q, 'доказ')) THEN 'interim_measures'
  WHEN regexp_matches(q, 'пеня|інфляц|3%') OR (contains(q, 'судов') AND contains(q, 'витрат')) THEN 'amounts_and_costs'
  WHEN regexp_matches(q, 'за/проти|дві ліні|две лини|неоднорід') THEN 'two_sided_practice'
  WHEN regexp_matches(q, 'депутат|народн|парламент|верховна рада|верховної ради|верховну раду|голосуванн|голосован|законопроект|законопроєкт|фракці|фракци|комітет|комитет') THEN 'parliament_search'
  WHEN regexp_matches(q, 'єдрпоу|едрпоу|эдрпоу|бенефіціар|бенефициар|реєстр підприємств|реестр предприятий|підприємств|предприяти|засновник|учредител|боржник|должник') OR (contains(q, 'юридичн') AND contains(q, 'особ')) OR (contains(q, 'юридическ') AND contains(q, 'лиц')) THEN 'registry_search'
  WHEN regexp_matches(q, 'споживач|затримка|доставка') THEN 'consumer_penalty_delay' WHEN regexp_matches(q, 'податк|налог') THEN 'tax_dispute' WHEN regexp_matches(q, 'прац|трудов') THEN 'labor_dispute' ELSE 'general_search' END"""


@query("txt20_intents", f"""WITH q AS (SELECT question_id, lower(coalesce(question, '')) AS q FROM {QUESTIONS.sql}) SELECT question_id, {_INTENT} AS intent, CASE WHEN contains(q, 'кпк') THEN 'КПК' WHEN contains(q, 'кас') THEN 'КАС' WHEN contains(q, 'гпк') THEN 'ГПК' WHEN contains(q, 'цпк') THEN 'ЦПК' END AS procedure_code,
  CASE WHEN contains(q, 'велика палата') OR contains(q, 'вп') THEN 'GrandChamber' WHEN regexp_matches(q, 'верховн|вс | кцс| кгс| ккc| ккс') THEN 'SC' WHEN contains(q, 'касац') THEN 'cassation' WHEN contains(q, 'апеляц') THEN 'appeal' WHEN contains(q, 'перша інстанц') OR contains(q, 'первая инстанц') THEN 'first_instance' END AS court_level,
  CASE WHEN contains(q, 'підбірк') THEN 'підбірка' WHEN contains(q, 'порівня') THEN 'порівняння' WHEN contains(q, 'таблиц') THEN 'таблиця' WHEN contains(q, 'чеклист') THEN 'чеклист' END AS desired_output,
  regexp_matches(q, 'пеня|штраф') AS penalty, contains(q, 'інфляц') AS inflation, regexp_matches(q, '3%|три відсотк|три проц') AS three_percent, contains(q, 'судов') AND contains(q, 'витрат') AS legal_fees FROM q""")
def intents(spark, d):
    return QUESTIONS.frame(spark, d).select("question_id", A.intent(F.col("question")).alias("i")).select("question_id", "i.intent", "i.procedure_code", "i.court_level", "i.desired_output", "i.penalty", "i.inflation", "i.three_percent", "i.legal_fees")


@query("txt23_services", f"SELECT question_id, CASE WHEN regexp_matches(q, '(?i)workflow|інтеграц|integration') THEN 'workflow_automation' WHEN regexp_matches(q, '(?i)vault|сховищ|хранилищ') THEN 'document_vault' WHEN regexp_matches(q, '(?i)due\\s*diligence|dd\\b|перевірк|провер|m&a') THEN 'due_diligence' ELSE 'legal_research' END AS service FROM (SELECT question_id, coalesce(question, '') AS q FROM {QUESTIONS.sql})")
def services(spark, d):
    return QUESTIONS.frame(spark, d).select("question_id", A.service(F.col("question")).alias("service"))


@query("txt21_court_levels", f"SELECT level_id, value, CASE WHEN lower(trim(value)) IN ('grandchamber', 'grand_chamber', 'grand chamber', 'вп') OR contains(lower(value), 'велика палата') OR contains(lower(value), 'вп вс') THEN 'GrandChamber' WHEN lower(trim(value)) IN ('sc', 'вс') OR regexp_matches(lower(value), 'supreme|верхов|кцс|кгс|кас|ккс') AND lower(trim(value)) <> 'cassation' THEN 'SC' WHEN lower(trim(value)) = 'cassation' OR contains(lower(value), 'касац') THEN 'cassation' WHEN lower(trim(value)) = 'appeal' OR contains(lower(value), 'апеляц') THEN 'appeal' WHEN lower(trim(value)) = 'first_instance' OR regexp_matches(lower(value), 'перша інстанц|первая инстанц') THEN 'first_instance' END AS level FROM {LEVELS.sql}")
def court_levels(spark, d):
    return LEVELS.frame(spark, d).select("level_id", "value", A.court_level(F.col("value")).alias("level"))


_ABBR = "regexp_replace({q}, '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])', '\\1{f}\\2', 'g')"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(lower(trim(question)), '\\s+', ' ', 'g'), '[?!]+$', ''), 'the\\s+', '', 'g')"
for _a, _f in (("цпк", "цивільний процесуальний кодекс"), ("гпк", "господарський процесуальний кодекс"), ("кас", "кодекс адміністративного судочинства"), ("цк", "цивільний кодекс"), ("гк", "господарський кодекс"), ("пк", "процесуальний кодекс")):
    _NORMAL = _ABBR.format(q=_NORMAL, a=_a, f=_f)


@query("txt33_normal_questions", f"SELECT question_id, {_NORMAL} AS question, sha256({_NORMAL}) AS key FROM {QUESTIONS.sql}")
def normal_questions(spark, d):
    return QUESTIONS.frame(spark, d).select("question_id", L.normal_question(F.col("question")).alias("question"), L.question_key(F.col("question")).alias("key"))


@query("txt19_snippets", f"SELECT doc_id, CASE WHEN greatest(p - 161, 0) > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(p - 161, 0) + 1, least(p - 1 + 4 + 160, length(text)) - greatest(p - 161, 0)), '\\s+', ' ', 'g')) || CASE WHEN p + 163 < length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'tion') AS p FROM documents) WHERE p > 0")
def first_snippets(spark, d):
    from docketry.sources.tables import table

    return table(spark, d, "documents").select("doc_id", F.element_at(F.nullif(L.snippets(F.col("text"), "TION", most=1), F.array().cast("array<string>")), 1).alias("snippet")).where("snippet is not null")


@query("txt28_change_importance", f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\d+\\s*грн|uah|usd|eur|\\$|€|\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}|термін|строк|penalty|штраф|неустойка|відповідальність') THEN 'critical' WHEN length(text) > 50 AND regexp_matches(text, '(?i)право|обов''язок|obligation|зобов''язання|умова|condition') THEN 'significant' ELSE 'minor' END AS importance FROM {REASONING.sql}")
def change_importance(spark, d):
    return REASONING.frame(spark, d).select("doc_id", L.change_importance(F.col("text")).alias("importance"))
