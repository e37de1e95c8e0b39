"""Filters, lookups, ordered results and documents' parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import legal as L
from docketry.functions import money as M
from docketry.operators import relational as R
from docketry.operators import vectors as V
from docketry.plans.fixtures import ANSWERS, ARTICLES, ASKED, COURTS, HOLDS, KEYS, LAWS, MATTERS, MEMBERS, PAGES, PAPERS, REASONING, RICH, TEXTS, VOTES
from docketry.plans.registry import query
from docketry.sources.tables import table


@query("flt4_array_membership", "SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the') AND lang IN ('en', 'de')")
def array_membership(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de")).withColumn("words", F.split(F.lower("text"), " "))
    return R.member(docs, "words", "the").select("doc_id")


@query("flt6_array_overlap", "SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['license', 'released', 'under', 'copyright'])) AS INT) AS n_shared FROM documents WHERE len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['license', 'released', 'under', 'copyright'])) > 0")
def array_overlap(spark, d):
    docs = table(spark, d, "documents").withColumn("words", F.split(F.lower("text"), " "))
    return R.overlapping(docs, "words", ["license", "released", "under", "copyright"]).select("doc_id", "n_shared")


@query("flt7_json_keys", "SELECT event_id FROM events WHERE json_exists(props, '$.k') OR json_exists(props, '$.tag')")
def json_keys(spark, d):
    return R.json_keys(table(spark, d, "events"), "props", ["k", "tag"]).select("event_id")


@query("flt8_json_array_any", f"SELECT matter_id FROM {MATTERS.sql} WHERE len(list_filter(CAST(parties AS VARCHAR[]), lambda x: contains(lower(x), 'альфа'))) > 0")
def json_array_any(spark, d):
    return R.json_any(MATTERS.frame(spark, d), "parties", "Альфа").select("matter_id")


@query("flt10_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://m.')")
def prefix(spark, d):
    return R.under(table(spark, d, "pages"), "url", "https://m.").select("page_id")


@query("flt14_periods", "SELECT 'this' AS period, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-24' UNION ALL SELECT 'before', count(*), CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24'")
def periods(spark, d):
    total = lambda name, back: R.period(table(spark, d, "events"), "ts", "2024-01-31", 7, back).agg(F.lit(name).alias("period"), F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("cost"))
    return total("this", 0).unionByName(total("before", 1))


# What factions are called, and the names that are then searched for.
ALIASES = {
    "опзж": ("Платформа за життя", "ОПЗЖ"), "опозиційна платформа": ("Платформа за життя", "ОПЗЖ", "Опозиційна платформа"), "за життя": ("Платформа за життя", "За життя"), "слуга народу": ("СЛУГА НАРОДУ",),
    "європейська солідарність": ("ЄВРОПЕЙСЬКА СОЛІДАРНІСТЬ",), "батьківщина": ("Батьківщина",), "голос": ("ГОЛОС",), "довіра": ("ДОВІРА",), "за майбутнє": ("За майбутнє",), "відновлення": ("Відновлення",),
}


def of_faction(members, name: str):
    """Members whose faction has one of the names that a nickname stands for, in any case."""
    wanted = next((names for nick, names in ALIASES.items() if nick in name.lower()), (name,))
    return members.where(reduce(lambda a, b: a | b, (F.lower("faction").contains(n.lower()) for n in wanted)))


@query("flt15_faction_aliases", f"SELECT member_id FROM {MEMBERS.sql} WHERE contains(lower(faction), 'платформа за життя') OR contains(lower(faction), 'опзж')")
def faction_aliases(spark, d):
    return of_faction(MEMBERS.frame(spark, d), "фракція ОПЗЖ").select("member_id")


# Kinds of justice by procedure code.
JUSTICE = {"cpc": 1, "crpc": 2, "gpc": 3, "cac": 4}


def supreme_court(df, procedure: str | None = None, grand: bool = False):
    """Decisions of the highest court by the codes of a court search, of its Grand Chamber alone, or of one procedure."""
    rows = df.where("instance_code = 1").where(F.col("court_code") == "9901" if grand else F.col("court_code").startswith("99"))
    return rows if procedure is None else rows.where(F.col("justice_kind") == JUSTICE[procedure])


@query("flt18_court_levels", f"SELECT 'all' AS what, doc_id FROM {COURTS.sql} WHERE instance_code = 1 AND court_code LIKE '99%' UNION ALL SELECT 'grand', doc_id FROM {COURTS.sql} WHERE instance_code = 1 AND court_code = '9901' UNION ALL SELECT 'gpc', doc_id FROM {COURTS.sql} WHERE instance_code = 1 AND court_code LIKE '99%' AND justice_kind = 3")
def court_levels(spark, d):
    rows = COURTS.frame(spark, d)
    arms = (("all", supreme_court(rows)), ("grand", supreme_court(rows, grand=True)), ("gpc", supreme_court(rows, "gpc")))
    return reduce(lambda a, b: a.unionByName(b), (r.select(F.lit(n).alias("what"), "doc_id") for n, r in arms))


@query("flt16_vector_filters", "SELECT vec_id FROM embeddings WHERE vec_id >= 10 AND vec_id <= 400 AND label IN (1, 3, 5)")
def vector_filters(spark, d):
    return V.filtered(table(spark, d, "embeddings"), must={}, ranges={"vec_id": (10, 400)}, should={"label": [1, 3, 5]}).select("vec_id")


@query("flt20_last_touched", "SELECT o_orderkey, greatest(o_orderdate, coalesce(max(l_shipdate), o_orderdate)) AS touched FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate")
def last_touched(spark, d):
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    return table(spark, d, "orders").join(shipped, "o_orderkey", "left").select("o_orderkey", F.greatest("o_orderdate", F.coalesce("s", "o_orderdate")).alias("touched"))


@query("flt21_backfill_candidates", f"SELECT doc_id FROM {TEXTS.sql} WHERE (text IS NULL OR length(text) < 100) AND regexp_matches(CAST(doc_id AS VARCHAR), '^\\d+$') AND json_extract_string('{{\"k\": \"757/123/2023\"}}', '$.k') <> coalesce(case_number, '')")
def backfill(spark, d):
    rows = TEXTS.frame(spark, d).withColumn("meta", F.to_json(F.struct(F.col("case_number").alias("k"))))
    return rows.where("text is null or length(text) < 100").where(F.col("doc_id").cast("string").rlike(r"^\d+$")).where(F.coalesce(F.get_json_object("meta", "$.k"), F.lit("")) != "757/123/2023").select("doc_id")


@query("srt2_page_with_total", "SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return R.with_total(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query("srt3_dynamic_sort", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars ASC NULLS LAST, doc_id LIMIT 25)")
def dynamic_sort(spark, d):
    return R.sorted_by(table(spark, d, "documents").select("doc_id", "n_chars"), "length", {"length": "n_chars", "id": "doc_id"}, "doc_id", descending=False, last="doc_id").limit(25)


@query("srt6_term_frequency", f"SELECT rada_id, article_number, CAST(round((len(regexp_extract_all(lower(full_text), 'строк')) + len(regexp_extract_all(lower(full_text), 'позов'))) / len(regexp_extract_all(full_text, '[\\p{{L}}\\p{{N}}]+')), 6) AS DOUBLE) AS rank FROM {ARTICLES.sql} WHERE contains(lower(full_text), 'строк') OR contains(lower(full_text), 'позов') ORDER BY rank DESC, rada_id, article_number LIMIT 4")
def term_frequency(spark, d):
    hits = L.occurrences(F.col("full_text"), "строк") + L.occurrences(F.col("full_text"), "позов")
    words = F.size(F.regexp_extract_all("full_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return ARTICLES.frame(spark, d).where(hits > 0).select("rada_id", "article_number", F.round(hits / words, 6).alias("rank")).orderBy(F.desc("rank"), "rada_id", "article_number").limit(4)


@query("srt8_severity_order", "SELECT event_id, level FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS level FROM events) ORDER BY CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, event_id")
def severity_order(spark, d):
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "medium").otherwise("low")
    rank = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("level"))
    return table(spark, d, "events").select("event_id", level.alias("level")).orderBy(rank, "event_id")


@query("jn2_current_articles", f"SELECT a.rada_id, title, article_number FROM {ARTICLES.sql} a JOIN {LAWS.sql} l ON a.rada_id = l.rada_id WHERE is_current AND a.rada_id LIKE '%435-15' AND article_number IN ('354', '354-1', '625')")
def current_articles(spark, d):
    """Articles of the law 435-15 of every group, those in force."""
    rows = ARTICLES.frame(spark, d).where(F.col("is_current") & F.col("rada_id").endswith("435-15") & F.col("article_number").isin("354", "354-1", "625"))
    return rows.join(LAWS.frame(spark, d), "rada_id").select("rada_id", "title", "article_number")


@query("jn13_hits_with_documents", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), h AS (SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS similarity FROM embeddings v, q ORDER BY similarity DESC, vec_id LIMIT 30) SELECT vec_id, similarity, lang, source FROM h JOIN documents ON vec_id = doc_id WHERE lang <> 'fr'")
def hits_with_documents(spark, d):
    vectors = table(spark, d, "embeddings")
    one = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    hits = vectors.crossJoin(one).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(30)
    return hits.join(table(spark, d, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")


@query("jn15_first_kind", "WITH k AS (SELECT DISTINCT l_partkey AS id FROM lineitem) SELECT id, CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN 'supplier' WHEN id IN (SELECT c_custkey FROM customer) THEN 'customer' WHEN id IN (SELECT p_partkey FROM part) THEN 'part' END AS kind FROM k")
def first_kind(spark, d):
    of = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"))
    return R.first_kind(of("lineitem", "l_partkey").distinct(), "id", {"supplier": of("supplier", "s_suppkey"), "customer": of("customer", "c_custkey"), "part": of("part", "p_partkey")})


@query("jn16_audit_with_users", "SELECT event_id, c_name, event_type FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('error', 'purchase')")
def audit_with_users(spark, d):
    events = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase"))
    return events.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "event_type")


@query("jn17_left_join_with_where", "SELECT c_custkey, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def left_join_with_where(spark, d):
    """A condition on the right side makes the left join an inner one."""
    orders = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return table(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("jn18_lateral_elements", f"SELECT matter_id, unnest(CAST(parties AS VARCHAR[])) AS party FROM {MATTERS.sql}")
def lateral_elements(spark, d):
    return MATTERS.frame(spark, d).select("matter_id", F.explode(F.from_json("parties", "array<string>")).alias("party"))


@query("jn19_without_chunks", f"SELECT rada_id, article_number FROM {ARTICLES.sql} WHERE is_current AND length(full_text) >= 10 AND article_number NOT IN ('10', '44')")
def without_chunks(spark, d):
    """Current articles of some length that no chunk covers."""
    chunks = ARTICLES.frame(spark, d).where(F.col("article_number").isin("10", "44")).select("rada_id", "article_number")
    return ARTICLES.frame(spark, d).where("is_current and length(full_text) >= 10").join(chunks, ["rada_id", "article_number"], "left_anti").select("rada_id", "article_number")


@query("agg20_ordered_articles", f"SELECT rada_id, string_agg(article_number, ',' ORDER BY CAST(nullif(regexp_extract(article_number, '^\\d+'), '') AS INT) NULLS LAST, article_number) AS articles FROM {ARTICLES.sql} WHERE is_current GROUP BY 1")
def ordered_articles(spark, d):
    number = F.coalesce(F.nullif(F.regexp_extract("article_number", r"^\d+", 0), F.lit("")).cast("bigint"), F.lit(2**62))
    listed = F.array_sort(F.collect_list(F.struct(number.alias("n"), "article_number")))
    return ARTICLES.frame(spark, d).where("is_current").groupBy("rada_id").agg(F.array_join(F.transform(listed, lambda x: x["article_number"]), ",").alias("articles"))


@query("agg21_active_holds", f"SELECT paper_id, string_agg(hold_id, ',' ORDER BY hold_id) AS hold_ids FROM {HOLDS.sql} WHERE status = 'active' AND paper_id IS NOT NULL GROUP BY 1")
def active_holds(spark, d):
    return holds_of(HOLDS.frame(spark, d), "paper_id").select("paper_id", F.array_join(F.transform("hold_ids", lambda x: x.cast("string")), ",").alias("hold_ids"))


def holds_of(holds, key: str):
    return holds.where("status = 'active'").where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list("hold_id")).alias("hold_ids"))


def deletable(papers, matters, holds, as_of: str):
    """paper_id, can_delete and reason: a hold on the paper, on its matter, or the matter's retention keeps it."""
    own, of_matter = (holds_of(holds, k).select(k, F.lit(True).alias(name)) for k, name in (("paper_id", "_paper"), ("matter_id", "_matter")))
    met = papers.join(own, "paper_id", "left").join(matters, "matter_id", "left").join(of_matter, "matter_id", "left")
    until = F.add_months("closed", F.col("years") * 12)
    reason = F.when(F.col("_paper"), "hold").when(F.coalesce(F.col("held"), F.lit(False)), "matter hold").when(until > F.lit(as_of).cast("date"), F.concat(F.lit("retention until "), until.cast("string")))
    return met.select("paper_id", reason.isNull().alias("can_delete"), reason.alias("reason"))


@query("dat5_deletable", f"SELECT paper_id, reason, reason IS NULL AS can_delete FROM (SELECT p.paper_id, CASE WHEN p.paper_id IN (SELECT paper_id FROM {HOLDS.sql} WHERE status = 'active' AND paper_id IS NOT NULL) THEN 'hold' WHEN coalesce(m.held, false) THEN 'matter hold' WHEN m.closed + to_years(CAST(m.years AS INT)) > TIMESTAMP '2024-01-31' THEN 'retention until ' || CAST(CAST(m.closed + to_years(CAST(m.years AS INT)) AS DATE) AS VARCHAR) END AS reason FROM {PAPERS.sql} p LEFT JOIN {MATTERS.sql} m ON p.matter_id = m.matter_id)")
def deletable_papers(spark, d):
    return deletable(PAPERS.frame(spark, d), MATTERS.frame(spark, d), HOLDS.frame(spark, d), "2024-01-31")


_VOTES_SQL = f"v AS (SELECT vote_id, session_date, bill, unnest(json_keys(votes::JSON)) AS member_id, votes FROM {VOTES.sql} WHERE votes IS NOT NULL), p AS (SELECT *, json_extract_string(votes, '$.\"' || member_id || '\"') AS vote FROM v)"


def positions_of(votes):
    """vote_id, session_date, bill, member_id and vote of every member in every vote."""
    return votes.select("vote_id", "session_date", "bill", F.explode(F.from_json("votes", "map<string,string>")).alias("member_id", "vote"))


def attendance(positions):
    """Counts by vote of each member; present are those who voted, in per cent of the votes they stand in."""
    by = lambda name, vote: F.count_if(F.col("vote") == vote).alias(name)
    out = positions.groupBy("member_id").agg(F.count("*").alias("total"), by("voted_for", "За"), by("voted_against", "Проти"), by("abstained", "Утримався"), by("not_present", "Не голосував"))
    return out.withColumn("attendance", F.round(M.percent(F.col("voted_for") + F.col("voted_against") + F.col("abstained"), F.col("total"), 6), 6))


@query("agg22_attendance", f"WITH {_VOTES_SQL} SELECT member_id, count(*) AS total, count(*) FILTER (vote = 'За') AS voted_for, count(*) FILTER (vote = 'Проти') AS voted_against, count(*) FILTER (vote = 'Утримався') AS abstained, count(*) FILTER (vote = 'Не голосував') AS not_present, round(count(*) FILTER (vote IN ('За', 'Проти', 'Утримався')) * 100.0 / count(*), 6) AS attendance FROM p GROUP BY 1")
def attendance_rates(spark, d):
    return attendance(positions_of(VOTES.frame(spark, d)))


@query("col4_vote_of_member", f"SELECT vote_id, vote FROM (SELECT vote_id, json_extract_string(votes, '$.\"' || (vote_id // 1000) || '9\"') AS vote FROM {VOTES.sql}) WHERE vote IS NOT NULL")
def vote_of_member(spark, d):
    """The vote of the member 9 of every group; a vote's thousands are its group."""
    vote = F.try_element_at(F.from_json("votes", "map<string,string>"), F.concat(F.floor(F.col("vote_id") / 1000).cast("string"), F.lit("9")))
    return VOTES.frame(spark, d).select("vote_id", vote.alias("vote")).where("vote is not null")


@query("agg43_demographics", f"SELECT 'status' AS what, status AS name, count(*) AS n FROM {MEMBERS.sql} GROUP BY 2 UNION ALL SELECT 'gender', coalesce(gender, 'unknown'), count(*) FROM {MEMBERS.sql} GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'faction', coalesce(faction, 'none') AS name, count(*) AS n FROM {MEMBERS.sql} GROUP BY 2 ORDER BY n DESC, name LIMIT 10)")
def demographics(spark, d):
    group = lambda what, column, other: MEMBERS.frame(spark, d).groupBy(F.coalesce(column, F.lit(other)).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    factions = group("faction", "faction", "none").orderBy(F.desc("n"), "name").limit(10)
    return group("status", "status", "unknown").unionByName(group("gender", "gender", "unknown")).unionByName(factions)


@query("col3_json_merge", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS kind FROM events")
def json_merge(spark, d):
    """Two JSON objects as one; the second's keys win."""
    both = R.merged_json(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind"))))
    merged = table(spark, d, "events").select("event_id", both.alias("j"))
    return merged.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.kind").alias("kind"))


@query("col8_tag_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), 'red']))), ',') AS tags FROM part")
def tag_union(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("red")))), ",").alias("tags"))


@query("col10_nested_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def nested_path(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k int").alias("inner")).alias("outer"))
    return rows.select("event_id", F.col("outer.inner.k").alias("k"))


@query("dat7_look_back", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-02'")
def look_back(spark, d):
    """Decisions of the three years before a day."""
    since = F.add_months(F.lit("2001-08-02").cast("date"), -36).cast("timestamp_ntz")
    return table(spark, d, "orders").where(F.col("o_orderdate") >= since).select("o_orderkey")


@query("dat9_freshness", "SELECT event_id, ts > TIMESTAMP '2024-01-24 00:00:00' AS fresh FROM events")
def freshness(spark, d):
    return table(spark, d, "events").select("event_id", M.fresh(F.col("ts"), F.lit("2024-01-31").cast("timestamp_ntz"), 7).alias("fresh"))


@query("txt34_word_chunks")
def word_chunks(spark, d):
    """Word chunks of every text; the fold has no SQL, tests compare it with a plain loop."""
    found = table(spark, d, "documents").select("doc_id", F.posexplode(L.word_chunks(F.col("text"))).alias("n", "chunk"))
    return found.select("doc_id", "n", F.sha2("chunk", 256).alias("chunk"))


_PARTS_SQL = f"""b AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), ' ') || ' ' || array_to_string(regexp_extract_all(html, '(?is)<div[^>]*id="article-container"[^>]*>(.*?)</div>', 1), ' ') AS body FROM {PAGES.sql}
), p AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(body, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '')) AS paragraph, generate_subscripts(list_filter(list_transform(regexp_extract_all(body, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> ''), 1) - 1 AS place FROM b)"""


@query("src12_paragraphs", f"WITH {_PARTS_SQL} SELECT page_id, CAST(place AS INT) AS place, paragraph FROM p")
def paragraphs(spark, d):
    return PAGES.frame(spark, d).select("page_id", F.posexplode(L.paragraphs(F.col("html"))).alias("place", "paragraph"))


@query("txt3_page_parts", f"WITH {_PARTS_SQL}, m AS (SELECT *, CASE WHEN regexp_matches(paragraph, 'УСТАНОВИВ:|ВСТАНОВИВ:') THEN 'ustanovyv' WHEN regexp_matches(paragraph, 'ВИРІШИВ:|УХВАЛИВ:') THEN 'vyrishyv' WHEN regexp_matches(paragraph, 'Суддя|Джерело:|ЄДРСР') THEN 'footer' END AS part FROM p) SELECT page_id, CAST(place AS INT) AS place, coalesce(last_value(part IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS UNBOUNDED PRECEDING), 'header') AS part FROM m")
def page_parts(spark, d):
    return parted(PAGES.frame(spark, d)).select("page_id", "place", "part")


def parted(pages):
    """page_id, place, paragraph and part: a paragraph belongs to the part that was begun last."""
    each = pages.select("page_id", F.posexplode(L.paragraphs(F.col("html"))).alias("place", "paragraph"))
    before = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("part", F.coalesce(F.last(L.page_part(F.col("paragraph")), ignorenulls=True).over(before), F.lit("header")))


@query("txt4_key_content", f"WITH {_PARTS_SQL}, m AS (SELECT *, CASE WHEN regexp_matches(paragraph, 'УСТАНОВИВ:|ВСТАНОВИВ:') THEN 'ustanovyv' WHEN regexp_matches(paragraph, 'ВИРІШИВ:|УХВАЛИВ:') THEN 'vyrishyv' WHEN regexp_matches(paragraph, 'Суддя|Джерело:|ЄДРСР') THEN 'footer' END AS part FROM p), n AS (SELECT page_id, place, paragraph, coalesce(last_value(part IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS UNBOUNDED PRECEDING), 'header') AS part FROM m) SELECT page_id, 'ВСТАНОВЛЕНІ ФАКТИ:' || chr(10) || string_agg(paragraph, ' ' ORDER BY place) FILTER (part = 'ustanovyv') || chr(10) || chr(10) || 'РЕЗОЛЮЦІЯ:' || chr(10) || string_agg(paragraph, ' ' ORDER BY place) FILTER (part = 'vyrishyv') AS content FROM n GROUP BY 1")
def key_content(spark, d):
    joined = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("place", "paragraph")))), lambda x: x["paragraph"]), " ")
    both = parted(PAGES.frame(spark, d)).groupBy("page_id").agg(joined("ustanovyv").alias("facts"), joined("vyrishyv").alias("decision"))
    head = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(title), F.col(c)))
    return both.select("page_id", F.concat_ws("\n", head("ВСТАНОВЛЕНІ ФАКТИ:\n", "facts"), head("\nРЕЗОЛЮЦІЯ:\n", "decision")).alias("content"))


@query("src16_rich_text", f"SELECT file_id, translate(plain, '^~', chr(9) || chr(10)) AS text FROM {RICH.sql}")
def rich_text(spark, d):
    return RICH.frame(spark, d).select("file_id", L.rich_text(F.translate("body", "|", "\\")).alias("text"))


@query("txt39_case_mentions", f"SELECT doc_id, unnest(regexp_extract_all(text, '№?\\s*(\\d{{3,4}}/\\d{{2,4}}/\\d{{2,4}})', 1)) AS case_number FROM {TEXTS.sql}")
def case_mentions(spark, d):
    return TEXTS.frame(spark, d).select("doc_id", F.explode(L.case_mentions(F.col("text"))).alias("m")).select("doc_id", "m.case_number")


@query("grf7_bill_impact", f"WITH b AS (SELECT DISTINCT bill FROM {VOTES.sql} WHERE bill IS NOT NULL), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '№?\\s*(\\d{{3,4}}/\\d{{2,4}}/\\d{{2,4}})', 1)) AS case_number FROM {TEXTS.sql}), c AS (SELECT b.bill, m.case_number, count(*) AS n FROM b, m WHERE substr(b.bill, 4, 1) = CAST(m.doc_id AS VARCHAR) GROUP BY 1, 2) SELECT bill, count(*) AS cases, CAST(sum(n) AS BIGINT) AS mentions, least(count(*) / 100.0, 1.0)::DOUBLE AS impact FROM c GROUP BY 1")
def bill_impact(spark, d):
    """Cases that texts about a bill mention, with a counter for each pair, and the bill's impact score."""
    bills = VOTES.frame(spark, d).where("bill is not null").select("bill").distinct()
    about = TEXTS.frame(spark, d).join(bills, F.substring("bill", 4, 1) == F.col("doc_id").cast("string"))
    mentions = about.select("bill", F.explode(L.case_mentions(F.col("text"))).alias("m")).select("bill", "m.case_number", F.lit(1).alias("seen"), F.col("m.context").alias("context"))
    pairs = R.counted(mentions, ["bill", "case_number"], "seen", ["context"])
    return pairs.groupBy("bill").agg(F.count("*").alias("cases"), F.sum("n").alias("mentions")).withColumn("impact", M.impact_score(F.col("cases")))


@query("snk10_counted_upsert", "SELECT user_id, event_type, count(*) AS n, max(ts) AS ts, arg_max(props, ts) AS props FROM events GROUP BY 1, 2")
def counted_upsert(spark, d):
    return R.counted(table(spark, d, "events"), ["user_id", "event_type"], "ts", ["props"])


@query("snk8_section_replace", "SELECT l_orderkey AS doc, l_linenumber AS part, l_quantity AS text FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def section_replace(spark, d):
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("text"))
    new = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("part"), F.col("o_totalprice").alias("text"))
    return R.replaced(old, new, "doc")


@query("set4_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def difference(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("win7_token_budget", "WITH RECURSIVE r AS (SELECT lang, doc_id, length(text) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents), f AS (SELECT lang, n, size <= 20000 AS kept, CASE WHEN size <= 20000 THEN size ELSE 40 END AS used, doc_id FROM r WHERE n = 1 UNION ALL SELECT r.lang, r.n, f.used + r.size <= 20000, CASE WHEN f.used + r.size <= 20000 THEN f.used + r.size ELSE f.used + 40 END, r.doc_id FROM f JOIN r ON r.lang = f.lang AND r.n = f.n + 1) SELECT lang, doc_id, kept FROM f")
def token_budget(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.length("text").alias("size"))
    return R.within_budget(docs, "lang", [F.asc("doc_id")], F.col("size"), F.lit(40), 20_000).select("lang", "doc_id", "kept")


@query("txt26_claims_in_texts", f"WITH c AS (SELECT DISTINCT answer_id, substr(trim(unnest(string_split_regex(answer, '[.!?]+'))), 1, 100) AS claim FROM {ANSWERS.sql}) SELECT answer_id, claim, len(list_filter((SELECT list(lower(text)) FROM {REASONING.sql}), lambda t: contains(t, lower(claim)))) > 0 AS found FROM c WHERE claim <> ''")
def claims_in_texts(spark, d):
    claims = ANSWERS.frame(spark, d).select("answer_id", F.explode(F.split("answer", "[.!?]+")).alias("c")).select("answer_id", F.substring(F.trim("c"), 1, 100).alias("claim")).where("claim <> ''").distinct()
    hits = R.containing(REASONING.frame(spark, d), "text", claims.select("claim").distinct(), "claim").select("claim").distinct().withColumn("found", F.lit(True))
    return claims.join(hits, "claim", "left").select("answer_id", "claim", F.coalesce("found", F.lit(False)).alias("found"))


@query("txt43_shadow_comparison", "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS same FROM orders")
def shadow_comparison(spark, d):
    """Two outputs are the same if they serialise to the same JSON."""
    a, b = (F.to_json(F.struct("o_orderkey", p.alias("p"))) for p in (F.col("o_orderpriority"), F.lit("1-URGENT")))
    return table(spark, d, "orders").select("o_orderkey", a.eqNullSafe(b).alias("same"))


@query("txt42_compact_results", "SELECT doc_id, substr(text, 1, 200) AS text, length(text) > 200 AS cut FROM documents")
def compact_results(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("text"), (F.length("text") > 200).alias("cut"))


@query("vec4_distinct_articles", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1), h AS (SELECT v.vec_id % 50 AS article, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS s FROM embeddings v, q ORDER BY s DESC, vec_id LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY s DESC, vec_id) AS k FROM h) SELECT article, vec_id, s FROM r WHERE k = 1 ORDER BY s DESC, vec_id LIMIT 10")
def distinct_articles(spark, d):
    """Twice the wanted hits, the best of each article, then the wanted number."""
    vectors = table(spark, d, "embeddings")
    one = F.broadcast(vectors.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1))  # one row
    hits = vectors.crossJoin(one).select((F.col("vec_id") % 50).alias("article"), "vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("s")).orderBy(F.desc("s"), "vec_id").limit(20)
    return R.first_per(hits, ["article"], [F.desc("s"), F.asc("vec_id")]).orderBy(F.desc("s"), "vec_id").limit(10)


@query("vec6_pattern_match", "WITH c AS (SELECT g, i, avg(x) AS m FROM (SELECT vec_id // 2 AS g, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id < 12) GROUP BY 1, 2), p AS (SELECT g, list(m ORDER BY i) AS centroid FROM c GROUP BY 1) SELECT vec_id, p.g AS pattern, round(list_cosine_similarity(v.embedding::DOUBLE[], p.centroid), 6) AS similarity FROM embeddings v, p WHERE list_cosine_similarity(v.embedding::DOUBLE[], p.centroid) > 0.7")
def pattern_match(spark, d):
    """Vectors against six stored patterns (the centroids of two vectors each), those above 0.7."""
    vectors = table(spark, d, "embeddings")
    stored = vectors.where("vec_id < 12").withColumn("pattern", F.floor(F.col("vec_id") / 2))
    patterns = F.broadcast(V.centroids(stored, "pattern"))  # six rows
    scored = vectors.select("vec_id", "embedding").crossJoin(patterns).withColumn("s", V.cosine(F.col("embedding"), F.col("centroid")))
    return scored.where("s > 0.7").select("vec_id", "pattern", F.round("s", 6).alias("similarity"))


@query("udf2_balance_check", "SELECT o_orderkey, coalesce(c_acctbal, 0) AS current_balance, coalesce(c_acctbal, 0) >= o_totalprice / 50 AS has_credits, CASE WHEN coalesce(c_acctbal, 0) >= o_totalprice / 50 THEN 'Sufficient balance' ELSE 'Insufficient credits' END AS reason FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey")
def balance_checks(spark, d):
    """Whether a customer's balance covers a fiftieth of an order; one segment has no balance."""
    requests = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), (F.col("o_totalprice") / 50).alias("amount"))
    balances = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user"), "c_acctbal")
    return R.affordable(requests, balances, "user", "amount", "c_acctbal").select("o_orderkey", "current_balance", "has_credits", "reason")


@query("udf2_key_limits", f"SELECT a.access, coalesce(k.is_active AND (k.reset_at < DATE '2024-01-31' OR k.requests_today < k.rate_limit) AND (k.expires_at IS NULL OR k.expires_at >= TIMESTAMP '2024-01-31 12:00:00'), FALSE) AS allowed, CASE WHEN k.access IS NULL THEN 'Invalid or inactive API key' WHEN k.reset_at >= DATE '2024-01-31' AND k.requests_today >= k.rate_limit THEN 'Daily rate limit exceeded' WHEN k.expires_at < TIMESTAMP '2024-01-31 12:00:00' THEN 'API key expired' ELSE 'OK' END AS reason, CASE WHEN k.access IS NULL OR k.reset_at < DATE '2024-01-31' THEN 0 ELSE k.requests_today END AS requests_today, coalesce(k.rate_limit, 0) AS rate_limit FROM {ASKED.sql} a LEFT JOIN (SELECT * FROM {KEYS.sql} WHERE is_active) k ON k.access = a.access")
def key_limits(spark, d):
    return R.key_limits(ASKED.frame(spark, d), KEYS.frame(spark, d), "access", "2024-01-31 12:00:00")


@query("udf2_without_expired", "SELECT event_id FROM events WHERE NOT (ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-31 12:00:00')")
def without_expired(spark, d):
    """What is left when rows that lasted ten days are cleared."""
    rows = table(spark, d, "events").select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(10))).alias("expires_at"))
    return rows.where(F.coalesce(F.col("expires_at") >= F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), F.lit(True))).select("event_id")
