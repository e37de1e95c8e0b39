"""Vector indexes, hybrid matches, similar facts, changes between texts, and logs of what was loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import cases as C
from docketry.functions import legal as L
from docketry.operators import cases as O
from docketry.operators import relational as R
from docketry.operators import vector_index as I
from docketry.operators import vectors as V
from docketry.plans.cases import _CHAIN
from docketry.plans.fixtures import DECISIONS, NUMBERS, REASONING
from docketry.plans.registry import query
from docketry.sources.tables import table


def _scored(vectors: DataFrame, question: int) -> DataFrame:
    one = F.broadcast(vectors.where(F.col("vec_id") == question).select(F.col("embedding").alias("q")).limit(1))  # one row
    return vectors.crossJoin(one).withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col("q")), 6)).drop("q")


@query("vec5_similar_reasoning", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 2) SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS similarity FROM embeddings v, q WHERE v.vec_id >= 20 AND v.label IN (0, 1, 2, 3, 4) ORDER BY similarity DESC, vec_id LIMIT 10")
def similar_reasoning(spark, d):
    """The nearest of a stretch of time (ids stand for dates) and of five chambers (labels)."""
    vectors = table(spark, d, "embeddings")
    asked = F.broadcast(vectors.where("vec_id = 2").select(F.col("embedding").alias("q")).limit(1))  # one row
    chosen = V.filtered(vectors, ranges={"vec_id": (20, None)}, should={"label": [0, 1, 2, 3, 4]})
    return chosen.crossJoin(asked).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)


@query("vec7_rerank_budget", "WITH RECURSIVE q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT d.lang, d.doc_id, length(d.text) AS size, coalesce(round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6), 0) AS similarity FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id CROSS JOIN q), big AS (SELECT lang FROM s GROUP BY 1 HAVING count(*) >= 3 AND sum(size) > 1.5 * 8000), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY similarity DESC, doc_id) AS n FROM s WHERE lang IN (SELECT lang FROM big)), f AS (SELECT lang, n, size <= 8000 AS kept, CASE WHEN size <= 8000 THEN size ELSE 60 END AS used, doc_id FROM r WHERE n = 1 UNION ALL SELECT r.lang, r.n, f.used + r.size <= 8000, CASE WHEN f.used + r.size <= 8000 THEN f.used + r.size ELSE f.used + 60 END, r.doc_id FROM f JOIN r ON r.lang = f.lang AND r.n = f.n + 1) SELECT lang, doc_id, kept FROM f UNION ALL SELECT lang, doc_id, true FROM s WHERE lang NOT IN (SELECT lang FROM big)")
def rerank_budget(spark, d):
    """Results by relevance until the budget is full, the others as a line of 60 characters; few or short results stay as they are."""
    scored = _scored(table(spark, d, "embeddings"), 0).select(F.col("vec_id").alias("doc_id"), "similarity")
    met = table(spark, d, "documents").select("lang", "doc_id", F.length("text").alias("size")).join(scored, "doc_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    big = met.groupBy("lang").agg((F.count("*") >= 3).alias("many"), (F.sum("size") > 1.5 * 8000).alias("long")).where("many and long").select("lang")
    kept = R.within_budget(met.join(big, "lang", "left_semi"), "lang", [F.desc("similarity"), F.asc("doc_id")], F.col("size"), F.lit(60), 8000)
    rest = met.join(big, "lang", "left_anti").withColumn("kept", F.lit(True))
    return kept.select("lang", "doc_id", "kept").unionByName(rest.select("lang", "doc_id", "kept"))


@query("vec8_hybrid_match", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 5), a AS (SELECT vec_id AS id, 0.7 AS score FROM embeddings WHERE label = 3 UNION ALL SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) FROM embeddings v, q UNION ALL SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['license', 'released', 'under'])) / 3.0 FROM documents) SELECT id, max(score)::DOUBLE AS score FROM a GROUP BY 1 HAVING max(score) >= 0.5 ORDER BY score DESC, id LIMIT 10")
def hybrid_match(spark, d):
    """Templates by category (0.7), by meaning and by shared keywords; the best arm counts."""
    vectors = table(spark, d, "embeddings")
    category = vectors.where("label = 3").select(F.col("vec_id").alias("id"), F.lit(0.7).alias("score"))
    meaning = _scored(vectors, 5).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    shared = F.size(F.array_intersect(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("license", "released", "under")))))
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (shared / 3.0).alias("score"))
    return R.best_of([category, meaning, words], "id", "score", 0.5, 10)


def index_rows(sections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """doc_id, section_type, n, chunk and embedding: chunks of the sections that are searched, met with their vectors.

    ``sections``: doc_id, section_type, text; ``embeddings``: doc_id, n, embedding (an input; none is computed here).
    """
    wanted = sections.where(F.col("section_type").isin("DECISION", "COURT_REASONING"))
    chunks = wanted.select("doc_id", "section_type", F.posexplode(L.word_chunks(F.col("text"))).alias("n", "chunk"))
    return chunks.join(embeddings, ["doc_id", "n"])


@query("vec9_index_pipeline")
def index_pipeline(spark, d):
    """Every chunk of the texts whose section is searched, with a vector; the fold into chunks has no SQL.

    The tables' vectors belong to no texts: chunk n of a document has the vector of number doc_id + n, counted round 500.
    """
    kind = F.when(F.col("lang") == "en", "DECISION").when(F.col("lang") == "de", "COURT_REASONING").otherwise("FACTS")
    sections = table(spark, d, "documents").select("doc_id", kind.alias("section_type"), "text")
    # a chunk has half of 2048 characters at least, or it is the last
    places = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), (F.length("text") / 500).cast("int"))).alias("n"))
    vectors = places.withColumn("vec_id", (F.col("doc_id") + F.col("n")) % 500).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").select("doc_id", "n", "embedding")
    return index_rows(sections, vectors).select("doc_id", "section_type", "n", F.sha2("chunk", 256).alias("chunk"), F.size("embedding").alias("width"))


@query("snk15_vector_replace", "SELECT vec_id, label, embedding[1]::DOUBLE AS first FROM embeddings WHERE label NOT IN (1, 2) UNION ALL SELECT vec_id, label, embedding[1]::DOUBLE + 1 FROM embeddings WHERE label = 1")
def vector_replace(spark, d):
    """Vectors of one document (label) are stored anew, those of another are deleted."""
    old = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("first"))
    return R.replaced(old.where("label <> 2"), old.where("label = 1").withColumn("first", F.col("first") + 1), "label")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("agg18_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def row_counts(spark, d):
    """Exact counts, from the files' footers."""
    return reduce(DataFrame.unionByName, (table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES))


@query("snk16_import_log", "SELECT 'orders' AS registry, CAST(o_orderdate AS DATE) AS day, count(*) AS records, count(*) FILTER (o_orderstatus = 'F') AS failed, sum(count(*)) OVER (ORDER BY CAST(o_orderdate AS DATE)) AS total FROM orders GROUP BY 2")
def import_log(spark, d):
    """A row for each day's import, with the records loaded so far (one row a day is summed)."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("records"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    return days.select(F.lit("orders").alias("registry"), "day", "records", "failed", F.sum("records").over(Window.orderBy("day")).alias("total"))


@query("srt7_instance_order", f"WITH {_CHAIN} SELECT number, doc_id, row_number() OVER (PARTITION BY number ORDER BY level DESC, decided DESC, doc_id) AS place FROM chain")
def instance_order(spark, d):
    by = Window.partitionBy("number").orderBy(F.desc("level"), F.desc("decided"), "doc_id")
    return O.case_chain(NUMBERS.frame(spark, d), DECISIONS.frame(spark, d)).select("number", "doc_id", F.row_number().over(by).alias("place"))


def similar_facts(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """fact_id, doc_id and hits: how many of a fact's search terms each text has; texts with none have no row."""
    terms = facts.select("fact_id", C.search_terms(F.col("facts"))["keywords"].alias("k")).select("fact_id", F.explode("k").alias("term"))
    found = R.containing(texts.select("doc_id", "text"), "text", terms.select("term").distinct(), "term").select("doc_id", "term").distinct()
    return found.join(terms, "term").groupBy("fact_id", "doc_id").agg(F.count("*").alias("hits"))


@query("txt41_similar_facts", f"SELECT 1 AS fact_id, doc_id, CAST(contains(t, 'позов') AS BIGINT) + CAST(contains(t, 'договір') AS BIGINT) + CAST(contains(t, 'пеня') AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM {REASONING.sql}) WHERE hits > 0")
def fact_patterns(spark, d):
    facts = spark.createDataFrame([(1, "Договір позики, позов про стягення, пеня")], "fact_id int, facts string")
    return similar_facts(facts, REASONING.frame(spark, d))


@query("txt28_word_changes")
def word_changes(spark, d):
    """What changes from a text to the next one of its topic; an alignment has no SQL, tests rebuild the new text from it."""
    before = F.lag("text").over(Window.partitionBy("topic").orderBy("doc_id"))
    pairs = REASONING.frame(spark, d).withColumn("before", before).where("before is not null")
    each = pairs.select("doc_id", F.explode(L.word_changes(F.col("before"), F.col("text"))).alias("c")).select("doc_id", "c.*")
    return each.withColumn("importance", L.change_importance(F.col("text")))


@query("vec2_index_exact", "SELECT qkey, key, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY similarity DESC, key) AS rank FROM (SELECT q.vec_id AS qkey, v.vec_id AS key, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10")
def index_exact(spark, d):
    """The ten nearest of every hundredth vector among all, compared in blocks of the stored lists."""
    vectors = table(spark, d, "embeddings")
    return I.search(I.build(vectors, "vec_id", "embedding"), vectors.where("vec_id % 100 = 0"), 10, exact=True)


@query("vec9_index_search")
def index_search(spark, d):
    """The same by codes of the nearest lists and a second look; tests measure its recall against all vectors."""
    vectors = table(spark, d, "embeddings")
    return I.search(I.build(vectors, "vec_id", "embedding"), vectors.where("vec_id % 100 = 0"), 10, probes=PROBES)


#: Of 64 lists; the tables' vectors have little structure, so a search looks into many.
PROBES = 40
