"""Rules on short texts, records and streams' results, over rows made from the given tables by expressions that SQL repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.functions import cases as C
from docketry.functions import legal as L
from docketry.functions import money as M
from docketry.operators import relational as R
from docketry.plans.registry import query
from docketry.sources import parliament, registries
from docketry.sources.tables import shared_folder, table
from docketry.streaming import events as E


def _path(spark) -> str:
    return f"{shared_folder(spark)}/derived-{uuid.uuid4().hex}"


_DECISION = "CASE o_orderkey % 4 WHEN 0 THEN 'Справа ' || o_orderkey || '. ВСТАНОВИВ: позивач ' || o_custkey || ' звернувся до суду МОТИВУВАЛЬНА ЧАСТИНА: суд виходить з ' || o_orderpriority || ' ВИРІШИВ: позов ' || o_orderstatus || ' задовольнити повністю' WHEN 1 THEN 'без частин ' || o_orderkey WHEN 2 THEN 'Встановив: ' || o_custkey || ' та інше у справі Ухвалив: стягнути ' || o_orderkey || ' гривень' END"
_CUT = "nullif(trim(regexp_extract(text, '(?is){}', 1)), '')"


@query("txt5_key_parts", "WITH t AS (SELECT o_orderkey AS id, " + _DECISION + " AS text FROM orders) SELECT id, " + ", ".join(f"trim(substr({_CUT.format(p)}, 1, 20)) AS {n}" for n, p in (("facts", "ВСТАНОВИВ[:\\s]*(.{10,}?)(?:МОТИВУВАЛЬНА|ВИРІШИВ|УХВАЛИВ|ПОСТАНОВИВ|$)"), ("reasoning", "МОТИВУВАЛЬНА[^:]*:[:\\s]*(.{10,}?)(?:ВИРІШИВ|УХВАЛИВ|ПОСТАНОВИВ|РЕЗОЛЮТИВНА|$)"), ("decision", "(?:ВИРІШИВ|УХВАЛИВ|ПОСТАНОВИВ)[:\\s]*(.{10,}?)$"))) + " FROM t")
def key_parts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_DECISION).alias("text"))
    return rows.select("id", L.key_parts(F.col("text"), 20).alias("p")).select("id", *(F.trim(f"p.{n}").alias(n) for n in L.KEY_PARTS))


_SNIPPET = "CASE o_orderkey % 3 WHEN 0 THEN 'Рішення по справі № ' || o_custkey || '/' || o_orderkey || '/22-ц  Суд ' || o_orderpriority || '<br>далі' WHEN 1 THEN 'Постанова По Справі №' || o_custkey || '/7/2022 Господарський суд ' || o_orderstatus ELSE 'без номера ' || o_orderkey END"


@query("txt36_court_of_snippet", f"SELECT o_orderkey, nullif(trim(regexp_extract({_SNIPPET}, '(?i)по справі №.*?\\d+/\\d+/\\d+[^\\s]*\\s+(.+?)(?:<|$)', 1)), '') AS court FROM orders")
def court_of_snippet(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.court_of_snippet(F.expr(_SNIPPET)).alias("court"))


_AGO = "CASE c_custkey % 5 WHEN 0 THEN 'last ' || (c_custkey % 9) || ' years' WHEN 1 THEN ' Last ' || (c_custkey % 13) || ' months' WHEN 2 THEN 'last 1 year' WHEN 3 THEN 'yesterday' END"


@query("dat2_relative_ranges", f"WITH t AS (SELECT c_custkey, {_AGO} AS t FROM customer), n AS (SELECT *, lower(trim(t)) AS l FROM t), m AS (SELECT *, coalesce(TRY_CAST(regexp_extract(l, 'last\\s+(\\d+)\\s+years?', 1) AS INT) * 12, TRY_CAST(regexp_extract(l, 'last\\s+(\\d+)\\s+months?', 1) AS INT)) AS months FROM n) SELECT c_custkey, CAST(DATE '2024-02-29' - to_months(months) AS DATE) AS date_from, CASE WHEN t IS NOT NULL AND months IS NULL THEN 'unsupported' END AS warning FROM m")
def relative_ranges(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", M.relative_range(F.expr(_AGO), F.lit("2024-02-29").cast("date")).alias("r"))
    return rows.select("c_custkey", "r.date_from", "r.warning")


@query("txt38_source_names", "WITH s AS (SELECT c_custkey, [CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END, 'u' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, NULL, c_mktsegment, c_name, 'x'] AS names FROM customer), e AS (SELECT c_custkey, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM s), f AS (SELECT c_custkey, name, min(i) AS i FROM e WHERE trim(name) <> '' GROUP BY 1, 2) SELECT c_custkey, string_agg(name, ',' ORDER BY i) AS names FROM f GROUP BY 1")
def source_names(spark, d):
    """Sources of an answer: ids, urls and titles, some blank, repeated or missing."""
    one = F.struct(F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_name END").alias("id"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END").alias("source_id"), F.expr("'u' || c_nationkey").alias("url"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END").alias("title"))
    two = F.struct(F.lit(None).cast("string").alias("id"), F.col("c_mktsegment").alias("source_id"), F.col("c_name").alias("url"), F.lit("x").alias("title"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(L.source_names(F.array(one, two)), ",").alias("names"))


_ANSWER = "CASE event_id % 4 WHEN 0 THEN 'Here: ' || props || ' as asked' WHEN 1 THEN props WHEN 2 THEN 'none ' || event_id ELSE '{broken ' || props END"


@query("col12_fenced_json", f"WITH t AS (SELECT event_id, {_ANSWER} AS a FROM events), f AS (SELECT *, regexp_extract(a, '(?s)\\{{.*\\}}', 0) AS inner_ FROM t) SELECT event_id, CAST(CASE WHEN json_valid(a) THEN json_extract_string(a, '$.k') WHEN json_valid(inner_) THEN json_extract_string(inner_, '$.k') END AS INT) AS k FROM f")
def fenced_json(spark, d):
    """JSON in an answer, alone or between other text; null where none can be read."""
    rows = table(spark, d, "events").select("event_id", F.expr(_ANSWER).alias("answer"))
    found = F.coalesce(F.try_parse_json("answer"), F.try_parse_json(F.nullif(F.regexp_extract("answer", r"(?s)\{.*\}", 0), F.lit(""))))
    return rows.select("event_id", F.try_variant_get(found, "$.k", "int").alias("k"))


@query("flt11_owned_or_shared", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey % 7, 0) = 3 OR nullif(c_nationkey % 7, 0) IS NULL")
def owned_or_shared(spark, d):
    """Rows of one owner and rows without an owner."""
    rows = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey") % 7, F.lit(0)).alias("owner"))
    return R.owned_or_shared(rows, "owner", 3).select("c_custkey")


@query("txt18_deviation", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN true END AS deviates FROM orders")
def deviation(spark, d):
    """Whether a text departs from earlier practice; the SQL knows which texts were made so."""
    text = F.concat_ws(" ", F.when(F.col("o_orderkey") % 3 == 0, "Суд ВІДСТУПАЄ від").otherwise("Суд згоден з"), F.when(F.col("o_orderkey") % 2 == 0, "висновком").otherwise("думкою"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", L.deviation(text).alias("deviates"))


@query("txt10_law_reference", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '435-15' WHEN 1 THEN '1618-15' WHEN 2 THEN '2747-15' END AS rada_id, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS VARCHAR) END AS article FROM orders")
def law_reference(spark, d):
    """The law and the article of references in three forms, the numbers from the table."""
    n = F.col("o_custkey").cast("string")
    form = F.col("o_orderkey") % 4
    text = F.when(form == 0, F.concat(F.lit("згідно зі ст. "), n, F.lit(" ЦК України"))).when(form == 1, F.concat(F.lit("за ЦПК ст. "), n)).when(form == 2, F.concat(F.lit("статті "), n, F.lit(" Кодексу адміністративного судочинства"))).otherwise(F.concat(F.lit("без посилань "), n))
    found = table(spark, d, "orders").select("o_orderkey", L.law_reference(text).alias("r"))
    return found.select("o_orderkey", "r.rada_id", "r.article")


@query("str10_alerts", "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT start, n FROM w WHERE errors / n > 0.25")
def alerts(spark, d):
    """Windows whose rate of errors passes a quarter."""
    rates = E.sliding_rates(table(spark, d, "events").withColumn("all", F.lit(1)), "all", "6 hours", "6 hours")
    return E.alerts(rates, error_rate=0.25, p95=float("inf")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("src1_registry_xml", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_nationkey > 12 THEN 'far' ELSE 'near' END AS place FROM customer")
def registry_xml(spark, d):
    """A registry's XML, written from a table by Spark: fields by path below a wrapper, and a computed column."""
    path = _path(spark)
    body = F.struct(F.col("c_custkey").alias("ID"), F.struct(F.col("c_name").alias("FULL"), F.col("c_nationkey").alias("NATION")).alias("SUBJECT")).alias("DATA")
    table(spark, d, "customer").select(body).write.option("rowTag", "RECORD").option("rootTag", "ROWS").option("encoding", "windows-1251").format("xml").save(path)
    registry = registries.Registry("subjects", ("id",), {"id": "ID", "name": "SUBJECT.FULL", "nation": "SUBJECT.NATION"}, wrapper="DATA", computed={"place": lambda r: F.when(r["nation"].cast("int") > 12, "far").otherwise("near")})
    return registries.read_xml(spark, path, registry)


@query("src4_named_items", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def named_items(spark, d):
    """Values by the name attribute of their elements."""
    item = lambda name, value: F.struct(F.lit(name).alias("_name"), value.alias("_VALUE"))
    items = F.array_compact(F.array(item("NAME", F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, item("SEGMENT", F.col("c_mktsegment")))))
    return table(spark, d, "customer").select("c_custkey", registries.named_item(items, "NAME").alias("name"), registries.named_item(items, "SEGMENT").alias("segment"))


@query("src9_json_lists", "SELECT n_nationkey, n_name FROM nation")
def json_lists(spark, d):
    """A data set of JSON files, each one list, written from a table and read with its schema."""
    path = _path(spark)
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # five nations a region
    lists.select("value").repartition(5).write.text(path)
    return parliament.read_json(spark, path, table(spark, d, "nation").select("n_nationkey", "n_name").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("src11_sessions", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")
def sessions(spark, d):
    """Days of sittings from lines DD.MM.YYYY, other lines left out."""
    path = _path(spark)
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("value")).distinct()
    days.union(table(spark, d, "nation").select("n_name")).write.text(path)
    return parliament.read_session_dates(spark, path)


@query("src19_one_decision", "SELECT doc_id, lang FROM documents WHERE doc_id = 17")
def one_decision(spark, d):
    from docketry.tools import TOOLS

    return TOOLS["get_court_decision"](table(spark, d, "documents"), 17).select("doc_id", "lang")
