"""Joins, windows, upserts, graphs and sessions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.operators import graphs as G
from docketry.operators import relational as R
from docketry.plans.registry import query
from docketry.sources.tables import table
from docketry.streaming import events as E


@query("jn1_filtered_join", "SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'")
def filtered_join(spark, d):
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("jn3_discriminated", "WITH f AS (SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'unknown', 1), p AS (SELECT 'customer' AS kind, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) SELECT f.kind, f.k, p.name FROM f LEFT JOIN p ON f.kind = p.kind AND f.k = p.k")
def discriminated_join(spark, d):
    parents = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))}
    fact = parents["customer"].select(F.lit("customer").alias("kind"), "k").unionByName(parents["supplier"].select(F.lit("supplier").alias("kind"), "k")).unionByName(spark.range(1, 2).select(F.lit("unknown").alias("kind"), F.col("id").alias("k")))
    return R.discriminated(fact, parents, "kind", "k", ["name"])


@query("jn5_left_with_predicate", "SELECT c_custkey, count(o_orderkey) AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1")
def left_with_predicate(spark, d):
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("recent"))


@query("jn7_scalar_lookups", "SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, CAST((SELECT round(sum(CAST(o_totalprice AS DECIMAL(18,4))), 2) FROM orders WHERE o_custkey = c_custkey) AS DOUBLE) AS spent FROM customer")
def scalar_lookups(spark, d):
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,4)")), 2).cast("double").alias("spent"))
    return table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order", F.coalesce("n", F.lit(0)).alias("n"), "spent")


@query("jn8_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-01')")
def semi(spark, d):
    late = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    return table(spark, d, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn9_effective_rate", "WITH r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS DATE) + 90 WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderdate AS DATE) + 1000 END AS t, o_totalprice AS rate FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, coalesce(max({'f': f, 'rate': rate}).rate, 0) AS rate FROM orders LEFT JOIN r ON k = o_custkey AND f <= CAST(o_orderdate AS DATE) AND (t IS NULL OR t >= CAST(o_orderdate AS DATE)) GROUP BY o_orderkey")
def effective_rates(spark, d):
    """A customer's finished orders set rates, some of which lapse; every order takes the one in force on its day."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    until = F.when(F.col("o_orderpriority") == "5-LOW", F.date_add("day", 90)).when(F.col("o_orderpriority") == "2-HIGH", F.date_add("day", 1000))
    rates = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("day").alias("effective_from"), until.alias("effective_to"), F.col("o_totalprice").alias("rate"))
    return R.effective_rate(orders.select("o_orderkey", "o_custkey", "day"), rates, "o_custkey", "day").select("o_orderkey", "rate")


@query("jn10_conflicts", "WITH n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS w FROM part), t AS (SELECT p_partkey, unnest(list_distinct(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'))) AS w FROM part) SELECT p_partkey, n.w AS matched FROM t JOIN n ON t.w = n.w")
def conflicts(spark, d):
    part = table(spark, d, "part")
    needles = part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("matched")).distinct()
    return R.containing(part.select("p_partkey", "p_name"), "p_name", needles, "matched").select("p_partkey", "matched")


@query("jn14_entity_details", "SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_items, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_parts, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def entity_details(spark, d):
    children = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_items"), F.countDistinct("l_partkey").alias("n_parts"))
    met = table(spark, d, "supplier").join(children, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return met.select("s_suppkey", "s_name", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), "n_name")


@query("win1_latest_per_kind", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def latest_per_kind(spark, d):
    return R.first_per(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate"), ["o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 5).drop("o_orderdate")


@query("win2_latest_version", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_versions(spark, d):
    return R.latest_version(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("win3_hash_chain", "SELECT event_id, lag(event_id) OVER w AS previous, sha256(concat_ws('|', coalesce(CAST(lag(event_id) OVER w AS VARCHAR), 'GENESIS'), event_id, event_type)) AS hash FROM events WINDOW w AS (ORDER BY ts, event_id)")
def hash_chain(spark, d):
    """Each event with the one before it in the whole order and a hash of both; found by positions, not in one task."""
    placed = R.positions(table(spark, d, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"])
    before = placed.select((F.col("position") + 1).alias("position"), F.col("event_id").alias("previous"))
    named = F.concat_ws("|", F.coalesce(F.col("previous").cast("string"), F.lit("GENESIS")), "event_id", "event_type")
    return placed.join(before, "position", "left").select("event_id", "previous", F.sha2(named, 256).alias("hash"))


@query("win5_invoice_numbers", "SELECT o_orderkey, concat('INV-', year(o_orderdate), '-', lpad(CAST(row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0')) AS number FROM orders")
def invoice_numbers(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", F.year("o_orderdate").alias("year"))
    placed = R.numbered(rows, ["year", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return placed.select("o_orderkey", F.concat(F.lit("INV-"), "year", F.lit("-"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("number"))


@query("win9_conversation_window", "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, row_number() OVER w AS r, CAST(sum(least(length(text), 2000) + 20) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE r <= 4 AND used <= 3000")
def conversation_window(spark, d):
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cut = F.least(F.length("text"), F.lit(2000)) + 20
    held = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(by).alias("r"), F.sum(cut).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return held.where("r <= 4 and used <= 3000").drop("r")


@query("win8_carried_headings", "SELECT event_id, user_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events")
def carried_headings(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.count(F.when(F.col("event_type") == "signup", 1)).over(by).alias("section"))


@query("snk1_exact_dedup", "SELECT sha256(text) AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.max("doc_id").alias("doc_id"))


@query("snk5_changes", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'new' WHEN c_custkey % 10 = 1 THEN 'gone' WHEN c_custkey % 10 = 2 AND c_acctbal <> 0 THEN 'changed' ELSE 'unchanged' END AS state FROM customer) GROUP BY 1")
def changed_rows(spark, d):
    all_ = table(spark, d, "customer")
    old = all_.where("c_custkey % 10 <> 0")
    new = all_.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 2, -F.col("c_acctbal")).otherwise(F.col("c_acctbal")))
    return R.changes(old, new, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]).groupBy("state").agg(F.count("*").alias("n"))


@query("snk7_upsert_keeping", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_keeping(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")).withColumn("c_name", F.lit(None).cast("string"))
    return R.upsert(old, new, ["c_custkey"], keep_if_null=("c_name",))


@query("grf1_neighbourhood", "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'o' || l_orderkey AS b FROM lineitem), d0 AS (SELECT 's0' AS node), d1 AS (SELECT DISTINCT b AS node FROM e JOIN d0 ON a = node), d2 AS (SELECT DISTINCT a AS node FROM e JOIN d1 ON b = node WHERE a <> 's0') SELECT node, 0 AS distance FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2")
def neighbourhood(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("o"), "l_orderkey").alias("b")).distinct()
    return G.neighbourhood(edges, spark.range(1).select(F.lit("s0").alias("node")), 2)


@query("grf2_standing", "WITH l AS (SELECT o_custkey AS case_id, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT c_custkey AS case_id, CASE WHEN f IS NULL THEN 'unknown' WHEN f THEN 'explicitly_overruled' WHEN p THEN 'questioned' ELSE 'valid' END AS status, CAST(CASE WHEN f IS NULL THEN 0.5 WHEN f THEN 0.9 WHEN p THEN 0.7 ELSE 0.8 END AS DOUBLE) AS confidence FROM customer LEFT JOIN l ON c_custkey = case_id")
def precedents(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "overrules").when(F.col("o_orderstatus") == "P", "distinguishes").otherwise("follows")
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("to_case_id"), kind.alias("citation_type"))
    return G.standing(links, table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")))


@query("str3_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS start, count(*) AS n_events FROM s GROUP BY user_id, n")
def session_rows(spark, d):
    found = E.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events")


@query("str5_daily_counts", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) > 5 AS over FROM events GROUP BY 1, 2")
def daily_counts(spark, d):
    return E.daily_counts(table(spark, d, "events"), "user_id", 5).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("str9_sliding_rates", "WITH w AS (SELECT event_type, value, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest(range(0, 6)) AS start FROM events) SELECT CAST(start AS VARCHAR) AS start, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM w GROUP BY 1")
def sliding_rates(spark, d):
    found = E.sliding_rates(table(spark, d, "events").withColumn("all", F.lit(1)), "all", "6 hours", "1 hour")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("error_rate", 6).alias("error_rate"))
