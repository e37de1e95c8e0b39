"""Usage, billing, cohort and completeness reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import money as M
from docketry.operators import relational as R
from docketry.plans.registry import query
from docketry.sources.tables import table

#: Reports are relative to this moment, never to the clock.
AS_OF = "2024-01-31"


def _money(column: str):
    return F.col(column).cast("decimal(18,4)")


def _total(column, digits: int = 2):
    return F.round(F.sum(column), digits).cast("double")


@query("flagship", "SELECT l_returnflag, l_linestatus, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_qty, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL")
def usage_summary(spark, d):
    items = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(_total(_money("l_quantity")).alias("sum_qty"), _total(_money("l_extendedprice")).alias("sum_price"), F.count("*").alias("n"))


@query("agg1_table_stats", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(round(avg(CAST(o_totalprice AS DECIMAL(18,4))), 4) AS DOUBLE) AS mean FROM orders")
def table_stats(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.avg(_money("o_totalprice")), 4).cast("double").alias("mean"))


@query("agg2_conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def conditional_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("agg3_revenue_by_day", "SELECT CAST(l_shipdate AS DATE) AS day, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4))), 2) AS DOUBLE) AS cost, count(*) AS requests FROM lineitem GROUP BY 1")
def revenue_by_day(spark, d):
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(_total(_money("l_extendedprice")).alias("revenue"), _total(_money("l_extendedprice") * _money("l_discount")).alias("cost"), F.count("*").alias("requests"))


@query("agg4_scorecard", "SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01') AS month, count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS active_users, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def scorecard(spark, d):
    since = lambda day: F.col("ts") >= F.lit(day).cast("timestamp_ntz")
    return table(spark, d, "events").agg(F.count_if(since("2024-01-30")).alias("today"), F.count_if(since("2024-01-01")).alias("month"), F.countDistinct(F.when(since("2024-01-24"), F.col("user_id"))).alias("active_users"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("agg5_tier_distribution", "SELECT c_mktsegment AS tier, count(*) AS users, CAST(round(sum(CAST(c_acctbal AS DECIMAL(18,4))), 2) AS DOUBLE) AS balance, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
def tier_distribution(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("tier")).agg(F.count("*").alias("users"), _total(_money("c_acctbal")).alias("balance"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("agg6_cohort_retention", "WITH f AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS cohort, min(o_orderdate) AS first FROM orders GROUP BY 1) SELECT CAST(f.cohort AS DATE) AS cohort, count(DISTINCT f.o_custkey) AS users, count(DISTINCT o.o_custkey) AS returned, round(100.0 * count(DISTINCT o.o_custkey) / count(DISTINCT f.o_custkey), 2) AS retention FROM f LEFT JOIN orders o ON o.o_custkey = f.o_custkey AND o.o_orderdate > f.first AND o.o_orderdate < f.first + INTERVAL 90 DAY GROUP BY 1")
def cohort_retention(spark, d):
    # the first order and those after it are one key's rows: a window on it, no self join
    by = Window.partitionBy("o_custkey")
    marked = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.min("o_orderdate").over(by).alias("first"))
    later = (F.col("o_orderdate") > F.col("first")) & (F.col("o_orderdate") < F.col("first") + F.expr("INTERVAL 90 DAYS"))
    users = marked.groupBy("o_custkey", F.to_date(F.date_trunc("month", "first")).alias("cohort")).agg(F.bool_or(later).alias("back"))
    out = users.groupBy("cohort").agg(F.count("*").alias("users"), F.count_if("back").alias("returned"))
    return out.withColumn("retention", F.round(F.lit(100.0) * F.col("returned") / F.col("users"), 2))


@query("agg7_usage_by_tool", "SELECT event_type AS tool, count(*) AS requests, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1 ORDER BY requests DESC, tool LIMIT 10")
def usage_by_tool(spark, d):
    grouped = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("requests"), _total(_money("value")).alias("revenue"))
    whole = grouped.agg(F.sum("requests").alias("_all"))  # one row
    return grouped.crossJoin(F.broadcast(whole)).withColumn("pct", F.round(F.lit(100.0) * F.col("requests") / F.col("_all"), 2)).drop("_all").orderBy(F.desc("requests"), "tool").limit(10)


@query("agg8_period_change", "WITH s AS (SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS now, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before FROM events GROUP BY 1) SELECT *, CASE WHEN before > 0 THEN round(100.0 * (now - before) / before, 2) END AS change_pct FROM s")
def period_change(spark, d):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    grouped = table(spark, d, "events").groupBy("event_type").agg(F.count_if(late).alias("now"), F.count_if(~late).alias("before"))
    return grouped.withColumn("change_pct", F.when(F.col("before") > 0, F.round(F.lit(100.0) * (F.col("now") - F.col("before")) / F.col("before"), 2)))


@query("agg9_cost_by_provider", "WITH calls AS (SELECT o_orderkey, o_orderpriority AS provider, list({'model': l_returnflag, 'cost': l_extendedprice}) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT provider, u.model AS model, count(*) AS requests, CAST(round(sum(CAST(u.cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS cost FROM (SELECT provider, unnest(c) AS u FROM calls) GROUP BY 1, 2")
def cost_by_provider(spark, d):
    calls = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("model"), _money("l_extendedprice").alias("cost"))
    met = calls.join(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("provider")), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("provider", "model").agg(F.count("*").alias("requests"), _total("cost").alias("cost"))


@query("agg11_hourly_by_model", "SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"CAST(round(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_type = '{t}'), 2) AS DOUBLE) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def hourly_by_model(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]  # named, so that no extra job finds them
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).pivot("event_type", kinds).agg(_total(_money("value")))


@query("agg12_run_rate", "SELECT CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS per_day, CAST(round(sum(CAST(value AS DECIMAL(18,4))) * 30, 2) AS DOUBLE) AS per_month FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30'")
def run_rate(spark, d):
    day = R.between(table(spark, d, "events"), "ts", F.lit("2024-01-29").cast("timestamp_ntz")).where(F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))
    return day.agg(_total(_money("value")).alias("per_day"), F.round(F.sum(_money("value")) * 30, 2).cast("double").alias("per_month"))


@query("agg13_completeness", "SELECT coalesce(lang, 'all') AS kind, count(*) AS total, count(*) FILTER (WHERE length(text) >= 500) AS has_text, count(l.doc_id) AS labelled, count(*) FILTER (WHERE length(text) < 500 AND l.doc_id IS NULL) AS missing_both, round(100.0 * count(l.doc_id) / count(*), 2) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)")
def completeness(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", F.lit(True).alias("there"))
    met = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n")).join(labelled, "doc_id", "left")
    has, known = F.col("n") >= 500, F.col("there").isNotNull()
    out = met.rollup("lang").agg(F.count("*").alias("total"), F.count_if(has).alias("has_text"), F.count_if(known).alias("labelled"), F.count_if(~has & ~known).alias("missing_both"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("kind"), "total", "has_text", "labelled", "missing_both", F.round(F.lit(100.0) * F.col("labelled") / F.col("total"), 2).alias("pct"))


@query("agg15_freshness", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, CAST(max({c}) AS DATE) AS latest, count(*) FILTER (WHERE CAST({c} AS DATE) = (SELECT max(CAST({c} AS DATE)) FROM {t})) AS last_batch FROM {t}" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))))
def freshness(spark, d):
    def one(name, column):
        days = table(spark, d, name).groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("n"))
        return days.agg(F.lit(name).alias("table_name"), F.sum("n").alias("n"), F.max("day").alias("latest"), F.max_by("n", "day").alias("last_batch"))

    return one("orders", "o_orderdate").unionByName(one("lineitem", "l_shipdate")).unionByName(one("events", "ts"))


@query("agg17_registry_statistics", "SELECT coalesce(kind, 'all') AS kind, count(*) AS total, count(*) FILTER (WHERE bal > 0) AS active FROM (SELECT 'customer' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY ROLLUP (kind)")
def registry_statistics(spark, d):
    parts = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal")).unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal")))
    return parts.rollup("kind").agg(F.count("*").alias("total"), F.count_if(F.col("bal") > 0).alias("active")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "total", "active")


@query("agg19_nested_children", "SELECT r_name, to_json(list({'k': n_nationkey, 'n': n_name} ORDER BY n_nationkey)) AS children FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def nested_children(spark, d):
    met = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return met.groupBy("r_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))))).alias("children"))


@query("agg23_common_terms", "WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT t.lang AS lang, w AS term, count(*) AS matches FROM t JOIN n ON t.lang = n.lang GROUP BY t.lang, w, n.n HAVING count(*) >= ceil(n.n * 0.3)")
def common_terms(spark, d):
    """Terms whose matches over all rows are at least as many as three tenths of the rows; a text counts as often as it matches."""
    docs = table(spark, d, "documents")
    terms = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("matches"))
    return terms.join(F.broadcast(docs.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.col("matches") >= F.ceil(F.col("n") * 0.3)).select("lang", "term", "matches")


@query("agg24_mode", "SELECT c AS o_custkey, o_orderstatus AS outcome FROM (SELECT o_custkey AS c, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def mode_of_outcomes(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return R.first_per(counts, ["o_custkey"], [F.desc("n"), F.asc("o_orderstatus")]).select("o_custkey", F.col("o_orderstatus").alias("outcome"))


@query("agg28_subscription_stats", "SELECT CASE WHEN GROUPING(o_orderstatus) = 0 THEN 'status' WHEN GROUPING(o_orderpriority) = 0 THEN 'tier' ELSE 'all' END AS level, coalesce(o_orderstatus, o_orderpriority, 'all') AS name, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS mrr FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def subscription_stats(spark, d):
    orders = table(spark, d, "orders").withColumn("price", _money("o_totalprice"))
    sets = orders.groupingSets([[], ["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    level = F.when(F.grouping("o_orderstatus") == 0, "status").when(F.grouping("o_orderpriority") == 0, "tier").otherwise("all")
    counted = sets.agg(level.alias("level"), F.count("*").alias("n"), _total("price").alias("mrr"))
    return counted.select("level", F.coalesce("o_orderstatus", "o_orderpriority", F.lit("all")).alias("name"), "n", "mrr")


@query("agg31_without_children", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def without_children(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("agg32_invoice_totals", "WITH t AS (SELECT l_orderkey AS invoice, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * 1.5 ELSE 0 END) AS paid, max(l_linestatus) AS was FROM lineitem GROUP BY 1), u AS (SELECT *, round(subtotal * 0.20, 2) AS tax FROM t) SELECT invoice, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax, CAST(subtotal + tax AS DOUBLE) AS total, CAST(round(paid, 2) AS DOUBLE) AS paid, CASE WHEN round(paid, 2) >= subtotal + tax THEN 'paid' WHEN paid > 0 AND was = 'O' THEN 'sent' WHEN was = 'O' THEN 'draft' ELSE 'overdue' END AS status FROM u")
def invoice_totals(spark, d):
    """Lines are invoice lines; one and a half times the price of those that are not returned counts as payments."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    paid = F.sum(F.when(F.col("l_returnflag") != "R", price * F.lit("1.5").cast("decimal(2,1)")).otherwise(0))
    was = F.when(F.max("l_linestatus") == "O", "draft").otherwise("overdue")
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("invoice")).agg(F.sum(price).alias("subtotal"), F.round(paid, 2).alias("paid"), was.alias("was"))
    tax = F.round(F.col("subtotal") * F.lit("0.20").cast("decimal(3,2)"), 2)
    total = F.col("subtotal") + tax
    status = M.invoice_status(F.col("paid"), total, F.col("was"))
    return t.select("invoice", *(c.cast("double").alias(n) for n, c in (("subtotal", F.col("subtotal")), ("tax", tax), ("total", total), ("paid", F.col("paid")))), status.alias("status"))


# Points of a finding by its severity; the categories that have a score of their own.
POINTS = {"critical": 25, "high": 15, "medium": 8, "low": 3}
CATEGORIES = {"contractual": "contractual_obligation", "financial": "financial_risk", "compliance": "compliance_issue", "legal": "legal_risk", "operational": "operational_risk"}

_FINDINGS_SQL = "f AS (SELECT user_id, CASE event_type WHEN 'error' THEN CASE WHEN value > 99 THEN 'critical' ELSE 'high' END WHEN 'purchase' THEN 'medium' ELSE 'low' END AS r, CASE event_id % 6 WHEN 0 THEN 'contractual' WHEN 1 THEN 'financial' WHEN 2 THEN 'compliance' WHEN 3 THEN 'legal' WHEN 4 THEN 'operational' ELSE 'other' END AS c FROM events), p AS (SELECT *, CASE r WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END AS p FROM f)"


def _findings(spark, d):
    """Events of a few kinds stand for findings on the documents of a user."""
    severity = F.when(F.col("event_type") == "error", F.when(F.col("value") > 99, "critical").otherwise("high")).when(F.col("event_type") == "purchase", "medium").otherwise("low")
    category = F.element_at(F.array(*(F.lit(c) for c in (*CATEGORIES.values(), "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("user_id", severity.alias("risk_level"), category.alias("category"))


def risk_scores(findings, key):
    """key, score and a score for each category (100 at most), counts by level, and the level of all.

    critical: a critical finding, or 75 points; high: more than two high findings, or 50 points; medium: 25 points.
    """
    points = F.coalesce(*(F.when(F.col("risk_level") == name, p) for name, p in POINTS.items()), F.lit(0))
    capped = lambda c: F.least(F.lit(100), F.coalesce(F.sum(c), F.lit(0))).cast("bigint")
    out = findings.groupBy(key).agg(capped(points).alias("score"), *(capped(F.when(F.col("category") == c, points)).alias(n) for n, c in CATEGORIES.items()), *(F.count_if(F.col("risk_level") == r).alias(f"n_{r}") for r in POINTS))
    score = F.col("score")
    level = F.when((F.col("n_critical") > 0) | (score >= 75), "critical").when((F.col("n_high") > 2) | (score >= 50), "high").when(score >= 25, "medium").otherwise("low")
    return out.withColumn("level", level)


@query("agg33_risk_score", "WITH " + _FINDINGS_SQL + ", s AS (SELECT user_id, CAST(least(100, sum(p)) AS BIGINT) AS score, CAST(least(100, coalesce(sum(p) FILTER (c = 'contractual'), 0)) AS BIGINT) AS contractual, CAST(least(100, coalesce(sum(p) FILTER (c = 'financial'), 0)) AS BIGINT) AS financial, CAST(least(100, coalesce(sum(p) FILTER (c = 'compliance'), 0)) AS BIGINT) AS compliance, CAST(least(100, coalesce(sum(p) FILTER (c = 'legal'), 0)) AS BIGINT) AS legal, CAST(least(100, coalesce(sum(p) FILTER (c = 'operational'), 0)) AS BIGINT) AS operational, count(*) FILTER (r = 'critical') AS n_critical, count(*) FILTER (r = 'high') AS n_high, count(*) FILTER (r = 'medium') AS n_medium, count(*) FILTER (r = 'low') AS n_low FROM p GROUP BY 1) SELECT *, CASE WHEN n_critical > 0 OR score >= 75 THEN 'critical' WHEN n_high > 2 OR score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM s")
def risk_score(spark, d):
    return risk_scores(_findings(spark, d), "user_id")


def portfolio_level(scores):
    """One row: the level of a portfolio of scored documents."""
    high, critical = (F.count_if(F.col("level") == name) for name in ("high", "critical"))
    return scores.agg(F.when(critical > 0, "critical").when(high * 2 > F.count("*"), "high").when(high > 0, "medium").otherwise("low").alias("level"))


@query("agg34_portfolio_risk", "WITH " + _FINDINGS_SQL + ", s AS (SELECT user_id, least(100, sum(p)) AS score, count(*) FILTER (r = 'critical') AS c, count(*) FILTER (r = 'high') AS h FROM p GROUP BY 1), l AS (SELECT CASE WHEN c > 0 OR score >= 75 THEN 'critical' WHEN h > 2 OR score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM s) SELECT CASE WHEN count(*) FILTER (level = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (level = 'high') * 2 > count(*) THEN 'high' WHEN count(*) FILTER (level = 'high') > 0 THEN 'medium' ELSE 'low' END AS level FROM l")
def portfolio_risk(spark, d):
    return portfolio_level(risk_scores(_findings(spark, d), "user_id"))


@query("agg36_year_matrix", "SELECT CAST(coalesce(CAST(year(o_orderdate) AS VARCHAR), 'all') AS VARCHAR) AS year, coalesce(o_orderpriority, 'all') AS kind, count(*) AS n FROM orders GROUP BY CUBE (year(o_orderdate), o_orderpriority)")
def year_matrix(spark, d):
    return table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).cube("y", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("year"), F.coalesce("o_orderpriority", F.lit("all")).alias("kind"), "n")


@query("agg37_count_cases_by_party", "SELECT count(DISTINCT o_orderkey) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '00012') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def count_cases_by_party(spark, d):
    party = R.contains_text(table(spark, d, "customer"), ["c_name"], "00012").select("c_custkey")
    return R.between(table(spark, d, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz")).join(party, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.countDistinct("o_orderkey").alias("total"))


@query("agg38_spending_limits", "SELECT user_id, CAST(coalesce(round(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE ts >= TIMESTAMP '2024-01-30'), 2), 0) AS DOUBLE) AS daily, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS monthly, CASE WHEN coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE ts >= TIMESTAMP '2024-01-30'), 0) > 50 THEN 'daily limit' WHEN sum(CAST(value AS DECIMAL(18,4))) > 1000 THEN 'monthly limit' END AS reason FROM events GROUP BY 1")
def spending_limits(spark, d):
    today = F.sum(F.when(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"), _money("value")))
    g = table(spark, d, "events").groupBy("user_id").agg(F.coalesce(today, F.lit(0).cast("decimal(18,4)")).alias("d"), F.sum(_money("value")).alias("m"))
    return g.select("user_id", F.round("d", 2).cast("double").alias("daily"), F.round("m", 2).cast("double").alias("monthly"), F.when(F.col("d") > 50, "daily limit").when(F.col("m") > 1000, "monthly limit").alias("reason"))


@query("snk11_monthly_accumulator", "SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS calls, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS cost FROM events GROUP BY 1")
def monthly_accumulator(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("calls"), _total(_money("value")).alias("cost"))


@query("mth1_annual_claim", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 3 * date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') / 36500.0, 2) AS DOUBLE) AS claim FROM orders")
def annual_claims(spark, d):
    days = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", M.annual_claim(F.col("o_totalprice"), days).cast("double").alias("claim"))


@query("mth2_tier_price", "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,6)) * CASE p_type WHEN 'ECONOMY' THEN 1.30 WHEN 'STANDARD' THEN 1.50 WHEN 'PROMO' THEN 1.40 ELSE 1.00 END, 6) AS DOUBLE) AS price, CASE WHEN p_retailprice >= 1000 THEN 15 WHEN p_retailprice >= 500 THEN 10 WHEN p_retailprice >= 250 THEN 5 ELSE 0 END AS discount, CAST(greatest(1, ceil(p_retailprice * 100)) AS BIGINT) AS credits FROM part")
def tier_prices(spark, d):
    tier = F.when(F.col("p_type") == "ECONOMY", "startup").when(F.col("p_type") == "STANDARD", "business").when(F.col("p_type") == "PROMO", "enterprise").otherwise("free")
    return table(spark, d, "part").select("p_partkey", M.tier_price(F.col("p_retailprice"), tier).cast("double").alias("price"), M.volume_discount(F.col("p_retailprice")).alias("discount"), M.credits(F.col("p_retailprice")).alias("credits"))


@query("mth7_stepped_price", "WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('month', ts), event_type ORDER BY ts, event_id) AS n FROM events) SELECT event_id, n, CASE WHEN n <= 10000 THEN 0.00714 WHEN n <= 20000 THEN 0.00690 WHEN n <= 30000 THEN 0.00667 WHEN n <= 50000 THEN 0.00643 ELSE 0.00238 END::DOUBLE AS price FROM n")
def stepped_prices(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", F.date_trunc("month", "ts").alias("month"))
    return R.numbered(rows, ["month", "event_type"], ["ts", "event_id"]).select("event_id", F.col("position").cast("bigint").alias("n")).withColumn("price", M.step_price(F.col("n")).cast("double"))


@query("mth10_line_amount", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(round(CAST(l_quantity AS BIGINT) * 1.00 / 60, 2) AS DECIMAL(10,2)) * CAST(l_extendedprice AS DECIMAL(12,2)), 2) AS DOUBLE) AS amount FROM lineitem")
def line_amounts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.line_amount(F.col("l_quantity").cast("bigint"), F.col("l_extendedprice")).cast("double").alias("amount"))


@query("dat1_deadlines", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 15 ELSE 30 END AS due FROM orders")
def deadlines(spark, d):
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "crpc").when(F.col("o_orderpriority") == "2-HIGH", "gpc").when(F.col("o_orderpriority") == "3-MEDIUM", "cpc").otherwise("cac")
    act = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "ruling").otherwise("decision")
    return table(spark, d, "orders").select("o_orderkey", M.deadline(F.to_date("o_orderdate"), code, F.lit("appeal"), act).alias("due"))
