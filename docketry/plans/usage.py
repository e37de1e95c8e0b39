"""Costs, activity and system reports; events stand for calls, users for accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import money as M
from docketry.operators import relational as R
from docketry.plans.registry import query
from docketry.sources.tables import table

AS_OF = "2024-01-31"


def _cost(column="value"):
    return F.col(column).cast("decimal(18,4)")


def _sum(column, test=None):
    chosen = column if test is None else F.when(test, column)
    return F.round(F.coalesce(F.sum(chosen), F.lit(0)), 2).cast("double")


def _since(days: int):
    return F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


_C = "CAST(value AS DECIMAL(18,4))"


@query("agg4_scorecard_by_period", f"SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, CAST(round(coalesce(sum({_C}) FILTER (ts >= TIMESTAMP '2024-01-30'), 0), 2) AS DOUBLE) AS cost_today, count(*) AS month, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-24') AS active_users, count(*) FILTER (event_type = 'error') AS failed, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS low_balance FROM events")
def scorecard(spark, d):
    low = table(spark, d, "customer").where("c_acctbal < 0").agg(F.count("*").alias("low_balance"))
    calls = table(spark, d, "events").agg(F.count_if(_since(1)).alias("today"), _sum(_cost(), _since(1)).alias("cost_today"), F.count("*").alias("month"), F.countDistinct(F.when(_since(7), F.col("user_id"))).alias("active_users"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return calls.crossJoin(F.broadcast(low))  # one row each


@query("agg7_usage_by_tool_by_period", f"WITH t AS (SELECT event_type AS tool, count(*) AS requests, CAST(round(sum({_C}), 2) AS DOUBLE) AS cost FROM events GROUP BY 1), p AS (SELECT *, round(requests * 100.0 / sum(requests) OVER (), 2) AS share FROM t) SELECT 'count' AS list, * FROM (SELECT * FROM p ORDER BY requests DESC, tool LIMIT 10) UNION ALL SELECT 'cost', * FROM (SELECT * FROM p ORDER BY cost DESC, tool LIMIT 8)")
def usage_by_tool(spark, d):
    tools = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("requests"), _sum(_cost()).alias("cost"))
    total = F.broadcast(table(spark, d, "events").agg(F.count("*").alias("total")))  # one row
    shared = tools.crossJoin(total).select("tool", "requests", "cost", M.percent(F.col("requests"), F.col("total")).alias("share"))
    top = lambda name, by, n: shared.orderBy(F.desc(by), "tool").limit(n).select(F.lit(name).alias("list"), "*")
    return top("count", "requests", 10).unionByName(top("cost", "cost", 8))


@query("agg10_daily_by_provider", f"SELECT CAST(ts AS DATE) AS day, CAST(round(coalesce(sum({_C}) FILTER (event_type = 'view'), 0), 2) AS DOUBLE) AS view, CAST(round(coalesce(sum({_C}) FILTER (event_type = 'click'), 0), 2) AS DOUBLE) AS click, CAST(round(coalesce(sum({_C}) FILTER (event_type = 'error'), 0), 2) AS DOUBLE) AS error FROM events GROUP BY 1")
def daily_by_provider(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(*(_sum(_cost(), F.col("event_type") == p).alias(p) for p in ("view", "click", "error")))


@query("agg14_recent_by_kind", "SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-07-01') AS recent, min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def recent_by_kind(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz")).alias("recent"), F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"))


@query("agg26_prompt_metrics", f"SELECT event_type AS intent, count(*) AS runs, count(*) FILTER (value >= 10) AS done, round(count(*) FILTER (value >= 10) * 100.0 / nullif(count(*), 0), 2) AS success, CAST(round(avg({_C}), 4) AS DOUBLE) AS mean, count(*) FILTER (value < 2) AS retried FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def prompt_metrics(spark, d):
    runs = R.period(table(spark, d, "events"), "ts", AS_OF, 30)
    done = F.count_if(F.col("value") >= 10)
    return runs.groupBy(F.col("event_type").alias("intent")).agg(F.count("*").alias("runs"), done.alias("done"), M.percent(done, F.count("*")).alias("success"), F.round(F.avg(_cost()), 4).cast("double").alias("mean"), F.count_if(F.col("value") < 2).alias("retried"))


@query("agg27_admin_activity", "SELECT c_name AS admin, event_type AS action, count(*) AS n, max(ts) AS last FROM events JOIN customer ON user_id = c_custkey WHERE ts >= TIMESTAMP '2024-01-01' AND c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def admin_activity(spark, d):
    admins = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("admin"))
    return R.period(table(spark, d, "events"), "ts", AS_OF, 30).join(admins, "user_id").groupBy("admin", F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("agg29_trending", f"SELECT p_partkey, count(l_orderkey) AS uses, CAST(round(avg(l_quantity), 4) AS DOUBLE) AS rating FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1")
def trending(spark, d):
    """Uses and mean rating of every template over a recent stretch, those without a use too."""
    used = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"), F.round(F.avg("l_quantity"), 4).alias("rating"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("uses", F.lit(0)).alias("uses"), "rating")


@query("agg30_top_categories", "SELECT p_type AS category, p_brand AS intent, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15")
def top_categories(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("intent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "intent").limit(15)


@query("agg40_upload_sessions", "SELECT user_id, count(*) AS sessions, count(*) FILTER (event_type IN ('view', 'click')) AS active, count(*) FILTER (event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-30') AS stuck, count(*) FILTER (event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-30' AND CAST(json_extract_string(props, '$.k') AS INT) % 5 <= 3) AS recoverable FROM events GROUP BY 1")
def upload_sessions(spark, d):
    """Sessions that run, those that have not moved for a day, and of them those with retries left."""
    runs = F.col("event_type").isin("view", "click")
    stuck = runs & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))
    left = F.get_json_object("props", "$.k").cast("int") % 5 <= 3
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(runs).alias("active"), F.count_if(stuck).alias("stuck"), F.count_if(stuck & left).alias("recoverable"))


@query("agg41_provider_totals", f"WITH e AS (SELECT user_id % 3 AS provider, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, {_C} AS cost FROM events) SELECT provider, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(cost), 2) AS DOUBLE) AS cost FROM e GROUP BY 1")
def provider_totals(spark, d):
    """Totals over calls that each row holds as a JSON array; rows without calls or with other JSON fall out."""
    calls = F.to_json(F.array(F.struct((F.col("user_id") % 3).alias("provider"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("value").alias("cost"))))
    each = table(spark, d, "events").select(F.inline(F.from_json(calls, "array<struct<provider:bigint,tokens:bigint,cost:decimal(18,4)>>")))
    return each.groupBy("provider").agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), _sum(F.col("cost")).alias("cost"))


@query("agg42_template_dashboard", "SELECT count(*) FILTER (p_size > 10) AS active, CAST(round(avg(p_size), 4) AS DOUBLE) AS quality, CAST(round(avg(p_retailprice) FILTER (p_size > 10), 4) AS DOUBLE) AS price, (SELECT count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') AS uses FROM part")
def template_dashboard(spark, d):
    uses = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).agg(F.count("*").alias("uses"))
    live = F.col("p_size") > 10
    return table(spark, d, "part").agg(F.count_if(live).alias("active"), F.round(F.avg("p_size"), 4).alias("quality"), F.round(F.avg(F.when(live, F.col("p_retailprice"))), 4).alias("price")).crossJoin(F.broadcast(uses))  # one row each


@query("agg44_import_statistics", "SELECT 'total' AS what, 'all' AS name, count(*) AS n FROM customer UNION ALL SELECT 'regions', 'distinct', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'terminated', 'all', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT * FROM (SELECT 'region', n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 ORDER BY n DESC, n_name LIMIT 10)")
def import_statistics(spark, d):
    customers = table(spark, d, "customer")
    one = lambda what, name, df, n: df.agg(n.alias("n")).select(F.lit(what).alias("what"), F.lit(name).alias("name"), "n")
    top = customers.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    parts = [one("total", "all", customers, F.count("*")), one("regions", "distinct", customers, F.countDistinct("c_nationkey")), one("terminated", "all", customers.where("c_acctbal < 0"), F.count("*"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(top.select(F.lit("region").alias("what"), "name", "n"))


@query("agg45_team_usage", f"SELECT c_nationkey AS team, count(DISTINCT user_id) AS active, count(*) AS requests, CAST(round(sum({_C}), 2) AS DOUBLE) AS cost FROM events JOIN customer ON user_id = c_custkey WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def team_usage(spark, d):
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("team"))
    return R.period(table(spark, d, "events"), "ts", AS_OF, 30).join(members, "user_id").groupBy("team").agg(F.countDistinct("user_id").alias("active"), F.count("*").alias("requests"), _sum(_cost()).alias("cost"))


@query("agg9_cost_breakdown", f"WITH e AS (SELECT 'a' AS provider, event_type AS model, {_C} AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events WHERE event_type <> 'view' UNION ALL SELECT 'b', 'v' || user_id % 4, {_C} * 2, 1 FROM events WHERE event_type = 'view') SELECT provider, model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(cost), 2) AS DOUBLE) AS cost FROM e GROUP BY 1, 2")
def cost_breakdown(spark, d):
    """Two providers' calls with their own models, one union, by provider and model."""
    events = table(spark, d, "events")
    a = events.where("event_type <> 'view'").select(F.lit("a").alias("provider"), F.col("event_type").alias("model"), _cost().alias("cost"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    b = events.where("event_type = 'view'").select(F.lit("b").alias("provider"), F.concat(F.lit("v"), F.col("user_id") % 4).alias("model"), (_cost() * 2).cast("decimal(18,4)").alias("cost"), F.lit(1).cast("bigint").alias("tokens"))
    return a.unionByName(b).groupBy("provider", "model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), _sum(F.col("cost")).alias("cost"))


@query("mth4_advised_tiers", f"WITH m AS (SELECT user_id, CAST(round(sum({_C}), 2) AS DOUBLE) AS spent FROM events GROUP BY 1 UNION ALL VALUES (-1, 0.0), (-2, 100.0), (-3, 500.0)) SELECT user_id, CASE WHEN spent = 0 THEN 'free' WHEN spent < 100 THEN 'startup' WHEN spent < 500 THEN 'business' ELSE 'enterprise' END AS tier FROM m")
def advised_tiers(spark, d):
    spent = table(spark, d, "events").groupBy("user_id").agg(_sum(_cost()).alias("spent"))
    edge = spark.createDataFrame([(-1, 0.0), (-2, 100.0), (-3, 500.0)], "user_id bigint, spent double")
    return spent.unionByName(edge).select("user_id", M.advised_tier(F.col("spent")).alias("tier"))


@query("mth5_revenue", "WITH t(tier, markup) AS (VALUES ('free', 0), ('startup', 30), ('business', 50), ('enterprise', 40)) SELECT p_partkey, tier, CAST(CAST(p_retailprice AS DECIMAL(18,6)) * 30 AS DOUBLE) AS cost, CAST(round(CAST(p_retailprice AS DECIMAL(18,6)) * 30 * (100 + markup) / 100.0, 6) AS DOUBLE) AS price, CAST(round(CAST(p_retailprice AS DECIMAL(18,6)) * 30 * markup / 100.0, 6) AS DOUBLE) AS profit, markup AS margin FROM part CROSS JOIN t")
def revenue(spark, d):
    tiers = F.explode(F.array(*map(F.lit, ("free", "startup", "business", "enterprise"))))
    each = table(spark, d, "part").select("p_partkey", "p_retailprice", tiers.alias("tier"))
    return each.select("p_partkey", "tier", M.monthly_revenue(F.col("p_retailprice"), F.col("tier")).alias("r")).select("p_partkey", "tier", "r.cost", "r.price", "r.profit", "r.margin")


@query("mth8_token_cost", "SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * CASE event_type WHEN 'view' THEN 0.00000006 WHEN 'click' THEN 0.00000002 ELSE 0.00000012 END AS DOUBLE) AS cost FROM events")
def token_costs(spark, d):
    model = F.when(F.col("event_type") == "view", "voyage-3").when(F.col("event_type") == "click", "voyage-3-lite").otherwise("voyage-law-2")
    return table(spark, d, "events").select("event_id", M.token_cost(model, F.get_json_object("props", "$.k")).cast("double").alias("cost"))


@query("mth9_cost_estimate", "WITH q AS (SELECT doc_id, doc_id % 3 AS b, doc_id % 2 AS t, length(text) AS n FROM documents), c AS (SELECT doc_id, [1000, 3000, 5000][b + 1] + n // 4 AS tokens, [1, 2, 5][b + 1] + t AS registry_calls, 5 * t AS search_calls FROM q) SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(registry_calls AS INT) AS registry_calls, CAST(search_calls AS INT) AS search_calls, round(tokens / 1000.0 * 0.002 + registry_calls * 0.00690 + search_calls * 0.00714, 6)::DOUBLE AS total FROM c")
def cost_estimates(spark, d):
    budget = F.element_at(F.array(*map(F.lit, ("quick", "standard", "deep"))), (F.col("doc_id") % 3 + 1).cast("int"))
    tool = F.when(F.col("doc_id") % 2 == 1, "search_decisions").otherwise("get_document")
    estimate = M.cost_estimate(tool, F.length("text"), budget, F.lit(15_000), F.lit(10))
    return table(spark, d, "documents").select("doc_id", estimate.alias("e")).select("doc_id", F.col("e.tokens").cast("bigint").alias("tokens"), F.col("e.registry_calls").cast("int").alias("registry_calls"), "e.search_calls", "e.total")


@query("mth11_timer_minutes", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice / 60) AS INT) AS minutes FROM lineitem")
def timer_minutes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.timer_minutes(F.col("l_extendedprice")).alias("minutes"))


@query("jn4_dimension_chain", "SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, n_name, r_name, s_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def dimension_chain(spark, d):
    t = lambda name: table(spark, d, name)
    chained = t("lineitem")
    for name, fact, key in (("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"), ("supplier", "l_suppkey", "s_suppkey")):
        chained = chained.join(t(name), F.col(fact) == F.col(key), "left")
    return chained.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "n_name", "r_name", "s_name")


@query("jn14_children_of_entity", "WITH o AS (SELECT o_custkey AS k, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1), e AS (SELECT user_id AS k, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS events FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1) SELECT c_custkey, c_name, coalesce(orders, '') AS orders, coalesce(events, '') AS events FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey")
def children_of_entity(spark, d):
    """An entity with its children of several tables, each gathered by key before the join."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    kinds = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey"), "event_type").agg(F.count("*").alias("n"))
    events = kinds.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", "n"))).alias("e"))
    met = table(spark, d, "customer").join(orders, "c_custkey", "left").join(events, "c_custkey", "left")
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return met.select("c_custkey", "c_name", shown("o").alias("orders"), shown("e").alias("events"))


@query("snk6_entity_rules", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'name,edrpou' WHEN c_custkey % 5 = 0 THEN 'edrpou' ELSE '' END AS errors, CASE WHEN c_acctbal < 0 THEN 'capital' ELSE '' END AS warnings FROM customer")
def entity_rules(spark, d):
    """A record and a name are needed and the code has eight digits; an odd capital is a warning."""
    rows = table(spark, d, "customer").withColumn("name", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")))
    rows = rows.withColumn("edrpou", F.when((F.col("c_custkey") % 5 == 0) | (F.col("c_custkey") % 7 == 0), "12x").otherwise(F.lpad(F.col("c_custkey").cast("string"), 8, "0")))
    judged = R.validated(rows, {"record": F.col("c_custkey").isNotNull(), "name": F.col("name") != "", "edrpou": F.col("edrpou").rlike(r"^\d{8}$")})
    return judged.select("c_custkey", F.array_join("errors", ",").alias("errors"), F.when(F.col("c_acctbal") < 0, "capital").otherwise("").alias("warnings"))


_META = """WITH src AS (SELECT event_id, event_type, props AS a, CASE event_id % 4 WHEN 0 THEN '{"n":' || event_id || ',"big":{"a":[1,null,"x"],"on":true}}' WHEN 1 THEN '{"k":null,"rate":0.25}' WHEN 2 THEN '{"k":"7"}' END AS b FROM events)"""


@query("snk7_merged_metadata", _META + """ SELECT event_id, title, '{' || string_agg('"' || k || '":' || coalesce(v, 'null'), ',' ORDER BY k) || '}' AS metadata FROM (SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'new' END, event_type) AS title, k, CAST(json_extract(CASE WHEN list_contains(json_keys(coalesce(b, '{}')), k) THEN b ELSE a END, '$.' || k) AS VARCHAR) AS v FROM (SELECT *, unnest(list_distinct(list_concat(json_keys(a), json_keys(coalesce(b, '{}'))))) AS k FROM src)) GROUP BY event_id, title""")
def merged_metadata(spark, d):
    """New values that are not null win; JSON objects are merged, the new one's keys win, and values keep their types."""
    rows = table(spark, d, "events")
    old = rows.select("event_id", F.col("event_type").alias("title"), F.col("props").alias("metadata"))
    asked = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit(',"big":{"a":[1,null,"x"],"on":true}}'))).when(F.col("event_id") % 4 == 1, '{"k":null,"rate":0.25}').when(F.col("event_id") % 4 == 2, '{"k":"7"}')
    new = rows.select("event_id", F.when(F.col("event_id") % 3 == 0, "new").alias("title"), asked.alias("metadata"))
    return R.upsert(old, new, ["event_id"], keep_if_null=("title",), merge=("metadata",))


@query("srt4_limited_arms", "SELECT kind, id FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer ORDER BY c_custkey DESC LIMIT 15) UNION ALL SELECT kind, id FROM (SELECT 'supplier' AS kind, s_suppkey AS id FROM supplier ORDER BY s_suppkey DESC LIMIT 5)")
def limited_arms(spark, d):
    """Each arm gives 15 rows at most, arms in order, 20 rows in all."""
    arm = lambda i, kind, name, key: table(spark, d, name).select(F.lit(i).alias("arm"), F.lit(kind).alias("kind"), F.col(key).alias("id")).orderBy(F.desc("id")).limit(15)
    return arm(0, "customer", "customer", "c_custkey").unionByName(arm(1, "supplier", "supplier", "s_suppkey")).orderBy("arm", F.desc("id")).limit(20).drop("arm")


@query("udf4_billing_view", f"SELECT c_custkey, count(event_id) AS calls, CAST(round(coalesce(sum({_C}), 0), 2) AS DOUBLE) AS spent, CAST(round(CAST(c_acctbal AS DECIMAL(18,4)) - coalesce(sum({_C}), 0), 2) AS DOUBLE) AS balance FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey, c_acctbal")
def billing_view(spark, d):
    spent = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("calls"), F.sum(_cost()).alias("s"))
    met = table(spark, d, "customer").join(spent, "c_custkey", "left")
    zero = F.coalesce("s", F.lit(0).cast("decimal(18,4)"))
    return met.select("c_custkey", F.coalesce("calls", F.lit(0)).alias("calls"), F.round(zero, 2).cast("double").alias("spent"), F.round(_cost("c_acctbal") - zero, 2).cast("double").alias("balance"))
