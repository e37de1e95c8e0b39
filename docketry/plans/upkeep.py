"""Copies kept in step, rows sorted out as they come in, graphs from many starts, and rules as SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.functions import sql as S
from docketry.operators import graphs as G
from docketry.operators import quarantine as Q
from docketry.operators import relational as R
from docketry.operators import sync as Y
from docketry.plans.registry import query
from docketry.sources import registries
from docketry.sources.tables import shared_folder, table

_COPY = "WITH o AS (SELECT o_orderkey, o_totalprice, CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders), t AS (SELECT o_orderkey, CASE WHEN month(day) = 5 AND o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, day FROM o WHERE NOT (month(day) = 8 AND o_orderkey % 97 = 0) UNION ALL SELECT -o_orderkey, o_totalprice, day FROM o WHERE month(day) = 11 AND o_orderkey % 89 = 0)"


def _two_copies(spark, d):
    """Orders by month, and a copy with changed, missing and further rows; both stored with their digests."""
    ours = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.trunc("o_orderdate", "month").alias("day"))
    changed = F.when((F.month("day") == 5) & (F.col("o_orderkey") % 50 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    fewer = ours.where(~((F.month("day") == 8) & (F.col("o_orderkey") % 97 == 0))).withColumn("o_totalprice", changed)
    more = ours.where((F.month("day") == 11) & (F.col("o_orderkey") % 89 == 0)).withColumn("o_orderkey", -F.col("o_orderkey"))
    paths = [f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}" for _ in range(2)]
    Y.stored(ours, "day", "o_orderkey", paths[0])
    Y.stored(fewer.unionByName(more), "day", "o_orderkey", paths[1])
    return paths


@query("str12_changed_rows", _COPY + " SELECT coalesce(t.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(t.day, o.day) AS day, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN t.o_orderkey IS NULL THEN 'gone' ELSE 'changed' END AS state FROM o FULL JOIN t ON o.o_orderkey = t.o_orderkey WHERE o.o_orderkey IS NULL OR t.o_orderkey IS NULL OR o.o_totalprice <> t.o_totalprice")
def changed_rows(spark, d):
    """What differs between two stored copies, by descent through their digests."""
    return Y.changed_rows(spark, *_two_copies(spark, d), "o_orderkey")


@query("str11_synced_copy", _COPY + " SELECT o_orderkey, o_totalprice, day FROM t")
def synced_copy(spark, d):
    """The first copy after its days that differ were replaced by the second's."""
    ours, theirs = _two_copies(spark, d)
    Y.copy_days(spark, ours, theirs)
    return spark.read.parquet(f"{ours}/rows").select("o_orderkey", "o_totalprice", "day")


_LINE = "c_custkey || ',' || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END || ',' || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END"


def _sorted_out(spark, d):
    nation = F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.col("c_nationkey").cast("string"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_name")), nation)
    rules = {"name": F.col("name") != "", "nation": F.col("nation") < 20}
    return Q.split(table(spark, d, "customer").select(line.alias("line")), "line", "id bigint, name string, nation int", rules)


@query("snk3_bad_rows", f"SELECT {_LINE} AS line, CASE WHEN c_custkey % 7 = 0 THEN 'broken' WHEN c_custkey % 11 = 0 AND c_nationkey >= 20 THEN 'name,nation' WHEN c_custkey % 11 = 0 THEN 'name' ELSE 'nation' END AS reasons FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_nationkey >= 20")
def bad_rows(spark, d):
    return _sorted_out(spark, d).bad.select("line", F.array_join("reasons", ",").alias("reasons"))


@query("snk3_good_rows", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_nationkey < 20")
def good_rows(spark, d):
    return _sorted_out(spark, d).good


_REACH = "WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d0 AS (SELECT 'o' || o_orderkey AS start, 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 150 = 0), d1 AS (SELECT DISTINCT start, b AS node FROM d0 JOIN u ON a = node), d2 AS (SELECT DISTINCT start, b AS node FROM d1 JOIN u ON a = node), n AS (SELECT start, node, min(distance) AS distance FROM (SELECT *, 0 AS distance FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY 1, 2)"


def _reached(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return G.reach(edges, table(spark, d, "orders").where("o_orderkey % 150 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("node")), 2)


@query("grf1_many_starts", _REACH + " SELECT start, node, CAST(distance AS INTEGER) AS distance FROM n")
def many_starts(spark, d):
    """Nodes within two steps of every 150th order, in a graph of orders and parts."""
    return _reached(spark, d)[0]


@query("grf1_edges", _REACH + " SELECT x.start, e.a, e.b FROM e JOIN n x ON x.node = e.a JOIN n y ON y.node = e.b AND y.start = x.start")
def edges(spark, d):
    """The edges inside those neighbourhoods."""
    return _reached(spark, d)[1]


@query("udf1_sql_functions", f"SELECT o_orderkey, CAST(greatest(1, ceil(CAST(o_totalprice AS DECIMAL(18,6)) * 100)) AS BIGINT) AS credits, CAST(round(CAST(o_totalprice AS DECIMAL(18,6)) * (100 + [0, 30, 50, 40, 0][1 + o_orderkey % 5]) / 100, 6) AS DOUBLE) AS price, CASE WHEN o_totalprice >= 1000 THEN 15 WHEN o_totalprice >= 500 THEN 10 WHEN o_totalprice >= 250 THEN 5 ELSE 0 END AS discount, 'INV-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS number FROM orders")
def sql_functions(spark, d):
    """Scalar rules called from SQL."""
    S.register(spark)
    table(spark, d, "orders").createOrReplaceTempView("docketry_orders")
    tiers = "array('free', 'startup', 'business', 'enterprise', 'internal')"
    return spark.sql(f"SELECT o_orderkey, usd_to_credits(o_totalprice) AS credits, CAST(tier_price(o_totalprice, {tiers}[CAST(o_orderkey % 5 AS INT)]) AS DOUBLE) AS price, volume_discount(o_totalprice) AS discount, invoice_number(CAST(o_orderdate AS DATE), o_orderkey) AS number FROM docketry_orders")


@query("udf1_table_functions", "SELECT c_custkey, coalesce(CAST(c_acctbal AS DECIMAL(18,2)), 0) >= 100 AS has_credits, CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) >= 100 THEN 'Sufficient balance' ELSE 'Insufficient credits' END AS reason, CASE WHEN c_acctbal >= 1000 THEN 15 WHEN c_acctbal >= 500 THEN 10 WHEN c_acctbal >= 250 THEN 5 ELSE 0 END AS percent, CAST(CAST(100.50 AS DECIMAL(18,2)) - round(CAST(100.50 AS DECIMAL(18,2)) * CASE WHEN c_acctbal >= 1000 THEN 15 WHEN c_acctbal >= 500 THEN 10 WHEN c_acctbal >= 250 THEN 5 ELSE 0 END / 100, 2) AS DOUBLE) AS due FROM customer")
def table_functions(spark, d):
    """Table rules, joined to laterally for every customer."""
    S.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("docketry_customer")
    return spark.sql("SELECT c_custkey, b.has_credits, b.reason, p.percent, CAST(p.due AS DOUBLE) AS due FROM docketry_customer, LATERAL check_balance(c_acctbal, 100) b, LATERAL discounted(100.50, c_acctbal) p")


@query("udf5_registry_functions", "SELECT c_custkey::VARCHAR AS id, c_name AS name, md5(c_name) AS name_hash, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'ok' END AS state FROM customer")
def registry_functions(spark, d):
    """A registry whose configuration has functions for columns, read from files that Spark wrote from a table."""
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("NAME"), F.col("c_acctbal").alias("BALANCE")).write.option("header", True).option("sep", ";").csv(path)
    registry = registries.Registry("customers", ("id",), {"id": "ID", "name": "NAME", "balance": "BALANCE"}, encoding="utf-8", computed={"name_hash": lambda r: F.md5(r["name"]), "state": lambda r: F.when(r["balance"].cast("double") < 0, "debtor").otherwise("ok")})
    return registries.read_delimited(spark, path, registry, multi_line=False).drop("balance")


@query("jn10_whole_names", "WITH t AS (SELECT s_suppkey, lower('In the matter of ' || s_name || ' against ' || c_name || ' and ' || upper(c_mktsegment)) AS text FROM supplier JOIN customer ON c_custkey = s_suppkey * 3) SELECT s_suppkey, c.c_custkey FROM t JOIN customer c ON contains(t.text, lower(c.c_name)) AND c.c_name <> ''")
def whole_names(spark, d):
    """Conflicts: parties whose whole names stand anywhere in a matter's text, in any case; a name may begin another."""
    suppliers, customers = table(spark, d, "supplier"), table(spark, d, "customer")
    text = F.concat(F.lit("In the matter of "), "s_name", F.lit(" against "), "c_name", F.lit(" and "), F.upper("c_mktsegment"))
    matters = suppliers.join(customers, F.col("c_custkey") == F.col("s_suppkey") * 3).select("s_suppkey", text.alias("text"))
    return R.containing(matters, "text", customers.select("c_custkey", "c_name"), "c_name").select("s_suppkey", "c_custkey")
