"""Ledgers, totals kept by deltas, hash chains and counters over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import counters as K
from docketry.operators import deltas as D
from docketry.operators import ledger as G
from docketry.operators import relational as R
from docketry.plans.registry import ORACLES, query
from docketry.sources.tables import table, written

_AMOUNT = "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * round(value * 100) AS BIGINT)"
_MOVES = f"WITH RECURSIVE r AS (SELECT user_id, event_id, {_AMOUNT} AS amount, CASE WHEN user_id % 3 = 0 THEN 5000 ELSE 0 END AS opening, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, n, event_id, amount, opening AS b, CASE WHEN opening + least(amount, 0) < 0 THEN opening ELSE opening + amount END AS a FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.event_id, r.amount, f.a, CASE WHEN f.a + least(r.amount, 0) < 0 THEN f.a ELSE f.a + r.amount END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)"


def _moved(spark, d):
    events = table(spark, d, "events")
    amount = F.when(F.col("event_type") == "purchase", 1).otherwise(-1) * F.round(F.col("value") * 100).cast("bigint")
    rows = events.select("user_id", "event_id", "ts", amount.alias("amount"))
    opening = events.select("user_id").distinct().where("user_id % 3 = 0").withColumn("balance", F.lit(5000))
    return G.movements(rows, "user_id", [F.asc("ts"), F.asc("event_id")], F.col("amount"), opening)


@query("udf2_credit_movements", _MOVES + " SELECT event_id, NOT (b + least(amount, 0) < 0) AS success, CAST(b AS BIGINT) AS balance_before, CAST(a AS BIGINT) AS balance_after FROM f")
def credit_movements(spark, d):
    """Purchases add, other events spend; what would overdraw is refused. A third of the users begin with 50."""
    return _moved(spark, d).select("event_id", "success", "balance_before", "balance_after")


@query("udf2_credit_totals", _MOVES + ", s AS (SELECT *, NOT (b + least(amount, 0) < 0) AS ok FROM f) SELECT user_id, CAST(arg_max(a, n) AS BIGINT) AS balance, CAST(coalesce(sum(amount) FILTER (ok AND amount > 0), 0) AS BIGINT) AS earned, CAST(coalesce(-sum(amount) FILTER (ok AND amount < 0), 0) AS BIGINT) AS spent, count(*) FILTER (NOT ok) AS refused FROM s GROUP BY user_id")
def credit_totals(spark, d):
    return G.totals(_moved(spark, d), "user_id", F.struct("ts", "event_id"), F.col("amount"))


@query("win4_hash_chain_append", "WITH RECURSIVE r AS (SELECT event_id, user_id || '|' || event_type AS content, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), f AS (SELECT n, event_id, 'GENESIS' AS previous, sha256(content || 'GENESIS') AS current FROM r WHERE n = 1 UNION ALL SELECT r.n, r.event_id, f.current, sha256(r.content || f.current) FROM f JOIN r ON r.n = f.n + 1) SELECT event_id, previous, current FROM f")
def hash_chain_append(spark, d):
    """Every event in one chain: its hash holds the hash of the one before."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return R.chained(events, ["ts", "event_id"], F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).select("event_id", "previous", "current")


@query("str14_kept_totals", ORACLES["agg32_invoice_totals"])
def kept_totals(spark, d):
    """The invoice totals from a log of changes: lines come with a wrong price first, some are deleted, and the log is merged in three batches of no order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    one = F.col("l_linenumber")
    first = lines.withColumn("l_extendedprice", F.when(one % 3 == 0, F.col("l_extendedprice") + 100).otherwise(F.col("l_extendedprice"))).unionByName(lines.where(one == 1).withColumn("l_linenumber", one + 100))
    log = first.withColumn("sign", F.lit(1)).unionByName(D.changes(first, lines))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    paid = F.when(F.col("l_returnflag") != "R", price * F.lit("1.5").cast("decimal(2,1)")).otherwise(0)
    rows = written(D.contributions(log, F.col("l_orderkey"), price, paid, F.col("l_linestatus") == "O").withColumn("_batch", F.pmod(F.xxhash64("invoice", "subtotal", "lines"), F.lit(3))))
    state = None
    for batch in range(3):
        more = rows.where(F.col("_batch") == batch).drop("_batch")
        state = written(D.merged(more) if state is None else D.merged(state, more))
    kept = D.totals(state)
    return kept.select("invoice", *(F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total", "paid")), "status")


_SAMPLES = "SELECT event_type, ts, CAST(((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) * 3) % 100 AS DOUBLE) AS value FROM events"


@query("str9_counter_rates", f"WITH s AS ({_SAMPLES}), g AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN value >= b THEN value - b ELSE value END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, value) AS b FROM s)), w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, epoch(min(ts)) AS x, epoch(max(ts)) AS y, arg_min(value, ts) AS v, sum(step) - coalesce(arg_min_null(step, ts), 0) AS grown FROM g GROUP BY 1, 2 HAVING count(*) > 1), m AS (SELECT *, epoch(start) AS s, epoch(start) + 21600 AS e, y - x AS span, (y - x) / (n - 1) AS mean FROM w WHERE y > x), p AS (SELECT *, CASE WHEN x - s >= mean * 1.1 THEN mean / 2 ELSE x - s END AS da, CASE WHEN e - y >= mean * 1.1 THEN mean / 2 ELSE e - y END AS db FROM m), i AS (SELECT *, grown * (span + CASE WHEN grown > 0 THEN least(da, span * v / grown) ELSE da END + db) / span AS increase FROM p) SELECT event_type, start, round(increase, 6) AS increase, round(increase / 21600, 9) AS rate FROM i")
def counter_rates(spark, d):
    """Counters of events by type, three a time, that fall back when they pass a hundred; rates in windows of six hours."""
    numbered = R.numbered(table(spark, d, "events").select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"])
    samples = numbered.select("event_type", "ts", ((F.col("position") * 3) % 100).cast("double").alias("value"))
    found = K.rates(samples, ["event_type"], "6 hours")
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.round("increase", 6).alias("increase"), F.round("rate", 9).alias("rate"))


_BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0]



@query("str9_histogram_quantiles", "WITH b(le, k) AS (VALUES (1.0::DOUBLE, 1), (2.5, 2), (5.0, 3), (10.0, 4), (25.0, 5), (50.0, 6), ('inf'::DOUBLE, 7)), h AS (SELECT event_type, k, le, count(*) FILTER (value <= le)::DOUBLE AS n FROM events CROSS JOIN b GROUP BY 1, 2, 3), q(name, q) AS (VALUES ('p50', 0.5), ('p95', 0.95), ('p99', 0.99)), r AS (SELECT h.event_type, name, q * max(n) FILTER (k = 7) OVER (PARTITION BY h.event_type, name) AS rank, k, le, n, lag(le, 1, 0.0) OVER (PARTITION BY h.event_type, name ORDER BY k) AS low, lag(n, 1, 0.0) OVER (PARTITION BY h.event_type, name ORDER BY k) AS under FROM h CROSS JOIN q), a AS (SELECT event_type, name, k, CASE WHEN k = 7 THEN low ELSE low + (le - low) * (rank - under) / nullif(n - under, 0) END AS v FROM r WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type, name ORDER BY k) = 1) SELECT event_type, round(max(v) FILTER (name = 'p50'), 6) AS p50, round(max(v) FILTER (name = 'p95'), 6) AS p95, round(max(v) FILTER (name = 'p99'), 6) AS p99 FROM a GROUP BY 1")
def histogram_quantiles(spark, d):
    """Histograms of each day and type, added up by type."""
    days = K.bucketed(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", _BOUNDS)
    whole = K.added(days, ["event_type"])
    return whole.select("event_type", *(F.round(K.quantile(F.col("buckets"), q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))
