"""Folds, ledgers, deltas, counters, syncing, sorting out and many starts against plain Python."""

import collections
import datetime
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.operators import counters as K
from docketry.operators import deltas as D
from docketry.operators import folds
from docketry.operators import graphs as G
from docketry.operators import ledger as L
from docketry.operators import quarantine as Q
from docketry.operators import relational as R
from docketry.operators import sync as Y


def judged(moves):
    now, out = 0, {}
    for i, amount in moves:
        before = now
        ok = amount is not None and before + min(amount, 0) >= 0
        now = before + amount if ok else before
        out[i] = (ok, before, now)
    return out


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_movements(spark, partitions):
    """A hot user over many partitions, users of one row, null users and amounts."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        r = random.Random(partitions)
        rows = [(i, "hot" if i % 3 else r.choice(["a", "b", None, f"u{i}"]), r.choice([None, 5, 20, -7, -30, 0])) for i in range(900)]
        got = {x.i: (x.success, x.balance_before, x.balance_after) for x in L.movements(spark.createDataFrame(rows, "i bigint, user string, amount bigint"), "user", [F.desc("i")], F.col("amount")).collect()}
        by = collections.defaultdict(list)
        for i, user, amount in sorted(rows, reverse=True):
            by[user].append((i, amount))
        assert got == {i: v for moves in by.values() for i, v in judged(moves).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chain_and_budget(spark):
    rows = [(i, None if i == 5 else f"text {i}") for i in range(300)]
    got = R.chained(spark.createDataFrame(rows, "i int, t string").repartition(5), ["i"], F.col("t"), "SEED").orderBy("i").collect()
    last = "SEED"
    for (_, text), x in zip(rows, got):
        assert x.previous == last
        last = hashlib.sha256(((text or "") + last).encode()).hexdigest()
        assert x.current == last
    assert R.check_chain(R.chained(spark.createDataFrame(rows[6:], "i int, t string"), ["i"], F.col("t")), ["i"], F.col("t"), "previous", "current").first().valid is False  # its hashes join in the other order
    assert folds.folded(spark.createDataFrame([], "i int"), [], [F.col("i")], [F.col("i")], lambda s, v: (s, v[0]), 0, "bigint", "x", "int").collect() == []


def test_ledger_stream(spark, tmp_path):
    """Movements that arrive out of order within the bound are judged in the order of their times, each once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    from docketry.streaming.ledger import ledger

    start, r = datetime.datetime(2024, 1, 1), random.Random(5)
    moves = [(i, i % 4, r.choice([9, 4, -6, -11])) for i in range(60)]
    late = [*range(60)]
    for k in range(0, 60, 6):
        part = late[k : k + 6]
        r.shuffle(part)
        late[k : k + 6] = part
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("user_id bigint, id bigint, amount bigint, ts timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = ledger(stream, "10 minutes").writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for k in [*range(0, 60, 20), 99]:
            ids = late[k : k + 20] if k < 99 else []
            rows = [{"user_id": moves[i][1], "id": i, "amount": moves[i][2], "ts": (start + datetime.timedelta(minutes=i)).isoformat()} for i in ids]
            rows += [{"user_id": 77, "id": 1000, "amount": 1, "ts": (start + datetime.timedelta(hours=9)).isoformat()}] if k == 99 else []
            (tmp_path / "in" / f"{k:03}.json").write_text("\n".join(map(json.dumps, rows)))
            query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {x.id: (x.success, x.balance_before, x.balance_after) for x in spark.table("ledger").where("id < 1000").collect()}
    wanted = {}
    for user in range(4):
        wanted |= judged([(i, amount) for i, u, amount in moves if u == user])
    assert got == wanted


def test_deltas(spark):
    """Inserts, updates and deletes in any batches give the totals of what is left; repeated and null rows count."""
    r = random.Random(3)
    schema = "invoice string, price decimal(18,2), paid decimal(18,2), open boolean"
    make = lambda: (r.choice("abcd"), __import__("decimal").Decimal(r.randint(1, 400)) / 4, __import__("decimal").Decimal(r.randint(0, 90)), r.random() < 0.5)
    first = [make() for _ in range(60)] + [("a", None, None, None)]
    second = first[10:40] + [make() for _ in range(20)] + [first[12]]
    frames = [spark.createDataFrame(x, schema) for x in (first, second)]
    states = lambda df: D.contributions(df, F.col("invoice"), F.coalesce("price", F.lit(0)), F.coalesce("paid", F.lit(0)), F.coalesce("open", F.lit(False)))
    signed = D.changes(*frames)
    kept = D.merged(D.merged(states(signed)), states(frames[0].withColumn("sign", F.lit(1))))
    whole = D.merged(states(frames[1].withColumn("sign", F.lit(1))))
    assert sorted(D.totals(kept).collect()) == sorted(D.totals(whole).collect()) and kept.count() == len({x[0] for x in second})
    assert D.changes(frames[0], frames[0]).count() == 0
    gone = D.merged(whole, states(D.changes(frames[1], frames[1].limit(0))))
    assert gone.count() == 0


def test_counter_steps_and_rates(spark):
    """A reset counts what the counter has since; days meet; the ends of a window are filled as monitoring systems do."""
    day = datetime.datetime(2024, 1, 1, 23, 58)
    values = [10, 20, 25, 3, 8, 8, 1]
    rows = [("a", day + datetime.timedelta(seconds=30 * i), float(v)) for i, v in enumerate(values)] + [("b", day, 5.0)]
    frame = spark.createDataFrame(rows, "s string, ts timestamp_ntz, value double")
    got = [x.step for x in K.steps(frame, ["s"]).where("s = 'a'").orderBy("ts").collect()]
    assert got == [None, 10, 5, 3, 5, 0, 1]
    first = K.rates(frame, ["s"], "2 minutes").where("s = 'a'").orderBy("start").collect()[0]
    # 23:58:00 to 23:59:30: 18 in 90 s, the end is 30 s away, below 1.1 x 30: 120 s in all; the start has no gap
    assert first.increase == pytest.approx(18 * 120 / 90) and first.rate == pytest.approx(18 / 90)
    assert K.rates(frame, ["s"], "2 minutes").where("s = 'b'").count() == 0


def test_histograms(spark):
    values = [0.5, 0.7, 1.5, 3.0, 3.5, 9.0, 100.0]
    frame = spark.createDataFrame([("x", i % 2, v) for i, v in enumerate(values)] + [("y", 0, None), ("z", 0, 500.0)], "k string, part int, value double")
    whole = K.bucketed(frame, ["k"], "value", [1, 2, 4, 10])
    parts = K.added(K.bucketed(frame, ["k", "part"], "value", [1, 2, 4, 10]), ["k"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select("k", "buckets").collect()))
    got = {x.k: x for x in whole.select("k", *(K.quantile(F.col("buckets"), q).alias(f"q{int(100 * q)}") for q in (0.2, 0.5, 0.99))).collect()}
    assert got["x"].q20 == pytest.approx(1.4 / 2) and got["x"].q50 == pytest.approx(2 + 2 * 0.5 / 2) and got["x"].q99 == 10 and got["y"].q50 is None and got["z"].q50 == 10


def test_sync(spark, tmp_path):
    """Three changed days are found and only their files read; copying them makes the copies equal, and again does nothing."""
    base = datetime.date(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(days=i % 40), f"v{i}" if i % 9 else None) for i in range(800)] + [(5000, None, "no day")]
    theirs = [(i, d, "new" if i == 41 else v) for i, d, v in rows if i != 125] + [(9000, base + datetime.timedelta(days=7), None)]
    for name, data in (("a", rows), ("b", theirs), ("c", theirs[::-1])):
        Y.stored(spark.createDataFrame(data, "id bigint, day date, v string").repartition(3), "day", "id", f"{tmp_path}/{name}")
    a, b, c = (f"{tmp_path}/{n}" for n in "abc")
    days = [base + datetime.timedelta(days=x) for x in (1, 5, 7)]
    assert Y.changed_days(spark, b, c) == [] and Y.changed_days(spark, a, b) == days
    found = Y.changed_rows(spark, a, b, "id")
    assert sorted((r.id, r.day, r.state) for r in found.collect()) == [(41, days[0], "changed"), (125, days[1], "gone"), (9000, days[2], "new")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*_day#\d+ IN \(" + ",".join(map(str, days)), plan)) >= 2  # of both sides; a plan that ran is printed twice
    assert Y.copy_days(spark, a, b) == days and Y.copy_days(spark, a, b) == []
    read = lambda p: sorted(map(str, spark.read.parquet(f"{p}/rows").select("id", "v", "_day").collect()))
    assert read(a) == read(b)
    Y.stored(spark.createDataFrame(rows[:3], "id bigint, day date, v string"), "day", "id", f"{tmp_path}/few")
    Y.copy_days(spark, a, f"{tmp_path}/few")
    assert read(a) == read(f"{tmp_path}/few")


def test_batches_run_once(spark, tmp_path):
    ledger, runs = Y.Batches(spark, f"{tmp_path}/ledger"), []

    def work():
        runs.append(1)
        return spark.range(5)

    assert [ledger.run(b, work, f"{tmp_path}/out") for b in ("d1", "d1", "d2", "d1")] == [True, False, True, False]
    assert len(runs) == 2 and spark.read.parquet(f"{tmp_path}/out").count() == 10 and ledger.done().count() == 2


def test_split(spark):
    lines = ["1,a,2.5", "x,b,1", "2,,3", "3,c", None, "", "4,d,-1,extra", "5,e,-2", '6,"f,g",1']
    got = Q.split(spark.createDataFrame([(x,) for x in lines], "raw string"), "raw", "id int, name string, v double", {"named": F.col("name") != "", "positive": F.col("v") > 0})
    assert sorted((r.id, r.name) for r in got.good.collect()) == [(1, "a"), (6, "f,g")]
    bad = {r.line: tuple(r.reasons) for r in got.bad.collect()}
    assert bad["x,b,1"] == ("broken",) and bad["2,,3"] == ("named",) and bad["5,e,-2"] == ("positive",) and bad[None] == ("broken",) and set(bad) == set(lines) - {"1,a,2.5", '6,"f,g",1'}
    assert got.counts["rows"] == len(lines) and got.counts["bad"] == len(bad) and got.counts["named"] == sum("named" in r for r in bad.values())
    objects = Q.split(spark.createDataFrame([('{"a":1}',), ("{no",), ('{"a":"t"}',), ("[1]",)], "raw string"), "raw", "a int", {}, kind="json")
    assert [r.a for r in objects.good.collect()] == [1] and objects.counts["bad"] == 3


def test_reach(spark, monkeypatch):
    """Seventy starts, a hub beyond the bound, loops, repeated and null edges, a start without edges."""
    monkeypatch.setattr(G, "HUB", 5)
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(100, i) for i in range(0, 60, 2)] + [(3, 3), (None, 1), (1, None), (100, 2)]
    starts = [*range(0, 60), *range(200, 210), None]
    nodes, inside = G.reach(spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame([(s,) for s in starts], "node bigint"), 3)
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    wanted, wanted_edges = set(), set()
    for s in starts[:-1]:
        seen, front = {s: 0}, {s}
        for step in (1, 2, 3):
            front = {y for x in front for y in near[x]} - set(seen)
            seen |= {y: step for y in front}
        wanted |= {(s, n, d) for n, d in seen.items()}
        wanted_edges |= {(s, a, b) for a, b in edges if a in seen and b in seen}
    got = [tuple(x) for x in nodes.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    got = [tuple(x) for x in inside.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted_edges


def test_merged_json(spark):
    rows = [('{"a":1,"b":{"c":[1,2]}}', '{"d":true,"e":null}', '{"a":1,"b":{"c":[1,2]},"d":true,"e":null}'), ('{"a":1.5,"z":"x\\"y"}', '{"a":{"q":null}}', '{"a":{"q":null},"z":"x\\"y"}'), (None, '{"k":[1,{"m":2}]}', '{"k":[1,{"m":2}]}'), ("nope", "[1]", "{}"), (None, None, "{}"), ('{"a":"1"}', '{"b c":12345678901234567890,"u":"é"}', '{"a":"1","b c":12345678901234567890,"u":"é"}')]
    got = spark.createDataFrame(rows, "a string, b string, w string").select(R.merged_json(F.col("a"), F.col("b")).alias("m"), "w").collect()
    assert [r.m for r in got] == [r.w for r in got]


def test_reach_of_many_starts(spark):
    """The plan is the same for ten starts and for five hundred: nothing has a column for a set of starts."""
    edges = spark.range(600).selectExpr("id AS a", "id + 1 AS b")
    few, many = (G.reach(edges, spark.range(n).selectExpr("id AS node"), 1) for n in (10, 500))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    for a, b in zip(few, many):
        assert size(b) < 1.2 * size(a)
    assert {tuple(x) for x in many[0].collect()} == {(s, n, abs(n - s)) for s in range(500) for n in (s - 1, s, s + 1) if n >= 0}
    assert {tuple(x) for x in many[1].collect()} == {(s, a, a + 1) for s in range(500) for a in (s - 1, s) if a >= 0}


def test_lookups_find_rows_in_every_group(spark, sf):
    """The case, the law and the member that are asked for are in each group of derived rows."""
    from docketry.plans import registry

    registry.load()
    customers, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "part"))
    found = lambda name: registry.QUERIES[name](spark, sf).collect()
    assert len(found("jn12_citing_cases")) == customers.where("c_custkey % 7 IN (1, 2)").count() > 0
    assert len(found("jn2_current_articles")) == parts.where("p_partkey % 8 IN (0, 1)").count() > 0
    assert len(found("col4_vote_of_member")) == customers.where("c_custkey % 5 IN (0, 2)").count() > 0
