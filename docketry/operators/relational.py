"""Joins, filters, windows and set operations that the queries share; each takes and returns DataFrames."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators import folds


def conjunction(df: DataFrame, **given) -> DataFrame:
    """Rows that equal every given value; None: any."""
    tests = [F.col(c) == v for c, v in given.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def contains_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Substring in any case in one of the columns; wildcards in ``text`` have no meaning."""
    return df.where(reduce(lambda a, b: a | b, (F.lower(c).contains(text.lower()) for c in columns)))


def owned_or_shared(df: DataFrame, column: str, owner) -> DataFrame:
    return df.where((F.col(column) == owner) | F.col(column).isNull())


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of any size in a total order; give a unique last key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark prunes each partition to n rows a key before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def member(df: DataFrame, array: str, value) -> DataFrame:
    return df.where(F.array_contains(array, value))


def overlapping(df: DataFrame, array: str, values: list) -> DataFrame:
    """Rows whose array shares a value with ``values``, with the number of distinct shared ones as n_shared."""
    return df.withColumn("n_shared", F.size(F.array_intersect(F.col(array), F.array(*map(F.lit, values))))).where("n_shared > 0")


def json_any(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose JSON array of texts has an element with ``part`` in it, in any case."""
    return df.where(F.coalesce(F.exists(F.from_json(column, "array<string>"), lambda x: F.lower(x).contains(part.lower())), F.lit(False)))


def json_keys(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows whose JSON object has one of the keys."""
    return df.where(F.coalesce(F.arrays_overlap(F.json_object_keys(column), F.array(*map(F.lit, keys))), F.lit(False)))


def under(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def period(df: DataFrame, column: str, as_of: str, days: int, back: int = 0) -> DataFrame:
    """Rows of the ``days`` before ``as_of``, or of the same stretch ``back`` stretches earlier; the end is not in it."""
    moment = F.lit(as_of).cast("timestamp_ntz")
    ago = lambda n: moment - F.make_dt_interval(F.lit(n * days))
    rows = df.where(F.col(column) >= ago(back + 1))
    return rows.where(F.col(column) < ago(back)) if back else rows


def sorted_by(df: DataFrame, wanted: str | None, allowed: dict[str, str], default: str, descending: bool = True, last: str = "") -> DataFrame:
    """Ordered by the column that ``allowed`` gives for ``wanted``, else by the default; ``last`` breaks ties."""
    column = allowed.get(wanted or "", default)
    order = [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *([F.asc(last)] if last else [])]
    return df.orderBy(*order)


def with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the number of all rows as total."""
    return page(df, order, offset, limit).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def first_kind(keys: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """key and kind: the first table, in the order given, that has the key; null where none has it."""
    named = reduce(DataFrame.unionByName, (t.select(F.col(key), F.lit(i).alias("_at"), F.lit(kind).alias("kind")) for i, (kind, t) in enumerate(tables.items())))
    return keys.join(named.groupBy(key).agg(F.min_by("kind", "_at").alias("kind")), key, "left").select(key, "kind")


def replaced(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """``old`` with all rows of every owner in ``new`` replaced by the new ones."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def counted(events: DataFrame, keys: list[str], moment: str, carried: list[str]) -> DataFrame:
    """Upsert with a counter: n mentions of each key (nulls are one key), the last moment, and the last known carried values."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(moment))).alias(c) for c in carried]
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max(moment).alias(moment), *last)


def within_budget(df: DataFrame, group: str, order: list[Column], size: Column, short: Column, most: int) -> DataFrame:
    """Adds kept: rows of a group are kept whole in their order until ``most`` is reached; one that does not fit counts with ``short``.

    What fits depends on what was kept before, so the sizes (a few numbers a row, no texts) are folded in order by
    ``folds.folded``: no group is held in memory. Give a total order; a null group is a group, null sizes are 0.
    """
    def step(used: int, values: list) -> tuple[int, list[bool]]:
        kept = []
        for whole, less in zip(*values):
            kept.append(used + whole <= most)
            used += whole if kept[-1] else less
        return used, kept

    sizes = [F.coalesce(size.cast("bigint"), F.lit(0)), F.coalesce(short.cast("bigint"), F.lit(0))]
    return folds.folded(df, [group], order, sizes, step, 0, "bigint", "kept", "boolean")


def latest_version(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Last write wins: one row a key, by partial maxima rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def merged_json(old: Column, new: Column) -> Column:
    """A JSON object with the keys of both; a value of ``new`` wins, whole. Values of every type stay as they are, nulls too.

    Null, or text that is no JSON object, counts as without keys. Keys come in alphabetic order.
    """
    parsed = lambda c: F.coalesce(F.try_parse_json(c).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    a, b = parsed(old), parsed(new)
    both = F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    # a null in JSON is a null value of the map
    member = lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.to_json(F.element_at(both, k)), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(both)), member), ","), F.lit("}"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), merge: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of the same key; a null in a column of ``keep_if_null`` keeps the old value.

    Columns of ``merge`` are JSON objects, merged by ``merged_json``.
    """
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    there = n.select(*new.columns, F.lit(True).alias("_new")).alias("n")
    joined = o.join(there, on, "full_outer")
    is_new = F.col("n._new").isNotNull()
    pick = lambda c: merged_json(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in merge else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null or c in keys else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and state (new, changed, unchanged, gone), by a hash of the whole content."""
    content = F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))
    a, b = old.select(key, content.alias("_a")), new.select(key, content.alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errors: the names of the rules that do not hold."""
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))))


#: A span of days is cut into pieces of 1, 32, 32^2 ... days; so many sizes cover every date.
_PIECE_BITS, _SIZES = 5, 5
#: Entries of a key in one part at most.
HOT = 50_000


def _day(df: DataFrame, column: str) -> Column:
    """A date's number from 0 on; whole numbers are taken as days."""
    half = 1 << (_PIECE_BITS * _SIZES - 1)
    dated = df.schema[column].dataType.typeName().startswith(("date", "timestamp"))
    number = (F.unix_date(F.to_date(column)) if dated else F.col(column)).cast("bigint")
    return F.when(F.abs(number) >= half, F.raise_error(F.lit("a day outside the calendar"))).otherwise(number + half)


def effective_rate(entries: DataFrame, rates: DataFrame, key: str, on: str, default: str | None = None) -> DataFrame:
    """Adds rate: the latest one in force on the entry's date, else the entry's default, else 0.

    ``rates``: key, effective_from, effective_to (null: open), rate. Dates count by day; of rates that begin on
    one day the highest wins; entries without key or date get the default. A rate's span is cut into aligned
    pieces of 1, 32, 32^2 ... days, of each size at most 62, and a piece of a key keeps its latest rate. An
    entry lies in one piece of each size, so five joins on key and piece find its rate: each entry stays one
    row. Keys with more than HOT entries are dealt out, a part for each HOT, and only their pieces are there once a part.
    """
    from docketry.sources.tables import written

    begin, end = _day(rates, "effective_from"), _day(rates, "effective_to")
    spans = rates.where(F.col("effective_from").isNotNull()).select(F.col(key), begin.alias("_a"), F.coalesce(end, F.lit((1 << (_PIECE_BITS * _SIZES)) - 1)).alias("_b"), F.struct(begin.alias("day"), "rate").alias("_rate"))
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    # at most a row for each HOT entries
    hot = F.broadcast(written(entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / HOT).alias("_salts")).where("_salts > 1")))
    mixed = F.xxhash64(*(name for name, kind in entries.dtypes if "map<" not in kind and "variant" not in kind))
    out = entries.withColumn("_day", _day(entries, on)).join(hot, key, "left")
    # entries that can meet no rate lie anywhere
    out = out.withColumn("_salt", F.pmod(mixed, F.when(F.col(key).isNull() | F.col("_day").isNull(), 1 << 10).otherwise(F.coalesce("_salts", F.lit(1))))).drop("_salts")
    for size in range(_SIZES):
        a, b = F.col("_a"), F.col("_b")
        # the pieces of the next size that the span covers whole
        spans = spans.withColumn("_c", F.shiftright(a + ((1 << _PIECE_BITS) - 1), _PIECE_BITS)).withColumn("_d", F.shiftright(b + 1, _PIECE_BITS) - 1)
        left = run(a, b)
        if size < _SIZES - 1:
            cut = F.concat(run(a, F.shiftleft("_c", _PIECE_BITS) - 1), run(F.shiftleft(F.col("_d") + 1, _PIECE_BITS), b))
            left = F.when(F.col("_c") <= F.col("_d"), cut).otherwise(left)
        latest = spans.select(F.col(key), F.explode(left).alias(f"_p{size}"), "_rate").groupBy(key, f"_p{size}").agg(F.max("_rate").alias(f"_r{size}"))
        out = out.withColumn(f"_p{size}", F.shiftright("_day", _PIECE_BITS * size))
        latest = latest.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        # never broadcast: sizes of tables that explode makes are underestimated
        out = out.join(latest.hint("merge"), [key, f"_p{size}", "_salt"], "left")
        spans = spans.select(key, F.col("_c").alias("_a"), F.col("_d").alias("_b"), "_rate")
    rate = F.greatest(*(f"_r{size}" for size in range(_SIZES)))["rate"]
    return out.select(*entries.columns, F.coalesce(rate, F.col(default) if default else F.lit(None), F.lit(0)).alias("rate"))


def imported(old: dict[str, DataFrame], new: dict[str, DataFrame], record: str, main: str = "main") -> dict[str, DataFrame]:
    """Tables after an import of entities: rows of ``main`` are replaced by ``record``, and all children of an
    entity that came by its new ones, none included; a table that is not in ``new`` loses those children.

    Entities without ``record`` are added. Of rows of one entity in ``new[main]`` all stay: make them one first.
    """
    came = new[main].select(record).where(F.col(record).isNotNull()).distinct()
    kept = {name: df.join(came, record, "left_anti").select(*df.columns) for name, df in old.items()}
    return {name: kept[name].unionByName(new[name].select(*df.columns)) if name in new else kept[name] for name, df in old.items()}


def affordable(requests: DataFrame, balances: DataFrame, user: str, amount: str, balance: str) -> DataFrame:
    """Adds has_credits, current_balance and reason to requests; a user without a balance has 0."""
    met = requests.join(balances.select(user, F.col(balance).alias("current_balance")), user, "left").withColumn("current_balance", F.coalesce("current_balance", F.lit(0)))
    enough = F.coalesce(F.col("current_balance") >= F.col(amount), F.lit(False))
    return met.withColumn("has_credits", enough).withColumn("reason", F.when(enough, "Sufficient balance").otherwise("Insufficient credits"))


def key_limits(asked: DataFrame, keys: DataFrame, key: str, as_of: str) -> DataFrame:
    """key, allowed, reason, requests_today and rate_limit of each key that is asked for.

    ``keys``: key, is_active, requests_today, reset_at, rate_limit, expires_at. Counts of an earlier day are 0. The
    tests go in this order: the key is active, under its limit, not expired.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    used = F.when(F.col("reset_at") < now.cast("date"), 0).otherwise(F.col("requests_today"))
    met = asked.join(keys.where("is_active").withColumn("_used", used), key, "left")
    reason = F.when(F.col("is_active").isNull(), "Invalid or inactive API key").when(F.col("_used") >= F.col("rate_limit"), "Daily rate limit exceeded").when(F.col("expires_at") < now, "API key expired").otherwise("OK")
    return met.select(key, (reason == "OK").alias("allowed"), reason.alias("reason"), F.coalesce("_used", F.lit(0)).alias("requests_today"), F.coalesce("rate_limit", F.lit(0)).alias("rate_limit"))


def discriminated(fact: DataFrame, parents: dict[str, DataFrame], kind: str, key: str, wanted: list[str]) -> DataFrame:
    """Left join to the parent table that ``kind`` names: parents become one table, joined once."""
    union = reduce(DataFrame.unionByName, (p.select(F.lit(k).alias("_kind"), F.col(key).alias("_key"), *wanted) for k, p in parents.items()))
    return fact.join(union, (fact[kind] == union["_kind"]) & (fact[key] == union["_key"]), "left").drop("_kind", "_key")


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs of a text and a needle that it holds anywhere, in any case; null and empty needles match nothing.

    An equi join on parts of three characters (of one or two for shorter needles) in place of a nested loop: a
    needle meets the texts that have its rarest part, and the whole needle is then looked for in each of them.
    """
    from docketry.sources.tables import written

    sought = needles.withColumn("_needle", F.lower(needle)).where("_needle <> ''")
    sizes = [r[0] for r in sought.select(F.least(F.lit(3), F.length("_needle"))).distinct().collect()]
    # dealt out anew, since many short texts may come from one small file
    rows = written(texts.withColumn("_row", F.monotonically_increasing_id()).repartition("_row"))
    parts = rows.select("_row", F.explode(_parts(F.lower(text), sizes)).alias("_part"))
    own = sought.select("_needle").distinct()
    own = own.select("_needle", F.explode(_parts(F.col("_needle"), sizes)).alias("_part")).where(F.length("_part") == F.least(F.lit(3), F.length("_needle")))
    # a needle with a part that no text has has no candidates
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    rarest = own.join(counts, "_part", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_part")).alias("_r")).where("_r._n > 0").select("_needle", F.col("_r._part").alias("_part"))
    # parts and rows are never broadcast: the sizes of what explode makes, and of texts stored compressed, are underestimated
    kept = parts.join(rarest.select("_part").distinct(), "_part", "left_semi")
    pairs = kept.join(rarest.hint("merge"), "_part").select("_row", "_needle")
    met = rows.join(pairs.hint("merge"), "_row").where(F.lower(text).contains(F.col("_needle")))
    return met.join(sought.hint("merge"), "_needle").drop("_row", "_needle")


def _parts(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many characters of a text, by code points."""
    one = F.split(text, "")
    joined = lambda a, b: F.concat(a, b)
    after = lambda n: F.slice(one, F.lit(n + 1), F.greatest(F.size(one), F.lit(0)))
    two = F.zip_with(one, after(1), joined)
    runs = {1: one, 2: two, 3: F.zip_with(two, after(2), joined)}
    whole = lambda size: F.filter(runs[size], lambda p: F.length(p) == size)
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *map(whole, sizes)))


def best_of(arms: list[DataFrame], key: str, score: str, least: float, n: int) -> DataFrame:
    """The n keys with the highest score over all arms."""
    merged = reduce(DataFrame.unionByName, arms).groupBy(key).agg(F.max(score).alias(score))
    return merged.where(F.col(score) >= least).orderBy(F.desc(score), key).limit(n)


def chained(df: DataFrame, order: list[str], content: Column, seed: str = "GENESIS") -> DataFrame:
    """Adds previous and current: each row's hash is of its content and the hash before it, from ``seed`` on.

    A hash needs the one before, so the partitions of a sort are walked one after another, and each hands its last hash on;
    a task streams its rows. Append to a stored chain by giving its last hash as ``seed``. Null content counts as empty.
    """
    def link(before: str, values: list) -> tuple[str, list[dict]]:
        out = []
        for text in values[0]:
            after = hashlib.sha256(((text or "") + before).encode()).hexdigest()
            out.append({"previous": before, "current": after})
            before = after
        return before, out

    hashed = folds.folded(df, [], [F.col(o) for o in order], [content], link, seed, "string", "_link", "struct<previous:string,current:string>")
    return hashed.select(*df.columns, "_link.previous", "_link.current")


def check_chain(df: DataFrame, order: list[str], content: Column, previous: str, current: str) -> DataFrame:
    """One row: whether a hash chain holds, how many rows it has, and the first that breaks it.

    Every row is compared with the row before it, which is found by a join on the position: positions come
    from the sort's partitions, so the whole chain never stands in one task.
    """
    placed = df.withColumn("_hash", F.sha2(F.concat(F.col(previous), content), 256)).select(*order, F.col(previous).alias("_p"), F.col(current).alias("_c"), "_hash")
    numbered = positions(placed, order)
    before = numbered.select((F.col("position") + 1).alias("position"), F.col("_c").alias("_before"))
    judged = numbered.join(before, "position", "left").withColumn("_bad", (F.col("_hash") != F.col("_c")) | (F.col("_p") != F.coalesce("_before", F.lit("GENESIS"))))
    return judged.agg(F.count("*").alias("n_rows"), (F.count_if("_bad") == 0).alias("valid"), F.min(F.when(F.col("_bad"), F.col("position"))).alias("first_bad"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds position from 1 on in a total order, without one task for all rows.

    A range shuffle deals the rows out in order; the counts of its partitions, one row each, give every
    partition its base. The shuffled rows are written once so that both passes see the same partitions.
    """
    from docketry.sources.tables import written

    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").count()
    base = totals.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))
    ranked = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return ranked.join(F.broadcast(base), "_part").withColumn("position", F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds position from 1 on in each group, in a total order, without one task for a group.

    A range shuffle on group and order deals a large group out over several partitions; each row is numbered in its
    partition, and the counts of a group's earlier partitions, one row each, are added. Groups are not null.
    """
    from docketry.sources.tables import written

    dealt = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", *group).count()
    base = counts.select("_part", *group, (F.sum("count").over(Window.partitionBy(*group).orderBy("_part")) - F.col("count")).alias("_base"))
    ranked = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    return ranked.join(base, ["_part", *group]).withColumn("position", F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")
