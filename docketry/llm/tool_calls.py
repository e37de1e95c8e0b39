"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

Only DataFrame operations. Calls and results meet in a hash join by identifier. A call may depend on
other calls; its layer is the length of the longest chain of calls that it waits for. Conversations whose
calls need one call at most are layered by pointer doubling, the others in a round for each layer. A message
is a row and carries its sort key, so no conversation is gathered in one task however long it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialize

#: tool: {argument: (type of the variant value, required, longest text)}.
Schemas = dict[str, dict[str, tuple[str, bool, int | None]]]


def _errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with parsed arguments, as an array of texts."""
    found = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool")))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required, longest) in fields.items():
            raw = F.try_variant_get(arguments, f"$.{field}", "variant")
            value = F.try_variant_get(arguments, f"$.{field}", kind)
            if required:
                checks.append(F.when(raw.isNull(), f"missing {field}"))
            checks.append(F.when(raw.isNotNull() & (value.isNull() | ~F.schema_of_variant(raw).rlike(_NAMES[kind])), f"{field} is not {kind}"))
            if longest is not None:
                checks.append(F.when(F.length(value.cast("string")) > longest, f"{field} is too long"))
        found = found.when(name == tool, F.array_compact(F.array(*checks)))
    return F.when(arguments.isNull(), F.array(F.lit("arguments are not JSON"))).otherwise(found)


#: What schema_of_variant calls the values that each type admits.
_NAMES = {"string": "^STRING$", "bigint": "^BIGINT$", "double": r"^(DOUBLE|FLOAT|BIGINT|DECIMAL\(.*\))$", "boolean": "^BOOLEAN$"}


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and for each result that no call took.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call_ids; null: none).
    ``results``: conv_id, turn, call_id, content. Other columns are not read.
    Returned: conv_id, turn, call_id, level, linked, valid, errors, json. A result belongs to the call of
    its conversation and identifier. Of calls with one identifier the first turn's has the first result (by turn,
    then content), the others are errors (duplicate identifier); every further result, and every result whose
    call is unknown or that has no identifier, is a row and an error of its own. level: 0 for calls that need no known call,
    else one more than the highest level that they need; sorting by conv_id, level, turn, call_id gives an
    order in which every dependency precedes. Calls in a cycle or behind one stand after all layers; they,
    calls with an unknown dependency, with null identifiers, or with a result before the call are errors;
    nothing is dropped. json has sorted keys and no blanks; arguments that are not JSON stand as text.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "needs")
    results = results.select("conv_id", F.col("turn").alias("result_turn"), "call_id", "content")
    key = ["conv_id", "call_id"]
    # an identifier's first call and first result; partial sums meet, never a group's rows
    stats = calls.groupBy(*key).agg(F.count("*").alias("_calls"), F.min(F.struct("turn", F.xxhash64("name", "arguments"))).alias("_first"))
    told = results.groupBy(*key, "result_turn", "content").agg(F.count("*").alias("_times"))
    answers = told.groupBy(*key).agg(F.sum("_times").alias("_results"), F.min(F.struct("result_turn", "content")).alias("_result"))
    met = calls.join(stats, key, "left").join(answers, key, "left")
    first = F.coalesce(F.col("_first") == F.struct("turn", F.xxhash64("name", "arguments")), F.lit(False))
    met = met.withColumn("result", F.when(first, F.col("_result")))
    # of a key with a call one row of its first result is taken; equal rows are told apart by their number alone
    owners = answers.join(stats.select(*key), key, "left_semi").select(*key, "_result")
    left = told.join(owners, key, "left").withColumn("_left", F.col("_times") - F.coalesce(F.col("_result") == F.struct("result_turn", "content"), F.lit(False)).cast("int"))
    orphans = left.select(*key, "result_turn", "content", F.when(F.col("_result").isNull(), "result without call").otherwise("further result").alias("_error"), F.explode(F.array_repeat(F.lit(0), F.col("_left").cast("int"))).alias("_one"))
    levels = _levels(calls)
    met = met.join(levels, key, "left") if levels is not None else met.withColumn("level", F.lit(0)).withColumn("_order", F.lit(None).cast("string"))

    parsed = F.try_parse_json(F.col("arguments"))
    wrong = F.array_compact(
        F.array(
            F.when(F.col("call_id").isNull(), "no identifier"),
            F.when(F.col("_calls") > 1, "duplicate identifier"),
            F.when(F.col("_results") > 1, "several results"),
            F.when(F.col("result.result_turn") <= F.col("turn"), "result before call"),
            F.col("_order"),
        )
    )
    judged = met.withColumn("errors", F.concat(wrong, _errors(F.col("name"), parsed, schemas)))
    arguments = F.coalesce(F.to_json(parsed), _quoted(F.col("arguments")))
    pairs = [("arguments", arguments), ("call_id", _quoted(F.col("call_id"))), ("name", _quoted(F.col("name"))), ("result", _quoted(F.col("result.content")))]
    linked = judged.select(*key[:1], "turn", "call_id", F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.col("result").isNotNull().alias("linked"), (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), _object(pairs).alias("json"))
    rest = orphans.select("conv_id", F.col("result_turn").alias("turn"), "call_id", F.lit(0).alias("level"), F.lit(False).alias("linked"), F.lit(False).alias("valid"), F.col("_error").alias("errors"), _object([("call_id", _quoted(F.col("call_id"))), ("result", _quoted(F.col("content")))]).alias("json"))
    return linked.unionByName(rest)


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in pairs)), F.lit("}"))


def _levels(calls: DataFrame) -> DataFrame | None:
    """conv_id, call_id, level and _order (an error or null) of the calls that need others; None where no call does."""
    key = ["conv_id", "call_id"]
    named = calls.where("call_id is not null")
    edges = named.select(*key, F.explode("needs").alias("need")).distinct()
    ends = named.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("_known")).distinct()
    checked = materialize(edges.join(ends, ["conv_id", "need"], "left"))
    if checked.isEmpty():
        return None
    unknown = checked.where("_known is null").select(*key).distinct().withColumn("_unknown", F.lit(True))
    known = checked.where("_known").select(*key, "need")
    single = materialize(known.groupBy(*key).agg(F.min("need").alias("need"), F.count("*").alias("n")))
    several = materialize(single.where("n > 1").select("conv_id").distinct())
    single = single.select(*key, "need")
    if several.isEmpty():
        layers, cyclic, n = _doubled(single)
    else:
        layers, cyclic, n = _doubled(single.join(several, "conv_id", "left_anti"))
        more, knots, m = _rounds(named.select(*key).distinct().join(several, "conv_id", "left_semi"), known.join(several, "conv_id", "left_semi"))
        layers, cyclic, n = layers.unionByName(more), cyclic.unionByName(knots), max(n, m)
    order = lambda text: F.lit(text).cast("string").alias("_order")
    layered = layers.select(*key, "level", order(None)).unionByName(cyclic.select(*key, F.lit(n).cast("bigint").alias("level"), order("cycle")))
    return layered.join(unknown, key, "full").select(*key, F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("_order", F.when(F.col("_unknown"), "unknown dependency")).alias("_order"))


def _doubled(single: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(layers, calls behind a cycle, number of layers) where each call needs one call at most.

    ``single``: conv_id, call_id, need. Each round doubles the way that a call looks back, so a chain of n
    calls takes log2(n) rounds. A round in which no call reaches a start leaves only cycles and what hangs on them.
    """
    active = single.select("conv_id", "call_id", F.col("need").alias("ahead"), F.lit(1).cast("bigint").alias("level"))
    done, n = active.limit(0).select("conv_id", "call_id", "level"), 1
    while True:
        # ahead is null where the way has ended at a call that needs none
        known = active.unionByName(done.withColumn("ahead", F.lit(None).cast("string"))).select("conv_id", F.col("call_id").alias("ahead"), F.col("ahead").alias("_next"), F.col("level").alias("_more"))
        went = materialize(active.join(known, ["conv_id", "ahead"], "left").select("conv_id", "call_id", F.col("_next").alias("ahead"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level")))
        ended = went.where("ahead is null")
        left, deepest = went.agg(F.count("ahead"), F.max(F.when(F.col("ahead").isNull(), F.col("level")))).first()
        if deepest is None:
            return done, active.select("conv_id", "call_id"), n
        active, done, n = went.where("ahead is not null"), done.unionByName(ended.drop("ahead")), max(n, deepest + 1)
        if not left:
            return done, active.select("conv_id", "call_id"), n


def _rounds(open_: DataFrame, within: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """As _doubled for calls that need several: a round for each layer. ``open_``: conv_id, call_id; ``within``: their needs."""
    key = ["conv_id", "call_id"]
    open_, within = materialize(open_), materialize(within)
    done: list[DataFrame] = []
    while True:
        # a layer: calls whose dependencies are all in earlier layers
        waiting = within.join(open_.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi").select(*key).distinct()
        ready = materialize(open_.join(waiting, key, "left_anti").withColumn("level", F.lit(len(done)).cast("bigint")))
        if ready.isEmpty():
            break
        done.append(ready)
        rest = materialize(open_.join(ready, key, "left_anti"))
        discard(open_)
        open_ = rest
    return reduce(DataFrame.unionByName, done, open_.limit(0).withColumn("level", F.lit(0).cast("bigint"))), open_, len(done)


def turns_as_calls(messages: DataFrame, tool: str = "reply", user: str = "user", assistant: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of turns: each user turn calls ``tool``, the assistant's next turn is its result.

    Identifiers are conv_id:turn; a call needs the call two turns before, where there is one.
    """
    name = lambda back: F.concat_ws(":", F.col("conv_id"), F.col("turn") - back)
    said = F.coalesce("text", F.lit(""))
    mine = messages.where(F.col("role") == user)
    earlier = mine.where("conv_id is not null and turn is not null").select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("_earlier")).distinct()
    mine = mine.join(earlier, ["conv_id", "turn"], "left")
    needs = F.when(F.col("_earlier"), F.array(name(2))).otherwise(F.array().cast("array<string>"))
    # a turn without text is a call without its arguments, which the validation reports
    arguments = F.to_json(F.struct(F.length("text").alias("n_chars"), F.col("text")))
    calls = mine.select("conv_id", "turn", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(0)).alias("call_id"), F.lit(tool).alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = messages.where(F.col("role") == assistant).select("conv_id", "turn", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(1)).alias("call_id"), said.alias("content"))
    return calls, results
