"""Citation graphs: neighbourhoods and the standing of precedents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starts in one number, and edges of a node in one part at most.
WORD, HUB = 62, 50_000

# What an incoming link means for a precedent, the worst decides, with the confidence.
STANDING = (("overrules", "explicitly_overruled", 0.9), ("distinguishes", "questioned", 0.7))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node and distance of what lies within ``depth`` undirected steps of ``start`` (column node).

    ``edges``: a, b. Each round joins the frontier to the edges and drops what was seen.
    """
    from docketry.sources.tables import written

    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    seen = frontier = start.select("node").distinct().withColumn("distance", F.lit(0))
    for step in range(1, depth + 1):  # each round reads stored tables, so the plan does not grow with the depth
        met = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = met.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step))
        if step < depth:
            frontier = written(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def standing(links: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, status and confidence by the types of incoming links; without links unknown."""
    met = links.groupBy(F.col("to_case_id").alias("case_id")).agg(*(F.bool_or(F.col("citation_type") == kind).alias(f"_{kind}") for kind, _, _ in STANDING))
    joined = cases.select("case_id").distinct().join(met, "case_id", "left")
    status, sure = F.when(F.col("_overrules").isNull(), "unknown"), F.when(F.col("_overrules").isNull(), 0.5)
    for kind, name, confidence in STANDING:
        status, sure = status.when(F.col(f"_{kind}"), name), sure.when(F.col(f"_{kind}"), confidence)
    return joined.select("case_id", status.otherwise("valid").alias("status"), sure.otherwise(0.8).alias("confidence"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the neighbourhoods of all ``starts`` (column node) at once.

    nodes: start, node, distance of what lies within ``depth`` undirected steps; edges: start, a, b of the given edges with
    both ends among a start's nodes, each once. Starts come in blocks of 62; a node has a row for each block that has
    reached it, with the block's starts as bits, so neither plan nor rows grow with the starts that never meet a node.
    A hub's edges are dealt out by salt, as many parts as its degree asks for. Start nodes without edges are nodes;
    null nodes and loops reach nothing.
    """
    from docketry.sources.tables import written

    # stored before anything reads them: the numbers are not the same in another run
    known = written(starts.select("node").where("node is not null").distinct().withColumn("_n", F.monotonically_increasing_id()))
    own = written(edges.select("a", "b").where("a is not null and b is not null").distinct())
    both = written(own.union(own.select("b", "a")).where("a <> b").distinct())
    degrees = both.groupBy("a").agg(F.count("*").alias("_d")).where(F.col("_d") > HUB)
    hubs = written(degrees.select(F.col("a").alias("node"), F.ceil(F.col("_d") / HUB).alias("_salts")))
    # the salts of a node: one for each HUB edges
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.lit(1 << 20)) % F.col("_salts"), F.lit(0).cast("bigint"))
    salted = both.join(hubs.withColumnRenamed("node", "a"), "a", "left").select("a", "b", salt.alias("_s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_n") % WORD).cast("int"))
    seen = written(known.select("node", F.floor(F.col("_n") / WORD).alias("_block"), bit.alias("_w")).groupBy("node", "_block").agg(F.bit_or("_w").alias("_w")))
    frontier, levels = seen, [seen.withColumn("distance", F.lit(0))]
    for step in range(1, depth + 1):
        dealt = frontier.join(hubs, "node", "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)))
        met = dealt.join(salted.withColumnRenamed("a", "node").hint("merge"), ["node", "_s"]).groupBy(F.col("b").alias("node"), "_block").agg(F.bit_or("_w").alias("_w"))
        old = seen.withColumnRenamed("_w", "_old").hint("merge")
        fresh = met.join(old, ["node", "_block"], "left").select("node", "_block", F.col("_w").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("bigint")))).alias("_w"))
        frontier = written(fresh.where("_w <> 0"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("distance", F.lit(step)))
        seen = written(seen.unionByName(frontier).groupBy("node", "_block").agg(F.bit_or("_w").alias("_w")))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    ends = seen.select(F.col("node").alias("a"), "_block", F.col("_w").alias("_a")).hint("merge")
    heads = seen.select(F.col("node").alias("b"), "_block", F.col("_w").alias("_b")).hint("merge")
    inside = own.join(ends, "a").join(heads, ["b", "_block"]).select("a", "b", "_block", F.col("_a").bitwiseAND(F.col("_b")).alias("_w"))
    return _starts(every, known).select("start", "node", "distance"), _starts(inside, known).select("start", "a", "b")


def _starts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each start in the bits of each row, with start in their place."""
    one = F.lit(1).cast("bigint")
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("shiftright", F.col("_w"), k).bitwiseAND(one) != 0)
    each = rows.where("_w <> 0").withColumn("_n", F.explode(F.transform(held, lambda k: k + F.col("_block") * WORD))).drop("_w", "_block")
    return each.join(known.withColumnRenamed("node", "start").hint("merge"), "_n").drop("_n")
