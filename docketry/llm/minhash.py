"""Near-duplicate grouping by SuperMinHash signatures.

Every shingle of a document permutes the signature's slots by its own Fisher-Yates shuffle: in step j it
offers j plus a fraction to the slot its shuffle draws next, so the ranks that one shingle gives to the
slots are correlated and the signature varies less than with independent hashes. A document stops once no
slot can improve. Bands of the signature are bucket keys; each bucket names its smallest document as the
centre. Links to centres are confirmed on full shingle sets; where a centre's documents still form several
components, they are compared in blocks of bounded size that report a spanning forest, never all pairs.
Components come from rounds of large-star and small-star steps on the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import Words, blocks, by_blocks, discard, factors, fresh, gram_hashes, materialize, mix64, quoted, text_key
from docketry.operators.relational import positions

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of so many slots each: two sets at similarity 0.8 meet in no band with probability 3e-6.
BANDS, ROWS = 32, 5
#: Elements whose shuffles are held at once.
PIECE = 1 << 17
#: A centre's documents are dealt to so many rows of its sizes.
DEALS = 64
#: Documents of one centre that are compared with each other at once.
BLOCK = 256


def super_minhash(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots, uint64: step << 32 | fraction) of the distinct elements first[i]:first[i + 1]."""
    n = len(first) - 1
    best = np.full((n, slots), np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n), np.diff(first))
    for k in range(0, len(elements), PIECE):  # a long text's later pieces find its slots filled and stop at once
        low, high = int(owner[k]), int(owner[min(k + PIECE, len(owner)) - 1]) + 1
        _offer(best[low:high].reshape(-1), elements[k : k + PIECE], owner[k : k + PIECE] - low, slots)
    return best


def _offer(best: np.ndarray, value: np.ndarray, owner: np.ndarray, slots: int) -> None:
    """Lowers ``best`` (documents * slots) by what the elements ``value`` of the documents ``owner`` offer."""
    n, order = len(best) // slots, None  # order: of each element, the slots that its shuffle has not drawn yet
    for step in range(slots):
        draw = mix64(value, step)
        place = step + (((draw >> np.uint64(32)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            slot = place
        else:
            row = np.arange(len(value))
            slot = order[row, place].astype(np.int64)
            order[row, place] = order[:, step]
        np.minimum.at(best, owner * slots + slot, np.uint64(step << 32) | (draw & np.uint64(0xFFFFFFFF)))
        # early stop: a document goes on while a slot holds more than any later step can offer
        open_ = best.reshape(n, slots).max(1) >= np.uint64((step + 1) << 32)
        live = np.flatnonzero(open_[owner])
        if not len(live):
            break
        if step == 0:
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(live), 1))
            order[np.arange(len(live)), place[live]] = 0
        elif len(live) < len(value):
            order = order[live]
        if len(live) < len(value):
            value, owner = value[live], owner[live]


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, first): the distinct shingles of k lower-cased words of each text, sorted within a text."""
    words = Words(column, lower=True)
    both = [words.hashes(seed=seed) for seed in (0, 1)]
    count = words.count
    row = words.row_of_word()
    inside = np.zeros(len(row), bool)
    if len(row) >= k:
        inside[: len(row) - k + 1] = row[: len(row) - k + 1] == row[k - 1 :]
    owner = row[inside]
    value, other = (gram_hashes(h, k)[inside[: max(0, len(row) - k + 1)]] for h in both)
    for n in range(1, k):  # the whole sequence is one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            whole = [mix64(sum(h[words.first[short] + i] * f for i, f in enumerate(factors(n))), n) for h in both]
            value, other, owner = np.append(value, whole[0]), np.append(other, whole[1]), np.append(owner, short)
    order = np.lexsort((other, value, owner))
    value, other, owner = value[order], other[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (other[1:] != other[:-1]) | (owner[1:] != owner[:-1])
    value, other, owner = value[new], other[new], owner[new]
    return value, other, np.searchsorted(owner, np.arange(len(count) + 1))


def _keys(k: int, bands: int, rows: int):
    """n_shingles, a 128-bit key of the set (from two independent hashes of its words), and a bucket key for each band."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        value, other, first = shingle_sets(part.column("text"), k)
        size = np.diff(first)
        some = np.flatnonzero(size)
        sums = []
        for hashes in (value, other):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes, 11))])
            sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        signature = super_minhash(value, np.append(first[:-1][some], first[-1]), bands * rows)
        buckets = np.zeros((len(some), bands), np.uint64)
        for b in range(bands):
            for r in range(rows):
                buckets[:, b] = mix64(buckets[:, b] ^ signature[:, b * rows + r], b + 1)
        ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(buckets.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), *map(pa.array, sums), lists], ["doc_id", "n_shingles", "k1", "k2", "buckets"])

    return by_blocks(one)


def _similar(size: np.ndarray, a: np.ndarray, b: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    percent = round(100 * similarity)
    return 100 * both >= percent * (size[a] + size[b] - both)


def _confirm(k: int, similarity: float):
    """Of pairs with both texts, those whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "other", 1 << 20):
                for piece in blocks(part, "text", 1 << 20):
                    n = piece.num_rows
                    (x, x2, fx), (y, y2, fy) = shingle_sets(piece.column("text"), k), shingle_sets(piece.column("other"), k)
                    pair = np.concatenate([np.repeat(np.arange(n), np.diff(fx)), np.repeat(np.arange(n), np.diff(fy))])
                    value, second = np.concatenate([x, y]), np.concatenate([x2, y2])
                    order = np.lexsort((second, value, pair))
                    value, second, pair = value[order], second[order], pair[order]
                    both = np.bincount(pair[1:][(value[1:] == value[:-1]) & (second[1:] == second[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
                    size = np.concatenate([np.diff(fx), np.diff(fy)])
                    good = pa.array(_similar(size, np.arange(n), np.arange(n) + n, both, similarity))
                    yield pa.RecordBatch.from_arrays([piece.column("a").filter(good), piece.column("b").filter(good)], ["a", "b"])

    return run


def forest(sets: list[np.ndarray], component: list[int], left: list[bool], right: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) between different components that join all that are similar; only pairs of a left and a right one."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    ids, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
    del ids
    shared = np.cumsum(times > 1) - 1
    keep = times[inverse] > 1
    column, owner = shared[inverse[keep]], owner[keep]
    both = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], column[a:b] - c] = 1
        both += table @ table.T
    union = size[:, None] + size[None, :] - both
    good = (100 * both >= round(100 * similarity) * union) & np.array(left)[:, None] & np.array(right)[None, :]
    parent = {c: c for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(good))):
        a, b = root(component[i]), root(component[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _compare(k: int, similarity: float):
    """Rows of a cell stand together; side 0: stands on both sides."""

    def cell(rows: list[tuple]) -> list[tuple[int, int]]:
        texts = pa.array([r[4] for r in rows], pa.string())
        value, _, first = shingle_sets(texts, k)
        sets = [value[a:b] for a, b in zip(first[:-1], first[1:])]
        found = forest(sets, [r[2] for r in rows], [r[3] != 2 for r in rows], [r[3] != 1 for r in rows], similarity)
        return [(rows[i][1], rows[j][1]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for part in blocks(batch, limit=1 << 20):
                for row in zip(*(part.column(c).to_pylist() for c in ("cell", "id", "component", "side", "text"))):
                    if held and row[0] != held[0][0]:
                        out += cell(held)
                        held = []
                    held.append(row)
        if held:
            out += cell(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``edges`` (a, b), by large-star and small-star rounds.

    A round is a minimum by key and a join; nothing of a component is gathered. Null ends are left out.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge whose lower end is the minimum of its neighbours stays as it is
        stays = both.where("v > u").join(least.where("m = u"), "u").select(F.col("v").alias("u"), F.col("u").alias("v"))
        stars = materialize(large.unionByName(stays).where("u <> v").distinct())
        lowest = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(small.where("u <> v").distinct())
        # done: every id has one lower neighbour and no id is both a lower and an upper end
        tops = after.groupBy("u").count()
        open_ = tops.where("count > 1").select("u").unionByName(after.select(F.col("v").alias("u")).distinct().join(tops, "u", "left_semi"))
        done = open_.isEmpty()
        discard(pairs)
        discard(stars)
        pairs = after
        if done:
            break
    roots = pairs.select(F.col("v").alias("id")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def _cells(members: DataFrame, block: int) -> DataFrame:
    """cell, id, component, side: every two documents of a centre that are in different components meet in a cell.

    The documents in the centre's own component are one class, already joined; the others meet each other and that class.
    """
    sizes = members.groupBy("centre").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_other")).where("n_other > 0 and n_own + n_other > 2")
    # a centre with very many documents has its sizes once for each deal, so its documents need not meet in one task
    deals = sizes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    met = members.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)).cast("int")).join(deals, ["centre", "deal"])
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    mine = met.withColumn("_o", parts("n_other")).withColumn("_m", F.when(F.col("n_own") > 0, parts("n_own")).otherwise(0))
    mine = mine.withColumn("_p", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("_m")).otherwise(F.col("_o"))).cast("int"))
    name = lambda kind, i, j: F.concat_ws(":", F.col("centre"), F.lit(kind), i, j)
    others = F.sequence(F.lit(0), F.col("_o") - 1)
    owns = F.when(F.col("_m") > 0, F.sequence(F.lit(0), F.col("_m") - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(others, lambda j: F.struct(name("o", F.least("_p", j), F.greatest("_p", j)).alias("cell"), F.when(j == F.col("_p"), 0).when(F.col("_p") < j, 1).otherwise(2).alias("side")))
    across = F.transform(owns, lambda j: F.struct(name("m", F.col("_p"), j).alias("cell"), F.lit(1).alias("side")))
    back = F.transform(others, lambda j: F.struct(name("m", j, F.col("_p")).alias("cell"), F.lit(2).alias("side")))
    return mine.select("id", "component", F.explode(F.when(F.col("own"), back).otherwise(F.concat(among, across))).alias("c")).select("c.cell", "id", "component", "c.side")


def group_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (it is the row's own) of each row.

    Documents are linked if their sets of word shingles have at least ``similarity`` in common (intersection
    over union). Null, empty and blank texts have no shingle and no link. Rows with one doc_id are one
    document to the links and keep a row each; rows without doc_id get no link, a null component and stay.
    Other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = materialize(texts.mapInArrow(_keys(shingle, bands, rows), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, buckets array<bigint>"))
    linkable = keyed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one node, named by the smallest doc_id; partial minima meet, never the copies
    nodes = materialize(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min("buckets").alias("buckets")))
    named = nodes.select("id", F.explode("buckets").alias("bucket"))
    centres = named.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("_last")).where("centre < _last").select("bucket", "centre")
    stars = materialize(named.join(materialize(centres), "bucket").where("id <> centre").select("id", "centre").distinct())
    wanted = stars.select("id").union(stars.select("centre")).distinct()
    # always by shuffle: the documents that have a link grow with the input, at no size are they sent whole
    linked = texts.join(wanted.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi")
    chosen = materialize(linked.select(F.col("doc_id").alias("id"), "text").distinct())
    pairs = stars.join(chosen, "id").select(F.col("id").alias("a"), F.col("centre").alias("b"), "text").join(chosen.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    links = materialize(pairs.select("a", "b", "text", "other").mapInArrow(_confirm(shingle, similarity), "a bigint, b bigint"))
    known = materialize(components(links))

    everyone = stars.union(stars.select(F.col("centre"), F.col("centre")).distinct())
    labelled = everyone.join(known, "id", "left").select("id", "centre", F.coalesce("component", "id").alias("component"))
    central = known.select(F.col("id").alias("centre"), F.col("component").alias("_of"))
    members = materialize(labelled.join(central, "centre", "left").select("id", "centre", "component", (F.col("component") == F.coalesce("_of", "centre")).alias("own")))
    cells = _cells(members, block).join(chosen, "id").select("cell", "id", "component", "side", "text")
    more = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(shingle, similarity), "a bigint, b bigint")
    more = materialize(more)
    final = known if more.isEmpty() else materialize(components(links.unionByName(more)))
    by_set = nodes.select("k1", "k2", "id").join(final, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("doc_id", "n_shingles", "k1", "k2").join(by_set, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, all columns unchanged.

    Rows without doc_id stay. Rows that share a doc_id but differ in text are documents of their own; of
    repeated rows with one doc_id and text one stays.
    """
    key, low, high, name, place = fresh(docs, "_key", "_low", "_high", "_id", "_n")
    columns = [quoted(c) for c in docs.columns]
    keyed = docs.where("doc_id is not null").withColumn(key, text_key())
    odd = keyed.groupBy("doc_id").agg(F.min(key).alias(low), F.max(key).alias(high)).where(F.col(low) < F.col(high))
    if odd.isEmpty():
        named = keyed.withColumn(name, F.col("doc_id")).drop(key)
    else:
        ids = positions(keyed.select("doc_id", key).distinct(), ["doc_id", key]).select("doc_id", key, F.col("position").cast("bigint").alias(name))
        named = materialize(keyed.join(ids, ["doc_id", key]).select(*columns, name))
    kept = group_duplicates(named.select(F.col(name).alias("doc_id"), "text"), **settings).where("kept").select(F.col("doc_id").alias(name)).distinct()
    numbered = named.join(kept, name, "left_semi")
    first = numbered.withColumn(place, F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64("text")))).where(F.col(place) == 1).select(*columns)
    return first.unionByName(docs.where("doc_id is null"))
