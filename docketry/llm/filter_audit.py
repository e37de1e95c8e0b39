"""How filters of documents overlap: what each removes, alone and after others, in every order.

Every text is scanned once for its mask of failed filters. Exact duplicates are found by partition refinement:
rows are split by length in code points, then by a hash of the next block of the text, round by round, and what is
alone in its class is dropped after every split. Blocks grow, so a text of n bytes has about log4(n / 256) of them,
and what is split are ids and hashes, not texts. Texts that are left are compared whole, copies in a task being
made one before they move; all but those with the smallest doc_id are marked. Then masks are counted by part: at
most 32 cells for each, from which every order and step follows by sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import Words, as_binary, blocks, materialize, span_hashes

#: Filters by letter; a document's mask has the bit of each that it fails.
LETTERS = "ABCDE"
# Fixed values of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 50, 65, 5, b"#$%&*|"
#: Bytes of the first block, and how many times longer the blocks up to the next one are.
FIRST_BLOCK, GROWTH = 256, 4
#: Keys of possible copies are told to all tasks by so many buckets at most.
BUCKETS = 1 << 20

_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS)] = True

SCAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("text_key", T.LongType()), T.StructField("mask", T.IntegerType()), T.StructField("class", T.LongType()), T.StructField("blocks", T.ArrayType(T.LongType()))])


def distinct_words(words: Words) -> np.ndarray:
    """Number of distinct words of each row: short words are told by their bytes, longer ones by 128 bits of hashes."""
    rows = len(words.first) - 1
    if not len(words):
        return np.zeros(rows, np.int64)
    one, second = span_hashes(words.data, words.start, words.end)
    long = np.flatnonzero(words.end - words.start > 8)
    if len(long):
        second = second.copy()
        second[long] = span_hashes(words.data, words.start[long], words.end[long], seed=7)[0]
    row = words.row_of_word()
    order = np.lexsort((second, one, row))
    row, one, second = row[order], one[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (second[1:] != second[:-1])
    return np.bincount(row[new], minlength=rows)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _block_hashes(data: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Hashes of each row's bytes [0, 256), [256, 1024), [1024, 4096) ..."""
    size, ends, edge = np.diff(at), [0], FIRST_BLOCK
    while ends[-1] < size.max(initial=0):
        ends.append(edge)
        edge *= GROWTH
    ends = np.array(ends)
    count = np.searchsorted(ends, size, "left")  # blocks that begin before the text's end
    row, number = np.repeat(np.arange(len(size)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start, end = at[row] + ends[number], np.minimum(at[row] + ends[np.minimum(number + 1, len(ends) - 1)], at[row + 1])
    hashes = span_hashes(data, start, end)[0] if len(row) else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(hashes.view(np.int64)))


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each document: its mask of A to D, its length in code points as class, and its block hashes; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                column = part.column("text")
                at, data = as_binary(column)
                words = Words(column)
                points = _per_row((data & 0xC0) != 0x80, at)
                n, distinct = words.count, distinct_words(words)
                capitals = _per_row((data >= 65) & (data <= 90), at)
                fails = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * points, _per_row(_SIGN[data], at) > 0)
                mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("text_key"), pa.array(mask, pa.int32()), pa.array(points), _block_hashes(data, at)], SCAN.names)

    return materialize(docs.mapInArrow(run, SCAN))


def _shared(groups: DataFrame) -> DataFrame:
    """Groups whose class has two doc_ids at least."""
    classes = groups.groupBy("class").agg(F.min("first").alias("_a"), F.max("last").alias("_b")).where("_a < _b").select("class")
    return groups.join(classes, "class", "left_semi")


def refined(scan: DataFrame) -> DataFrame:
    """text_key and class of what shares a class after the split by length and by all blocks.

    Rows with the same length, blocks and text_key can never be split: they become one before the first round, so a
    text with a great many copies is one row here.
    """
    groups = scan.where("doc_id is not null").groupBy("class", "blocks", "text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups, number = materialize(_shared(groups)), 0
    while True:  # a round for each block of the longest text that is left; what remains is stored, so plans stay small
        left = groups.agg(F.max(F.size("blocks"))).first()[0] or 0
        if number >= left:
            return groups.select("text_key", "class")
        groups = materialize(_shared(groups.withColumn("class", F.xxhash64("class", F.coalesce(F.get("blocks", F.lit(number)), F.lit(0))))))
        number += 1


def first_copies(texts: DataFrame, left: DataFrame) -> DataFrame:
    """text_key, n_texts and first of the texts that stand under two doc_ids at least; stored.

    ``texts``: doc_id, text_key, text. Only texts whose key falls in a bucket of a key of ``left`` move; of equal
    ones in a task one does. They are then compared whole, by grouping.
    """
    bucket = F.pmod("text_key", F.lit(BUCKETS)).alias("bucket")
    wanted = left.select(bucket).distinct()  # BUCKETS rows at most
    near = texts.select("*", bucket).join(F.broadcast(wanted), "bucket", "left_semi")
    whole = near.groupBy("text_key", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    by_key = whole.groupBy("text_key").agg(F.count("*").alias("n_texts"), F.min("first").alias("first"), F.max("last").alias("last"))
    return materialize(by_key.where("first < last").select("text_key", "n_texts", "first"))


def marked(scan: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """``scan`` with the bit of E in mask where the text equals one with a smaller doc_id."""
    later = lambda first: F.when(F.col("doc_id") > first, 1 << LETTERS.index("E")).otherwise(0)
    plain = scan.join(firsts, "text_key", "left")
    if firsts.where("n_texts > 1").isEmpty():
        return plain.withColumn("mask", F.col("mask").bitwiseOR(later(F.col("first"))))
    # texts whose keys meet: these rows alone are told apart by the text
    mixed = texts.join(firsts.where("n_texts > 1").select("text_key"), "text_key", "left_semi")
    apart = mixed.join(mixed.groupBy("text_key", "text").agg(F.min("doc_id").alias("_own")), ["text_key", "text"]).groupBy("doc_id", "text_key").agg(F.min("_own").alias("_own"))
    own = F.when(F.col("n_texts") > 1, F.col("_own")).otherwise(F.col("first"))
    return plain.join(apart, ["doc_id", "text_key"], "left").withColumn("mask", F.col("mask").bitwiseOR(later(own)))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bits of the filters A to E that the document fails), a row for each row of ``docs`` (doc_id, text, source).

    Null texts are empty, null sources the empty part. A row without doc_id is no copy of another and has none.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    scan, texts = scanned(plain), plain.select("doc_id", "text_key", "text")
    return marked(scan, texts, first_copies(texts, refined(scan))).select("doc_id", "part", "mask")


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic documents of each part and mask. A doc_id with several labels has each mark that one of them gives it."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    return masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps() -> Column:
    """All orders and steps, 600, as one constant: the order, the step, its filter's bit and the bits of those before."""
    found = []
    for order in permutations(LETTERS):
        before = 0
        for i, letter in enumerate(order):
            found.append({"o": "".join(order), "s": i + 1, "bit": 1 << LETTERS.index(letter), "before": before})
            before |= 1 << LETTERS.index(letter)
    return F.from_json(F.lit(json.dumps(found)), "array<struct<o string, s int, bit int, before int>>")


def interactions(counted: DataFrame) -> DataFrame:
    """A row for each part, order and step from the cells of ``counted`` (part, mask, n, good, toxic)."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_cells"))  # 32 at most
    each = parts.select("part", "_cells", F.explode(_steps()).alias("x"))
    bit, before = F.col("x.bit"), F.col("x.before")
    total = lambda test, value: F.aggregate(F.filter("_cells", test), F.lit(0).cast("bigint"), lambda s, c: s + value(c))
    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    removed = lambda c: has(c, bit) & ~has(c, before)
    # of the 120 orders, one in as many as the filters that a document fails has a given one of these first
    share = lambda c: c["n"] * (F.lit(120).cast("bigint") / F.greatest(F.bit_count(c["mask"]), F.lit(1))).cast("bigint")
    return each.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total(lambda c: ~has(c, before.bitwiseOR(bit)), lambda c: c["n"]).alias("kept"), total(removed, lambda c: c["n"]).alias("removed"),
        total(lambda c: has(c, bit) & has(c, before), lambda c: c["n"]).alias("redundant"), total(lambda c: c["mask"] == bit, lambda c: c["n"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"), total(lambda c: has(c, bit), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(cells(masks(docs), labels))
