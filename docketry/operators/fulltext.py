"""Full-text search with word forms: an inverted index with positions, written by term range, and exact top-k over its blocks.

A text's words are cut at all but letters and digits and lose their endings (``functions/stems.py``). Texts are dealt
out by key and counted in segments, each word of a segment once. Postings are sorted by term and document over range partitions, so a frequent term lies in several, and are packed in blocks with their highest
frequency. A small table of terms says in which parts a term lies; a search reads those parts alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.stems import STOP_WORDS, listed, stem
from docketry.sources.tables import shared_folder, written

#: Documents of a term in one block at most.
BLOCK = 128
#: Bytes of text, in whole documents, whose postings of a word are one row before they are sorted by term.
SEGMENT = 8 << 20
#: What stands between words.
BETWEEN = r"[^\p{L}\p{N}]+"
COUNTED = "word string, segment bigint, docs array<bigint>, counts array<int>, places array<int>"
BLOCKS = "term string, first_doc bigint, last_doc bigint, n int, most int, docs array<bigint>, counts array<int>, places array<array<int>>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def query_terms(spark: SparkSession, query: str, config: str, forms: dict[str, str] | None = None) -> list[str | None]:
    """Stems of the query's words in their order, null for stop words."""
    return spark.range(1).select(F.transform(words(F.lit(query)), lambda w: stem(w, config, forms)).alias("t")).first().t


def matches(text: Column, terms: list[str], config: str, forms: dict[str, str] | None = None) -> Column:
    """Whether a text has every term (stems as ``query_terms`` gives them), by a scan; no terms match nothing."""
    own = F.transform(words(text), lambda w: stem(w, config, forms))
    return F.size(F.array_except(F.array(*map(F.lit, terms)), own)) == 0 if terms else F.lit(False)


@dataclass
class Index:
    spark: SparkSession
    path: str
    config: str
    forms: dict[str, str] | None = None

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS + ", part int").parquet(f"{self.path}/blocks")

    @property
    def terms(self) -> DataFrame:
        """term, docs, occurrences, most and parts."""
        return self.spark.read.schema("term string, docs bigint, occurrences bigint, most int, parts array<int>").parquet(f"{self.path}/terms")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (doc, text) that come by doc, in runs of SEGMENT bytes of text and more (the last may be shorter); all rows of a doc are in one."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        doc, first = rows["doc"].to_numpy(), 0
        begin = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        size = np.concatenate([[0], np.cumsum(pc.binary_length(rows["text"]).to_numpy().astype(np.int64))])
        while (i := np.searchsorted(size[begin], size[first] + SEGMENT)) < len(begin):
            yield rows.slice(first, begin[i] - first)
            first = begin[i]
        held = rows.slice(first)
    if held is not None and held.num_rows:
        yield held


def _counted(stops: list[str]):
    """A mapInArrow function: rows (doc, words with one blank between them) by doc to a row for each segment and word that is no stop word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = pa.array(["", *stops], pa.string())
        for rows in _segments(batches):
            doc = rows["doc"].to_numpy()
            split = pc.split_pattern(rows["text"].combine_chunks(), " ")
            split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
            at, found = split.offsets.to_numpy(), split.flatten().dictionary_encode()
            code, row = found.indices.to_numpy(), np.repeat(np.arange(len(doc)), np.diff(at))
            so_far = np.concatenate([[0], np.cumsum((pc.binary_length(found.dictionary).to_numpy() > 0)[code])])  # words, not the empty texts about blanks
            place = so_far[:-1] - so_far[at[:-1]][row]
            keep = np.flatnonzero(~pc.is_in(found.dictionary, left_out).to_numpy(zero_copy_only=False)[code])
            if not len(keep):
                continue
            code, place, other = code[keep], place[keep], np.concatenate([[True], doc[1:] != doc[:-1]])
            number = (np.cumsum(other) - 1)[row[keep]]
            if other.all():  # they come by text and place
                order = np.sort(code.astype(np.int64) << 32 | np.arange(len(code))) & 0xFFFFFFFF
            else:  # a key with several texts
                order = np.lexsort((place, number, code))
            code, place, number = code[order], place[order], number[order]
            posting = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (number[1:] != number[:-1])]))
            word = np.flatnonzero(np.concatenate([[True], code[posting][1:] != code[posting][:-1]]))
            bounds = pa.array(np.append(word, len(posting)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    found.dictionary.take(pa.array(code[posting][word])), pa.array(np.full(len(word), doc[0])), pa.ListArray.from_arrays(bounds, pa.array(doc[other][number[posting]])),
                    pa.ListArray.from_arrays(bounds, pa.array(np.diff(np.append(posting, len(code))).astype(np.int32))), pa.ListArray.from_arrays(pa.array(np.append(posting[word], len(code)), pa.int32()), pa.array(place.astype(np.int32))),
                ],
                ["word", "segment", "docs", "counts", "places"],
            )

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows (term, segment, ...) in runs; all rows of a term in a segment, its word forms, are in one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        other = pc.or_(pc.not_equal(rows["term"], rows["term"][-1]), pc.not_equal(rows["segment"], rows["segment"][-1])).to_numpy()
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None:
        yield held


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows (term, segment, docs, counts, places of all docs); a term's run may go on in the next batch, as another block."""
    for rows in _whole(batches):
        term, listed, docs, counts, places = (rows[c].combine_chunks() for c in ("term", "docs", "docs", "counts", "places"))
        code = np.repeat(term.dictionary_encode().indices.to_numpy(), np.diff(listed.offsets.to_numpy()))
        first = np.repeat(np.arange(len(term)), np.diff(listed.offsets.to_numpy()))
        docs, counts, places = (x.flatten().to_numpy() for x in (docs, counts, places))
        if not np.all((code[1:] > code[:-1]) | (docs[1:] > docs[:-1])):  # forms of a word are one posting of a document
            order = np.lexsort((docs, code))
            code, docs, first, own = code[order], docs[order], first[order], counts[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (docs[1:] != docs[:-1])])
            moved = np.repeat((np.cumsum(counts) - counts)[order] - (np.cumsum(own) - own), own) + np.arange(len(places))
            places = (np.sort(np.repeat(np.cumsum(new) - 1, own) << 32 | places[moved]) & 0xFFFFFFFF).astype(np.int32)
            counts, code, docs, first = np.add.reduceat(own, np.flatnonzero(new)).astype(np.int32), code[new], docs[new], first[new]
        run = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        length = np.diff(np.append(run, len(code)))
        # the places at which a block begins: every BLOCK-th of each run
        pieces = -(-length // BLOCK)
        cut = np.repeat(run, pieces) + BLOCK * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.append(cut[1:], len(code))
        bounds = pa.array(np.append(cut, len(code)), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(bounds, values)
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(places))
        yield pa.RecordBatch.from_arrays(
            [term.take(pa.array(first[cut])), pa.array(docs[cut]), pa.array(docs[ends - 1]), pa.array((ends - cut).astype(np.int32)), pa.array(np.maximum.reduceat(counts, cut)), lists(pa.array(docs)), lists(pa.array(counts)), lists(each)],
            ["term", "first_doc", "last_doc", "n", "most", "docs", "counts", "places"],
        )


def build(docs: DataFrame, key: str, text: str, config: str = "simple", path: str | None = None, forms: dict[str, str] | None = None) -> Index:
    """An index of whole texts, stored under ``path`` (a folder of its own below the shared one if None).

    ``key`` is a whole number, one text each; rows without it are left out, null texts have no words. Of a key with
    several texts, all words are that key's. Positions count words from 0, stop words among them. ``forms``: the
    words that are forms of some stems, where a list and not the rules says so (``stems.stem``).
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/fulltext-{uuid.uuid4().hex}"
    stops = STOP_WORDS["english"] + STOP_WORDS["russian"] * (config == "russian") if config != "simple" else []
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), BETWEEN, " ").alias("text")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    # all texts of a key are in one part; a row for each word of a segment, not for each word of a text, is stemmed and moved
    counted = rows.repartitionByRange("doc").sortWithinPartitions("doc").select("doc", plain).mapInArrow(_counted(stops), COUNTED)
    # stored, since the range shuffle samples its input before it reads it
    stemmed = counted.withColumn("term", stem(F.col("word"), config))
    if forms:
        stemmed = stemmed.withColumn("term", listed(F.col("word"), F.col("term"), forms))
    postings = written(stemmed.select("term", "segment", "docs", "counts", "places"))
    sorted_ = postings.repartitionByRange("term", "segment").sortWithinPartitions("term", "segment")
    packed = sorted_.mapInArrow(_packed, BLOCKS).withColumn("part", F.spark_partition_id())
    packed.write.partitionBy("part").parquet(f"{path}/blocks")
    index = Index(spark, path, config, forms)
    # n_parts of a term are at most all parts; a term's row is small
    terms = index.blocks.groupBy("term").agg(F.sum("n").cast("bigint").alias("docs"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("occurrences"), F.max("most").alias("most"), F.sort_array(F.collect_set("part")).alias("parts"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return index


def _found(index: Index, terms: list[str]) -> tuple[list, DataFrame]:
    """Rows of the terms' table, and the blocks of the terms from the parts in which they lie."""
    rows = index.terms.where(F.col("term").isin(terms)).collect()  # a row for each term of the query
    parts = sorted({p for r in rows for p in r.parts})
    return rows, index.blocks.where(F.col("part").isin(parts) & F.col("term").isin(terms))


def _postings(blocks: DataFrame) -> DataFrame:
    """term, doc, count and places of each document of the blocks."""
    return blocks.select("term", F.explode(F.arrays_zip("docs", "counts", "places")).alias("x")).select("term", F.col("x.docs").alias("doc"), F.col("x.counts").alias("count"), F.col("x.places").alias("places"))


def _scored(postings: DataFrame, n: int) -> DataFrame:
    """doc and score (occurrences of all terms) of the documents that have all n terms."""
    both = postings.groupBy("doc").agg(F.sum("count").cast("bigint").alias("score"), F.count("*").alias("_n"))
    return both.where(F.col("_n") == n).drop("_n")


def search(index: Index, query: str, k: int | None = None) -> DataFrame:
    """doc and score of the documents that have every word of ``query`` in some form; the best k, of equals the smaller doc.

    For the best k, blocks of the rarest term come by their bound: their highest frequency and that of the other
    terms anywhere. The first blocks that hold 2 k documents give a score that k documents reach (if so many match);
    of the rest only blocks whose bound is as high are read. Nothing that could be among the best is left out.
    """
    terms = sorted({t for t in query_terms(index.spark, query, index.config, index.forms) if t is not None})
    rows, blocks = _found(index, terms)
    if len(rows) < len(terms) or not terms:
        return index.spark.createDataFrame([], "doc bigint, score bigint")
    if k is None:
        return _scored(_postings(blocks), len(terms))
    rare = min(rows, key=lambda r: (r.docs, r.term))
    others = sum(r.most for r in rows) - rare.most
    own = blocks.where(F.col("term") == rare.term)
    bounds = own.groupBy((F.col("most") + others).alias("bound")).agg(F.sum("n").alias("n"))  # a row for each frequency
    first, so_far = None, 0
    for r in bounds.orderBy(F.desc("bound")).toLocalIterator():
        first, so_far = r.bound, so_far + r.n
        if so_far >= 2 * k:
            break
    order = [F.desc("score"), F.asc("doc")]

    def best(least: int) -> DataFrame:
        """The best of the blocks with so high a bound; the other terms' documents are met by the rare one's."""
        chosen = _postings(own.where(F.col("most") + others >= least))
        rest = _postings(blocks.where(F.col("term") != rare.term)).join(chosen.select("doc"), "doc", "left_semi")
        return _scored(chosen.unionByName(rest), len(terms)).orderBy(*order).limit(k)

    reached = best(first).collect()  # k rows at most
    least = reached[-1].score if len(reached) == k else 0
    return best(least) if least < first else index.spark.createDataFrame(reached, "doc bigint, score bigint")


def phrase(index: Index, query: str) -> DataFrame:
    """doc and n: how often the words of ``query`` stand one after another in it, in any form; stop words hold any word's place."""
    terms = query_terms(index.spark, query, index.config, index.forms)
    wanted = [(t, i) for i, t in enumerate(terms) if t is not None]
    rows, blocks = _found(index, sorted({t for t, _ in wanted}))
    if not wanted or len(rows) < len({t for t, _ in wanted}):
        return index.spark.createDataFrame([], "doc bigint, n bigint")
    offsets = F.create_map(*(F.lit(x) for t in {t for t, _ in wanted} for x in (t, [i for u, i in wanted if u == t])))
    starts = _postings(blocks).select("doc", F.explode(F.element_at(offsets, F.col("term"))).alias("_at"), "places").select("doc", F.explode(F.transform("places", lambda p: p - F.col("_at"))).alias("start"))
    hits = starts.groupBy("doc", "start").agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted))
    return hits.groupBy("doc").agg(F.count("*").alias("n"))
