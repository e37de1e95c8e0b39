"""Substring deduplication by super-k-mers.

A text's windows of ``window`` words are grouped by minimiser, the least hash among the runs of ``seed``
words in a window: consecutive windows that share it travel as one packed string to the minimiser's bucket.
Equal windows have equal minimisers, so buckets with a single document hold no repeat and drop out before
any text moves. In a bucket the windows of its distinct strings are sorted, which gives each window's
smallest doc_id exactly. Buckets with many distinct strings, or with many bytes of windows, are dealt out:
their windows are packed by parts of the key space, a part's minima are merged and looked up, so that no
bucket is one task's work. A text of one repeated word has one minimiser; its super-k-mer is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import Words, as_binary, blocks, by_blocks, gram_hashes, materialize, sliding_min, text_key

WINDOW = 50
#: Words in the runs among which a window's minimiser is chosen.
SEED = 6
#: Distinct strings from which on a bucket is taken apart.
LARGE_BUCKET = 256
#: Bytes of all windows of a bucket, each counted whole, from which on it is taken apart.
LARGE_BYTES = 1 << 24
#: A part of a large bucket has the windows of about so many times LARGE_BUCKET strings, or LARGE_BYTES.
PART = 4
#: Windows in a super-k-mer, at most.
LONGEST = 1024


def super_k_mers(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, first word in the row, windows, minimiser) of every super-k-mer of a block."""
    hashes = words.hashes()
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    least = sliding_min(gram_hashes(hashes, seed), window - seed + 1)
    row = words.row_of_word()
    inside = row[: len(least)] == row[window - 1 :]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
    start = np.flatnonzero(fresh)
    stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~fresh[1:], False)) + 1
    n = stop - start
    pieces = -(-n // LONGEST)
    at = np.repeat(np.arange(len(n)), pieces)
    skip = (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
    return row[start][at], (start - words.first[row[start]])[at] + skip, np.minimum(n[at] - skip, LONGEST), least[start].view(np.int64)[at]


def _keys(window: int, seed: int):
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        row, _, _, least = super_k_mers(Words(part.column("text")), window, seed)
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(least), pa.array(doc)], ["minimiser", "doc_id"])

    return by_blocks(one)


def _occurrences(window: int, seed: int):
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        row, start, n, least = super_k_mers(Words(part.column("text")), window, seed)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(least), part.column("doc_id").take(take), part.column("text_key").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["minimiser", "doc_id", "text_key", "start", "n"])

    return by_blocks(one)


def _hex(words: list[bytes]) -> str:
    return sha256(b" ".join(words)).hexdigest()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts without a candidate become results; the others keep their text."""
    for batch in batches:
        for part in blocks(batch):
            at, raw = as_binary(part.column("text"))
            data, open_ = raw.tobytes(), part.column("runs").is_valid().to_pylist()
            split = [data[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            kept = pa.array([None if o else b" ".join(w) for o, w in zip(open_, split)], pa.binary()).cast(pa.string())
            texts = pa.array([b" ".join(w) if o else None for o, w in zip(open_, split)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(w) for w in split], pa.int64()), kept, texts, part.column("runs")], ["doc_id", "text_key", "n_words", "kept", "text", "runs"])


_RUNS = "array<struct<start:int,n:int,minimiser:bigint>>"


def _strings(window: int, with_string: bool):
    """The packed string of each candidate super-k-mer, or where it stands and its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=1 << 19):
                out = []
                for doc, key, text, runs in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "runs"))):
                    words = text.encode().split(b" ")
                    for r in runs:
                        string = b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1])
                        name = blake2b(string, digest_size=16).digest()
                        out.append((r["minimiser"], name, string.decode(), doc, len(string) * min(r["n"], window)) if with_string else (name, doc, key, r["start"]))
                if not out:
                    continue
                kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()] if with_string else [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
                names = ["minimiser", "name", "string", "doc_id", "size"] if with_string else ["name", "doc_id", "text_key", "start"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _windows(string: str, window: int) -> Iterator[bytes]:
    data = string.encode()
    words = data.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    begins = [0, *ends[:-1]]
    return (data[begins[i] : ends[i + window - 1] - 1] for i in range(len(words) - window + 1))


def _encoded(values: list[int]) -> list[dict]:
    return [{"n": len(list(g)), "doc_id": v} for v, g in groupby(values)]


def _sorted_buckets(window: int):
    """Sorts the windows of each bucket; the rows of a bucket stand together."""

    def bucket(rows: list[tuple[bytes, str, int]]) -> list[tuple[bytes, list[dict]]]:
        if len(rows) == 1:
            name, string, doc = rows[0]
            return [(name, [{"n": string.count(" ") + 2 - window, "doc_id": doc}])]
        entries = sorted((w, doc, k, i) for k, (_, string, doc) in enumerate(rows) for i, w in enumerate(_windows(string, window)))
        least: list[dict[int, int]] = [{} for _ in rows]
        for _, same in groupby(entries, key=lambda e: e[0]):
            first = None
            for _, doc, k, i in same:
                first = doc if first is None else first
                least[k][i] = first
        return [(name, _encoded([least[k][i] for i in range(len(least[k]))])) for k, (name, _, _) in enumerate(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, str, int]] = []
        current, out = None, []
        kind = pa.list_(pa.struct([("n", pa.int32()), ("doc_id", pa.int64())]))

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([m for _, m in out], kind)], ["name", "least"])

        for batch in batches:
            for minimiser, name, string, doc in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "name", "string", "doc_id"))):
                if minimiser != current and held:
                    out += bucket(held)
                    held = []
                    if len(out) > 5000:
                        yield flushed()
                        out = []
                current = minimiser
                held.append((name, string, doc))
        if held:
            out += bucket(held)
        if out:
            yield flushed()

    return run


def _taken_apart(window: int):
    """Packs the windows of a large bucket's strings by part: keys, doc_ids, and the string and place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for k in range(0, batch.num_rows, 512) for p in blocks(batch.slice(k, 512), "string", 1 << 22)):
                rows = list(zip(*(part.column(c).to_pylist() for c in ("minimiser", "parts", "name", "string", "doc_id"))))
                out = []
                for (minimiser, parts), own in groupby(rows, key=lambda r: r[:2]):
                    own = list(own)
                    digests = [b"".join(blake2b(w, digest_size=16).digest() for w in _windows(r[3], window)) for r in own]
                    keys = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
                    size = [len(d) // 16 for d in digests]
                    which, place = np.repeat(np.arange(len(own)), size).astype("<i4"), np.concatenate([np.arange(n) for n in size]).astype("<i4")
                    docs = np.array([r[4] for r in own], "<i8")[which]
                    to = (keys[:, 0] % np.uint64(parts)).astype(np.int64)
                    names = b"".join(r[2] for r in own)
                    for p in np.unique(to):
                        at = to == p
                        out.append((minimiser, int(p), keys[at].tobytes(), docs[at].tobytes(), names, which[at].tobytes(), place[at].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.binary()] * 5))], ["minimiser", "part", "keys", "docs", "names", "which", "place"])

    return run


def _least_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
    keys, docs = keys[order], docs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(1)
    return keys[fresh], docs[fresh]


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest doc_id of each distinct window of a part; its rows stand together and are merged one by one."""
    name, keys, docs = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([docs.tobytes()], pa.binary())], ["minimiser", "part", "table_keys", "table_docs"])

    for batch in batches:
        for minimiser, part, k, d in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "part", "keys", "docs"))):
            new = np.frombuffer(k, "<u8").reshape(-1, 2), np.frombuffer(d, "<i8")
            if name == (minimiser, part):
                new = np.concatenate([keys, new[0]]), np.concatenate([docs, new[1]])
            elif name is not None:
                yield done()
            name, (keys, docs) = (minimiser, part), _least_of(*new)
    if name is not None:
        yield done()


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name and found (place, smallest doc_id) of the strings of each packed row, from its part's table."""
    held, table = None, {}
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if held != (row["minimiser"], row["part"]):
                held, raw = (row["minimiser"], row["part"]), row["table_keys"]
                table = dict(zip([raw[i : i + 16] for i in range(0, len(raw), 16)], np.frombuffer(row["table_docs"], "<i8").tolist()))
            keys, names = row["keys"], row["names"]
            found: dict[int, list] = {}
            for i, (w, at) in enumerate(zip(np.frombuffer(row["which"], "<i4").tolist(), np.frombuffer(row["place"], "<i4").tolist())):
                found.setdefault(w, []).append({"i": at, "doc_id": table[keys[16 * i : 16 * i + 16]]})
            kind = pa.list_(pa.struct([("i", pa.int32()), ("doc_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([names[16 * w : 16 * w + 16] for w in found], pa.binary()), pa.array(list(found.values()), kind)], ["name", "found"])


def _finished(window: int):
    """Removes the covered words from the texts that have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                words = text.encode().split(b" ") if text else []
                change = np.zeros(len(words) + 1, np.int32)
                for f in found or ():
                    at = f["start"]
                    for part in f["least"]:
                        if part["doc_id"] < doc:
                            change[at] += 1
                            change[at + part["n"] + window - 1] -= 1
                        at += part["n"]
                gone = np.cumsum(change)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc, len(words), int(gone.sum()), b" ".join(kept).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, large_bucket: int = LARGE_BUCKET, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by blanks) for each row.

    A word goes if it is covered by a window of ``window`` words that also starts in a row with a smaller
    doc_id. Texts with fewer words, empty and null texts lose nothing; so do rows without doc_id, which are
    nobody's smaller one. Repeated rows keep a row each; rows with one doc_id and different texts do not
    remove from each other. Other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered = texts.where("doc_id is not null")
    keys = numbered.mapInArrow(_keys(window, seed), "minimiser bigint, doc_id bigint")
    repeated = materialize(keys.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser"))
    found = numbered.withColumn("text_key", text_key()).mapInArrow(_occurrences(window, seed), "minimiser bigint, doc_id bigint, text_key bigint, start int, n int")
    runs = found.join(repeated, "minimiser", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "minimiser")).alias("runs"))

    schema = f"doc_id bigint, text_key bigint, n_words bigint, kept string, text string, runs {_RUNS}"
    joined = texts.withColumn("text_key", text_key()).join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "runs")
    prepared = materialize(joined.mapInArrow(_prepared, schema))
    done = prepared.where("runs is null").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept")
    open_ = prepared.where("runs is not null").select("doc_id", "text_key", "text", "runs")

    strings = open_.mapInArrow(_strings(window, True), "minimiser bigint, name binary, string string, doc_id bigint, size bigint")
    distinct = materialize(strings.groupBy("minimiser", "name", "string").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size")))
    sizes = distinct.groupBy("minimiser").agg(F.count("*").alias("count"), F.sum("size").alias("size")).where((F.col("count") > large_bucket) | (F.col("count") > 1) & (F.col("size") > large_bytes))
    large = materialize(sizes.select("minimiser", F.ceil(F.greatest(F.col("count") / (PART * large_bucket), F.col("size") / (PART * large_bytes))).cast("int").alias("parts")))
    least = "name binary, least array<struct<n:int,doc_id:bigint>>"
    usual = distinct.drop("size").join(large, "minimiser", "left_anti").repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_sorted_buckets(window), least)
    # a large bucket's strings are dealt out; their windows meet by part, first as minima, then to look them up
    dealt = distinct.join(large, "minimiser").withColumn("deal", F.pmod(F.xxhash64("name"), F.col("parts"))).repartition("minimiser", "deal").sortWithinPartitions("minimiser", "deal")
    packed = materialize(dealt.select("minimiser", "parts", "name", "string", "doc_id").mapInArrow(_taken_apart(window), "minimiser bigint, part int, keys binary, docs binary, names binary, which binary, place binary"))
    minima = packed.select("minimiser", "part", "keys", "docs").repartition("minimiser", "part").sortWithinPartitions("minimiser", "part").mapInArrow(_minima, "minimiser bigint, part int, table_keys binary, table_docs binary")
    looked = packed.drop("docs").join(minima, ["minimiser", "part"]).mapInArrow(_looked_up, "name binary, found array<struct<i:int,doc_id:bigint>>")
    split = looked.groupBy("name").agg(F.transform(F.array_sort(F.flatten(F.collect_list("found"))), lambda x: F.struct(F.lit(1).alias("n"), x["doc_id"].alias("doc_id"))).alias("least"))
    places = open_.mapInArrow(_strings(window, False), "name binary, doc_id bigint, text_key bigint, start int")
    hits = places.join(usual.unionByName(split), "name").where(F.exists("least", lambda x: x["doc_id"] < F.col("doc_id")))
    removed = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "least")).alias("found"))
    rest = open_.select("doc_id", "text_key", "text").join(removed, ["doc_id", "text_key"], "left").select("doc_id", "text", "found").mapInArrow(_finished(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return done.unionByName(rest)
