"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens in chunks of a few MB. A chunk keeps its pre-tokens as positions into the
chunk's own word list; the words alone are exploded by hash bucket and shuffled, so every distinct word
of the corpus is encoded once, in one task. The ids go back to the chunks by a join and are laid out by
position. Decoding looks each id up in the table of token bytes.

The texts are cut twice, once for the words and once for the positions, rather than stored: that halves
the disk. A chunk's key holds its partition, its number and a hash of its pre-tokens, so a source whose
rows change places between two reads is an error and never wrong ids; write such a source to files first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import as_binary, blocks, mix64, numbered, quoted, span_hashes

#: The pattern whose matches are found without a regular expression engine (a fixed value).
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a chunk; one longer text is a chunk alone.
CHUNK_BYTES = 4 << 20

_OTHER, _LETTER, _NUMBER, _BLANK = range(4)
_memo: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _memo:
        import regex

        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
            for run in regex.findall(name, every):
                table[ord(run[0]) : ord(run[-1]) + 1] = kind
        _memo["classes"] = table
    return _memo["classes"]


def _compiled(pattern: str):
    if pattern not in _memo:
        import regex

        # white space is the Unicode property here, as in the library whose ids are matched
        _memo[pattern] = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return _memo[pattern]


def pretoken_starts(texts: list[str], pattern: str = KNOWN_PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """(whether a pre-token starts at each code point of the joined texts, the code points)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    bound = np.cumsum([0, *map(len, texts)])
    begins = np.zeros(len(points) + 1, bool)
    begins[bound] = True
    starts = np.zeros(len(points), bool)
    special = range(len(texts))
    if pattern == KNOWN_PATTERN and len(points):
        kind = _classes()[points]
        starts[1:] = kind[1:] != kind[:-1]
        # the last of the white space before other text is a pre-token's start; a plain space is that text's own
        last = np.flatnonzero(starts[1:] & (kind[:-1] == _BLANK) & ~begins[1:-1])
        starts[last] = True
        starts[last[points[last] == 32] + 1] = False
        starts |= begins[:-1]
        quotes = np.flatnonzero(points == 39)
        special = np.unique(np.searchsorted(bound, quotes, "right") - 1).tolist()
        special = [i for i in special if any(f"'{x}" in texts[i] for x in ("s", "t", "re", "ve", "m", "ll", "d"))]
    for i in special:
        starts[bound[i] : bound[i + 1]] = False
        size = np.array([len(x) for x in _compiled(pattern).findall(texts[i])], np.int64)
        starts[bound[i] + np.cumsum(size) - size] = True
    return starts, points


def _packed(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words), 3)


def _unpacked(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n)) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


_CHUNKS = "chunk string, bucket int, n int, payload binary, doc_ids array<bigint>, counts array<bigint>, buckets binary"


def _chunks(pattern: str, buckets: int, chunk_bytes: int, positions: bool):
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def chunk_rows(texts: list[str], doc_ids: list[int | None], chunk: str) -> list[tuple]:
        starts, points = pretoken_starts(texts, pattern)
        width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        data = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)
        at = np.flatnonzero(starts)
        byte = (np.cumsum(width, dtype=np.int32) - width)[at]
        del width, points, starts
        ends = np.append(byte[1:], len(data))
        size = ends - byte
        bound = np.cumsum([0, *map(len, texts)])
        counts = np.diff(np.searchsorted(at, bound))
        if not len(at):
            return [(chunk, None, 0, b"", doc_ids, counts.tolist(), b"")] if positions else []
        hashes, head = span_hashes(data, byte, ends)
        chunk += f"-{int(hashes.sum()):x}"
        _, index, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        same = (head == head[index][inverse]) & (size == size[index][inverse])
        large = np.flatnonzero(size > 8)  # beyond the first eight bytes an independent hash tells words apart
        other = np.zeros(len(at), np.uint64)
        if len(large):
            other[large] = span_hashes(data, byte[large], ends[large], 1)[0]
        if not (same & (other == other[index][inverse])).all():
            seen: dict[bytes, int] = {}
            raw = data.tobytes()
            hashes = mix64(np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(byte.tolist(), ends.tolist())], np.uint64))
            _, index, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small positions
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        index = index[order]
        bucket = (hashes[index] % np.uint64(buckets)).astype(np.uint16)
        if positions:
            planes = rank[inverse].astype("<u4").view(np.uint8).reshape(-1, 4).T
            return [(chunk, None, len(at), zstandard.compress(planes.tobytes(), 3), doc_ids, counts.tolist(), zstandard.compress(bucket.tobytes(), 3))]
        rows, raw = [], data.tobytes()
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by])) + 1
        for own in np.split(by, cuts):
            words = [raw[a:b] for a, b in zip(byte[index[own]].tolist(), ends[index[own]].tolist())]
            rows.append((chunk, int(bucket[own[0]]), len(words), _packed(words), None, None, None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _CHUNKS.split(", ")]
        partition, seen, texts, doc_ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen, texts, doc_ids, held
            rows = chunk_rows(texts, doc_ids, f"{partition}-{seen}")
            seen, texts, doc_ids, held = seen + 1, [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for part in blocks(batch, limit=1 << 18):
                more = [t or "" for t in part.column("text").to_pylist()]
                size = len(as_binary(part.column("text"))[1])
                if texts and held + size > chunk_bytes:
                    yield from flush()
                texts += more
                doc_ids += part.column("doc_id").to_pylist()
                held += size
        if texts:
            yield from flush()

    return run


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoding(path: str, pattern: str):
    if ("encoding", path) not in _memo:
        import tiktoken

        _memo["encoding", path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _memo["encoding", path]


def _ids_of(words: list[bytes], known: dict[bytes, bytes], encoding) -> list[bytes]:
    """The ids of each word. Words that are not known are encoded and kept; the others cost a look-up each, however many are known."""
    for w in words:
        if w not in known:
            known[w] = np.array(encoding.encode_ordinary(w.decode("utf-8")), "<u4").tobytes()
    return [known[w] for w in words]


def encode(docs: DataFrame, ranks: str, pattern: str = KNOWN_PATTERN, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and ids (array of int) of every row's text.

    Null and empty texts give an empty array; null or repeated doc_ids stay as they are, a row each;
    columns other than doc_id and text are not read. ``ranks``: a file of ranks on every worker.
    ``buckets``: the distinct words are dealt to so many hash buckets.
    """
    spark = docs.sparkSession
    n = buckets or min(4096, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    words, places = (docs.select("doc_id", "text").mapInArrow(_chunks(pattern, n, chunk_bytes, p), _CHUNKS) for p in (False, True))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known = _encoding(ranks, pattern), {}
        for batch in batches:
            out = []
            for blob, count in zip(batch.column("payload").to_pylist(), batch.column("n").to_pylist()):
                ids = _ids_of(_unpacked(blob, count), known, encoding)
                raw = np.frombuffer(b"".join(ids), "<u4")
                wide = raw.astype("<u2" if len(raw) == 0 or raw.max() < 1 << 16 else "<u4")
                out.append(bytes([wide.itemsize]) + zstandard.compress(np.array([len(i) // 4 for i in ids], "<u4").tobytes() + wide.tobytes(), 3))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), batch.column("n"), pa.array(out, pa.binary())], ["chunk", "bucket", "n", "ids"])

    coded = (
        words.select("chunk", "bucket", "n", "payload").repartition("bucket")
        .mapInArrow(encode_words, "chunk string, bucket int, n int, ids binary")
        .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "ids")).alias("coded"))
    )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                counts = np.array(row["counts"], np.int64)
                flat, ends = _laid_out(row, counts)
                for k in range(0, len(counts), 1024):
                    e = ends[k : k + 1025]
                    ids = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(flat[e[0] : e[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][k : k + 1024], pa.int64()), ids], ["doc_id", "ids"])

    positions = places.select("chunk", F.col("n").alias("n_positions"), "payload", "doc_ids", "counts", "buckets")
    return positions.join(coded, "chunk", "left").mapInArrow(lay_out, "doc_id bigint, ids array<int>")


def _laid_out(row: dict, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's documents and where each document's ids end (from 0 on)."""
    n = row["n_positions"]
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(counts) + 1, np.int64)
    planes = np.frombuffer(zstandard.decompress(row["payload"]), np.uint8).reshape(4, n)
    position = np.ascontiguousarray(planes.T).view("<u4").ravel()
    bucket = np.frombuffer(zstandard.decompress(row["buckets"]), np.uint16)
    order = np.argsort(bucket, kind="stable")
    sizes, ids = [], []
    for part in sorted(row["coded"] or [], key=lambda c: c["bucket"]):
        raw = zstandard.decompress(part["ids"][1:])
        sizes.append(np.frombuffer(raw, "<u4", part["n"]))
        ids.append(np.frombuffer(raw, f"<u{part['ids'][0]}", offset=4 * part["n"]))
    if sum(map(len, sizes)) != len(bucket):
        raise ValueError("a chunk's words did not all come back: the source's rows changed places, write it to files first")
    size_in_order, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
    size, begin = np.empty_like(size_in_order), np.empty_like(size_in_order)
    size[order] = size_in_order
    begin[order] = np.cumsum(size_in_order) - size_in_order
    each = size[position]
    done = np.cumsum(each)
    out = flat[np.arange(done[-1]) + np.repeat(begin[position] - (done - each), each)]
    return out, np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(counts)])]


def _as_list(ids: pa.Scalar) -> list[int]:
    return ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []


def decode(encoded: DataFrame, ranks: str, digest: bool = False) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, by the table of token bytes. Null ids give empty bytes.

    ``digest``: instead of ids and bytes, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256.
    """
    kept = [c for c in encoded.columns if c not in ("decoded", *(("ids", "n_tokens", "ids_sha256", "decoded_sha256") if digest else ()))]
    plain = numbered(encoded, "ids")
    own = [p for c, p in zip(encoded.columns, plain.columns) if c in kept]
    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, decimal = _table(ranks)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = list(map(_as_list, part.column("ids")))
                decoded = [b"".join(map(table.__getitem__, i)) for i in ids]
                out = [pa.array(decoded, pa.binary())]
                if digest:
                    shown = (",".join(map(decimal.__getitem__, i)).encode() for i in ids)
                    out = [pa.array(map(len, ids), pa.int64()), pa.array([sha256(s).hexdigest() for s in shown], pa.string()), pa.array([sha256(d).hexdigest() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *out], [*kept, *(m.split(" ")[0] for m in more.split(", "))])

    schema = T.StructType([*encoded.select(*map(quoted, kept)).schema, *T.StructType.fromDDL(more)])
    return plain.mapInArrow(run, schema)


def _table(path: str) -> tuple[list[bytes], list[str]]:
    """Bytes and decimal form of every id."""
    if ("table", path) not in _memo:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _memo["table", path] = table, list(map(str, range(len(table))))
    return _memo["table", path]
