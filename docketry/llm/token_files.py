"""Token-id output: concatenated id arrays whose document boundaries are Elias-Fano coded.

A file is a Parquet table of blocks in the order of doc_id. A block holds the ids of whole documents as
one little-endian array (2 bytes an id where the vocabulary allows, else 4) and the documents' ends as an
Elias-Fano sequence: the low bits of each end, packed, and the high parts as a unary bit string with a
sample of every 256th set bit. ``EliasFano.select`` finds any end from the sample by counting bits, so
no table of 64-bit offsets is kept: an end costs 2 + log2(ids / documents) bits.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import Words, as_binary, blocks, materialize, span_hashes

#: A set bit in so many has its position sampled.
SAMPLE = 256
#: Ids after which a block is closed (one longer document is a block alone).
BLOCK_IDS = 1 << 21
#: Units of text whose ids a worker remembers.
MEMORY = 1 << 20


class EliasFano:
    """A sequence of ascending integers: ``low`` bits packed, ``high`` parts in unary, ``samples`` of set bits."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        width = max(0, int(values[-1] // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width)[None, :]) & 1
        places = (values >> width) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8)).tobytes(), np.packbits(high).tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``: bits are read from the nearest sampled one before the first to that after the last."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return index
        first, last = int(index.min()), int(index.max())
        if first < 0 or last >= self.n:
            raise IndexError(first if first < 0 else last)
        samples, high = np.frombuffer(self.samples, "<u4"), np.frombuffer(self.high, np.uint8)
        behind = last // SAMPLE + 1
        byte = int(samples[first // SAMPLE]) // 8
        stop = int(samples[behind]) // 8 + 1 if behind < len(samples) else len(high)
        places = np.flatnonzero(np.unpackbits(high[byte:stop])) + 8 * byte
        places = places[np.searchsorted(places, samples[first // SAMPLE]) :]
        return ((places[index - first // SAMPLE * SAMPLE] - index) << self.width) | self._low(index, first, last)

    def _low(self, index: np.ndarray, first: int, last: int) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.int64)
        byte = first * self.width // 8
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[byte : ((last + 1) * self.width + 7) // 8])
        place = (index * self.width - 8 * byte)[:, None] + np.arange(self.width)
        return bits[place].astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))


#: The steps before the model that ``WordEncoder`` takes itself (fixed values: those of the public word tokenizer).
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
#: White space is 0; control characters, the apostrophe and every byte of a character beyond ASCII are odd.
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[39] = _ODD
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLOSING = np.zeros(256, bool)
_CLOSING[[*b".,;:!?"]] = True


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans that the tokenizer never joins, and each row's range of them.

    White space ends a unit. A word of printable ASCII without an apostrophe is cut into runs of letters, single
    digits and runs of other signs; of other words only closing marks behind a letter a-z are cut off.
    """
    data, kind = words.data, _CLASS[words.data]
    odd = np.concatenate([[0], np.cumsum(kind == _ODD, dtype=np.int32)])
    whole = odd[words.end] > odd[words.start]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & (kind[1:] != 0)
    if whole.any():
        step = np.zeros(len(data) + 1, np.int8)
        step[words.start[whole]] = 1
        step[words.end[whole]] -= 1
        begins &= np.cumsum(step, dtype=np.int8) == 0
    begins[words.start] = True
    # closing marks of whole words, one more to the left in each round
    at, open_ = words.end[whole].copy(), np.flatnonzero(whole)
    lowest = words.start[whole]
    live = np.arange(len(at))
    while len(live):
        live = live[(at[live] - 1 > lowest[live]) & _CLOSING[data[at[live] - 1]]]
        at[live] -= 1
    cut = at[(at < words.end[open_]) & (kind[at - 1] == _LETTER)]
    begins[cut] = True
    start = np.flatnonzero(begins[:-1])
    word = np.searchsorted(words.start, start, "right") - 1
    end = np.append(start[1:], len(data))
    return start, np.minimum(end, words.end[word]), np.searchsorted(start, words.at)


def _as_written(words: Words, column: pa.Array) -> np.ndarray:
    """The bytes of lower-case words, but for words with a sign beyond ASCII, which stay as they are.

    The library composes letters and marks before it lower-cases them, and some pairs (H and U+0331) have a sign of
    their own in one case only.
    """
    beyond = np.concatenate([[0], np.cumsum(words.data > 127, dtype=np.int64)])
    kept = np.flatnonzero(beyond[words.end] > beyond[words.start])
    if not len(kept):
        return words.data
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.start[kept]] = 1
    step[words.end[kept]] -= 1
    return np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, as_binary(column)[1], words.data)


class UnitTable:
    """Ids of units by hash, size and first bytes, in flat arrays: open addressing, all look-ups of a block at once."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.key, self.head = (np.zeros(1 << 15, np.uint64) for _ in range(2))
        self.size, self.begin, self.count = (np.zeros(1 << 15, np.int64) for _ in range(3))
        self.ids, self.n_ids = np.zeros(1 << 16, self.dtype), 0

    def find(self, key: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each unit; -1: not known."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (key & mask).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            number = self.slots[slot]
            taken = number >= 0
            open_, slot, number = open_[taken], slot[taken], number[taken]
            same = (self.key[number] == key[open_]) & (self.head[number] == head[open_]) & (self.size[number] == size[open_])
            out[open_[same]] = number[same]
            open_, slot = open_[~same], (slot[~same] + 1) & int(mask)
        return out

    def add(self, key: np.ndarray, head: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Units that are not known yet, each once."""
        old, n = self.n, self.n + len(key)
        while n > len(self.key):
            self.key, self.head, self.size, self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.head, self.size, self.begin, self.count))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.key[old:n], self.head[old:n], self.size[old:n], self.count[old:n] = key, head, size, count
        self.begin[old:n] = self.n_ids + np.cumsum(count) - count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = n, self.n_ids + len(ids)
        if 2 * n > len(self.slots):
            self.slots = np.full(4 * len(self.slots) if n < 1 << 18 else 2 << (2 * n).bit_length() - 1, -1, np.int32)
            old = 0
        mask = len(self.slots) - 1
        number = np.arange(old, n, dtype=np.int32)
        slot = (self.key[number] & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several that want a slot one gets it
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & mask


class WordEncoder:
    """Ids of texts from a tokenizers file; each distinct unit of a text goes through the library once and is remembered.

    Units are cut only where the tokenizer's own steps before its model cut; a tokenizer with other steps than
    the known ones gets whole texts, and so do texts that hold one of its special tokens.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = bool(suffix and self.special) and rules["normalizer"] == KNOWN_NORMALIZER and steps[0] == KNOWN_SPLIT and [s["type"] for s in steps[1:]] == ["ByteLevel"]
        if not self.known:
            return
        # between units that stand alone: a special token, which no unit holds
        self.divider, self.divider_id = self.special[0].decode(), rules["added_tokens"][0]["id"]
        # ASCII units are lower-case and single pieces already and need the model only
        self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.closes = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.closes[[i for token, i in rules["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.table = UnitTable(dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learned(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each unit): several hundred units go to the library in a text."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        texts = [b" ".join(found[i : i + 512]).decode() for i in range(0, len(found), 512)]
        for k, got in enumerate(self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            array = np.array(got.ids, self.dtype)
            ends = np.flatnonzero(self.closes[array]) + 1
            own = found[512 * k : 512 * k + 512]
            if len(ends) != len(own):  # a piece inside a unit reads like an end
                each = [np.array(self.bare.encode(u.decode(), add_special_tokens=False).ids, self.dtype) for u in own]
                array, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            ids.append(array)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _learned_alone(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        texts = [self.divider.join(u.decode("utf-8", "replace") for u in found[i : i + 128]) for i in range(0, len(found), 128)]
        for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            array = np.array(got.ids, np.int64)
            divider = array == self.divider_id
            counts.append(np.diff(np.concatenate([[-1], np.flatnonzero(divider), [len(array)]])) - 1)
            ids.append(array[~divider].astype(self.dtype))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end); null texts have none."""
        if not self.known:
            each = [self.whole(t or "") for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.cumsum([len(e) for e in each], dtype=np.int64)
        words = Words(column, lower=True)
        low = words.data.tobytes()
        words.data = _as_written(words, column)
        start, end, first = units(words)
        raw = words.data.tobytes()
        apart = {}
        if any(s.lower() in low for s in self.special):
            for row, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist())):
                if any(s.lower() in low[a:b] for s in self.special):
                    apart[row] = self.whole(column[row].as_py())
            keep = ~np.isin(np.repeat(np.arange(len(first) - 1), np.diff(first)), list(apart))
            start, end = start[keep], end[keep]
            first = np.searchsorted(start, words.at)
        key, head = span_hashes(words.data, start, end)
        size = end - start
        table = self.table
        number = table.find(key, head, size)
        while len(missing := np.flatnonzero(number < 0)):
            new = missing[np.unique(key[missing], return_index=True)[1]]
            if len(new) < table.n < MEMORY < table.n + len(new):
                table.clear()
                number[:] = -1
                continue
            odd = np.concatenate([[0], np.cumsum(_CLASS[words.data] == _ODD, dtype=np.int32)])
            alone = odd[end[new]] > odd[start[new]]
            for own, learn in ((new[~alone], self._learned), (new[alone], self._learned_alone)):
                if len(own):
                    ids, count = learn([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())])
                    table.add(key[own], head[own], size[own], ids, count)
            number[missing] = table.find(key[missing], head[missing], size[missing])
        count = table.count[number]
        done = np.cumsum(count)
        total = int(done[-1]) if len(done) else 0
        ids = table.ids[np.arange(total) + np.repeat(table.begin[number] - (done - count), count)]
        ends = np.concatenate([[0], done])[first[1:]]
        if apart:
            pieces = np.split(ids, ends[:-1])
            pieces = [apart.get(row, piece) for row, piece in enumerate(pieces)]
            ids, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces], dtype=np.int64)
        return ids, ends


_encoders: dict[tuple[str, str], WordEncoder] = {}

_BLOCK = "shard int, shard_start bigint, n_docs int, n_ids bigint, id_bytes int, doc_ids array<bigint>, ids binary, ends_width int, ends_low binary, ends_high binary, ends_samples binary"

_FIELDS = [tuple(f.split(" ")) for f in _BLOCK.split(", ")]
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def write_token_file(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int = 1 << 16, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text and write the blocks in ascending doc_id order; returns the stored table.

    Null texts count as empty: they hold only the end id. The library is called as it stands but without adding
    special tokens: the text of a special token in a document is that token. Null doc_ids come first. Rows with one doc_id
    stand side by side in the order of their texts' hashes; extra columns are not read.
    ``tokenizer``: a tokenizers file on every worker; ``vocabulary``: ids are below it.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    size = int(dtype[-1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((tokenizer, dtype)) or _encoders.setdefault((tokenizer, dtype), WordEncoder(tokenizer, dtype))
        shard, start = TaskContext.get().partitionId(), 0
        doc_ids: list[pa.Array] = []
        pieces: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal start, doc_ids, pieces, sizes, held
            ends = np.cumsum(np.concatenate(sizes))
            code = EliasFano.of(ends)
            ids = pa.array([np.concatenate(pieces).tobytes()], pa.binary())
            names = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.concat_arrays(doc_ids))
            plain = {"shard": shard, "shard_start": start, "n_docs": len(ends), "n_ids": held, "id_bytes": size, "ends_width": code.width, "ends_low": code.low, "ends_high": code.high, "ends_samples": code.samples}
            out = pa.RecordBatch.from_arrays([ids if f == "ids" else names if f == "doc_ids" else pa.array([plain[f]], _KINDS[k]) for f, k in _FIELDS], [f for f, _ in _FIELDS])
            start, doc_ids, pieces, sizes, held = start + held, [], [], [], 0
            return out

        for batch in batches:
            for part in blocks(batch):
                ids, ends = encoder.encode(part.column("text"))
                # the end id behind each text
                n = part.num_rows
                with_end = np.full(len(ids) + n, end_id, dtype)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends, prepend=0))] = ids
                ends = ends + np.arange(1, n + 1)
                row, done = 0, 0
                while row < n:  # a block is closed by the document that fills it
                    to = min(n, int(np.searchsorted(ends, done + block_ids - held)) + 1)
                    doc_ids.append(part.column("doc_id").slice(row, to - row))
                    pieces.append(with_end[done : ends[to - 1]])
                    sizes.append(np.diff(ends[row:to], prepend=done))
                    held += len(pieces[-1])
                    row, done = to, int(ends[to - 1])
                    if held >= block_ids:
                        yield close()
        if pieces:
            yield close()

    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = chosen.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(write, _BLOCK))


def read_token_file(blocks_: DataFrame) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (binary) and id_bytes."""
    totals = blocks_.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    # one row for each shard that was written, not for each document
    before = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, ids = row["id_bytes"], row["ids"]
                code = EliasFano(row["n_docs"], row["ends_width"], row["ends_low"], row["ends_high"], row["ends_samples"])
                base, before_ = row["shard_start"] + row["_base"], 0
                for k in range(0, code.n, 4096):
                    e = code.select(np.arange(k, min(code.n, k + 4096)))
                    s = np.concatenate([[before_], e[:-1]])
                    before_ = int(e[-1])
                    arrays = [
                        pa.array(row["doc_ids"][k : k + 4096], pa.int64()),
                        pa.array(s + base),
                        pa.array(e - s),
                        pa.array([ids[a * size : b * size] for a, b in zip(s.tolist(), e.tolist())], pa.binary()),
                        pa.array([size] * len(s), pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids", "id_bytes"])

    return blocks_.join(before, "shard").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary, id_bytes int")


def ids_checksum(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(i, f"<u{w}").astype("<u4").tobytes()) for i, w in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
