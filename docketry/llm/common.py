"""Helpers that the training-data operators share.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir`` so that a lost
executor never takes them along; text is handled in Arrow batches inside tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once (one longer text is taken alone).
BLOCK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docketry-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docketry-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, whole rows only."""
    at, _ = as_binary(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def by_blocks(make: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES):
    """A mapInArrow function that applies ``make`` to bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column, limit):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return run


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well mixed 64-bit value for each 64-bit value."""
    return _mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SIZE = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first eight bytes as a number) of the byte spans of ``data``; no span is empty.

    Every eight bytes are mixed with their place before they are added up, so no choice of letters makes the
    hashes of different spans meet other than by chance. Another ``seed`` gives an independent hash.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    head = lanes[start] & _HEAD[np.minimum(size, 8)]
    out = mix64(head, seed)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        begin = np.cumsum(more) - more
        number = np.arange(int(more.sum()), dtype=np.int64) - np.repeat(begin, more) + 1
        place = np.repeat(start[long], more) + 8 * number
        lane = lanes[place] & _HEAD[np.minimum(np.repeat(end[long], more) - place, 8)]
        out[long] += np.add.reduceat(mix64(lane ^ mix64(number.astype(np.uint64), seed + 1)), begin)
    return _mix(out + size.astype(np.uint64) * _SIZE), head


def factors(n: int) -> np.ndarray:
    """Fixed odd numbers that have nothing to do with each other."""
    return mix64(np.arange(n, dtype=np.uint64), 3) | np.uint64(1)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column of texts: byte spans and rows' word ranges.

    ``start``/``end``: byte span of each word in ``data``; ``first[i]:first[i + 1]``: words of row i.
    """

    def __init__(self, column: pa.Array, lower: bool = False, dividers: np.ndarray | None = None):
        """``dividers``: 256 flags of the bytes between words, white space if None."""
        self.at, data = as_binary(column)
        self.data = _LOWER[data] if lower else data
        space = (_SPACE if dividers is None else dividers)[data]
        word = ~space
        before = np.ones(len(data) + 1, bool)
        before[1:] = space
        before[self.at] = True  # a text's first byte begins a word
        after = np.ones(len(data), bool)
        after[:-1] = space[1:]
        after[self.at[self.at > 0] - 1] = True
        self.start = np.flatnonzero(word & before[:-1])
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, prefix: int | None = None, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return span_hashes(self.data, self.start, end, seed)[0]

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; the last k - 1 places are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, factor in enumerate(factors(k)):
        out += words[i : i + n] * factor
    return mix64(out, k)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def text_key(column: str = "text"):
    """A key that tells apart rows with one doc_id and different texts."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def quoted(column: str) -> str:
    """A column's name as one identifier, whatever signs it has."""
    return "`" + column.replace("`", "``") + "`"


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, longer where ``docs`` has columns of that name in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with plain names for all columns but ``keep``, as functions over Arrow batches want them."""
    return docs.toDF(*(c if c in keep else f"c{i}" for i, c in enumerate(docs.columns)))
