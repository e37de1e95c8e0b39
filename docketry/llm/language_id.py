"""Language identification by cross-parsing: the language whose labelled text explains a text in the fewest phrases.

The suffix automaton of a language's sample has a path for every part of it. A text is cut into phrases, each the
longest that the sample holds somewhere; a letter that it never holds is a phrase alone. A phrase costs the bits
that name a place in the sample, so samples of different sizes compare: phrases times log2 of the sample's length.

The automaton becomes a table of states and signs, with a failed step leading to where the next phrase stands
after its first sign, so that parsing is one look-up a sign. Texts are parsed whole, in segments of a fixed number
of signs that begin a phrase of their own; all segments of a block of texts step side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import as_binary, blocks, fresh, numbered

#: Labelled rows of a language that a fit takes at most (those with the smallest hash), and the characters of each:
#: of a longer text, a stretch at a place given by the hash.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 512
#: Cells of all languages' tables together at most (four bytes each); samples are cut to stay within them.
CELLS = 1 << 24
#: Signs of a text that are parsed in one piece.
SEGMENT = 512
#: A text's last segment is filled up with this sign, and all bytes that no sample has are this one.
_FILL, _OTHER = 0, 1

UNKNOWN = "und"

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: What is neither a letter nor a byte of a character beyond ASCII counts as a space.
_LOW[[i for i in range(128) if not chr(i).isalpha()]] = 32


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see; those without doc_id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def signs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes): ASCII letters in lower case, other ASCII as spaces, a run of spaces as one."""
    at, data = as_binary(column)
    low = _LOW[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[at[:-1][at[:-1] < len(low)]] = True
    return np.concatenate([[0], np.cumsum(keep)])[at], low[keep]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton with a path for every part of ``text``; state 0 begins."""
    step, link, length, last = [{}], [-1], [0], 0
    for sign in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and sign not in step[at]:
            step[at][sign] = new
            at = link[at]
        if at >= 0:
            target = step[at][sign]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:  # the parts that end here also end elsewhere, with less before them
                twin = len(step)
                step.append(dict(step[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(sign) == target:
                    step[at][sign] = twin
                    at = link[at]
                link[target] = link[new] = twin
        last = new
    return step


@dataclass
class Model:
    """``table``: for state * width + sign class the next state * width, below 0 (by ~) where a phrase begins."""

    languages: list[str]
    table: np.ndarray
    classes: np.ndarray
    width: int
    starts: np.ndarray
    bits: np.ndarray


def fit_samples(samples: dict[str, bytes], cells: int = CELLS) -> Model:
    """A model of each language's sample (bytes as ``signs`` gives them)."""
    languages = sorted(name for name, text in samples.items() if text)
    classes = np.full(256, _OTHER, np.uint8)
    seen = np.unique(np.frombuffer(b"".join(samples[x] for x in languages), np.uint8))
    classes[seen] = np.arange(len(seen)) + 2
    width, tables, starts, total = len(seen) + 2, [], [], 0
    most = max(64, cells // (2 * width * max(1, len(languages))))  # an automaton has two states a sign at most
    for name in languages:
        automaton = suffix_automaton(samples[name][:most])
        table = np.full((len(automaton), width), -1, np.int64)
        for state, steps in enumerate(automaton):
            if steps:
                table[state, classes[list(steps)]] = list(steps.values())
        table = np.where(table >= 0, table + total, -1)
        begins = np.where(table[0] >= 0, table[0], total)
        table[1:] = np.where(table[1:] >= 0, table[1:] * width, ~(begins * width)[None, :])
        table[0] = ~(begins * width)
        table[:, _FILL] = total * width
        tables.append(table.astype(np.int32))
        starts.append(total * width)
        total += len(automaton)
    sizes = np.array([min(len(samples[x]), most) for x in languages], float)
    return Model(languages, np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32), classes, width, np.array(starts, np.int64), np.log2(sizes + 1))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from text and lang of rows that are not held out: at most ``sample_rows`` of a language, the same at any size of the corpus.

    What comes to the driver is bounded by the number of languages; each task keeps so many rows of a language before any shuffle.
    """
    from pyspark.sql import Window

    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    hashed = known.select("lang", "doc_id", F.xxhash64("text").alias("_h"), "text")
    place = F.lit(1) + F.pmod("_h", F.greatest(F.length("text") - sample_chars + 1, F.lit(1)))
    cut = hashed.select("lang", F.xxhash64("doc_id", "_h").alias("_order"), F.col("text").substr(place.cast("int"), F.lit(sample_chars)).alias("piece"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "piece"))).where(F.col("_rank") <= sample_rows)
    pieces: dict[str, list[str]] = {}
    for r in ranked.select("lang", "piece", "_rank").orderBy("lang", "_rank").toLocalIterator():
        pieces.setdefault(r.lang, []).append(r.piece)
    return fit_samples({lang: signs(pa.array([" ".join(parts)]))[1].tobytes() for lang, parts in pieces.items()})


def phrases(model: Model, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Number of phrases (rows x languages) of the texts data[at[i]:at[i + 1]]."""
    rows, n_languages = len(at) - 1, len(model.languages)
    count = -(-np.diff(at) // SEGMENT)
    row = np.repeat(np.arange(rows), count)
    if not len(row):
        return np.zeros((rows, n_languages), np.int64)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = at[row] + number * SEGMENT
    size = np.minimum(at[row + 1] - start, SEGMENT)
    longest = int(size.max())
    order = np.argsort(-size, kind="stable")  # short segments come last and leave early
    ending = np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1]  # segments with so many signs at least
    line = np.concatenate([model.classes[data], np.zeros(1, np.uint8)]).astype(np.int32)
    begin = start[order]
    state = np.repeat(model.starts.astype(np.int32)[:, None], len(row), 1)
    found = np.zeros((n_languages, len(row)), np.int32)
    for i in range(longest):
        here = int(ending[i + 1])
        step = model.table[state[:, :here] + line[begin[:here] + i]]
        new = step >> 31  # -1 where a phrase begins
        found[:, :here] -= new
        state[:, :here] = step ^ new
    out = np.zeros((rows, n_languages), np.int64)
    np.add.at(out, row[order], found.T)
    return out


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score; no column but text has a part in them.

    lang_pred: the language whose phrases cost the fewest bits (of equals the first by name); ``und`` with score 0
    for texts that are null or have no letter, or where no language was learned. score: the share of the second
    language's bits in the sum of both, 0.5 for a tie; 1 if one language was learned. Columns of ``docs`` with these names are replaced.
    """
    kept = docs.drop(*names)
    columns, names_of = kept.columns, [*model.languages, UNKNOWN]
    (letter,) = fresh(kept, "letter")
    plain = numbered(kept.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                n, own = part.num_rows, part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(n, len(names_of) - 1), np.zeros(n)
                if model.languages:
                    cost = phrases(model, *signs(part.column("text"))) * model.bits
                    ranked = np.sort(cost, axis=1)
                    best = np.where(own, cost.argmin(1), best)
                    share = ranked[:, 1] / np.maximum(ranked[:, 0] + ranked[:, 1], 1e-9) if len(model.languages) > 1 else np.ones(n)
                    score = np.where(own, share, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([names_of[i] for i in best]), pa.array(score)], [*columns, *names])

    return plain.mapInArrow(run, T.StructType([*kept.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
