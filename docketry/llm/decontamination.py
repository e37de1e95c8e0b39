"""Benchmark decontamination by the CGK random-walk embedding and bit-sampling LSH.

Texts are sequences of lower-cased words. A CGK walk emits the word it stands on and moves on or not by a
coin that depends on the step and the word; two walks with the same coins fall into step again after an
edit, so words that are inserted or missing cost few places of Hamming distance. A bucket key samples a few
places of a walk; several samples of several walks reach the target recall. Windows with an item's length
are looked up among the items' keys, and what shares a key is confirmed by the exact edit distance.

Before any walk, the q-gram lemma drops windows that cannot be near any item. An item of n words that allows
e edits is looked for by its runs of q words, q being three or n / (e + 1), whichever is less: k edits destroy
q k of its n - q + 1 runs at most, so one is left at any length and the filter loses nothing; candidates still
come from the buckets alone. Items are taken in blocks of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import Words, blocks, fresh, gram_hashes, materialize, mix64, text_key

#: Edits in hundredths of an item's words, up to which a window counts as its copy.
EDITS_PERCENT = 20
WALKS, SAMPLES, PLACES = 8, 8, 6
#: Items, and characters of them, that are looked up at once.
ITEM_BLOCK, ITEM_CHARS = 20_000, 32 << 20
#: The longest runs of words that are looked for before any walk.
RUN = 3

_DIVIDERS = np.ones(256, bool)
_DIVIDERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_END = np.uint64(0x5F3759DF5F3759DF)


def allowed(length: np.ndarray, percent: int) -> np.ndarray:
    return length * percent // 100


def cgk_keys(words: np.ndarray, start: np.ndarray, length: np.ndarray, stop: np.ndarray, walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES) -> np.ndarray:
    """Bucket keys (windows x walks * samples) of the windows of ``length`` words from ``start`` on, cut off at ``stop``.

    A walk over L words has 3 L steps; beyond the window it emits an end sign. Which steps a sample takes
    depends on L, the walk and the sample alone.
    """
    n = len(start)
    keys = np.zeros((n, walks * samples), np.uint64)
    slot = np.arange(walks * samples, dtype=np.uint64)
    for k in range(0, n, 2048):
        begin, own = start[k : k + 2048], length[k : k + 2048]
        size, steps = np.minimum(own, stop[k : k + 2048] - begin), 3 * own
        taken = np.stack([mix64(slot * np.uint64(64) + np.uint64(p), 100 + p)[None, :] % steps[:, None].astype(np.uint64) for p in range(places)], 2).astype(np.int64)
        out = np.repeat(mix64(own.astype(np.uint64), 77)[:, None], len(slot), 1)
        for walk in range(walks):
            at = np.zeros(len(own), np.int64)
            emitted = np.empty((len(own), int(steps.max())), np.uint64)
            for step in range(emitted.shape[1]):
                now = np.where(at < size, words[np.minimum(begin + at, len(words) - 1)], _END)
                emitted[:, step] = now
                # the coin: a fixed odd factor for each step, the top bit of the product
                at += ((now * _coin(walk, step)) >> np.uint64(63)).astype(np.int64)
            of_walk = slice(walk * samples, (walk + 1) * samples)
            for p in range(places):
                where = taken[:, of_walk, p]
                out[:, of_walk] += mix64(np.take_along_axis(emitted, where, 1) + where.astype(np.uint64), 200 + p)
        keys[k : k + 2048] = out
    return keys


def _coin(walk: int, step: int) -> np.uint64:
    return np.uint64(int(mix64(np.array([walk << 32 | step], np.uint64), 9)[0]) | 1)


def fit_distance(items: list[np.ndarray], areas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of each item to a part of its area, with that part's first word and end (leftmost end)."""
    n = len(items)
    rows, columns = max(map(len, items)), max(1, max(map(len, areas)))
    a = np.zeros((n, rows), np.uint64)
    b = np.zeros((n, columns), np.uint64)
    la, lb = np.array([len(x) for x in items]), np.array([len(x) for x in areas])
    for i, (x, y) in enumerate(zip(items, areas)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    column = np.arange(columns + 1)
    cost = np.zeros((n, columns + 1), np.int64)
    origin = np.tile(column, (n, 1))
    best, first = cost.copy(), origin.copy()
    for r in range(rows):
        new = np.empty_like(cost)
        come = np.empty_like(origin)
        new[:, 0], come[:, 0] = r + 1, 0
        swap, drop = cost[:, :-1] + (a[:, r : r + 1] != b), cost[:, 1:] + 1
        new[:, 1:] = np.minimum(swap, drop)
        come[:, 1:] = np.where(swap <= drop, origin[:, :-1], origin[:, 1:])
        # words inserted in the area: a running minimum of cost less place
        slope = new - column
        low = np.minimum.accumulate(slope, 1)
        fresh = np.where(slope == low, column, 0)
        source = np.maximum.accumulate(fresh, 1)
        cost, origin = low + column, np.take_along_axis(come, source, 1)
        ended = la == r + 1
        best[ended], first[ended] = cost[ended], origin[ended]
    best[column[None, :] > lb[:, None]] = 1 << 40
    end = best.argmin(1)
    pick = np.arange(n)
    return best[pick, end], first[pick, end], end


#: Hits of runs that are looked at together.
HITS = 1 << 19


class Runs:
    """The runs of ``q`` words of some items, sorted, with the item and place of each."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]):
        self.q = q
        grams = [gram_hashes(item, q) for _, item in items]
        order = np.argsort(np.concatenate(grams), kind="stable")
        self.runs = np.concatenate(grams)[order]
        self.item = np.concatenate([np.full(len(g), k) for g, (k, _) in zip(grams, items)])[order]
        self.offset = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.runs >> np.uint64(42)).astype(np.int64)] = True


class Benchmark:
    """Words, runs and bucket keys of a block of items."""

    def __init__(self, item_ids: list[int], texts: list[str], percent: int, settings: tuple[int, int, int]):
        words = Words(pa.array(texts, pa.string()), lower=True, dividers=_DIVIDERS)
        hashes = words.hashes()
        length = words.count
        use = np.flatnonzero(length)
        self.percent, self.settings = percent, settings
        self.ids = np.array(item_ids, np.int64)[use]
        self.items = [hashes[words.first[i] : words.first[i + 1]] for i in use]
        self.length = length[use]
        q = np.clip(self.length // (allowed(self.length, percent) + 1), 1, RUN)
        self.runs = [Runs(size, [(k, self.items[k]) for k in np.flatnonzero(q == size).tolist()]) for size in np.unique(q).tolist()]
        flat = np.concatenate(self.items) if self.items else np.zeros(1, np.uint64)
        ends = np.cumsum(self.length)
        keys = cgk_keys(flat, ends - self.length, self.length, ends, *settings)
        keys = mix64(keys + np.arange(keys.shape[1], dtype=np.uint64)[None, :], 5).ravel()
        by = np.argsort(keys, kind="stable")
        self.keys, self.key_item = keys[by], (by // max(1, settings[0] * settings[1]))

    def _windows(self, runs: Runs, hashes: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, words, end of the text) of the windows that the q-gram lemma leaves."""
        grams = gram_hashes(hashes, runs.q)
        maybe = np.flatnonzero(runs.bits[(grams >> np.uint64(42)).astype(np.int64)] & (row[: len(grams)] == row[runs.q - 1 :])) if len(grams) else np.zeros(0, np.int64)
        low, high = (np.searchsorted(runs.runs, grams[maybe], side) for side in ("left", "right"))
        known = high > low
        place, low, high = maybe[known], low[known], high[known]
        seen = np.zeros(len(hashes) + 1, np.int64)
        seen[place + 1] = 1
        seen = np.cumsum(seen)
        # a run that many items share stands for many windows: hits are taken in slices, and equal windows made one in each
        parts, times = [], high - low
        ends = np.cumsum(times)
        cuts = np.searchsorted(ends, np.arange(HITS, int(ends[-1]) + HITS, HITS), "left") if len(ends) else []
        for a, b in zip([0, *(cuts[:-1] + 1)] if len(cuts) else [], [*(cuts[:-1] + 1), len(ends)] if len(cuts) else []):
            if a < b:
                parts.append(self._kept(runs, place[a:b], low[a:b], times[a:b], seen, row, first))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        start, size, stop = (np.concatenate(c) for c in zip(*parts))
        return start, size, stop

    def _kept(self, runs: Runs, place: np.ndarray, low: np.ndarray, times: np.ndarray, seen: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows around some hits, those in which enough runs of items stand, each once."""
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        place = np.repeat(place, times)
        # what surrounds a run far enough for any alignment of its item
        size = self.length[runs.item[entry]]
        begin, stop = first[row[place]], first[row[place] + 1]
        start = np.maximum(place - runs.offset[entry], begin)
        _, one = np.unique(start * (int(self.length.max()) + 1) + size, return_index=True)
        start, size, begin, stop = start[one], size[one], begin[one], stop[one]
        edits = allowed(size, self.percent)
        left, right = np.maximum(start - edits, begin), np.minimum(start + size + edits, stop)
        enough = seen[right] - seen[left] >= np.maximum(1, size - runs.q + 1 - runs.q * edits)
        return start[enough], size[enough], stop[enough]

    def find(self, words: Words) -> tuple[np.ndarray, ...]:
        """(row, item_id, first word in the row, words, distance) of the nearest window for each row and item."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        hashes, row = words.hashes(), words.row_of_word()
        found_windows = [self._windows(r, hashes, row, words.first) for r in self.runs]
        if not found_windows:
            return none
        start, size, stop = (np.concatenate(c) for c in zip(*found_windows))
        _, index = np.unique(start * (int(self.length.max()) + 1) + size, return_index=True)
        start, size, stop = start[index], size[index], stop[index]
        if not len(start):
            return none
        keys = cgk_keys(hashes, start, size, stop, *self.settings)
        keys = mix64(keys + np.arange(keys.shape[1], dtype=np.uint64)[None, :], 5).ravel()
        low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        times = high - low
        hit = np.flatnonzero(times)
        item = self.key_item[np.arange(times.sum()) - np.repeat(np.cumsum(times[hit]) - times[hit], times[hit]) + np.repeat(low[hit], times[hit])]
        window = np.repeat(hit // keys_per(self.settings), times[hit])
        pairs = np.unique(window * len(self.ids) + item)
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        text = row[start[window]]
        plain = np.array([np.array_equal(hashes[s : s + len(x)], x) for s, x in zip(start[window].tolist(), (self.items[i] for i in item))], bool)
        plain &= start[window] + self.length[item] <= stop[window]
        for x in np.flatnonzero(plain)[::-1].tolist():  # leftmost last; no edit is needed
            found[int(text[x]), int(self.ids[item[x]])] = 0, int(start[window[x]] - words.first[text[x]]), int(self.length[item[x]])
        rest = np.array([x for x, (r, i) in enumerate(zip(text.tolist(), self.ids[item].tolist())) if (r, i) not in found], np.int64)
        for k in range(0, len(rest), 1024):
            w, i = window[rest[k : k + 1024]], item[rest[k : k + 1024]]
            edits = allowed(self.length[i], self.percent)
            left, right = np.maximum(start[w] - edits, words.first[row[start[w]]]), np.minimum(start[w] + self.length[i] + edits, stop[w])
            distance, first, last = fit_distance([self.items[x] for x in i], [hashes[a:b] for a, b in zip(left, right)])
            for x in np.flatnonzero(distance <= edits).tolist():
                r = int(row[start[w[x]]])
                at = int(left[x] - words.first[r])
                new = (int(distance[x]), at + int(first[x]), int(last[x] - first[x]))
                name = (r, int(self.ids[i[x]]))
                found[name] = min(new, found.get(name, new))
        if not found:
            return none
        out = [(r, i, s, n, d) for (r, i), (d, s, n) in sorted(found.items())]
        return tuple(np.array(c, np.int64) for c in zip(*out))


def keys_per(settings: tuple[int, int, int]) -> int:
    return settings[0] * settings[1]


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT, walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES, item_block: int = ITEM_BLOCK, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, item_id, start, n_words, distance: the nearest window of each row for each item that it holds.

    A row holds an item if some window of its words is within ``percent`` hundredths of the item's words in
    edits (words put in, left out or changed). Words are runs of letters and digits, A-Z as a-z. Rows and
    items without text match nothing; an item that allows no edit (under five words at 20 %) is matched word by
    word; ``percent`` is below 100; null ids stay null ids; repeated rows give their matches again; repeated item_ids count as one item with several wordings. Other columns
    are not read, but for the bigint columns ``carried``, which follow. An empty benchmark gives no row.
    """
    schema = ", ".join(f"{c} bigint" for c in ("doc_id", "item_id", "start", "n_words", "distance", *carried))
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()  # a repeated row would fill one block
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-count // item_block), -(-chars // ITEM_CHARS))
    settings = (walks, samples, places)
    texts = docs.select("doc_id", "text", *carried).where("text is not null")
    out = None
    for p in range(parts):  # each block of items, of bounded size, against all rows
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        ids, wordings = [r.item_id for r in own], [r.text for r in own]
        one = texts.mapInArrow(_matcher(ids, wordings, percent, settings, carried), schema)
        if parts > 1:
            one = materialize(one)  # a block's items are let go before the next one's come
        out = one if out is None else out.unionByName(one)
    return out


_held: dict[str, Benchmark] = {}


def _matcher(ids: list[int], wordings: list[str], percent: int, settings: tuple[int, int, int], carried: tuple[str, ...] = ()):
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _held:  # a worker builds the index once
            _held.clear()
            _held[token] = Benchmark(ids, wordings, percent, settings)
        known = _held[token]
        for batch in batches:
            for part in blocks(batch):
                row, *found = known.find(Words(part.column("text"), lower=True, dividers=_DIVIDERS))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *map(pa.array, found), *(part.column(c).take(pa.array(row)) for c in carried)], ["doc_id", "item_id", "start", "n_words", "distance", *carried])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns unchanged.

    A row is told by its doc_id (null too) and a hash of its text, so a clean row stays beside a leak of the same doc_id.
    """
    key, leak, text = fresh(docs, "_key", "_leak", "_text")
    found = matches(docs.select("doc_id", "text", text_key().alias(key)), benchmark, carried=(key,), **settings)
    leaks = found.select(F.col("doc_id").alias(leak), F.col(key).alias(text)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)) & (text_key() == F.col(text)), "left_anti")
