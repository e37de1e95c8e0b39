"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links; each link knows how many pieces it pops. Closing the links
under every byte gives one table of next states and one of popped counts, so a word's length in greedy
longest pieces takes one step a byte and no piece is ever built. All words of a block take a step at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import Words, by_blocks

_DEAD = 0


class PieceAutomaton:
    """States: 0 dead, 1 a word's start, 2 after a piece; then a state for each prefix of a piece."""

    def __init__(self, initial: list[bytes], later: list[bytes]):
        children: list[dict[int, int]] = [{}, {}, {}]
        depth, piece = [0, 0, 0], [False, False, False]
        parents = [(0, 0)] * 3
        for root, words in ((1, initial), (2, later)):
            for word in words:
                at = root
                for byte in word:
                    if byte not in children[at]:
                        children[at][byte] = len(children)
                        children.append({})
                        depth.append(depth[at] + 1)
                        piece.append(False)
                        parents.append((at, byte))
                    at = children[at][byte]
                piece[at] = piece[at] or at > 2
        n = len(children)
        link, pops = [_DEAD] * n, [0] * n
        order = sorted(range(3, n), key=depth.__getitem__)
        for state in order:
            if piece[state]:
                link[state], pops[state] = 2, 1
                continue
            parent, byte = parents[state]
            to, popped = link[parent], pops[parent]
            while to and byte not in children[to]:
                popped, to = popped + pops[to], link[to]
            if to:
                link[state], pops[state] = children[to][byte], popped
        self.classes = np.zeros(256, np.int32)
        used = sorted({b for c in children for b in c})
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.next = np.zeros((n, self.width), np.int32)
        self.popped = np.zeros((n, self.width), np.uint8)
        self.closing = np.full(n, -1, np.int64)  # pieces popped at the word's end; -1: unknown
        self.closing[2] = 0
        for state in [2, 1, *order]:
            if link[state]:
                self.next[state] = self.next[link[state]]
                self.popped[state] = np.where(self.next[state] > 0, self.popped[link[state]] + pops[state], 0)
                if self.closing[link[state]] >= 0:
                    self.closing[state] = self.closing[link[state]] + pops[state]
            for byte, child in children[state].items():
                self.next[state, self.classes[byte]] = child
                self.popped[state, self.classes[byte]] = 0

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word (spans of data); -1 where some part of it is no piece."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        live = np.cumsum(np.bincount(size)[::-1])[::-1]  # live[k]: words of k bytes or more
        state, total = np.ones(len(start), np.int32), np.zeros(len(start), np.int64)
        flat, popped, classes = self.next.ravel(), self.popped.ravel(), self.classes[data]
        for k in range(len(live) - 1):
            n = int(live[k + 1])
            at = state[:n] * self.width + classes[begin[:n] + k]
            total[:n] += popped[at]
            state[:n] = flat[at]
        closed = self.closing[state]
        out = np.empty_like(total)
        out[order] = np.where(closed < 0, -1, total + closed)
        return out


def sentence_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces that go on) of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, later = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or piece == "▁":
            continue
        (initial if piece[0] == "▁" else later).append(piece.lstrip("▁").encode())
    return [p for p in initial if p], [p for p in later if p]


_automata: dict[str, PieceAutomaton] = {}


def count_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row's text.

    Words are divided by ASCII white space; a word with a part that is no piece is one token, unknown.
    Null and empty texts count 0; repeated and null doc_ids keep a row each; other columns are not read.
    ``model``: a sentencepiece model on every worker, whose pieces are matched longest first.
    """

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automata.get(model) or _automata.setdefault(model, PieceAutomaton(*sentence_pieces(model)))
        words = Words(part.column("text"))
        counts = automaton.counts(words.data, words.start, words.end)
        unknown = counts < 0
        sums = [np.concatenate([[0], np.cumsum(c)])[words.first] for c in (np.where(unknown, 1, counts), unknown)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.diff(x).astype(np.int64)) for x in (words.first, *sums))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    run = by_blocks(one)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
