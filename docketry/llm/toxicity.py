"""A toxicity classifier that does not lean on identity terms.

Logistic regression over the presence of words and word beginnings. For every labelled text with an
identity term, counterfactual texts with the terms swapped for others, or for a neutral word, join the fit:
the squared change of the score between the two is part of the loss, so neutral mentions gain no weight.

The terms are those that the caller names and those that the labelled rows show: whole words that stand in
a hundredth of the texts of label 0 at least, lean to label 1 without being clear signs of it, and stand in
more texts of label 0 than of label 1. A fit that leans on such a word is wrong in most texts that have it.
The terms are features themselves, so their weight is seen and held down; ``Model`` says how many pairs
entered the loss, and the score change under swaps without and with the penalty.
The fit takes a bounded sample of labelled rows; scoring takes every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import Words, blocks, numbered

#: Labelled rows that a fit takes at most, those with the smallest hash of doc_id.
SAMPLE_ROWS = 8000
#: Features kept: those that speak for label 1 most clearly.
FEATURES = 512
#: Least standard score of a kept feature.
CLEAR = 5.0
THRESHOLD = 0.7
#: Terms that are found in the labelled rows at most, and the least share of texts of label 0 that hold one.
FOUND_TERMS, SHARE = 48, 0.01
# Terms that name groups, as lower-case words, and the neutral word they are swapped for.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino",
    "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "atheist", "immigrant", "immigrants", "refugees", "disabled", "elderly",
    "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "frauen", "männer", "muslime", "christen", "juden", "einwanderer",
    "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes",
)
NEUTRAL = "people"

_DIVIDERS = np.ones(256, bool)
_DIVIDERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)


def _feature_hashes(words: Words) -> list[np.ndarray]:
    """For whole words and for each length of beginning, a hash of every word."""
    return [words.hashes(), *(words.hashes(k) ^ np.uint64(k) for k in BEGINNINGS)]


def _text_features(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text."""
    words = Words(pa.array(texts, pa.string()), lower=True, dividers=_DIVIDERS)
    kinds = _feature_hashes(words)
    return [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(words.first[:-1], words.first[1:])]


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    #: Pairs of a text and a counterfactual in the loss, and the root of the mean squared change of the score's logit.
    pairs: int = 0
    change_without_penalty: float = 0.0
    change: float = 0.0


def fit_rows(rows: list[tuple[str, int]], penalty: float = 10.0, ridge: float = 1e-5, terms: tuple[str, ...] = IDENTITY_TERMS, neutral: str = NEUTRAL, found_terms: int = FOUND_TERMS) -> Model:
    """Fit (text, label) rows; ``penalty`` weighs the squared score changes under counterfactual swaps of
    ``terms`` and of at most ``found_terms`` more that the rows show."""
    texts, labels = [t or "" for t, _ in rows], np.array([y for _, y in rows], float)
    positive, n = labels.sum(), len(labels)
    prior = (positive + 0.5) / (n + 1)
    intercept = float(np.log(prior / (1 - prior)))
    if positive == 0 or positive == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), intercept)
    # two passes over blocks of texts: a feature that is kept stands in three texts of label 1 at least
    flagged = np.flatnonzero(labels)
    known, ones = np.zeros(0, np.uint64), np.zeros(0)
    for block in _by_text(texts, flagged):
        more, times = np.unique(np.concatenate(block[1]), return_counts=True)
        known, inverse = np.unique(np.concatenate([known, more]), return_inverse=True)
        ones = np.bincount(inverse, np.concatenate([ones, times]), len(known))
    known, ones = known[ones >= 3], ones[ones >= 3]
    both = np.zeros(len(known))
    for _, features in _by_text(texts, np.arange(n)):
        place = _places(known, np.concatenate(features))
        both += np.bincount(place[place >= 0], minlength=len(known))
    rate = both / n
    score = (ones / positive - (both - ones) / (n - positive)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / positive + 1 / (n - positive)))
    chosen = np.flatnonzero(score >= CLEAR)
    kept = known[chosen[np.argsort(-score[chosen], kind="stable")[:FEATURES]]]
    leaning = np.flatnonzero((score > 0) & (score < CLEAR) & (both - ones > ones) & (both - ones >= SHARE * (n - positive)))
    named = _term_features(texts, known[leaning[np.argsort(-score[leaning], kind="stable")]], terms, found_terms)
    kept = np.unique(np.concatenate([kept, named[len(terms) :, 0]]))
    x = np.zeros((n, len(kept) + 1), np.float32)
    x[:, -1] = 1
    for rows_, features in _by_text(texts, np.arange(n)):
        owner, place = np.repeat(rows_, [len(f) for f in features]), _places(kept, np.concatenate(features))
        x[owner[place >= 0], place[place >= 0]] = 1
    changes, pairs = _swap_changes(texts, x, kept, named, _feature_rows([neutral])[0])
    plain, _ = _newton(x, labels, changes, intercept, 0.0, ridge)
    weights, intercept = _newton(x, labels, changes, intercept, penalty, ridge)
    before, after = (float(np.sqrt(max(0.0, w @ changes @ w))) for w in (plain, weights))
    return Model(kept, weights, intercept, pairs, before, after)


def _feature_rows(words: list[str]) -> np.ndarray:
    """The features of each word (words x kinds)."""
    found = Words(pa.array(words, pa.string()), lower=True, dividers=_DIVIDERS)
    return np.stack(_feature_hashes(found), 1)


def _term_features(texts: list[str], leaning: np.ndarray, terms: tuple[str, ...], most: int) -> np.ndarray:
    """Features (terms x kinds) of the given terms, and of the first ``most`` of ``leaning`` that are whole words of the texts."""
    given, seen = _feature_rows(list(terms)), {}
    wanted = np.sort(np.setdiff1d(leaning, given[:, 0]))
    for k in range(0, len(texts), 200):
        words = Words(pa.array(texts[k : k + 200], pa.string()), lower=True, dividers=_DIVIDERS)
        whole = words.hashes()
        place = np.flatnonzero((_places(wanted, whole) >= 0) & (words.end - words.start >= BEGINNINGS[0]))
        for i in place[np.unique(whole[place], return_index=True)[1]]:
            seen.setdefault(int(whole[i]), (words.data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace")))
    found = [seen[h] for h in leaning.tolist() if h in seen][:most]
    return np.concatenate([given, _feature_rows(found)]) if found else given


def _swap_changes(texts: list[str], x: np.ndarray, kept: np.ndarray, terms: np.ndarray, neutral: np.ndarray, swaps: int = 3) -> tuple[np.ndarray, int]:
    """(mean of d d', pairs): d is what a swap changes in the features of a text that holds a term.

    Of each such text all terms go at once: for the neutral word, and ``swaps`` times for other terms in turn.
    """
    k, pairs, every = len(kept), 0, 0
    total = np.zeros((k, k))
    by = np.argsort(terms[:, 0], kind="stable")
    step = max(1, len(terms) // (swaps + 1))
    of_terms = _places(kept, terms.ravel()).reshape(terms.shape)
    of_neutral = _places(kept, neutral)
    for b in range(0, len(texts), 200):
        words = Words(pa.array(texts[b : b + 200], pa.string()), lower=True, dividers=_DIVIDERS)
        kinds = np.stack(_feature_hashes(words), 1)
        term = _places(terms[by, 0], kinds[:, 0])
        place = _places(kept, kinds.ravel()).reshape(kinds.shape)
        changes = []
        for i, (low, high) in enumerate(zip(words.first[:-1], words.first[1:])):
            held = np.unique(term[low:high][term[low:high] >= 0])
            if not len(held):
                continue
            rest = place[low:high][term[low:high] < 0].ravel()
            for s in range(swaps + 1):
                new = np.zeros(k, np.float32)
                new[rest[rest >= 0]] = 1
                put = of_neutral if s == 0 else of_terms[(by[held] + s * step) % len(terms)].ravel()
                new[put[put >= 0]] = 1
                changes.append(x[b + i, :k] - new)
        if changes:
            d = np.stack(changes).astype(float)
            total, pairs, every = total + d.T @ d, pairs + int(d.any(1).sum()), every + len(d)
    return total / max(1, every), pairs


def _by_text(texts: list[str], rows: np.ndarray, size: int = 200) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, their distinct features) of a few texts at a time."""
    for k in range(0, len(rows), size):
        own = rows[k : k + size]
        yield own, _text_features([texts[i] for i in own])


def _places(kept: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where each feature stands in the sorted ``kept``; -1: nowhere."""
    if not len(kept):
        return np.full(len(features), -1)
    at = np.minimum(np.searchsorted(kept, features), len(kept) - 1)
    return np.where(kept[at] == features, at, -1)


def _newton(x, y, d, intercept, penalty, ridge):
    """Minimise mean log loss + ridge |w|^2 / 2 + penalty * w' d w / 2; the last column of x is the constant."""
    n, k = x.shape[0], x.shape[1] - 1
    fixed = np.diag(np.append(np.full(k, ridge), 0.0))
    fixed[:k, :k] += penalty * d
    w = np.append(np.zeros(k), intercept)
    for _ in range(30):
        gradient, hessian = fixed @ w, fixed + 1e-8 * np.eye(k + 1)
        for i in range(0, n, 1000):
            part = x[i : i + 1000].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            gradient += part.T @ (p - y[i : i + 1000]) / n
            hessian += (part * (p * (1 - p))[:, None]).T @ part / n
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:k], float(w[k])


def held_out(doc_id):
    """Rows whose labels no fit may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out (repeated labels of a doc_id: the largest)."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the broadcast side has sample_rows rows of two numbers at most
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample_rows)
    return fit_rows([(r.text, int(r.toxic > 0)) for r in joined.select("text", "toxic").toLocalIterator()])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from the threshold on); no column but text has a part in it.

    ``names``: what the two are called; columns of ``docs`` with these names are replaced.

    Null and empty texts get the score of a text without features; rows and other columns stay as they are.
    """
    value_name, predicted = names
    kept = docs.drop(value_name, predicted)
    columns = kept.columns
    order = np.argsort(model.features)
    features, weights = model.features[order], model.weights[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                words = Words(part.column("text"), lower=True, dividers=_DIVIDERS)
                total = np.full(part.num_rows, model.intercept)
                if len(features) and len(words):
                    rows, found = [], []
                    for hashes in _feature_hashes(words):
                        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
                        hit = np.flatnonzero(features[at] == hashes)
                        found.append(at[hit])
                        rows.append(np.searchsorted(words.first, hit, "right") - 1)
                    pairs = np.unique(np.concatenate(rows) * len(features) + np.concatenate(found))
                    total += np.bincount(pairs // len(features), weights[pairs % len(features)], part.num_rows)
                value = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], [*columns, *names])

    return numbered(kept, "text").mapInArrow(run, T.StructType([*kept.schema, T.StructField(value_name, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))
