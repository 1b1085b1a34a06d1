"""Document quality by Bradley-Terry ranking: scores learned from preferences between pairs of documents.

A document's strength is linear in features of its text.  The probability that one document is preferred to another
is the logistic function of the difference of their strengths, so the weights come from logistic loss on feature
differences of (preferred, other) pairs.  The threshold is the quantile of strengths that as many labelled documents
stay below as are labelled 0; a logistic curve through it turns strengths into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labels import sample, with_labels

#: Labelled documents whose features are fitted on the driver (about 150 bytes each).
MOST_LABELLED = 20_000
#: Preference pairs for each document of the smaller class.
PAIRS = 8
#: The score that a document of the threshold's strength gets.
CUT = 0.3

#: The most frequent function words of the languages at hand.
FUNCTION_WORDS = (
    "the of and to in a is that it was for on are with as be this by from or an at not "
    "de la que el en y los se del las un por con una para es al lo como "
    "le les et des une du dans est qui au sur pas pour ne ce "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine auch"
).split()
_FUNCTION = np.sort(np.unique(np.concatenate(W.hash_words([" ".join(FUNCTION_WORDS)], W.ALNUM))))

NAMES = ("characters", "letters", "capitals", "digits", "blanks", "lines", "stops", "bars", "marks", "symbols", "beyond",
         "words", "word_length", "distinct", "function_words", "top_word")


def _classes() -> np.ndarray:
    """Class of each byte, the place of its feature less one; continuation bytes go with "beyond"."""
    kind = np.full(256, 8, np.int64)  # symbols
    for name, members in (("letters", b"abcdefghijklmnopqrstuvwxyz"), ("capitals", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                          ("digits", b"0123456789"), ("blanks", b" \t\r\f\v"), ("lines", b"\n"), ("stops", b".,;:'\"-()"),
                          ("bars", b"|"), ("marks", b"!?"), ("beyond", bytes(range(0x80, 0x100)))):
        kind[list(members)] = NAMES.index(name) - 1
    return kind


_KIND = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """A row of features, in the order of NAMES, for each text; an empty or null text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    data, offsets = W.text_bytes(texts)
    for first, last in W.slices(offsets):
        own = offsets[first : last + 1] - offsets[first]
        kind = _KIND[data[offsets[first] : offsets[last]]]
        row = np.repeat(np.arange(last - first), np.diff(own))
        counts = np.bincount(row * 10 + kind, minlength=10 * (last - first)).reshape(-1, 10)
        size = np.diff(own)
        out[first:last, 0] = np.log1p(size)
        out[first:last, 1:11] = counts / np.maximum(size, 1)[:, None]
    for w in W.words(texts, W.ALNUM):
        bound = w.bounds()
        n = np.diff(bound)
        rows = slice(w.first, w.last)
        some = np.maximum(n, 1)
        out[rows, 11] = np.log1p(n)
        out[rows, 12] = np.bincount(w.doc - w.first, w.end - w.start, w.last - w.first) / some
        at = np.minimum(np.searchsorted(_FUNCTION, w.hash), len(_FUNCTION) - 1)
        out[rows, 14] = np.bincount(w.doc - w.first, _FUNCTION[at] == w.hash, w.last - w.first) / some
        for i in np.flatnonzero(n):
            h = np.sort(w.hash[bound[i] : bound[i + 1]])
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            out[w.first + i, 13] = (len(edge) - 1) / n[i]
            out[w.first + i, 15] = np.diff(edge).max() / n[i]
    return out


class Ranking(NamedTuple):
    """Weights over standardised features; ``threshold`` of strengths and the slope of the score there."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strengths(self, f: np.ndarray) -> np.ndarray:
        return np.clip((f - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, f: np.ndarray) -> np.ndarray:
        margin = self.slope * (self.strengths(f) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(f: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 7) -> Ranking:
    """Learn from features and 0/1 labels; with a class missing, all documents get the same score."""
    mean = f.mean(0) if len(f) else np.zeros(len(NAMES))
    scale = (f.std(0) if len(f) else np.ones(len(NAMES))) + 1e-9
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        weights, level = np.zeros(f.shape[1]), (1.0 if len(good) else -1.0)
        return Ranking(mean, scale, weights, -level, 1.0)
    rng = np.random.default_rng(seed)
    n = pairs * max(len(good), len(bad))
    x = np.clip((f - mean) / scale, -8, 8)
    d = x[rng.permutation(np.resize(good, n))] - x[rng.permutation(np.resize(bad, n))]
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        gradient = penalty * weights - d.T @ p / n
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = x @ weights
    threshold = float(np.quantile(s, len(bad) / len(s)))
    base = np.log(CUT / (1 - CUT))

    def loss(slope: float) -> float:
        m = np.clip(slope * (s - threshold) + base, -500, 500)
        return float(np.logaddexp(0, np.where(y == 1, -m, m)).mean())

    slope = min(np.geomspace(0.05, 50, 61), key=loss)
    return Ranking(mean, scale, weights, threshold, float(slope))


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = features(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "f": pa.array(list(f), pa.list_(pa.float64())),
                                          "place": batch.column("place")})


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", learnt: Column | None = None,
          most: int = MOST_LABELLED) -> Ranking:
    """Fit on the labelled documents: at most ``most`` labels, chosen by a hash of their keys.

    Only text and label are used.  A document that repeats counts again; null texts count as empty.  Keys may repeat
    among the documents: of more than ``4 * most`` rows, those with the lowest hashes of text and key count.
    """
    chosen = with_labels(docs, sample(labels, label, most, learnt=learnt))
    rows = chosen.select("text", "y", F.xxhash64("text", "doc_id").alias("place")) \
        .mapInArrow(_labelled_features, "y int, f array<double>, place bigint") \
        .orderBy("place", "y").limit(4 * most).toArrow()
    f = np.array(rows.column("f").to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array(rows.column("y").to_pylist(), int)
    order = np.lexsort([*f.T, y])  # the same fit, however rows arrive
    return fit(f[order], y[order])


def score(text: Column, ranking: Ranking) -> Column:
    """Score of a text, from 0 to 1; a null text scores as an empty one."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(ranking.scores(features(texts)), pa.float64())

    return run(text)
