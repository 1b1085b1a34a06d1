"""Toxic passages by maximal scoring segments over token log-odds.

Words and their beginnings get the log-odds of occurring in toxic against other documents, with an informative
Dirichlet prior in proportion to their share of both.  A token (word) scores as the most significant of its units,
itself and its beginnings, so inflected and compound forms count without having been seen; tokens of which no unit
differs significantly share the (slightly negative) log-odds of the rest.  A linear-time scan finds all maximal scoring segments of a text.  Their scores follow an extreme-value
distribution in clean text: the chance of one of score s in n tokens is 1 - exp(-k n exp(-rate s)).  The parameters
are estimated on clean training documents, and what segments score above expectation is summed and calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labels import remainder, sample, with_labels

#: Labelled documents to learn from (12 bytes each are broadcast).
MOST_LABELLED = 50_000
#: Units with a score of their own, the most significant ones (24 bytes each on every worker).
MOST_TOKENS = 1 << 16
#: Bytes of the beginnings of words that are units.
BEGINNINGS = (5, 6, 7, 8)
#: Weight of the prior, as a share of the units seen, and least significance of a unit's log-odds.
PRIOR, SIGNIFICANT = 0.1, 3.5
#: Every fourth labelled document is kept for calibration and teaches no tokens.
FOLDS = 4
#: Chance, in clean text, under which a passage is reported.
CHANCE = 0.01


class Detector(NamedTuple):
    tokens: np.ndarray  # hashes of units, ascending
    buckets: np.ndarray  # of the hashes' leading bits: whether any unit has them
    scores: np.ndarray
    weight: np.ndarray  # significance
    neutral: float
    rate: float
    k: float
    slope: float
    offset: float


def _buckets(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(tokens >> np.uint64(44)).astype(np.int64)] = True
    return out


def _beginning(w: W.Words, size: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the words at ``which`` that are longer than ``size`` bytes, and hashes of their beginnings."""
    which = which[w.end[which] - w.start[which] > size]
    start = w.start[which]
    return which, W.hash_spans(w.data, start, start + size) ^ np.uint64(0x5DEECE66D)


def _once(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the first of each document's equal hashes."""
    order = np.lexsort((h, doc))
    if not len(order):
        return order
    x, d = h[order], doc[order]
    return np.sort(order[np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each unit."""
    for batch in batches:
        label = np.asarray(batch.column("y"))
        parts = []
        for w in W.words(W.lowered(batch.column("text")), W.ALNUM):
            first = _once(w.doc, w.hash)
            parts.append((w.hash[first], label[w.doc[first]]))
            for size in BEGINNINGS:
                which, h = _beginning(w, size, first)
                one = _once(w.doc[which], h)
                parts.append((h[one], label[w.doc[which[one]]]))
        if parts:
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            toxic = np.bincount(at, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)
            total = np.bincount(at, minlength=len(h))
            yield pa.RecordBatch.from_pydict({"token": pa.array(h.view(np.int64)), "toxic": pa.array(toxic),
                                              "other": pa.array(total - toxic)})


def segments(values: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence of positive values with a negative gap before each but the first.

    Each is (first, last, score).  A candidate is joined with earlier ones as long as that raises the score; every
    value joins or leaves the list once, so the time is linear.
    """
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum at its end
    total = 0.0
    for i, value in enumerate(values):
        if i:
            total += gaps[i]
        first, before = i, total
        total += value
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j -= 1
            if j < 0 or held[j][3] >= total:
                held.append((first, i, before, total))
                break
            first, before = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, end - start) for a, b, start, end in held]


def _scan(w: W.Words, detector: Detector) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Row, number of tokens, and segments (first and last token, score) of each row with a scored token above 0."""
    own, best = np.full(len(w.hash), detector.neutral), np.zeros(len(w.hash))
    every = np.arange(len(w.hash))
    for which, h in [(every, w.hash), *(_beginning(w, size, every) for size in BEGINNINGS)]:
        maybe = np.flatnonzero(detector.buckets[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(detector.tokens, h[maybe]), max(len(detector.tokens) - 1, 0))
        hit = np.flatnonzero(detector.tokens[at] == h[maybe]) if len(maybe) else maybe
        word, at = which[maybe[hit]], at[hit]
        up = detector.weight[at] > best[word]
        own[word[up]], best[word[up]] = detector.scores[at[up]], detector.weight[at[up]]
    bound = w.bounds()
    for row in np.unique(w.doc[own > 0]) - w.first:
        s = own[bound[row] : bound[row + 1]]
        up = np.flatnonzero(s > 0)
        sums = np.concatenate([[0.0], np.cumsum(s)])
        gaps = [0.0, *(sums[up[1:]] - sums[up[:-1] + 1])]
        found = segments(s[up].tolist(), gaps)
        yield w.first + int(row), len(s), [(int(up[a]), int(up[b]), x) for a, b, x in found]


def _evidence(n: int, found: list[tuple[int, int, float]], detector: Detector) -> float:
    """What the segments score above the score expected of the best one in clean text of this length."""
    expected = np.log(max(detector.k * n, 1e-9))
    return float(sum(max(0.0, detector.rate * s - expected) for _, _, s in found))


def _best(detector: Detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            evidence = np.zeros(batch.num_rows)
            for w in W.words(W.lowered(batch.column("text")), W.ALNUM):
                n[w.first : w.last] = np.diff(w.bounds())
                for row, length, found in _scan(w, detector):
                    best[row] = max(s for _, _, s in found)
                    evidence[row] = _evidence(length, found, detector)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "n": pa.array(n), "best": pa.array(best),
                                              "evidence": pa.array(evidence), "place": batch.column("place")})
    return run


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive solution of sum(p * exp(rate * s)) = 1, or 1 where there is none."""
    low, high = 0.05, 8.0

    def above(rate: float) -> bool:
        return float((p * np.exp(np.minimum(rate * s, 700))).sum()) > 1

    if above(low) or not above(high):
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by penalised Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (p - y) + 1e-2 * beta
        curve = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", learnt: Column | None = None,
          most: int = MOST_LABELLED, most_tokens: int = MOST_TOKENS) -> Detector:
    """Learn token scores and calibration from at most ``most`` labelled documents, chosen by a hash of their keys.

    Of several labels of one key, 0 wins.  Keys may repeat among the documents: of more than ``4 * most`` calibration
    rows, those with the lowest hashes of text and key count.  With a class missing, no token is scored and all documents get the same
    score, the share of toxic labels.
    """
    chosen = sample(labels, label, most, learnt=learnt)
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(FOLDS)) == 0
    counts = with_labels(docs, chosen).filter(~held).select("text", "y") \
        .mapInArrow(_presence, "token bigint, toxic bigint, other bigint") \
        .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    total = counts.agg(F.sum("toxic"), F.sum("other")).first()
    n1, n0 = float(total[0] or 0), float(total[1] or 0)
    tokens, scores, weight, neutral, rate = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), -1e-3, 1.0
    if n1 and n0:
        prior = PRIOR * (n1 + n0)
        a = F.lit(prior) * (F.col("toxic") + F.col("other")) / F.lit(n1 + n0)
        up, down = F.col("toxic") + a, F.col("other") + a
        odds = F.log(up / (F.lit(n1 + prior) - up)) - F.log(down / (F.lit(n0 + prior) - down))
        z = odds / F.sqrt(1 / up + 1 / down)
        scored = counts.withColumns({"odds": odds, "z": z, "p": down / F.lit(n0 + prior)}) \
            .filter(F.abs("z") >= SIGNIFICANT).orderBy(F.desc(F.abs("z")), "token").limit(most_tokens)
        got = scored.select("token", "odds", "z", "p", "toxic", "other").toArrow()
        tokens = got.column("token").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        tokens, scores, p = tokens[order], got.column("odds").to_numpy()[order], got.column("p").to_numpy()[order]
        weight = np.abs(got.column("z").to_numpy()[order])
        rest1 = max(n1 - got.column("toxic").to_numpy().sum(), 1.0) / n1
        rest0 = max(n0 - got.column("other").to_numpy().sum(), 1.0) / n0
        neutral = min(float(np.log(rest1 / rest0)), -1e-3)
        rate = _rate(np.append(p, max(1 - p.sum(), 0.0)), np.append(scores, neutral))
    draft = Detector(tokens, _buckets(tokens), scores, weight, neutral, rate, 1.0, 0.0, 0.0)
    measured = with_labels(docs, chosen).filter(held).select("text", "y", F.xxhash64("text", "doc_id").alias("place"))

    def measure(detector: Detector) -> pa.Table:
        found = measured.mapInArrow(_best(detector), "y int, n bigint, best double, evidence double, place bigint")
        return found.orderBy("place", "y").limit(4 * most).toArrow()

    seen = measure(draft)
    y, n, best = (seen.column(c).to_numpy() for c in ("y", "n", "best"))
    clean = (y == 0) & (n > 0)
    k = float(clean.sum() / max((n[clean] * np.exp(-rate * best[clean])).sum(), 1e-9)) if clean.any() else 1.0
    draft = draft._replace(k=k)
    seen = measure(draft) if len(tokens) else seen
    slope, offset = _logistic(seen.column("evidence").to_numpy(), seen.column("y").to_numpy().astype(float))
    return draft._replace(slope=max(slope, 0.0), offset=offset)


RESULT = "score double, passages array<struct<first:int,last:int,score:double,chance:double>>"


def detect(text: Column, detector: Detector, chance: float = CHANCE) -> Column:
    """``struct<score, passages>`` of a text; passages are ranges of tokens (alphanumeric words), best in order of place.

    A passage is reported if clean text of this length has one so strong with a chance below ``chance``.  Empty and
    null texts have no passage and the score of text without evidence.
    """
    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        evidence = np.zeros(len(texts))
        passages: list[list[dict]] = [[] for _ in range(len(texts))]
        for w in W.words(W.lowered(texts), W.ALNUM):
            for row, n, found in _scan(w, detector):
                evidence[row] = _evidence(n, found, detector)
                for a, b, s in found:
                    odds = -np.expm1(-detector.k * n * np.exp(-detector.rate * s))
                    if odds < chance:
                        passages[row].append({"first": a, "last": b, "score": s, "chance": float(odds)})
        score = 1 / (1 + np.exp(-np.clip(detector.slope * evidence + detector.offset, -500, 500)))
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()),
                                   ("chance", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(passages, kind)],
                                          ["score", "passages"])

    return run(text)


def held_out(key: Column, of: int, rest: int) -> Column:
    """True where the key's CRC-32 leaves this remainder, and for null keys, which no label names."""
    return F.coalesce(remainder(key, of) == rest, F.lit(True))
