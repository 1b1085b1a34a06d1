"""Secrets: three patterns, and strings that look drawn at random.

A candidate is a run of at least 16 characters of the usual encodings; digits alone are a number (of a card, an order,
a time), however random, and no candidate.  The smallest alphabet that holds it (16, 32,
62 or 64 symbols) is inferred, and three tests compare it with uniform independent draws from that alphabet: the
chi-squared test of uniformity (through the number of equal pairs, with its exact moments), a runs test over classes
of symbols, and the serial correlation of neighbours.  Ordinary strings have too many equal pairs, too few runs and
correlated neighbours.  The sum of the three standard scores is near zero for random strings and grows with the
length of ordinary ones.

Which sums are rare among ordinary strings is learnt from all documents: character pairs of the whole corpus, with
word boundaries, give a Markov chain, restricted to each alphabet.  Words drawn from it, joined in the usual styles
of names, tell mean and deviation of the sum by style and length.  A candidate's p-value is the greatest chance, over
the styles, that an ordinary string of its alphabet and length looks so random.  Over all different candidates of the
corpus the Benjamini-Hochberg cut keeps the expected share of ordinary strings among the reported ones under a bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import staged

#: The patterns, with the least length of what must be long.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
#: Least length of a candidate, greatest sum (in standard deviations) of one that still looks random, and share of
#: ordinary strings among the reported ones.
LEAST, RANDOM, FALSE = 16, 3.1, 0.05
#: Character pairs from which on a text counts as one of so many, so that no long text rules the chain.
PAIRS = 1000
#: Lengths at which ordinary strings are drawn, and how many of them; longer candidates are judged as the longest.
LENGTHS = (16, 20, 24, 32, 48, 64, 96, 128)
DRAWN = 1000
#: Styles of names: whether words begin with a capital, and what stands between them.
STYLES = ((False, b""), (True, b""), (False, b"_"), (True, b"_"))
#: p-values are counted in steps of a tenth of a power of ten.
STEPS = 400

SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"


class Encoding(NamedTuple):
    size: int
    share: np.ndarray  # of the classes: lower case, upper case, digits, others


#: Of hexadecimal strings, letters of either case are one class.
ENCODINGS = (
    Encoding(16, np.array([6, 0, 10, 0]) / 16), Encoding(32, np.array([0, 26, 6, 0]) / 32),
    Encoding(62, np.array([26, 26, 10, 0]) / 62), Encoding(64, np.array([26, 26, 10, 2]) / 64),
)
_CLASS = np.full(256, 3, np.int8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_INSIDE = _CLASS < 3
_INSIDE[list(b"+/-_")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _values() -> np.ndarray:
    """Place of each byte in each alphabet, -1 outside."""
    out = np.full((len(ENCODINGS), 256), -1, np.int64)
    for place, byte in enumerate(b"0123456789abcdef"):
        out[0, byte] = out[0, bytes([byte]).upper()[0]] = place
    for place, byte in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        out[1, byte] = place
    for place, byte in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
        out[2:, byte] = place
    out[3, list(b"+-")], out[3, list(b"/_")] = 62, 63
    return out


VALUES = _values()


class Law(NamedTuple):
    """Mean and deviation of the sum for ordinary strings, styles x encodings x LENGTHS, and the greatest p-value
    (as common logarithm) that is reported."""

    mean: np.ndarray
    deviation: np.ndarray
    cut: float


def _runs(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are inside; the last byte is outside."""
    member = inside[data]
    edges = np.flatnonzero(np.diff(member, prepend=False))
    return edges[0::2], edges[1::2]


def _candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least LEAST characters of one encoding; a run with signs of both base-64 alphabets is cut at + and /."""
    start, end = _runs(data, _INSIDE)
    long_ = end - start >= LEAST
    start, end = start[long_], end[long_]
    mixed = [i for i, (a, b) in enumerate(zip(start, end, strict=True))
             if np.isin(data[a:b], list(b"+/")).any() and np.isin(data[a:b], list(b"-_")).any()]
    more = []
    for i in mixed:
        part = np.append(data[start[i] : end[i]], 0)
        a, b = _runs(np.where(np.isin(part, list(b"+/")), 0, part), _INSIDE)
        more.append(np.column_stack([a, b])[b - a >= LEAST] + start[i])
    if mixed:
        both = np.concatenate([np.delete(np.column_stack([start, end]), mixed, axis=0), *more])
        both = both[np.argsort(both[:, 0])]
        start, end = both[:, 0], both[:, 1]
    return start, end


def _encodings(kinds: np.ndarray, first: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Encoding of each string: strings are laid end to end, ``first`` are their beginnings."""
    def all_of(x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduceat(x, first)

    one_case = all_of(kinds != 0) | all_of(kinds != 1)
    return np.where(all_of(VALUES[0, raw] >= 0) & one_case, 0,
                    np.where(all_of(VALUES[1, raw] >= 0), 1, np.where(all_of(kinds < 3), 2, 3)))


def _moments(e: int) -> tuple[float, float, float]:
    """Chance that two, and three, symbols are of one class, and mean product of two values if such pairs alone count."""
    size, share = ENCODINGS[e]
    symbols = np.flatnonzero(VALUES[e] >= 0)
    value = (VALUES[e, symbols] - (size - 1) / 2) / math.sqrt((size ** 2 - 1) / 12)
    kind = _CLASS[symbols]
    means = [value[kind == k].mean() if (kind == k).any() else 0.0 for k in range(4)]
    return float((share ** 2).sum()), float((share ** 3).sum()), float(((share * means) ** 2).sum())


def battery(raw: np.ndarray, lengths: np.ndarray, encoding: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Encoding, and sum of the three standard scores, of strings laid end to end (two bytes each at least)."""
    first = np.cumsum(lengths) - lengths
    kinds = _CLASS[raw]
    encoding = _encodings(kinds, first, raw) if encoding is None else encoding
    own = np.repeat(np.arange(len(lengths)), lengths)
    value = VALUES[encoding[own], raw]
    kinds = np.where((encoding[own] == 0) & (kinds == 1), 0, kinds)
    size = np.array([e.size for e in ENCODINGS])[encoding].astype(float)
    n = lengths.astype(float)

    counts = np.bincount(own * 64 + value, minlength=64 * len(lengths)).reshape(-1, 64).astype(float)
    equal, pairs = (counts * (counts - 1) / 2).sum(axis=1), n * (n - 1) / 2
    uniformity = (equal - pairs / size) / np.sqrt(pairs / size * (1 - 1 / size))

    inner = own[1:] == own[:-1]
    alike = np.bincount(own[1:][inner & (kinds[1:] == kinds[:-1])], minlength=len(lengths))
    square, cube, tie = (np.array(x)[encoding] for x in zip(*map(_moments, range(len(ENCODINGS))), strict=True))
    deviation = np.sqrt((n - 1) * square * (1 - square) + 2 * (n - 2) * (cube - square ** 2))
    runs = (alike - (n - 1) * square) / deviation

    spread = (value - (size[own] - 1) / 2) / np.sqrt((size[own] ** 2 - 1) / 12)
    serial = np.bincount(own[1:][inner], (spread[1:] * spread[:-1])[inner], len(lengths)) / np.sqrt(n - 1)
    # Covariances, of neighbours only: equal symbols are of one class, and symbols of one class have values alike.
    equals = np.sqrt(pairs / size * (1 - 1 / size))
    shared = (n - 1) * (tie / deviation / np.sqrt(n - 1)
                        + (1 - square) / size / equals / deviation + 1 / size / equals / np.sqrt(n - 1))
    return encoding, (uniformity + runs + serial) / np.sqrt(3 + 2 * shared)


def _tail(z: np.ndarray) -> np.ndarray:
    """Common logarithm of the chance that a standard normal variable is at most z."""
    plain = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in np.maximum(z, -20)])
    far = -(z ** 2) / 2 / math.log(10) - np.log10(np.maximum(-z, 1) * math.sqrt(2 * math.pi))
    return np.where(z > -20, np.log10(plain), far)


def chances(encoding: np.ndarray, lengths: np.ndarray, total: np.ndarray, law: Law) -> np.ndarray:
    """Common logarithm of each candidate's p-value; 0 for those that are not like random strings."""
    at, grid = np.sqrt(np.minimum(lengths, LENGTHS[-1])), np.sqrt(LENGTHS)
    out = np.full(len(lengths), -np.inf)
    for e in range(len(ENCODINGS)):
        own = encoding == e
        for mean, deviation in zip(law.mean[:, e], law.deviation[:, e], strict=True):
            z = (total[own] - np.interp(at[own], grid, mean)) / np.interp(at[own], grid, deviation)
            out[own] = np.maximum(out[own], _tail(z))
    return np.where(np.abs(total) <= RANDOM, out, 0.0)


def _drawn(pairs: np.ndarray, e: int, rng: np.random.Generator) -> np.ndarray:
    """Bytes of strings of the chain, blanks between words; letters are folded to the case that the encoding has."""
    folded = np.arange(256)
    if e == 0:
        folded[0x41:0x5B] += 0x20
    if e == 1:
        folded[0x61:0x7B] -= 0x20
    symbols = np.unique([0x20, *folded[np.flatnonzero(VALUES[e] >= 0)]])
    place = np.full(256, -1)
    place[symbols] = np.arange(len(symbols))
    a, b = place[folded[np.repeat(np.arange(256), 256)]], place[folded[np.tile(np.arange(256), 256)]]
    known = (a >= 0) & (b >= 0)
    chain = 1.0 + np.bincount(a[known] * len(symbols) + b[known], pairs.reshape(-1)[known] / 1024, len(symbols) ** 2)
    chain = chain.reshape(len(symbols), -1)
    chain[0, 0] = 0  # the blank is the first symbol and never repeats
    steps = np.cumsum(chain / chain.sum(axis=1)[:, None], axis=1)
    out = np.zeros((DRAWN, 2 * LENGTHS[-1] + 1), np.int64)
    for i in range(1, out.shape[1]):
        out[:, i] = np.minimum((steps[out[:, i - 1]] < rng.random(DRAWN)[:, None]).sum(axis=1), len(symbols) - 1)
    return symbols[out]


def ordinary(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the sum for ordinary strings, from counts of pairs of bytes (256 x 256, in 1/1024).

    Every pair of symbols counts once more than it was seen, so without texts nothing is told from random strings.
    """
    rng = np.random.default_rng(7)
    mean, deviation = np.zeros((2, len(STYLES), len(ENCODINGS), len(LENGTHS)))
    for e, encoding in enumerate(ENCODINGS):
        drawn = _drawn(pairs, e, rng)
        for s, (capital, between) in enumerate(STYLES):
            words = drawn.astype(np.uint8)
            if capital and encoding.size > 32:
                begins = (words[:, 1:] >= 0x61) & (words[:, 1:] <= 0x7A) & (words[:, :-1] == 0x20)
                words[:, 1:][begins] -= 0x20
            if encoding.size < 64:
                between = b""
            joined = [row.tobytes()[1:].replace(b" ", between)[: LENGTHS[-1]] for row in words]
            names = np.frombuffer(b"".join(joined), np.uint8).reshape(DRAWN, -1)
            for j, n in enumerate(LENGTHS):
                _, total = battery(names[:, :n].reshape(-1), np.full(DRAWN, n), np.full(DRAWN, e))
                mean[s, e, j], deviation[s, e, j] = total.mean(), max(total.std(), 0.5)
    return mean, deviation


class _Rows(NamedTuple):
    """Some rows' bytes, each row followed by a byte 0."""

    first: int  # number of the first row
    begins: np.ndarray  # place of each row's first byte, and the end
    data: np.ndarray


def _rows(texts: pa.Array) -> Iterator[_Rows]:
    data, offsets = W.text_bytes(texts)
    for first, last in W.slices(offsets):
        own = offsets[first : last + 1] - offsets[first]
        begins = own + np.arange(last - first + 1)
        out = np.zeros(begins[-1], np.uint8)
        out[np.arange(own[-1]) + np.repeat(np.arange(last - first), np.diff(own))] = data[offsets[first] : offsets[last]]
        yield _Rows(first, begins, out)


def _patterns(rows: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, start and end (bytes) of what the three patterns find, by start."""
    found = []
    whole = rows.data.tobytes()  # a byte 0 belongs to no pattern, so no match goes over the end of a row
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(whole) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(whole) if m.end() - m.start() >= ACCESS_LENGTH]
    start, end = _runs(rows.data, _HEX)
    long_ = end - start >= HEX_LENGTH
    found += [(a, 2, b) for a, b in zip(start[long_].tolist(), end[long_].tolist(), strict=True)]
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    return out[:, 1], out[:, 0], out[:, 2]


def _tested(rows: _Rows, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, encoding and sum of the candidates that overlap none of the given spans."""
    a, b = _candidates(rows.data)
    if not len(a):
        return a, b, a, a.astype(float)
    # Spans of different kinds may overlap: the greatest end of all that begin before a candidate's end decides.
    reach = np.concatenate([[0], np.maximum.accumulate(end)]) if len(end) else np.zeros(1, np.int64)
    free = reach[np.searchsorted(start, b)] <= a
    a, b = a[free], b[free]
    if not len(a):
        return a, b, a, a.astype(float)
    lengths = b - a
    first = np.cumsum(lengths) - lengths
    raw = rows.data[np.arange(lengths.sum()) + np.repeat(a - first, lengths)]
    named = ~np.logical_and.reduceat(_CLASS[raw] == 2, first)  # not a number
    a, b, raw = a[named], b[named], raw[np.repeat(named, lengths)]
    return (a, b, *battery(raw, b - a)) if len(a) else (a, b, a, a.astype(float))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character pairs (pair, n; in units of 1/1024), and candidates (hash, encoding, length, total)."""
    pairs, seen = np.zeros(1 << 16, np.int64), {}
    for batch in batches:
        for rows in _rows(batch.column("text")):
            letters = np.where(_INSIDE[rows.data], rows.data, 0x20).astype(np.int64)
            two = letters[:-1] << 8 | letters[1:]
            at = np.flatnonzero(two != 0x2020)
            row = np.searchsorted(rows.begins, at, "right") - 1
            share = np.maximum(1, np.minimum(1024, 1024 * PAIRS // np.maximum(np.bincount(row), 1)))
            pairs += np.bincount(two[at], share[row], 1 << 16).astype(np.int64)
            _, start, end = _patterns(rows)
            a, b, encoding, total = _tested(rows, start, end)
            if len(a):
                h, one = np.unique(W.hash_spans(rows.data, a, b), return_index=True)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(h.view(np.int64)), "n": pa.array((b - a)[one], pa.int64()),
                    "encoding": pa.array(encoding[one], pa.int64()), "total": pa.array(total[one], pa.float64())})
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_pydict({
        "key": pa.array(at, pa.int64()), "n": pa.array(pairs[at], pa.int64()),
        "encoding": pa.array(np.full(len(at), -1), pa.int64()), "total": pa.array(np.zeros(len(at)), pa.float64())})


def cut_of(counts: dict[int, int], false: float = FALSE) -> float:
    """Greatest p-value (as common logarithm) of the Benjamini-Hochberg cut; ``counts`` are p-values by step."""
    total, below, cut = sum(counts.values()), 0, -math.inf
    for step in sorted(counts, reverse=True):  # step s holds p-values of at most 10 ** (-s / 10)
        below += counts[step]
        if total * 10 ** (-step / 10) <= false * below:
            cut = -step / 10
    return cut


def learn(docs: DataFrame, text: str = "text", false: float = FALSE) -> Law:
    """The law of ordinary strings and the cut, from all texts (one pass; of equal candidates one counts)."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    surveyed = staged(texts.mapInArrow(_survey, "key bigint, n bigint, encoding bigint, total double"))
    pairs = np.zeros(1 << 16)
    counted = surveyed.filter("encoding = -1").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    pairs[counted.column("key").to_numpy()] = counted.column("n").to_numpy()
    law = Law(*ordinary(pairs.reshape(256, 256)), -math.inf)

    @F.arrow_udf("int")
    def step(encoding: pa.Array, n: pa.Array, total: pa.Array) -> pa.Array:
        p = chances(*(np.asarray(x) for x in (encoding, n, total)), law)
        return pa.array(np.clip(np.floor(-10 * p), 0, STEPS).astype(np.int32))

    different = surveyed.filter("encoding >= 0").groupBy("key", "n", "encoding").agg(F.min("total").alias("total"))
    steps = different.select(step("encoding", "n", "total").alias("step")).groupBy("step").count().collect()
    return law._replace(cut=cut_of({r["step"]: r["count"] for r in steps}, false))


def spans(text: Column, law: Law) -> Column:
    """``array<struct<kind, start, end>>`` of a text, by start and kind: code points, end exclusive.

    Kinds are places in KINDS; a random string is reported if it overlaps nothing that a pattern finds.  Null and empty
    texts have none.
    """
    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for rows in _rows(texts):
            kind, start, end = _patterns(rows)
            a, b, encoding, total = _tested(rows, start, end)
            hit = chances(encoding, b - a, total, law) <= law.cut if len(a) else np.zeros(0, bool)
            kind = np.concatenate([kind, np.full(hit.sum(), 3)])
            start, end = np.concatenate([start, a[hit]]), np.concatenate([end, b[hit]])
            order = np.lexsort((kind, start))
            kind, start, end = kind[order], start[order], end[order]
            row = np.searchsorted(rows.begins, start, "right") - 1
            for r in np.unique(row):
                a, b = np.searchsorted(row, (r, r + 1))
                begin = rows.begins[r]
                points = np.cumsum((rows.data[begin : end[a:b].max()] & 0xC0) != 0x80)
                at = np.concatenate([[0], points])
                out[rows.first + r] = [
                    {"kind": int(k), "start": int(s), "end": int(e)} for k, s, e in
                    zip(kind[a:b], at[start[a:b] - begin], at[end[a:b] - begin], strict=True)]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def digest(df: DataFrame, key: str, found: str) -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans``: counts, hash of what the patterns found, and all spans."""
    all_ = F.col(f"`{found}`")
    names = F.array(*map(F.lit, KINDS))

    def joined(spans_: Column) -> Column:
        return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter(all_, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    base = F.filter(all_, lambda s: s["kind"] < 3)
    return df.select(F.col(f"`{key}`"), *map(count, range(3)), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                     joined(all_).alias("spans"))
