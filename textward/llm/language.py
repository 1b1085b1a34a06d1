"""Language by rank-order profiles: out-of-place distance between a text's most frequent n-grams and each language's.

N-grams are one to three letters long, lower-cased, and taken from words padded by one blank on each side; every
other character is a blank.  A profile lists the most frequent n-grams of a language's training texts in order.  The
distance of a text is the sum, over its own most frequent n-grams, of how far each is from its place in the profile;
one that the profile lacks counts as the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: N-grams in a profile, of a language and of a text.
PROFILE = 300
#: Characters whose n-grams are counted at once.
PIECE = 1 << 20
UNDETERMINED = "und"


class Profiles(NamedTuple):
    """``ranks[i, j]`` is the place of n-gram ``codes[j]`` in the profile of ``languages[i]``."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text as numbers, ascending, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(points) + 2, np.uint16)
    c[1:-1] = np.where(_letters()[points], np.minimum(points, 0xFFFF), 0)
    found = []
    for at in range(0, len(points) + 1, PIECE):
        x = c[at : at + PIECE + 2].astype(np.int64)
        a, b, z = x[:-2], x[1:-1], x[2:]
        two = x[:-1] << 16 | x[1:] if at + PIECE >= len(points) else a << 16 | b
        middle = b > 0
        found.append(np.unique(np.concatenate([
            b[middle] | 1 << 48, two[two > 0] | 2 << 48, (a << 32 | b << 16 | z)[middle] | 3 << 48]),
            return_counts=True))
    return merged(found)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by code."""
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            parts = counts.setdefault(lang.as_py(), [])
            parts.append(gram_counts(text.as_py()))
            if len(parts) > 200:
                parts[:] = [merged(parts)]
    for lang, parts in counts.items():
        codes, n = merged(parts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()),
                                          "code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of all rows whose text and language are not null; ties between n-grams go to the smaller number.

    Rows that repeat count again.  Without rows, no language is known and every text is undetermined.
    """
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")) \
        .filter(F.col("t").isNotNull() & F.col("l").isNotNull())
    counts = rows.mapInArrow(_count_partition, "lang string, code bigint, n bigint") \
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).collect()
    languages = sorted({r.lang for r in top})
    codes = np.array(sorted({r.code for r in top}), np.int64)
    ranks = np.full((len(languages), len(codes)), size, np.int32)
    at = {lang: i for i, lang in enumerate(languages)}
    for r in top:
        ranks[at[r.lang], np.searchsorted(codes, r.code)] = r.rank
    return Profiles(languages, codes, ranks)


def distances(text: str, profiles: Profiles, size: int = PROFILE) -> np.ndarray | None:
    """Out-of-place distance to each profile, from 0 to 1; None for a text without letters."""
    codes, counts = gram_counts(text)
    if not len(codes):
        return None
    top = codes[np.argsort(-counts, kind="stable")[:size]]
    at = np.minimum(np.searchsorted(profiles.codes, top), len(profiles.codes) - 1)
    known = profiles.codes[at] == top
    place = np.arange(len(top))
    apart = np.abs(profiles.ranks[:, at[known]] - place[known])
    apart[profiles.ranks[:, at[known]] == size] = size
    return (np.minimum(apart, size).sum(1) + size * (~known).sum()) / (size * len(top))


def decide(text: str | None, profiles: Profiles, size: int = PROFILE) -> tuple[str, float]:
    """Nearest language, of equals the first by name, and how much nearer it is than the second."""
    d = distances(text, profiles, size) if text and profiles.languages else None
    if d is None:
        return UNDETERMINED, 0.0
    best = int(np.argmin(d))
    if len(d) == 1:
        return profiles.languages[0], float(1 - d[0])
    second = float(np.partition(d, 1)[1])
    return profiles.languages[best], float((second - d[best]) / second) if second > 0 else 0.0


def identify(text: Column, profiles: Profiles, size: int = PROFILE) -> Column:
    """``struct<lang, score>`` of a text; ``und`` with score 0 for one that is null or has no letter."""
    @F.arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        found = [decide(t.as_py(), profiles, size) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                           pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return run(text)
