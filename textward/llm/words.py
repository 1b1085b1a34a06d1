"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over its bytes, taken from prefix sums over a block of text and brought to the
word's start by the inverse power, then mixed.  It depends on the word alone, so hashes agree between rows, tasks
and runs.  With n different words, the chance that any two agree is about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose prefix sums are held at once, and of rows that are handled together.
BLOCK = 1 << 20
SLICE = 2 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Word characters: everything but the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word characters: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    """Words of some consecutive rows: ``doc`` is the row within the column, ``start`` and ``end`` are byte places
    in ``data``; ``first`` and ``last`` are the rows covered, those without words included."""

    first: int
    last: int
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def bounds(self) -> np.ndarray:
        """Place of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.first, self.last + 1))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) <= n:
        size = max(n, 2 * BLOCK)
        _TABLES["up"], _TABLES["down"] = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)
    return _TABLES["up"], _TABLES["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the place where each row begins; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case, of any script."""
    return pc.utf8_lower(texts.cast(pa.large_string()))


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, at least one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, which are disjoint and in order."""
    out = np.empty(len(start), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(start):
            at = int(start[done])
            upto = max(done + 1, int(np.searchsorted(end, at + BLOCK, "right")))
            stop = int(end[upto - 1])
            up, down = _power_tables(stop - at)
            sums = np.zeros(stop - at + 1, np.uint64)
            np.cumsum(_LETTERS[data[at:stop]] * up[: stop - at], out=sums[1:])
            s, e = start[done:upto] - at, end[done:upto] - at
            out[done:upto] = mix((sums[e] - sums[s]) * down[s])
            done = upto
    return out


def words(texts: pa.Array, inside: np.ndarray = NOT_SPACE, ascii_lower: bool = True) -> Iterator[Words]:
    """Words of every row, some rows at a time; ``inside`` tells which bytes belong to a word."""
    data, offsets = text_bytes(texts)
    for first, last in slices(offsets):
        base = offsets[first]
        block = data[base : offsets[last]]
        if ascii_lower:
            block = _ASCII_LOWER[block]
        own = offsets[first : last + 1] - base
        # One more byte after each row keeps the last word of a row apart from the first of the next.
        member = np.zeros(len(block) + last - first + 1, bool)
        shift = np.repeat(np.arange(last - first), np.diff(own)) + 1
        member[np.arange(len(block)) + shift] = inside[block]
        edges = np.flatnonzero(member[1:] != member[:-1])
        start, end = edges[0::2], edges[1::2]
        doc = np.searchsorted(own + np.arange(last - first + 1), start, "right") - 1
        start, end = start - doc, end - doc
        yield Words(first, last, doc + first, hash_spans(block, start, end), start, end, block)


def hash_words(texts: list[str], inside: np.ndarray = NOT_SPACE, ascii_lower: bool = True) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    out: list[np.ndarray] = []
    for w in words(pa.array(texts, pa.large_string()), inside, ascii_lower):
        out += np.split(w.hash, w.bounds()[1:-1]) if w.last - w.first > 1 else [w.hash]
    return out
