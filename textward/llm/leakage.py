"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequences.

Documents and items are cut into passages of WIDTH words.  Terms are the words of the items; a term weighs its inverse
document frequency over all documents.  A randomised singular value decomposition of the TF-IDF rows of passages (the
items' own, and every document passage whose weight lies mostly in the terms) is computed in one distributed pass:
each task adds up A'A times a random matrix, and the small sum yields the leading right singular vectors.  Passages
near an item's passage in that space are candidates.  So is every passage with an anchor of an item, one of its rarest
words, one more of them than a leak may miss: copies are found at any place and length, however many documents there
are.  A candidate is a leak if the longest common subsequence of the item's words and the words around the passage is
long enough: a high share of the item alone, or a lower share that holds the item's answer (its last sentence) too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Words of a passage, and from one passage of a document or an item to the next.
WIDTH, STEP, ITEM_STEP = 16, 8, 4
#: Latent dimensions, and columns of the random matrix.
RANK, SKETCH = 128, 144
#: Least share of a passage's weight in the terms, and least cosine of a candidate.
COVERED, NEAR = 0.5, 0.6
#: Share of an item's words, in order, that is a leak; share that is one if at least ANSWER of its answer is there.
CERTAIN, LIKELY, ANSWER = 0.8, 0.65, 0.5
#: Items shorter than this must occur whole.
SHORT = 8
#: Items whose terms, latent space and passages one pass over the documents handles; bounds what is broadcast.
BLOCK_ITEMS = 2_000
#: Passages that are compared at once, and anchors that are looked up at once (more only within one document).
ROWS, PAIRS = 4_096, 1 << 20

FOUND = "array<struct<item_id:{},share:double,cosine:double,first:int>>"


class Items(NamedTuple):
    """Words of some items as places in ``terms``; ``answer`` is where the last sentence begins."""

    ids: list[str | None]  # as text; ``kind`` is their type
    words: list[np.ndarray]
    answer: list[int]
    terms: np.ndarray  # hashes, ascending
    buckets: np.ndarray  # of the hashes' leading bits: whether any term has them
    kind: str = "bigint"


class Anchors(NamedTuple):
    """Items by anchor: those of term ``x`` are ``items[start[x] : start[x + 1]]``; ``least`` words of an item are a leak."""

    start: np.ndarray
    items: np.ndarray
    least: np.ndarray


class Index(NamedTuple):
    items: Items
    weights: np.ndarray  # by term
    other: float  # weight of a word that is no term
    space: np.ndarray  # terms x RANK
    latent: np.ndarray  # item passages x RANK
    owner: np.ndarray  # item of each item passage
    anchors: Anchors


def _items(rows: list[tuple[str | None, str]]) -> Items:
    lowered = W.lowered(pa.array([text for _, text in rows], pa.large_string())).to_pylist()  # as the documents are
    hashes = W.hash_words(lowered, W.ALNUM)
    ends = [[m.end() for m in re.finditer(r"[.?!:\n]+\s+(?=\S)", t.rstrip())] for t in lowered]
    before = W.hash_words([t[: e[-1]] if e else "" for t, e in zip(lowered, ends, strict=True)], W.ALNUM)
    terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    buckets = np.zeros(1 << 16, bool)
    buckets[(terms >> np.uint64(48)).astype(np.int64)] = True
    return Items([i for i, _ in rows], [np.searchsorted(terms, h) for h in hashes], [len(b) for b in before], terms, buckets)


def _terms(h: np.ndarray, items: Items) -> np.ndarray:
    """Place of each hash in the terms, or -1."""
    out = np.full(len(h), -1, np.int64)
    maybe = np.flatnonzero(items.buckets[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.terms, h[maybe]), len(items.terms) - 1)
    out[maybe] = np.where(items.terms[at] == h[maybe], at, -1)
    return out


def _document_counts(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(len(items.terms), np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for w in W.words(W.lowered(batch.column("text")), W.ALNUM):
                t = _terms(w.hash, items)
                pairs = np.unique(w.doc[t >= 0] * len(counts) + t[t >= 0])
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *some], pa.int64()),
                                          "n": pa.array([docs, *counts[some]], pa.int64())})
    return run


class _Passages(NamedTuple):
    """Passages as rows of term places (-1 for none), with what they are of."""

    terms: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def _rows(terms: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``terms`` of the word ranges, each from ``first`` and at most WIDTH words, before ``end``."""
    at = first[:, None] + np.arange(WIDTH)
    inside = at < end[:, None]
    return np.where(inside, terms[np.minimum(at, max(len(terms) - 1, 0))], -2)


def _passages(w: W.Words, t: np.ndarray, weights: np.ndarray, other: float) -> _Passages:
    """Passages of some documents whose weight lies in the terms by COVERED at least."""
    squared = np.where(t >= 0, weights[np.maximum(t, 0)] ** 2, other**2)
    known = np.concatenate([[0.0], np.cumsum(np.where(t >= 0, squared, 0.0))])
    every = np.concatenate([[0.0], np.cumsum(squared)])
    bound = w.bounds()
    begin, n = bound[:-1], np.diff(bound)
    count = np.where(n > 0, np.maximum(-(-(n - WIDTH) // STEP), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = begin[doc] + STEP * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(first + WIDTH, bound[1:][doc])
    keep = known[end] - known[first] >= np.maximum(COVERED * (every[end] - every[first]), 1e-12)
    first, doc, end = first[keep], doc[keep], end[keep]
    return _Passages(_rows(t, first, end), doc, first)


def _weighted(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of each place of a passage in its unit TF-IDF row; repeated terms add up."""
    w = np.where(terms >= 0, weights[np.maximum(terms, 0)], 0.0)
    same = (terms[:, :, None] == terms[:, None, :]) & (terms >= 0)[:, :, None]
    norm = np.sqrt(np.einsum("ri,rij,rj->r", w, same, w))  # sum over terms of (count * weight) squared
    return w / np.maximum(norm, 1e-12)[:, None]


def _project(terms: np.ndarray, weights: np.ndarray, space: np.ndarray) -> np.ndarray:
    out = np.zeros((len(terms), space.shape[1]), np.float32)
    unit = _weighted(terms, weights).astype(np.float32)
    for j in range(terms.shape[1]):
        out += unit[:, j, None] * space[np.maximum(terms[:, j], 0)]
    return out


def _gram_times(terms: np.ndarray, weights: np.ndarray, random: np.ndarray) -> np.ndarray:
    """A'A times the random matrix, for the passages at hand."""
    out = np.zeros(random.shape, np.float64)
    for at in range(0, len(terms), ROWS):
        part = terms[at : at + ROWS]
        y, unit = _project(part, weights, random), _weighted(part, weights)
        row, column = np.nonzero(part >= 0)
        term = part[row, column]
        order = np.argsort(term, kind="stable")
        term, row, column = term[order], row[order], column[order]
        if len(term):
            edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            out[term[edge]] += np.add.reduceat(y[row] * unit[row, column].astype(np.float32)[:, None], edge, axis=0)
    return out


#: Terms whose rows of the sketch travel together.
_TERMS = 512


def _sketches(items: Items, weights: np.ndarray, other: float, random: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(random.shape, np.float64)
        for batch in batches:
            for w in W.words(W.lowered(batch.column("text")), W.ALNUM):
                total += _gram_times(_passages(w, _terms(w.hash, items), weights, other).terms, weights, random)
        for at in range(0, len(total), _TERMS):
            part = total[at : at + _TERMS]
            if part.any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()),
                                                  "sketch": pa.array([part.astype(np.float32).tobytes()], pa.binary())})
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketches with the same place; holds one sum for each place of the partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, sketch in zip(batch.column("at").to_pylist(), batch.column("sketch"), strict=True):
            part = np.frombuffer(sketch.as_py(), np.float32).astype(np.float64)
            sums[at] = sums[at] + part if at in sums else part
    for at, part in sums.items():
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()),
                                          "sketch": pa.array([part.astype(np.float32).tobytes()], pa.binary())})


def _leading(sketch: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of A from A'A times a random matrix (Nystrom's approximation)."""
    if not len(sketch) or not sketch.any():
        return np.zeros((len(random), 1), np.float32)
    shift = 1e-6 * np.linalg.norm(sketch)
    y = sketch + shift * random
    core = random.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * values.max()
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = s**2 > 2 * shift
    return u[:, keep][:, :RANK].astype(np.float32)


def _item_passages(items: Items) -> tuple[np.ndarray, np.ndarray]:
    rows, owner = [], []
    for i, t in enumerate(items.words):
        last = max(len(t) - WIDTH, 0)
        first = np.unique(np.append(np.arange(0, last + 1, ITEM_STEP), last))
        rows.append(_rows(t, first, np.full(len(first), len(t))))
        owner.append(np.full(len(first), i))
    return np.concatenate(rows), np.concatenate(owner)


def _anchors(items: Items, weights: np.ndarray) -> Anchors:
    size = np.array([len(x) for x in items.words], np.int64)
    least = np.where(size < SHORT, size, np.ceil(LIKELY * size - 1e-9).astype(np.int64))
    term, item = [], []
    for i, x in enumerate(items.words):
        rare = np.unique(x[np.argsort(-weights[x], kind="stable")[: size[i] - least[i] + 1]])
        term.append(rare)
        item.append(np.full(len(rare), i))
    terms, owners = np.concatenate(term), np.concatenate(item)
    start = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weights)))])
    return Anchors(start, owners[np.argsort(terms, kind="stable")], least)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def learn(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text") -> list[Index]:
    """Latent indexes of all items, one for each block of BLOCK_ITEMS; document statistics cover all documents.

    Items without words are left out; of items that repeat an id each is searched for.  Ids may be null, and of any
    type that can be cast to a string and back.
    """
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = benchmark.select(F.col(f"`{item}`").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")) \
        .filter(F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    out, block = [], []
    for row in rows.withColumn("id", F.col("id").cast("string")).toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK_ITEMS:
            out += _index(texts, block, kind)
            block = []
    return out + _index(texts, block, kind)


def _index(texts: DataFrame, block: list[tuple[str | None, str]], kind: str) -> list[Index]:
    block = sorted((r for r in block if re.search(r"\w", r[1])), key=lambda r: (r[0] is None, len(r[0] or ""), r))
    items = _items(block)._replace(kind=kind)
    if not len(items.terms):
        return []
    block_words = [bool(len(w)) for w in items.words]
    items = items._replace(ids=[x for x, some in zip(items.ids, block_words, strict=True) if some],
                           words=[x for x in items.words if len(x)],
                           answer=[x for x, some in zip(items.answer, block_words, strict=True) if some])
    counted = texts.mapInArrow(_document_counts(items), "term bigint, n bigint").groupBy("term") \
        .agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    total = int(n[term < 0].sum())
    frequency = np.zeros(len(items.terms))
    frequency[term[term >= 0]] = n[term >= 0]
    weights, other = np.log((total + 1) / (frequency + 1)) + 0.05, float(np.log(total + 1) + 0.05)
    random = np.random.default_rng(11).standard_normal((len(items.terms), SKETCH)).astype(np.float32)
    rows, owner = _item_passages(items)
    partial = texts.mapInArrow(_sketches(items, weights, other, random), "at bigint, sketch binary")
    summed = partial.repartition("at").mapInArrow(_added, "at bigint, sketch binary").toArrow()
    sketch = _gram_times(rows, weights, random)
    for at, part in zip(summed.column("at").to_pylist(), summed.column("sketch"), strict=True):
        x = np.frombuffer(part.as_py(), np.float32).reshape(-1, SKETCH)
        sketch[at : at + len(x)] += x
    space = _leading(sketch, random)
    return [Index(items, weights, other, space, _unit(_project(rows, weights, space)), owner, _anchors(items, weights))]


def common(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of a whole row of the table at a time."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        masks[t] = masks.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for t in region.tolist():
        if m := masks.get(t):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def _judge(items: Items, i: int, t: np.ndarray, first: int) -> float | None:
    """Share of the item that the words around a passage hold in order, if it is a leak."""
    item = items.words[i]
    size = len(item)
    region = t[max(first - size, 0) : first + WIDTH + size]
    around = set(region.tolist())
    if sum(x in around for x in item.tolist()) < (LIKELY * size if size >= SHORT else size):
        return None
    if size < SHORT:
        whole = region[: len(region) - size + 1, None] if size == 1 else \
            np.lib.stride_tricks.sliding_window_view(region, size) if len(region) >= size else np.zeros((0, size))
        return 1.0 if (whole == item).all(axis=1).any() else None
    share = common(item, region) / size
    if share >= CERTAIN:
        return share
    answer = item[items.answer[i]:]
    if share >= LIKELY and common(answer, region) >= ANSWER * len(answer):
        return share
    return None


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges from ``start``, each of ``count`` numbers, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _anchored(w: W.Words, t: np.ndarray, index: Index) -> Iterator[tuple[int, int, list[int]]]:
    """Documents and items, with the first words of the passages that hold an anchor of the item.

    Left out are only pairs where the whole document lacks so many of the item's words that no part can be a leak.
    """
    anchors, bound = index.anchors, w.bounds()
    own = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    at = np.flatnonzero(t >= 0)
    held = np.unique(own[at] * len(index.weights) + t[at])
    at = at[np.diff(anchors.start)[t[at]] > 0]
    doc, count = own[at], np.diff(anchors.start)[t[at]]
    last = np.maximum(-(-(np.diff(bound)[doc] - WIDTH) // STEP), 0)
    passage = np.minimum((at - bound[doc]) // STEP, last)
    item_start = np.concatenate([[0], np.cumsum([len(x) for x in index.items.words])])
    item_terms = np.concatenate(index.items.words)
    cut = np.searchsorted(doc, np.arange(len(bound)))  # documents stay whole
    total, a = np.concatenate([[0], np.cumsum(count)]), 0
    while a < len(bound) - 1:
        b = max(int(np.searchsorted(total[cut], total[cut[a]] + PAIRS, "right")) - 1, a + 1)
        x = slice(cut[a], cut[b])
        item = anchors.items[_spread(anchors.start[t[at[x]]], count[x])]
        rows = np.stack([np.repeat(doc[x], count[x]), item, np.repeat(passage[x], count[x])], axis=1)
        a = b
        if not len(rows):
            continue
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
        pair_doc, pair_item = rows[first, 0], rows[first, 1]
        size = item_start[pair_item + 1] - item_start[pair_item]
        key = np.repeat(pair_doc, size) * len(index.weights) + item_terms[_spread(item_start[pair_item], size)]
        there = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
        enough = np.add.reduceat(there, np.cumsum(size) - size, dtype=np.int64) >= anchors.least[pair_item]
        end = np.append(first[1:], len(rows))
        for k in np.flatnonzero(enough).tolist():
            yield int(pair_doc[k]), int(pair_item[k]), (STEP * np.unique(rows[first[k] : end[k], 2])).tolist()


def _cosine(index: Index, i: int, t: np.ndarray, first: int) -> float:
    z = _unit(_project(_rows(t, np.array([first]), np.array([len(t)])), index.weights, index.space))
    return float((z @ index.latent[index.owner == i].T).max())


def _search(w: W.Words, index: Index) -> Iterator[tuple[int, int, float, float, int]]:
    """Document, item, share, cosine and first word of every leak in some documents."""
    t = _terms(w.hash, index.items)
    found = _passages(w, t, index.weights, index.other)
    bound = w.bounds()
    near: dict[tuple[int, int], dict[int, float]] = {}
    for at in range(0, len(found.doc), ROWS):
        z = _unit(_project(found.terms[at : at + ROWS], index.weights, index.space))
        cosine = z @ index.latent.T
        row, column = np.nonzero(cosine >= NEAR)
        for r, c, x in zip((row + at).tolist(), index.owner[column].tolist(), cosine[row, column].tolist(), strict=True):
            doc = int(found.doc[r])
            places, first = near.setdefault((doc, c), {}), int(found.first[r] - bound[doc])
            places[first] = max(x, places.get(first, 0.0))
    for doc, item, firsts in _anchored(w, t, index):
        places = near.setdefault((doc, item), {})
        for first in firsts:
            places.setdefault(first, -1.0)  # after those that are near
    for (doc, item), places in near.items():
        own = t[bound[doc] : bound[doc + 1]]
        for first, x in sorted(places.items(), key=lambda p: (-p[1], p[0])):
            share = _judge(index.items, item, own, first)
            if share is not None:
                if x < 0:
                    x = _cosine(index, item, own, first)
                yield w.first + doc, index.items.ids[item], share, min(x, 1.0), first
                break


def leaks(text: Column, indexes: list[Index]) -> Column:
    """Items that a text holds, with the share of the item's words and the cosine of the passage that gave it away.

    Null, empty and wordless texts hold none; without items the array is empty.
    """
    parts = [_leaks_of(text, index) for index in indexes]
    if not parts:
        return F.array().cast(FOUND.format("bigint"))
    return F.concat(*parts).cast(FOUND.format(indexes[0].items.kind))


def _leaks_of(text: Column, index: Index) -> Column:
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(index)

    @F.arrow_udf(FOUND.format("string"))
    def run(texts: pa.Array) -> pa.Array:
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for w in W.words(W.lowered(texts), W.ALNUM):
            for doc, item, share, cosine, first in _search(w, shared.value):
                found[doc].append({"item_id": item, "share": share, "cosine": cosine, "first": first})
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("share", pa.float64()), ("cosine", pa.float64()),
                                   ("first", pa.int32())]))
        return pa.array(found, kind)

    return run(text)
