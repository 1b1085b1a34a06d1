"""Unigram pieces: Viterbi encoding over a double-array trie, and decoding.

The model file names the pieces.  Its scores are used as they are where the model is a unigram model; the file at
hand ranks merges instead, so a piece's log score then follows Zipf's law on its rank.  Text is marked (each blank
becomes the marker, one marker goes in front), cut at places that no piece crosses, and each different cut is encoded
once: the trie gives all pieces that start at a place, and the best sum of scores wins, of equals the one whose last
piece starts first.  A character that no piece covers costs ten less than the lowest score and becomes byte pieces.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import slices, text_bytes

MARK = "▁"
#: Bytes of text whose cuts are encoded together, and of a cut that is encoded among others of its length.
TOGETHER, WIDEST = 4 << 20, 64
#: Different cuts that are encoded in one array operation.
ROWS = 1 << 16


class Trie(NamedTuple):
    """Node ``base[s] + byte + 1`` follows node s if its ``check`` is s; ``value`` is the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(pieces: dict[bytes, int]) -> Trie:
        keys = sorted(pieces)
        base, check, value = [0], [-1], [-1]
        used = bytearray(1)
        free = 1
        todo = [(0, 0, len(keys), 0)]  # node, keys from, to, depth
        while todo:
            node, a, b, depth = todo.pop()
            if len(keys[a]) == depth:
                value[node] = pieces[keys[a]]
                a += 1
            children, at = [], a
            while at < b:
                c, begin = keys[at][depth], at
                while at < b and keys[at][depth] == c:
                    at += 1
                children.append((c + 1, begin, at))
            if not children:
                continue
            lowest, tried = children[0][0], 0
            at = max(free, lowest + 1)
            while True:
                while at < len(used) and used[at]:
                    at += 1
                    tried += 1
                start = at - lowest
                if all(start + c >= len(used) or not used[start + c] for c, _, _ in children):
                    break
                at += 1
                tried += 1
            if tried > 512:  # what lies before is nearly full
                free = at
            grow = start + 257 - len(used)
            if grow > 0:
                used.extend(bytes(grow))
                base.extend([0] * grow), check.extend([-1] * grow), value.extend([-1] * grow)
            base[node] = start
            for c, begin, end in children:
                used[start + c], check[start + c] = 1, node
                todo.append((start + c, begin, end, depth + 1))
        return Trie(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


class Pieces(NamedTuple):
    """A model: trie, log scores by piece, byte pieces by byte, bytes of every piece, and where texts may be cut."""

    trie: Trie
    scores: np.ndarray
    bytes: np.ndarray
    blob: np.ndarray
    starts: np.ndarray
    longest: int
    unknown: float
    cuts: str | None


def load(path: str) -> Pieces:
    """Read a model file (on the driver; its size is that of its vocabulary)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                         or model.is_unused(i))]
    given = np.array([model.get_score(i) for i in range(n)])
    ranked = bool(np.median(np.diff(np.sort(given[plain]))) == 1.0)  # unigram scores are no whole steps apart
    texts = {i: model.id_to_piece(i) for i in range(n)}
    by_byte = {int(texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    return build({texts[i]: (i, given[i]) for i in plain}, by_byte, n, ranked)


def build(pieces: dict[str, tuple[int, float]], by_byte: dict[int, int], size: int, ranked: bool = False) -> Pieces:
    """A model of ``pieces`` (id and score); ``ranked``: the order of scores is that of ranks by frequency."""
    if len(by_byte) != 256:
        raise ValueError("the model needs a piece for every byte")
    scores = np.full(size, -np.inf)
    order = sorted(pieces.values(), key=lambda p: (-p[1], p[0]))
    total = float(np.log(np.sum(1 / np.arange(1, len(order) + 1)))) if order else 0.0
    for rank, (i, score) in enumerate(order):
        scores[i] = -np.log(rank + 1) - total if ranked else score
    trie = Trie.build({text.encode(): i for text, (i, _) in pieces.items() if text})
    raw = [b""] * size
    for text, (i, _) in pieces.items():
        raw[i] = text.replace(MARK, " ").encode()
    byte_ids = np.zeros(256, np.int32)
    for b, i in by_byte.items():
        raw[i], byte_ids[b] = bytes([b]), i
    inner = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.DOTALL)
    cuts = None if any(inner.search(t) for t in pieces) else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"
    lengths = np.array([len(r) for r in raw])
    finite = scores[np.isfinite(scores)]
    return Pieces(trie, scores, byte_ids, np.frombuffer(b"".join(raw), np.uint8),
                  np.concatenate([[0], np.cumsum(lengths)]), max((len(t.encode()) for t in pieces), default=1),
                  float(finite.min() if len(finite) else 0.0) - 10.0, cuts)


def _width(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins with this byte."""
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def viterbi(texts: list[bytes], model: Pieces) -> list[np.ndarray]:
    """Piece ids of each text, all computed side by side; texts should be of about the same length."""
    n, size = len(texts), np.array([len(t) for t in texts])
    wide = int(size.max(initial=0))
    data = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(n, wide)
    base, check, value = model.trie
    best = np.full((n, wide + 1), -np.inf)
    best[:, 0] = 0
    begin = np.zeros((n, wide + 1), np.int32)
    piece = np.full((n, wide + 1), -1, np.int32)
    for s in range(wide):
        rows = np.flatnonzero(best[:, s] > -np.inf)
        rows = rows[size[rows] > s]
        if not len(rows):
            continue
        width = _width(data[rows, s])
        covered = np.zeros(n, bool)
        everyone, their_width = rows, width
        own = np.zeros(n, np.int64)
        own[rows] = width
        node = np.zeros(len(rows), np.int64)
        for e in range(s, min(wide, s + model.longest)):
            to = base[node] + data[rows, e] + 1
            to[to >= len(check)] = 0
            ok = check[to] == node
            ok &= to > 0
            rows, node = rows[ok], to[ok].astype(np.int64)
            if not len(rows):
                break
            ends = value[node]
            hit = np.flatnonzero(ends >= 0)
            if len(hit):
                r, p = rows[hit], ends[hit]
                covered[r[own[r] == e + 1 - s]] = True
                score = best[r, s] + model.scores[p]
                up = score > best[r, e + 1]
                best[r[up], e + 1], begin[r[up], e + 1], piece[r[up], e + 1] = score[up], s, p[up]
            more = size[rows] > e + 1
            rows, node = rows[more], node[more]
            if not len(rows):
                break
        bare = ~covered[everyone]
        r, e = everyone[bare], s + their_width[bare]
        score = best[r, s] + model.unknown
        up = score > best[r, e]
        best[r[up], e[up]], begin[r[up], e[up]], piece[r[up], e[up]] = score[up], s, -1
    out = np.full((n, wide), -1, np.int32)
    rows, at = np.flatnonzero(size > 0), size[size > 0]
    while len(rows):
        p, s = piece[rows, at], begin[rows, at]
        known = p >= 0
        out[rows[known], s[known]] = p[known]
        for r, a, b in zip(rows[~known], s[~known], at[~known], strict=True):
            out[r, a:b] = model.bytes[data[r, a:b]]
        rows, at = rows[s > 0], s[s > 0]
    flat, counts = out[out >= 0], (out >= 0).sum(1)
    return np.split(flat, np.cumsum(counts)[:-1]) if n else []


def _long(text: bytes, model: Pieces) -> np.ndarray:
    """The same for one text of any length, place by place."""
    base, check, value = model.trie
    n = len(text)
    best, begin, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    scores, limit = model.scores, len(check)
    for s in range(n):
        if best[s] == -np.inf:
            continue
        width = 1 + (text[s] >= 0xC0) + (text[s] >= 0xE0) + (text[s] >= 0xF0)
        node, covered = 0, False
        for e in range(s, min(n, s + model.longest)):
            to = int(base[node]) + text[e] + 1
            if to >= limit or check[to] != node:
                break
            node, p = to, value[to]
            if p >= 0:
                covered |= e + 1 - s == width
                score = best[s] + scores[p]
                if score > best[e + 1]:
                    best[e + 1], begin[e + 1], piece[e + 1] = score, s, int(p)
        if not covered and best[s] + model.unknown > best[s + width]:
            best[s + width], begin[s + width], piece[s + width] = best[s] + model.unknown, s, -1
    out, at = [], n
    while at:
        s = begin[at]
        out.append([piece[at]] if piece[at] >= 0 else [int(model.bytes[b]) for b in text[s:at]])
        at = s
    return np.array([i for ids in reversed(out) for i in ids], np.int32)


def encode_all(texts: list[str], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the number of each; an empty text has none."""
    cut = re.compile(model.cuts).findall if model.cuts else lambda t: [t]
    places: dict[str, int] = {}
    docs = [[places.setdefault(x, len(places)) for x in cut(MARK + t.replace(" ", MARK))] if t else [] for t in texts]
    raw = [x.encode() for x in places]
    ids: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
    size = np.array([len(x) for x in raw], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= WIDEST]
    at = 0
    while at < len(order):
        upto = min(len(order), at + ROWS, int(np.searchsorted(size[order], size[order[at]] + 4, "right")))
        part = order[at:upto]
        for i, found in zip(part, viterbi([raw[j] for j in part], model), strict=True):
            ids[i] = found
        at = upto
    for i in np.flatnonzero(size > WIDEST):
        ids[i] = _long(raw[i], model)
    length = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    start = np.cumsum(length) - length
    cuts = np.array([p for d in docs for p in d], np.int64)
    n = length[cuts]
    into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[cuts], n)
    per_doc = np.array([len(d) for d in docs], np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[into], np.diff(ends[np.concatenate([[0], np.cumsum(per_doc)])])


def decode_all(ids: np.ndarray, counts: np.ndarray, model: Pieces) -> list[str]:
    """Texts of runs of ids: markers become blanks, byte pieces join to characters, the marker in front goes.

    Bytes that are no UTF-8 become U+FFFD; ids without a text, such as controls, become nothing.
    """
    size = model.starts[ids + 1] - model.starts[ids]
    into = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(model.starts[ids], size)
    data = model.blob[into].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        text = data[a:b].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def _together(offsets: np.ndarray):
    return slices(offsets, TOGETHER)


def encode(text: Column, model: Pieces) -> Column:
    """``struct<ids, intact>``: piece ids, and whether decoding them gives the text back.

    An empty text has no ids, a null text null ids; both count as intact.  Only the marker itself as part of a text
    is lost (it comes back as a blank).
    """
    shared = _broadcast(model)

    @F.arrow_udf("ids array<int>, intact boolean")
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        _, offsets = text_bytes(texts)
        ids, counts, intact = [], [], []
        for first, last in _together(offsets):
            part = [t or "" for t in texts.slice(first, last - first).to_pylist()]
            flat, n = encode_all(part, m)
            ids.append(flat)
            counts.append(n)
            intact += [a == b for a, b in zip(part, decode_all(flat, n, m), strict=True)]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        bounds = pa.array(ends.astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
        lists = pa.ListArray.from_arrays(bounds, values)
        return pa.StructArray.from_arrays([lists, pa.array(intact, pa.bool_())], ["ids", "intact"])

    return run(text)


def decode(ids: Column, model: Pieces) -> Column:
    """Text of piece ids; null for null ids, empty for none."""
    shared = _broadcast(model)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
        texts = decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, shared.value)
        return pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return run(ids)


def _broadcast(model: Pieces):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)
