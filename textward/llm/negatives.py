"""Hard negatives by exact scores from Four-Russians tables.

An anchor's integer components are cut into groups of eight.  For each group a table of 256 entries holds the sums of
all subsets of its components.  A candidate's components, in two's complement, are cut into bit planes, and each
plane's eight bits of a group are packed into a byte.  The byte looks up the group's table; sums over groups, shifted
by the plane's weight and added (the top plane subtracted), give the full inner product, exactly.

Candidates are never moved: a bounded block of anchors is broadcast per round, each task scores its own candidates
against it in small blocks and keeps the first few of each anchor, and a ranked window merges the tasks.  A first
pass of a round finds the positives, over candidates of the anchor's label only; a second one, over the others, finds
the negatives whose scores lie in the window of each positive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import checkpoint_folder, staged

#: Components of all anchors of a round (8 bytes each are broadcast), and anchors of a round, whose first few
#: candidates every task holds.
ROUND_VALUES = 1 << 20
ROUND_ANCHORS = 1 << 14
#: Candidates and anchors that are scored together: 4 or 8 bytes for each pair.
ROWS, ANCHORS = 2048, 128
#: Components of this size and beyond leave no room for exact 64-bit sums.
LARGEST = 1 << 24

MINED = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
         "negative_score bigint, place int")
FOUND = "anchor_id bigint, place int, id bigint, score bigint"


class Anchors(NamedTuple):
    """Anchors of a round in ascending order of ids; windows (closed score ranges) belong to the second pass."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray  # anchors x components, padded with zeros to a multiple of eight
    low: np.ndarray  # anchors x positives; a window that is not used has low > high
    high: np.ndarray


def quantized(df: DataFrame, key: str, vector: str, label: Column, scale: float = 256.0) -> DataFrame:
    """``vec_id, label, weights``: floor(scale * x) of each component, as integers.

    Rows take no part if the id, the label, the vector or any component is null, if a component is not finite, or if
    an integer is of 2**24 or more in size, since sums of such products could leave 64 bits.
    """
    x = F.col(f"`{vector}`")
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(F.lit(scale) * v.cast("double")) < float(LARGEST))),
                       F.lit(False))  # NaN is above every number
    return df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                     F.when(whole, F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("int")))
                     .alias("weights")).dropna()


def tables(values: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Sums of all subsets of each group of eight components: groups x 256 x anchors."""
    n, width = values.shape
    groups = values.reshape(n, width // 8, 8).transpose(1, 2, 0)
    out = np.zeros((width // 8, 256, n), kind)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + groups[:, bit : bit + 1]
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of the components in two's complement, packed by groups of eight: planes x groups x candidates."""
    n, width = values.shape
    depth = 1 + max(int(values.max(initial=0)), int(~values.min(initial=0))).bit_length()
    bits = (values[None] >> np.arange(depth)[:, None, None]) & 1
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8).reshape(depth, n, width // 8, 8), axis=3,
                                            bitorder="little")[..., 0].transpose(0, 2, 1))


def scores(packed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner products, candidates x anchors: looked up by byte, doubled from plane to plane; the top plane is negative."""
    depth, groups, n = packed.shape
    total = np.zeros((n, table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for plane in range(depth - 1, -1, -1):
        total <<= 1
        for group in range(groups):
            np.take(table[group], packed[plane, group], axis=0, out=part, mode="clip")
            total += part
        if plane == depth - 1:
            np.negative(total, out=total)
    return total


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each group, ties to smaller ids; in order of group and rank."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` integers: shorter ones are filled up with zeros, longer ones cut.

    Components that the other side lacks add nothing to a product, so cutting at the anchors' width loses nothing.
    """
    n = np.asarray(column.value_lengths()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width).astype(np.int64)
    row, at = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((len(n), width), np.int64)
    keep = at < width
    out[row[keep], at[keep]] = flat[keep]
    return out


class _Kept:
    """The first k of each group so far, merged as blocks of hits arrive."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, np.iinfo(np.int64).min)
        self.group = self.score = self.ids = np.zeros(0, np.int64)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        keep = first(group, score, ids, self.k)
        self.hits.append((group[keep], score[keep], ids[keep]))
        self.held += len(keep)
        if self.held > 4 * self.k * len(self.least):
            self.merge()

    def merge(self) -> None:
        group, score, ids = (np.concatenate(x) for x in
                             zip((self.group, self.score, self.ids), *self.hits, strict=True))
        keep = first(group, score, ids, self.k)
        self.group, self.score, self.ids, self.hits, self.held = group[keep], score[keep], ids[keep], [], 0
        ends = np.flatnonzero(np.append(self.group[1:] != self.group[:-1], True)) if len(keep) else keep
        full = ends[np.bincount(self.group, minlength=len(self.least))[self.group[ends]] == self.k]
        self.least[self.group[full]] = self.score[full]


def _search(anchors: Anchors, k: int, positives: bool):
    """Map candidates to the first k of each anchor (positives) or of each anchor's windows (negatives)."""
    per = 1 if positives else anchors.low.shape[1]

    def nearest(own: slice, s: np.ndarray, ids: np.ndarray, kept: _Kept) -> None:
        cut = kept.least[own]
        if len(ids) > k:  # its own row takes one of the places at most
            cut = np.maximum(cut, np.partition(s, len(ids) - k - 1, axis=0)[len(ids) - k - 1])
        row, col = np.nonzero(s >= cut.clip(np.iinfo(s.dtype).min, None).astype(s.dtype))
        other = ids[row] != anchors.ids[own][col]
        row, col = row[other], col[other]
        kept.add(own.start + col, s[row, col].astype(np.int64), ids[row])

    def within(own: slice, s: np.ndarray, ids: np.ndarray, labels: np.ndarray, kept: _Kept) -> None:
        low, high = anchors.low[own], anchors.high[own]
        used, range_ = low <= high, np.iinfo(s.dtype)
        bottom = np.where(used, low, range_.max).min(axis=1).clip(range_.min, range_.max).astype(s.dtype)
        top = np.where(used, high, range_.min).max(axis=1).clip(range_.min, range_.max).astype(s.dtype)
        row, col = np.nonzero((s >= bottom) & (s <= top))
        other = (labels[row] != anchors.labels[own][col]) & (ids[row] != anchors.ids[own][col])
        row, col = row[other], col[other]
        score, found = s[row, col].astype(np.int64), ids[row]
        for j in range(per):
            group = (own.start + col) * per + j
            inside = (score >= low[col, j]) & (score <= high[col, j]) & (score >= kept.least[group])
            kept.add(group[inside], score[inside], found[inside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width = anchors.values.shape
        kept = _Kept(n * per, k)
        largest = int(np.abs(anchors.values).max(initial=0))

        def blocks(values: np.ndarray, begin: int, end: int) -> Iterator[tuple[slice, np.ndarray]]:
            packed = planes(values)
            # Every sum on the way is at most this in size; 32 bits are enough for most vectors.
            kind = np.int32 if largest * width << packed.shape[0] < 1 << 31 else np.int64
            for x in range(begin, end, ANCHORS):
                own = slice(x, min(x + ANCHORS, end))
                yield own, scores(packed, tables(anchors.values[own], kind))

        for batch in batches:
            ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            values = _padded(batch.column("weights"), width)
            parts = [(np.arange(len(ids)), 0, n)]
            if positives:  # only with the anchors of the same label, which lie together
                order = np.argsort(labels, kind="stable")
                parts = [(rows, *np.searchsorted(anchors.labels, (labels[rows[0]], labels[rows[0]] + 1)))
                         for rows in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(rows)]
            for rows, begin, end in parts:
                for at in range(0, len(rows) if begin < end else 0, ROWS):
                    part = rows[at : at + ROWS]
                    for own, s in blocks(values[part], begin, end):
                        if positives:
                            nearest(own, s, ids[part], kept)
                        else:
                            within(own, s, ids[part], labels[part], kept)
        if kept.hits:
            kept.merge()
        yield pa.RecordBatch.from_pydict({
            "anchor_id": pa.array(anchors.ids[kept.group // per], pa.int64()),
            "place": pa.array((kept.group % per).astype(np.int32), pa.int32()),
            "id": pa.array(kept.ids, pa.int64()), "score": pa.array(kept.score, pa.int64())})

    return run


def _merged(candidates: DataFrame, anchors: Anchors, k: int, positives: bool) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(shared.value, k, positives)(batches)

    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return candidates.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both frames have ``vec_id, label, weights`` as ``quantized`` makes them.  An anchor's positives are the
    ``positives`` rows of highest score among those of its label and another id.  For each, the first ``negatives``
    rows of another label and id with ``low * positive_score <= 100 * score <= high * positive_score`` are returned.
    Higher scores come first, ties by smaller id.  Vectors of different lengths are multiplied as far as both go.  Of
    anchors that repeat an id the smallest (label, vector) counts; candidates that repeat an id are each a candidate,
    and a positive that repeats is returned once for each of its places (``place`` tells them apart).  Without
    anchors, positives or rows in a window there are no rows.

    Rounds follow one another; each broadcasts at most ROUND_VALUES components or one anchor, reads all
    candidates twice, and writes its rows to the shared folder.
    """
    spark = candidates.sparkSession
    once = staged(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "weights")).alias("a"))
                  .select("vec_id", "a.label", "a.weights", F.size("a.weights").alias("_size")))
    total = once.agg(F.count("*").alias("n"), F.coalesce(F.max("_size"), F.lit(0)).alias("width")).first()
    width = -(-max(total.width, 1) // 8) * 8
    rounds = -(-total.n // max(1, min(ROUND_ANCHORS, ROUND_VALUES // width)))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    written = []
    for number in range(rounds):  # a hash of the id deals the anchors evenly
        rows = once.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == number).select("vec_id", "label", "weights") \
            .toArrow().sort_by([("label", "ascending"), ("vec_id", "ascending")])
        n, none = rows.num_rows, np.zeros((rows.num_rows, positives), np.int64)
        block = Anchors(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(),
                        _padded(rows.column("weights").combine_chunks(), width), none, none)
        nearest = _merged(candidates, block, positives, True).select("anchor_id", "rank", "id", "score").toArrow()
        order = np.argsort(block.ids)
        at = order[np.searchsorted(block.ids, nearest.column("anchor_id").to_numpy(), sorter=order)] if n else order
        place, score = nearest.column("rank").to_numpy().astype(np.int32) - 1, nearest.column("score").to_numpy()
        bottom, top = none + 1, none.copy()
        bottom[at, place], top[at, place] = -(-low * score // 100), high * score // 100
        chosen = spark.createDataFrame(pa.table({
            "anchor_id": nearest.column("anchor_id"), "place": pa.array(place, pa.int32()),
            "positive_id": nearest.column("id"), "positive_score": nearest.column("score")}))
        written.append(f"{folder}/{number}")
        _merged(candidates, block._replace(low=bottom, high=top), negatives, False) \
            .join(chosen, ["anchor_id", "place"]).select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"), "place").write.parquet(written[-1])
    return spark.read.schema(MINED).parquet(*written) if written else spark.createDataFrame([], MINED)
