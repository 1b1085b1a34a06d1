"""Exact top-k by inner product: term-at-a-time accumulation over blocks of postings.

Rows are sparse lists of (term, integer weight); a dense vector has one term for each component.  Candidates are
packed into blocks of postings: for each term, the rows that hold it and their weights.  Queries are packed into
blocks of rows.  Every query block meets every candidate block once, by an equi-join on the block number.  For each
term the weights of the queries are scattered, times the weighted postings, into a dense array of scores; then
partition selection leaves k rows for each query and block, and a ranked window merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block; scores of a pair of blocks take 8 * QUERY_ROWS * CANDIDATE_ROWS bytes.
QUERY_ROWS = 1024
CANDIDATE_ROWS = 2048
#: Parts into which the candidate blocks that meet one query block are dealt.
DEALS = 32


def quantized(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """``vec_id, weights``: floor(scale * x) of each component; rows without a whole finite vector or id are left out."""
    x = F.col(f"`{vector}`")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                                     & (F.abs(v.cast("double")) < float("inf")))
    return df.filter(F.coalesce(whole, F.lit(False)) & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("bigint").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("weights"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.value_lengths()).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: ids in ascending order, and postings sorted by term."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_ROWS):
            part = batch.slice(at, CANDIDATE_ROWS)
            order = np.argsort(part.column("vec_id").to_numpy(), kind="stable")
            part = part.take(pa.array(order))
            n, weight = _flat(part.column("weights"))
            row = np.repeat(np.arange(len(n)), n)
            term = np.arange(len(weight)) - np.repeat(np.cumsum(n) - n, n)
            keep = np.flatnonzero(weight)
            keep = keep[np.argsort(term[keep], kind="stable")]
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([part.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "terms": pa.array([term[keep].astype(np.int32).tobytes()], pa.binary()),
                "rows": pa.array([row[keep].astype(np.int32).tobytes()], pa.binary()),
                "weights": pa.array([weight[keep].astype(np.int64).tobytes()], pa.binary())})


def _pack_queries(keys: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    n, weight = _flat(table.column("weights"))
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.flatnonzero(weight)
    keep = keep[np.argsort(term[keep], kind="stable")]
    return pa.table({
        "q_block": pa.array([keys[0].as_py()], pa.int64()),
        "q_ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "q_terms": pa.array([term[keep].astype(np.int32).tobytes()], pa.binary()),
        "q_rows": pa.array([row[keep].astype(np.int32).tobytes()], pa.binary()),
        "q_weights": pa.array([weight[keep].astype(np.int64).tobytes()], pa.binary())})


def scores(q_ids, q_terms, q_rows, q_weights, ids, terms, rows, weights) -> np.ndarray:
    """Inner products of all queries of a block with all candidates of a block."""
    out = np.zeros((len(q_ids), len(ids)), np.int64)
    for term in np.unique(q_terms):
        a, b = np.searchsorted(terms, (term, term + 1))
        if a == b:
            continue
        c, d = np.searchsorted(q_terms, (term, term + 1))
        add = q_weights[c:d, None] * weights[a:b][None, :]
        if b - a == len(ids):  # every row holds the term; rows of a term are in order
            out[q_rows[c:d]] += add
        else:
            out[q_rows[c:d, None], rows[a:b][None, :]] += add
    return out


def best(score: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and candidate places of the k highest scores of each query, ties to smaller ids; its own id is left out."""
    queries, places = [], []
    for q in range(len(q_ids)):
        s = score[q]
        other = np.flatnonzero(ids != q_ids[q])
        if len(other) > k:
            least = np.partition(s[other], len(other) - k)[len(other) - k]
            above = other[s[other] > least]
            other = np.concatenate([above, other[s[other] == least][: k - len(above)]])  # ids ascend
        queries.append(np.full(len(other), q))
        places.append(other)
    return np.concatenate(queries), np.concatenate(places)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                def col(name, kind):
                    return np.frombuffer(batch.column(name)[i].as_py(), kind)
                q_ids, ids = col("q_ids", np.int64), col("ids", np.int64)
                s = scores(q_ids, col("q_terms", np.int32), col("q_rows", np.int32), col("q_weights", np.int64),
                           ids, col("terms", np.int32), col("rows", np.int32), col("weights", np.int64))
                q, c = best(s, q_ids, ids, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[q], pa.int64()),
                                                  "vec_id": pa.array(ids[c], pa.int64()),
                                                  "score": pa.array(s[q, c], pa.int64())})
    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k highest inner products over all candidates but its own id.

    Both frames have ``vec_id bigint, weights array<bigint>``; vectors of different lengths meet on the terms that
    both have.  Of queries that repeat an id, the smallest vector counts; candidates that repeat an id are each a
    candidate.  Ties go to the smaller id.  Without queries or candidates the result is empty.  Sums are 64-bit.
    """
    asked = queries.groupBy("vec_id").agg(F.min("weights").alias("weights"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    packed_queries = asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("q_block") \
        .applyInArrow(_pack_queries, "q_block bigint, q_ids binary, q_terms binary, q_rows binary, q_weights binary")
    packed = candidates.select("vec_id", "weights") \
        .mapInArrow(_pack_candidates, "ids binary, terms binary, rows binary, weights binary")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    dealt = packed.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(DEALS))).withColumn("q_block", F.explode(numbers))
    met = packed_queries.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                 F.lit(DEALS - 1).cast("bigint")))) \
        .join(dealt, ["q_block", "deal"])
    found = met.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
