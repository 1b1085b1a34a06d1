"""Ranked lexical search of many queries at once, with common subexpressions evaluated once.

A query's score is a sum over its terms, so queries that share terms share parts of their sums.  Terms that occur
equally often in the same queries form one set; then, again and again, the two parts that stand together in most
queries become a new part, until no two parts stand together in two queries.  What results is a directed graph:
terms, parts that are sums of terms or other parts, and queries that are sums of parts.  For a block of documents,
postings of the queries' terms are turned into impacts, every part is accumulated once, in the graph's order, over all
documents of the block, and each query adds up its parts.  Every task keeps the best documents of each query, and a
ranked window merges the tasks.

The corpus is read twice for each block of queries: once for document counts, once for the scores.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .negatives import first
from .storage import checkpoint_folder

#: Different texts of a block of queries, and their words; both bound what is mined on the driver and broadcast.  A
#: longer text is a block of its own.
BLOCK_ITEMS, BLOCK_WORDS = 1000, 100_000
#: Documents that are accumulated together at most, and numbers that their accumulators may hold.
DOCUMENTS, ACCUMULATED = 512, 1 << 22
#: Constants of the score: full weight, share of it that depends on the length, saturation and scales.
FULL, LENGTH_SHARE, SATURATION, SCALE, WEIGHT_SCALE = 100, 75, 8, 1_000_000_000, 1000

RANKED = "item_id bigint, rank int, doc_id bigint, score bigint"


class Graph(NamedTuple):
    """Node i < len(terms) is a term; the others are sums of earlier nodes; a query is a sum of multiples of nodes."""

    terms: np.ndarray  # hashes, ascending
    sums: list[list[int]]  # of the nodes after the terms
    queries: list[list[tuple[int, int]]]  # (node, times)


def share(queries: list[Counter]) -> Graph:
    """The graph of queries that are given as counts of term hashes."""
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for term, times in terms.items():
            held[term].append((q, times))
    terms = sorted(held)
    number = {t: i for i, t in enumerate(terms)}
    alike: dict[tuple, list[int]] = defaultdict(list)
    for term in terms:
        alike[tuple(held[term])].append(number[term])
    sums: list[list[int]] = []
    parts: list[dict[int, int]] = [{} for _ in queries]
    for users, nodes in alike.items():
        if len(nodes) > 1 and len(users) > 1:
            sums.append(nodes)
            nodes = [len(terms) + len(sums) - 1]
        for q, times in users:
            parts[q].update(dict.fromkeys(nodes, times))

    # Operands that stand in several queries, as (node, times); a pair's users shrink as it is replaced.
    users: dict[tuple[int, int], set[int]] = defaultdict(set)
    for q, nodes in enumerate(parts):
        for operand in nodes.items():
            users[operand].add(q)
    shared = [sorted(o for o in nodes.items() if len(users[o]) > 1) for nodes in parts]
    pairs: Counter = Counter()
    for operands in shared:
        pairs.update((a, b) for a, b in combinations(operands, 2) if a[1] == b[1])
    ranked: dict[int, set] = defaultdict(set)
    for pair, n in pairs.items():
        if n > 1:
            ranked[n].add(pair)
    n = max(ranked, default=0)
    while n > 1:
        if not ranked[n]:
            n -= 1
            continue
        a, b = min(ranked[n])
        ranked[n].discard((a, b))
        both = users[a] & users[b]
        if len(both) < n:  # some of its queries have used a or b in another sum meanwhile
            if len(both) > 1:
                ranked[len(both)].add((a, b))
            continue
        sums.append([a[0], b[0]])
        node = (len(terms) + len(sums) - 1, a[1])
        near: Counter = Counter()
        for q in both:
            del parts[q][a[0]], parts[q][b[0]]
            near.update(o for o in parts[q].items() if o[1] == a[1] and len(users[o]) > 1)
            parts[q][node[0]] = node[1]
        users[a], users[b], users[node] = users[a] - both, users[b] - both, set(both)
        for other, together in near.items():
            if together > 1:
                ranked[together].add((min(other, node), max(other, node)))
        n = max(n, max(near.values(), default=0))
    return Graph(np.array(terms, np.uint64), sums, [sorted(p.items()) for p in parts])


def _terms(texts: list[str]) -> list[Counter]:
    return [Counter(h.tolist()) for h in W.hash_words(texts, W.ALNUM)]


def _in_terms(w: W.Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row within the words' rows, term and occurrences, of each row's terms that are among ``terms``."""
    at = np.minimum(np.searchsorted(terms, w.hash), max(len(terms) - 1, 0))
    hit = np.flatnonzero(terms[at] == w.hash) if len(terms) else np.zeros(0, np.int64)
    key, times = np.unique((w.doc[hit] - w.first).astype(np.int64) * len(terms) + at[hit], return_counts=True)
    return key // max(len(terms), 1), key % max(len(terms), 1), times


def _count(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term; term -1 counts documents with any word, -2 all words."""
    n = np.zeros(len(terms), np.int64)
    texts = tokens = 0
    for batch in batches:
        for w in W.words(batch.column("text"), W.ALNUM):
            _, term, _ = _in_terms(w, terms)
            n += np.bincount(term, minlength=len(terms))
            texts += int((np.diff(w.bounds()) > 0).sum())
            tokens += len(w.hash)
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(seen, [-1, -2]), pa.int64()),
                                      "n": pa.array(np.append(n[seen], [texts, tokens]), pa.int64())})


def accumulate(graph: Graph, impacts: np.ndarray) -> np.ndarray:
    """Scores, queries x documents, from impacts, terms x documents: every part once, in the graph's order."""
    n = len(graph.terms)
    nodes = np.empty((n + len(graph.sums), impacts.shape[1]), np.int64)
    nodes[:n] = impacts
    for i, (one, *others) in enumerate(graph.sums, n):
        nodes[i] = nodes[one]
        for other in others:
            nodes[i] += nodes[other]
    out = np.zeros((len(graph.queries), impacts.shape[1]), np.int64)
    for q, operands in enumerate(graph.queries):
        for node, times in operands:
            out[q] += nodes[node] if times == 1 else times * nodes[node]
    return out


def _scores(w: W.Words, graph: Graph, weights: np.ndarray, texts: int, tokens: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and scores (queries x documents) of blocks of rows."""
    row, term, times = _in_terms(w, graph.terms)
    length = np.diff(w.bounds())
    norm = FULL - LENGTH_SHARE + (LENGTH_SHARE * length * texts) // max(tokens, 1)
    impact = weights[term] * ((SCALE * times) // (WEIGHT_SCALE * times + SATURATION * norm[row]))
    step = max(1, min(DOCUMENTS, ACCUMULATED // (len(graph.terms) + len(graph.sums) + len(graph.queries) + 1)))
    for at in range(0, len(length), step):
        a, b = np.searchsorted(row, (at, at + step))
        if a < b:
            block = np.zeros((len(graph.terms), min(step, len(length) - at)), np.int64)
            block[term[a:b], row[a:b] - at] = impact[a:b]
            yield w.first + at, accumulate(graph, block)


def _best(batches: Iterator[pa.RecordBatch], graph: Graph, weights: np.ndarray, texts: int, tokens: int, k: int):
    """The k best documents of each query among a task's; a missing id counts as the largest one."""
    last = np.iinfo(np.int64).max
    least = np.zeros(len(graph.queries), np.int64)
    kept = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        ids = batch.column("doc_id").fill_null(last).to_numpy(zero_copy_only=False)
        hits = [kept]
        for w in W.words(batch.column("text"), W.ALNUM):
            for at, score in _scores(w, graph, weights, texts, tokens):
                cut = np.maximum(least, 1)
                if score.shape[1] > k:
                    cut = np.maximum(cut, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
                query, doc = np.nonzero(score >= cut[:, None])
                hits.append([query, score[query, doc], ids[at + doc]])
        query, score, own = (np.concatenate(x) for x in zip(*hits, strict=True))
        keep = first(query, score, own, k)
        kept = query, score, own = [query[keep], score[keep], own[keep]]
        full = np.flatnonzero(np.bincount(query, minlength=len(least)) == k)
        least[full] = score[np.searchsorted(query, full, "right") - 1]
    query, score, own = kept
    yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "doc_id": pa.array(own, pa.int64()),
                                      "score": pa.array(score, pa.int64()), "missing": pa.array(own == last)})


def _ranked(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """``query, rank, doc_id, score`` for one block of queries."""
    context = docs.sparkSession.sparkContext
    graph = context.broadcast(share(_terms(texts)))

    def count(batches):
        yield from _count(batches, graph.value.terms)

    counted = docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True))
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1)))
                        for t in range(len(graph.value.terms))], np.int64)

    def best(batches):
        yield from _best(batches, graph.value, weights, n, tokens, k)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "missing", "doc_id")
    return docs.mapInArrow(best, "query bigint, doc_id bigint, score bigint, missing boolean") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query", "rank", F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item.

    Terms are runs of ASCII letters (lower-cased), ASCII digits and all characters beyond ASCII; repeats count.  Null
    and empty texts have no terms: such documents don't count as documents, and such items find nothing.  Ties go to
    the smaller document id, null ids last; documents that repeat an id are each ranked.  Rows of ``items`` that
    repeat id and text are one item; items that share an id but not a text are ranked one by one.  Terms are
    compared by 64-bit hashes; for n different ones the chance of any error is about n * n / 2**65.

    Items are taken in blocks, each of which reads the documents twice and writes its rows to the shared folder.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .filter("text IS NOT NULL").distinct()
    folder = f"{checkpoint_folder(spark).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    written: list[str] = []

    def search(block: list) -> None:
        found = _ranked(texts, [r.text for r in block], k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(block)], "query bigint, item_id bigint")
        written.append(f"{folder}/{len(written)}")
        found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score").write.parquet(written[-1])

    block, size = [], 0
    for item in asked.toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(item.text) // 2 > BLOCK_WORDS):
            search(block)
            block, size = [], 0
        block.append(item)
        size += len(item.text) // 2
    if block:
        search(block)
    return spark.read.schema(RANKED).parquet(*written) if written else spark.createDataFrame([], RANKED)
