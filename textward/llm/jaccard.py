"""Exact Jaccard self-join of word n-gram sets by vertical partitioning, and the groups that its links form.

N-grams are 64-bit hashes; their global order is cut into fragments, and every count is a sum of counts made in each
fragment alone.

1. Every text gives a set, named by a hash of its members.  Equal sets are one node from here on.
2. In the lower half of the order, the n-grams that no other node holds are counted for each node.  A node with more
   of them than its size allows a partner to miss is done.  What remains is what has copies, whatever lines or passages
   other documents share.
3. For the remaining nodes there is one row for each n-gram of each node.  They are counted by n-gram, and a node's
   prefix is its rarest n-grams, one more than it may miss.  Two linked nodes share one of their prefixes, at places low
   enough for the overlap that their sizes need.
4. Each n-gram has one hub, of the nodes with it in their prefix the one whose n-grams are most frequent.  Each node is
   compared with the hub of most of its prefix.  Overlaps are counted in each fragment, summed for each pair, and linked
   pairs form groups.
5. Nodes that share a prefix n-gram at such places with a node of another group are compared with the n-gram's most
   central one, and groups are formed again, some times.
6. Pairs that share a prefix n-gram at such places but are not in one group yet are compared the same way, so no link between
   groups is lost, while a group of any size costs one comparison a member and not all pairs.

With n different n-grams the chance that hashes disturb any overlap is that of a 64-bit collision within a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import staged

#: Rows of an Arrow batch that go back to Spark.
BATCH = 65_536
#: Bytes of texts or members that a task turns into Arrow rows at once.
SLICE = 2 << 20
#: Fragments in which the overlap of a pair is counted.
FRAGMENTS = 8
#: Times that open nodes are compared with one node for each of their n-grams before all open pairs are.
ROUNDS = 2
_STEP = np.uint64(0xD6E8FEB86659FD93)


def ngram_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted hashes of the different n-grams of each text; fewer than n words form one n-gram, none an empty set."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for w in W.words(texts):
            h = w.hash
            size = max(len(h) - n + 1, 0)
            grams = np.zeros(size, np.uint64)
            for k in range(n):
                grams = grams * _STEP + h[k : k + size]
            grams = W.mix(grams)
            whole = w.doc[:size] == w.doc[n - 1 : n - 1 + size]
            bound = w.bounds()
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                if b - a >= n:
                    out.append(np.unique(grams[a : b - n + 1]))
                elif b > a:
                    g = np.uint64(b - a)
                    for k in range(a, b):
                        g = g * _STEP + h[k]
                    out.append(W.mix(np.array([g + _STEP], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
            del whole
    return out


def _name(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLICE`` bytes of the column: Spark counts rows, and those of long texts are large."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for first, last in W.slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), SLICE):
            yield batch.slice(first, last - first)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            sets = ngram_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "row": batch.column("row"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([_name(s) if len(s) else None for s in sets], pa.int64())})
    return run


def _members(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            sets = [s for s in ngram_sets(batch.column("text"), n) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([_name(s) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "members": pa.array([s.tobytes() for s in sets], pa.binary())})
    return run


def _to_ranges(nodes: np.ndarray, sets: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """One row for each range that holds a member: the nodes there and their members."""
    nodes, first = np.unique(nodes, return_index=True)  # equal sets once
    sets = [sets[i] for i in first]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), size)
    at = ((flat >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    flat, own, at = flat[order], own[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    rows: dict[str, list] = {"range": [], "nodes": [], "sizes": [], "counts": [], "members": []}
    for a, b in zip(edge, np.append(edge[1:], len(at))[: len(edge)], strict=True):
        held, count = np.unique(own[a:b], return_counts=True)
        rows["range"].append(int(at[a]))
        rows["nodes"].append(nodes[held].astype(np.int64).tobytes())
        rows["sizes"].append(size[held].astype(np.int32).tobytes())
        rows["counts"].append(count.astype(np.int32).tobytes())
        part = flat[a:b]
        rows["members"].append(part.tobytes())
    binary = pa.binary()
    return pa.RecordBatch.from_pydict({"range": pa.array(rows["range"], pa.int64()), **{
        k: pa.array(rows[k], binary) for k in ("nodes", "sizes", "counts", "members")}})


def _half(n: int):
    """``gram, node`` for the n-grams in the lower half of the order, of each different set of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            sets = {_name(s): s[: np.searchsorted(s, np.uint64(1 << 63))]
                    for s in ngram_sets(batch.column("text"), n) if len(s)}
            size = [len(s) for s in sets.values()]
            grams = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
            nodes = np.repeat(np.fromiter(sets, np.int64), size)
            for a in range(0, len(grams), BATCH):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(grams[a : a + BATCH].view(np.int64)),
                                                  "node": pa.array(nodes[a : a + BATCH])})
    return run


def _sets_to_ranges(ranges: int):
    """Sets cut into ranges of the order, a row for each range of a batch.  No query uses it: its rows grow faster than its input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "members"):
            sets = [np.frombuffer(m.as_py(), np.uint64) for m in batch.column("members")]
            yield _to_ranges(batch.column("node").to_numpy(), sets, ranges)
    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, node, n`` for each member of each set."""
    for batch in _slices(batches, "members"):
        sets = [np.frombuffer(m.as_py(), np.uint64) for m in batch.column("members")]
        size = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        nodes, sizes = np.repeat(batch.column("node").to_numpy(), size), np.repeat(size, size)
        for a in range(0, len(grams), BATCH):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams[a : a + BATCH]), "node": pa.array(nodes[a : a + BATCH]),
                                              "n": pa.array(sizes[a : a + BATCH])})


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``gram, node, n, place, mean``: prefix n-grams that other nodes hold too, with their places from 0, lone n-grams
    counted, and the mean frequency of the node's n-grams.

    An n-gram that many nodes hold is counted in every task before it is shuffled; the counts are staged, so that the
    join reads both its sides from shuffles, where Spark splits the rows of a frequent n-gram.
    """
    held = sets.select("node", "members").mapInArrow(_rows, "gram bigint, node bigint, n bigint")
    shared = staged(held.groupBy("gram").agg(F.count("*").alias("frequency")).filter(F.col("frequency") > 1))
    own = Window.partitionBy("node")
    n = F.col("n")
    return held.join(shared, "gram") \
        .withColumn("rank", F.row_number().over(own.orderBy("frequency", "gram"))) \
        .withColumn("lone", n - F.count("*").over(own)) \
        .withColumn("mean", (F.sum("frequency").over(own) + F.col("lone")) / n) \
        .select("gram", "node", "n", (F.col("lone") + F.col("rank") - 1).alias("place"), "mean") \
        .filter(F.col("place") <= F.floor((100 - percent) * n / 100))


def _stars(prefixes: DataFrame) -> DataFrame:
    """``b, n_b, a``: every node and the hub of most of its prefix, other than itself."""
    hubs = staged(prefixes.groupBy("gram").agg(F.max(F.struct("mean", "node")).getField("node").alias("a")))
    votes = prefixes.join(hubs, "gram").filter(F.col("a") != F.col("node")).groupBy("node", "n", "a").count()
    return votes.groupBy(F.col("node").alias("b"), F.col("n").alias("n_b")) \
        .agg(F.max_by("a", F.struct("count", "a")).alias("a"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(64 - FRAGMENTS.bit_length() + 1))
    for batch in _slices(batches, "members"):
        node, fragment, members = [], [], []
        for name, m in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
            for f, part in enumerate(np.split(s := np.frombuffer(m.as_py(), np.uint64), np.searchsorted(s, edges))):
                if len(part):
                    node.append(name), fragment.append(f), members.append(part.tobytes())
        yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "fragment": pa.array(fragment, pa.int32()),
                                          "members": pa.array(members, pa.binary())})


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "left"):
        shared = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), True))
                  for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"),
                                          "shared": pa.array(shared, pa.int64())})


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (``a, b, n_a, n_b``) whose sets are similar enough: partial overlaps by fragment, summed."""
    cut = sets.select("node", "members").mapInArrow(_fragments, "node bigint, fragment int, members binary")
    right = pairs.select("a", "b").join(cut.withColumnsRenamed({"node": "b", "members": "right"}), "b")
    met = right.join(cut.withColumnsRenamed({"node": "a", "members": "left"}), ["a", "fragment"])
    partial = met.select("a", "b", "left", "right").mapInArrow(_overlaps, "a bigint, b bigint, shared bigint")
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(pairs, ["a", "b"])
    return total.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))) \
        .select("a", "b", "shared")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``: the smallest node that can be reached."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node") \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left") \
            .select("node", "old", F.least("label", "next").alias("label"))
        after = staged(jumped)
        labels = after.select("node", "label")
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _open(prefixes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Prefix rows with the label of their group, without those that no row of another group can need."""
    rows = staged(prefixes.select("gram", "node", "n", "place").join(groups, "node", "left")
                  .withColumn("label", F.coalesce("label", "node")))
    for _ in range(2):  # what leaves may leave others without a partner
        mixed = staged(rows.groupBy("gram")
                       .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
                       .filter(F.col("low") != F.col("high")).select("gram", "least"))
        smallest = F.greatest("least", F.ceil(percent * F.col("n") / 100))
        rows = staged(rows.join(mixed, "gram")
                      .filter(F.col("place") <= F.col("n") - _needed(F.col("n"), smallest, percent)).drop("least"))
    return rows


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups that share a prefix n-gram at low enough places.

    The smaller set of a pair holds the n-gram at a place low enough for partners of its own size or more; such rows
    stand in bins of size.  The larger one looks into the bins of the sizes that its own place allows.  Rows of an
    n-gram's largest group meet only rows of other groups, so members of a large group never meet each other.
    """
    sizes = rows.groupBy("gram", "label").count()
    largest = staged(sizes.groupBy("gram").agg(F.max_by("label", F.struct("count", "label")).alias("largest")))
    marked = staged(rows.join(largest, "gram").withColumn("outside", F.col("label") != F.col("largest")).drop("largest"))

    def bin_of(size: Column) -> Column:
        return F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(1.02)))

    n, place = F.col("n"), F.col("place")
    smaller = marked.filter(place <= n - _needed(n, n, percent)).select(
        "gram", bin_of(n).alias("bin"), F.col("node").alias("a"), n.alias("n_a"), place.alias("place_a"),
        F.col("label").alias("label_a"), F.col("outside").alias("outside_a"))
    low = F.ceil(percent * n / 100)
    high = F.least(n, F.floor((100 + percent) * (n - place) / percent) - n)
    larger = marked.filter(high >= low).select(
        "gram", F.explode(F.sequence(bin_of(low), bin_of(high))).alias("bin"), F.col("node").alias("b"),
        n.alias("n_b"), high.alias("high"), F.col("label").alias("label_b"), F.col("outside").alias("outside_b"))
    fits = (F.col("label_a") != F.col("label_b")) & (F.col("n_a") <= F.col("high")) \
        & (F.col("place_a") <= F.col("n_a") - _needed(F.col("n_a"), F.col("n_b"), percent))
    one = smaller.filter("outside_a").join(larger, ["gram", "bin"]).filter(fits)
    other = smaller.filter(~F.col("outside_a")).join(larger.filter("outside_b"), ["gram", "bin"]).filter(fits)
    return one.unionByName(other).select("a", "b", "n_a", "n_b")


def _pairs(a: DataFrame, percent: int) -> DataFrame:
    """Different pairs whose sizes allow a link."""
    return a.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("a") != F.col("b"))) \
        .distinct()


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80,
          row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows, and links that join the same nodes as all links between different sets would.

    The first frame has ``doc_id, row, n, node`` for every row (node null for an empty set), the second
    ``a, b, shared``.  Null texts have empty sets.  ``row`` is a hash of the row, of its text if not given; the key may
    be null and repeat.
    """
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"),
                       (F.xxhash64(body) if row is None else row).alias("row"))
    signatures = staged(rows.mapInArrow(_signatures(n), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                                        "row bigint, n bigint, node bigint"))
    nodes = signatures.filter(F.col("node").isNotNull()).groupBy("node") \
        .agg(F.min("row").alias("row"), F.max("n").alias("n"))

    # An n-gram that many texts hold is combined in every task before it is shuffled.
    lone = rows.select("text").mapInArrow(_half(n), "gram bigint, node bigint").groupBy("gram") \
        .agg(F.min("node").alias("node"), F.max("node").alias("last")).filter(F.col("node") == F.col("last")) \
        .groupBy("node").agg(F.count("*").alias("unshared"))
    slack = F.floor((100 - percent) * F.col("n") / 100)
    left = staged(nodes.join(lone, "node", "left").filter(F.coalesce("unshared", F.lit(0)) <= slack)
                  .select("row", "n"))
    members = rows.select("text", "row").join(left.select("row").distinct(), "row", "left_semi").select("text") \
        .mapInArrow(_members(n), "node bigint, n bigint, members binary")
    sets = staged(members.dropDuplicates(["node"]))
    prefixes = staged(_prefixes(sets, percent))
    size = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    stars = _stars(prefixes).join(size, "a")
    first = staged(linked(staged(_pairs(stars.select("a", "b", "n_a", "n_b"), percent)), sets, percent))
    found, groups = first, components(first)
    rows_left = prefixes.drop("mean")
    for _ in range(ROUNDS):
        rows_left = _open(rows_left, groups, percent)
        central = staged(rows_left.groupBy("gram").agg(F.min(F.struct("place", "node", "n", "label")).alias("hub")))
        star = rows_left.join(central, "gram").filter(F.col("label") != F.col("hub.label")).select(
            F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"),
            F.when(F.col("node") < F.col("hub.node"), F.col("n")).otherwise(F.col("hub.n")).alias("n_a"),
            F.when(F.col("node") < F.col("hub.node"), F.col("hub.n")).otherwise(F.col("n")).alias("n_b"))
        found = staged(found.union(linked(staged(_pairs(star, percent)), sets, percent)))
        groups = components(found)
    open_rows = _open(rows_left, groups, percent)
    second_pairs = _across(open_rows, percent)
    second = staged(linked(staged(_pairs(second_pairs, percent)), sets, percent))
    return signatures, found.union(second)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest key that links reach, its own included.

    Words are what ASCII white space separates, A-Z lower-cased; a set holds the different runs of n words, or the
    whole text if it has fewer.  Two rows are linked if 100 * shared >= percent * united.  Rows with the same set are
    linked; rows without words are linked with nothing.  Rows that repeat a key are judged each by its own text and
    may differ.  Null keys count after all others: a group has a null one only if all its rows do.  An empty table gives
    an empty result.
    """
    signatures, found = links(docs, key, text, n, percent)
    labels = components(found)
    nodes = signatures.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = staged(staged(labelled.select("node", "label")).join(staged(lowest), "label")
                     .select("node", "component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    with_words = signatures.filter(F.col("node").isNotNull()).join(of_node, "node")
    without = signatures.filter(F.col("node").isNull()).withColumn("component_id", F.col("doc_id"))
    return with_words.unionByName(without, allowMissingColumns=True) \
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: by smallest key (null ones last), then by set, then by a hash of all columns.

    Rows without words are linked with nothing and stay.  Rows that are equal in all columns count once.  Keys may be
    null and repeat; rows that share one are judged each by its own text.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*columns, *[c.isNull() for c in columns])  # the hash itself passes over nulls
    signatures, found = links(docs, key, text, n, percent, row)
    rank = F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "node", "row")
    nodes = signatures.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(rank).alias("first"))
    chosen = nodes.join(components(found), "node", "left").groupBy(F.coalesce("label", "node")) \
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    kept = chosen.union(signatures.filter(F.col("node").isNull()).select("row"))
    return docs.withColumn("_row", row).join(kept, "_row", "left_semi").dropDuplicates(["_row", key]) \
        .select(*columns)
