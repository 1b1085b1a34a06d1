"""Benchmark items of any script, with null, repeated and textual ids."""

import pytest
from pyspark.sql import functions as F

from textward.llm import leakage

#: Words whose lower case depends on the rule: final sigma, dotted I, sharp s, ligature, titlecase digraph, Kelvin sign.
SPECIAL = ["ΟΔΟΣ", "İSTANBUL", "STRAẞE", "ﬁNAL", "ǅUNGLA", "KELVIN", "ΜΈΓΑΣ", "IĞDIR"]


def found(spark, items, texts, kind="bigint"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    benchmark = spark.createDataFrame(items, f"item_id {kind}, text string")
    indexes = leakage.learn(docs, benchmark)
    rows = docs.select("doc_id", F.explode(leakage.leaks(F.col("text"), indexes)).alias("x")).select("doc_id", "x.item_id")
    assert rows.schema["item_id"].dataType.simpleString() == kind
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("size", [3, 8, 12])
def test_exact_copies_in_capitals_are_found_in_every_script(spark, size):
    items = [(i, " ".join([w] * 1 + [f"{w}{k}" for k in range(size - 1)])) for i, w in enumerate(SPECIAL)]
    texts = [f"Some words before. {t} And some words after it." for _, t in items] + ["nothing here", None, ""]
    assert found(spark, items, texts) == [(i, i) for i in range(len(items))]


def test_items_without_or_with_textual_ids_are_searched_for(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "uno dos tres cuatro cinco seis siete ocho nueve"
    items = [(None, one), (None, two), (None, None), ("q-1", two), ("q-1", one), ("q-2", "...")]
    got = found(spark, items, [f"say {one} now", f"say {two} now", "none"], "string")
    assert got == sorted([(0, "q-1"), (0, None), (1, "q-1"), (1, None)], key=repr)
