"""A training corpus from ``documents``: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import jaccard, language, leakage, pieces, quality, toxicity
from textward.llm.queries import MODEL, TOKENIZERS
from textward.llm.storage import checkpoint_folder

#: How much nearer another language must be before a document's own label is held to be wrong.
SURE = 0.15


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = quality.learn(docs, labels, learnt=~toxicity.held_out(F.col("doc_id"), 5, 0))
    return docs.withColumn("_score", quality.score(F.col("text"), ranking)) \
        .filter(F.col("_score") >= quality.CUT).drop("_score")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, without those whose label is plainly another one."""
    profiles = language.learn(docs.filter(~toxicity.held_out(F.col("doc_id"), 4, 2)))
    other = F.coalesce((F.col("_found.lang") != F.col("lang")) & (F.col("_found.score") >= SURE), F.lit(False))
    return docs.withColumn("_found", language.identify(F.col("text"), profiles)) \
        .filter((F.col("_found.lang") != language.UNDETERMINED) & ~other).drop("_found")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; ids may be null (last) or repeat."""
    return jaccard.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    indexes = leakage.learn(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.withColumn("_leaks", leakage.leaks(F.col("text"), indexes)) \
        .filter(F.size("_leaks") == 0).drop("_leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents that are left, with their keys; ``intact`` tells that they decode to the text."""
    coded = docs.withColumn("_coded", pieces.encode(F.col("text"), pieces.load(f"{TOKENIZERS}/{MODEL}")))
    return coded.select("doc_id", "lang", "source", F.col("_coded.ids").alias("ids"),
                        F.coalesce(F.size("_coded.ids"), F.lit(0)).cast("bigint").alias("n_pieces"),
                        F.col("_coded.intact").alias("intact"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pieces", encode),
]
#: Learned scores, profiles and a trie are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
