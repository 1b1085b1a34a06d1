"""The operators of this package as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, jaccard, language, leakage, lexical, negatives, pieces, quality, secrets, shards, topk, toxicity, urls

#: Rules of the query, and marks of hosts whose pages are listed.
RULES = (
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
)
LISTED_HOSTS = "casino|bets|pills"
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; passages as ranges of tokens."""
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 3, 1)
    detector = toxicity.learn(docs, _table(spark, sf_dir, "labels"), learnt=~held)
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.detect(F.col("text"), detector).alias("found"))
    return scored.select("doc_id", "held_out", F.col("found.score").alias("score"),
                         (F.col("found.score") >= 0.7).cast("int").alias("predicted"),
                         F.col("found.passages").alias("passages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    model = pieces.load(f"{TOKENIZERS}/{MODEL}")
    coded = _table(spark, sf_dir, "documents").select("doc_id", pieces.encode(F.col("text"), model).alias("coded"))
    return coded.select("doc_id", F.col("coded.ids").alias("ids"),
                        F.coalesce(F.size("coded.ids"), F.lit(0)).cast("bigint").alias("n_pieces"),
                        F.col("coded.intact").alias("intact"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 5, 0)
    ranking = quality.learn(docs, _table(spark, sf_dir, "labels"), learnt=~held)
    return docs.select("doc_id", held.alias("held_out"), quality.score(F.col("text"), ranking).alias("score")) \
        .withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def listed(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on listed hosts."""
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    return pages.filter(host.rlike(LISTED_HOSTS)).select(urls.canonical(host, path).alias("canonical"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, RULES, listed(pages)).drop("listed")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return shards.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS) \
        .select("doc_id", F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("bigint").alias("shard"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return jaccard.groups(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest inner products of every fiftieth vector over all others."""
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.filter(F.pmod("vec_id", F.lit(50)) == 0), vectors, 5)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return _table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text")) \
        .withColumn("n_chars", F.length("text").cast("bigint"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: one row for each document and item."""
    docs = _table(spark, sf_dir, "documents")
    indexes = leakage.learn(docs, _table(spark, sf_dir, "benchmark"))
    found = docs.select("doc_id", F.explode(leakage.leaks(F.col("text"), indexes)).alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.share", "leak.cosine", "leak.first")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 4, 2)
    profiles = language.learn(docs.filter(~held))
    return docs.select("doc_id", held.alias("held_out"), language.identify(F.col("text"), profiles).alias("found")) \
        .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five positives."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = negatives.quantized(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return negatives.mine(vectors, vectors.filter(F.pmod("vec_id", F.lit(100)) == 0)).drop("place")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: three patterns, and what the randomness tests add."""
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.spans(F.col("text"), secrets.learn(docs)).alias("found"))
    return secrets.digest(found, "doc_id", "found")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item."""
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def _rule_sql(value: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.text), -len(r.host)))
    cases = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
                     f"THEN '{getattr(r, value)}'" for r in ordered)
    return f"CASE {cases} END"


OP4_SQL = f"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
named AS (
  SELECT *, regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') AS canonical FROM split),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED_HOSTS}'))
SELECT page_id, host, path, {_rule_sql("text")} AS rule,
       coalesce({_rule_sql("action")},
                CASE WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named
"""


def _op5_sql() -> str:
    table = shards.lookup_table(SHARDS)
    return f"""
WITH owners AS (SELECT {table} AS owner),
slots AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {len(table)} AS slot
  FROM documents)
SELECT doc_id, slot, CAST(owner[slot + 1] AS BIGINT) AS shard FROM slots, owners
"""


OP6_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * o >= 80 * (p.n + q.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

OP7_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM vectors a, vectors c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same)
  WHERE r <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""

OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(c * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_sentencepiece": (op2_sentencepiece, None),
    "op3_quality": (op3_quality, None),
    "op4_urls": (op4_urls, OP4_SQL),
    "op5_sharding": (op5_sharding, _op5_sql()),
    "op6_ngram_jaccard": (op6_ngram_jaccard, OP6_SQL),
    "op7_topk": (op7_topk, OP7_SQL),
    "op8_html": (op8_html, None),
    "op9_decontamination": (op9_decontamination, None),
    "op10_language": (op10_language, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_secrets": (op12_secrets, None),
    "op13_lexical": (op13_lexical, OP13_SQL),
}
