"""Retrieval security: clearances, query and store authorisation, top-k, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.spans import PLAIN
from . import threats as T

SALTS = 32


def _level(value: Column, levels: dict[str, int], unknown: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), F.lit(unknown))


def role_level(role: Column) -> Column:
    return _level(role, C.ROLE_CLEARANCE, C.UNKNOWN_ROLE_LEVEL)


def class_level(classification: Column) -> Column:
    return _level(classification, C.CLASSIFICATION_CLEARANCE, C.UNKNOWN_CLASS_LEVEL)


def can_access(role: Column, classification: Column) -> Column:
    """True where the role's clearance covers the classification; nulls count as unknown."""
    return role_level(role) >= class_level(classification)


def document_access(documents: DataFrame, role: Column) -> DataFrame:
    """Append ``access``: quarantined documents are denied to everyone."""
    allowed = ~F.col("is_quarantined") & can_access(role, F.col("classification"))
    return documents.withColumn("access", F.when(allowed, "allowed").otherwise("denied"))


def access_counts(documents: DataFrame) -> DataFrame:
    """Role by classification: documents each role may read.

    The matrix has one fixed row per role and classification; documents are
    counted per classification before they meet it.
    """
    counts = documents.groupBy("classification").agg(
        F.count("*").alias("documents"), F.count_if(~F.col("is_quarantined")).alias("_open"))
    roles = F.array(*[F.lit(r) for r in C.ROLE_CLEARANCE])
    rows = counts.select("*", F.explode(roles).alias("role"))
    allowed = can_access(F.col("role"), F.col("classification"))
    return rows.select(
        "role", "classification", "documents", allowed.alias("has_access"),
        F.when(allowed, F.col("_open")).otherwise(0).alias("readable"))


def authorize_queries(requests: DataFrame, query: str = "query") -> DataFrame:
    """Append the query verdict: injection denies, otherwise the fishing risk decides."""
    staged = requests.select("*", T.query_injection(F.col(query)).alias("_inj"), T.query_risk(F.col(query)).alias("_risk"))
    injected = F.col("_inj").isNotNull()
    return staged.select(
        *requests.columns,
        F.when(injected, "deny").when(F.col("_risk") < 0.7, "allow").otherwise("filter").alias("action"),
        (~injected).alias("query_allowed"),
        F.when(injected, F.lit(C.QUERY_INJECTION_RISK)).otherwise(F.col("_risk")).alias("query_risk_score"),
        injected.alias("injection_detected"),
        F.when(injected, F.concat(F.lit("Query injection detected: "), F.col("_inj"))).alias("block_reason"),
    )


def authorize_stores(
    requests: DataFrame, stores: DataFrame, query: str = "query", deny_unknown: bool = False
) -> DataFrame:
    """Query verdict plus store clearance; stores not in the registry are allowed unless told otherwise.

    Query texts are scanned once and dropped before stores are exploded.
    """
    verdict = authorize_queries(requests, query).drop(query)
    registry = stores.select("store_id", "classification")
    exploded = verdict.select("request_id", "user_role", "query_allowed", F.posexplode_outer("store_ids").alias("_p", "store_id"))
    known = F.col("classification").isNotNull()
    granted = F.col("query_allowed") & F.when(known, can_access(F.col("user_role"), F.col("classification"))).otherwise(
        not deny_unknown)
    item = F.struct("_p", "store_id")
    checked = exploded.join(registry, "store_id", "left").where("store_id IS NOT NULL").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(granted, item))).alias("_ok"),
        F.array_sort(F.collect_list(F.when(~granted, item))).alias("_no"))
    ids = lambda c: F.coalesce(F.transform(c, lambda s: s["store_id"]), F.array().cast("array<string>"))
    joined = verdict.drop("store_ids").join(checked, "request_id", "left")
    return joined.select(
        *[c for c in verdict.columns if c not in ("store_ids", "query_allowed")],
        (F.col("query_allowed") & (F.size(ids("_ok")) > 0)).alias("allowed"),
        ids("_ok").alias("authorized_stores"), ids("_no").alias("denied_stores"))


def best_rows(df: DataFrame, keys, k: int, *order: Column, salt: Column) -> DataFrame:
    """The ``k`` best rows per key with their ``rank``, ranked per salt first."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.drop("_salt", "rank").withColumn("rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def retrieve_top_k(requests: DataFrame, vectors: DataFrame, top_k: int = 5, min_score: float = 0.7) -> DataFrame:
    """Nearest vectors per request within its store, restricted to readable classifications.

    ``requests``: request_id, user_role, store_id, query_vector.
    ``vectors``: vec_id, store_id, classification, embedding.
    A request meets only the vectors of its own store (an equi-join); ranks are
    salted, so a store holding much of the table is not ranked in one task.
    """
    pairs = vectors.join(requests, "store_id").where(can_access(F.col("user_role"), F.col("classification")))
    scored = pairs.select("request_id", "store_id", "vec_id", cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    good = scored.where(F.col("score") >= min_score)
    return best_rows(good, ["request_id"], top_k, F.col("score").desc(), F.col("vec_id"), salt=F.col("vec_id"))


def citations(retrieved: DataFrame) -> DataFrame:
    """Citation rows: position before filtering (gaps stay), only what the role may see."""
    numbered = retrieved.withColumn("citation_id", F.row_number().over(
        Window.partitionBy("request_id").orderBy("rank")))
    classification = F.coalesce("classification", F.lit("internal"))
    return numbered.withColumn("classification", classification).where(
        can_access(F.col("user_role"), F.col("classification")))


def attribution_context(cited: DataFrame) -> DataFrame:
    """The context text per request: its cited sources in order (at most top-k of them)."""
    block = F.concat(
        F.lit("[Source "), F.col("citation_id").cast("string"), F.lit("] "), F.col("title"),
        F.lit(" (doc_id: "), F.col("doc_id").cast("string"), F.lit(", relevance: "),
        F.format_string("%.2f", "score"), F.lit(")\n"), F.col("content"))
    grouped = cited.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("citation_id", block.alias("b")))).alias("_b"))
    return grouped.select(
        "request_id", F.size("_b").alias("sources"),
        F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def simulate(requests: DataFrame, query: str = "query") -> DataFrame:
    """The three retrieval checks: authorisation, injection, personal number in the query."""
    q = F.col(query)
    injected = reduce(lambda a, b: a | b, [q.rlike(PLAIN + p) for p in C.SIMULATION_INJECTIONS])
    personal = q.rlike("(?U)" + C.SIMULATION_PERSONAL_NUMBER)
    # An unlisted role has no access at all here, unlike the clearance table's default.
    known = F.col("user_role").isin(*C.ROLE_CLEARANCE)
    staged = requests.select(
        *[c for c in requests.columns if c != query],
        (known & can_access(F.col("user_role"), F.col("classification"))).alias("authorized"),
        (~injected).alias("injection_free"), (~personal).alias("pii_free"))
    return staged.withColumn("retrieval_allowed", F.col("authorized") & F.col("injection_free") & F.col("pii_free"))


def store_kpis(stores: DataFrame) -> DataFrame:
    return stores.agg(
        F.count("*").alias("stores"), F.sum("docs").alias("documents"),
        F.count_if(F.col("classification") == "restricted").alias("restricted"),
        F.count_if(F.col("status") != "healthy").alias("unhealthy"))


def retrieval_kpis(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("retrievals"), F.count_if("allowed").alias("authorized"),
        F.count_if(~F.col("allowed")).alias("unauthorized"),
        F.count_if(F.col("query_risk_score") > 0.7).alias("high_risk"))
