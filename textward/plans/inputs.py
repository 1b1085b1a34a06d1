"""Spark views over the driver tables that stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table
from . import seeds as X


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Scan requests: the documents with their seed phrase."""
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    seeded = F.concat("text", X.chosen(X.DOCUMENT_SEEDS, F.col("doc_id"), X.N_DOCUMENT_SEEDS))
    return d.withColumn("text", seeded)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation messages with their seed phrase, keyed by tenant and session."""
    c = spread(table(spark, sf, "conversations"))
    key = F.col("conv_id") * 7 + F.col("turn")
    return c.select(
        F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("tenant_id"),
        F.col("conv_id").alias("session_id"),
        "turn", "role",
        F.concat("text", X.chosen(X.TURN_SEEDS, key, X.N_TURN_SEEDS)).alias("content"),
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages offered for ingestion."""
    p = spread(table(spark, sf, "pages").select("page_id", "html"))
    payload = X.chosen(X.DOCUMENT_SEEDS, F.col("page_id"), X.N_DOCUMENT_SEEDS)
    return p.select("page_id", F.concat("html", payload).alias("html"))


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events from the event log: action, risk, tenant, policy per event."""
    e = table(spark, sf, "events")
    risk = F.least(F.floor("value") / 200, F.lit(1.0))
    return e.select(
        "event_id", "ts", "user_id", "event_type",
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        action_of(F.col("event_type")).alias("action"),
        risk.alias("risk_score"),
        risk_level(risk).alias("risk_level"),
        F.when(F.col("event_type").isin("error", "purchase"), F.element_at(
            F.array(*[F.lit(p) for p in ("hipaa_v1", "gdpr_v1", "pci_dss_v1")]),
            (F.col("event_id") % 3 + 1).cast("int"))).alias("policy_id"),
        F.element_at(F.array(*[F.lit(d) for d in ("Sales", "Engineering", "Legal", "Finance")]),
                     (F.col("user_id") % 4 + 1).cast("int")).alias("department"),
        F.floor("value").cast("bigint").alias("processing_ms"),
        F.concat(F.lit("s"), (F.col("event_id") % 97).cast("string")).alias("session_id"),
    )


def action_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "block").when(event_type == "purchase", "redact")
        .when(event_type == "view", "alert").otherwise("allow")
    )


def risk_level(risk: Column) -> Column:
    return (
        F.when(risk >= 0.9, "critical").when(risk >= 0.7, "high").when(risk >= 0.4, "medium")
        .when(risk >= 0.1, "low").otherwise("none")
    )


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Agent tool calls from the event log."""
    e = table(spark, sf, "events")
    threat = X.chosen(X.ARGUMENT_SEEDS, F.col("event_id"), X.N_ARGUMENT_SEEDS)
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("agent_id"),
        "ts",
        F.get(F.array(*[F.lit(t) for t in X.TOOLS]), (F.col("event_id") % len(X.TOOLS)).cast("int")).alias("tool_name"),
        F.when(threat == "", F.col("props")).otherwise(threat).alias("arguments"),
    )


def agents(spark: SparkSession, sf: str) -> DataFrame:
    """Agent registrations: every sign-up event (re-)registers its user."""
    e = table(spark, sf, "events").where("event_type = 'signup'")
    k = F.col("event_id") % 6
    permissions = F.when(k == 0, F.array(F.lit("read_files"))).when(
        k == 1, F.array(*[F.lit(x) for x in ("read_files", "write_files", "database_read")])
    ).otherwise(F.array(*[F.lit(x) for x in (
        "read_files", "write_files", "delete_files", "execute_code", "network_access", "database_read",
        "database_write", "email_send", "api_call", "system_command", "memory_read", "memory_write")]))
    return e.select(
        F.col("user_id").alias("agent_id"),
        F.col("ts").alias("registered_at"),
        F.col("event_id").alias("registration_id"),
        permissions.alias("permissions"),
        F.when(k == 5, "critical").otherwise("high").alias("max_risk"),
        F.when(k == 2, "medium").when(k == 3, "critical").otherwise("high").alias("require_approval_above"),
        (k == 4).alias("sandbox_mode"),
        (F.col("event_id") % 11 != 0).alias("is_active"),
    )


CLASSES = ("public", "internal", "confidential", "restricted")
ROLES = ("anonymous", "employee", "analyst", "compliance_officer", "admin", "visitor")


def by_index(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def document_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Document metadata for retrieval: store, classification, quarantine flag."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.select(
        "doc_id", F.col("source").alias("store_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        by_index(CLASSES, F.col("doc_id")).alias("classification"),
        (F.col("doc_id") % 17 == 0).alias("is_quarantined"),
    )
