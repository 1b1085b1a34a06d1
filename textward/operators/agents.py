"""Agent tool-call governance: registry, argument threats, permissions, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.spans import PLAIN, array_text, literal
from . import limits as L
from . import threats as T
from .asof import as_of_join


def valid_registrations(registrations: DataFrame) -> DataFrame:
    """Registrations whose permissions and risk ceilings are known values."""
    known = F.array_except("permissions", F.expr(array_text(C.AGENT_PERMISSIONS)))
    return registrations.where(
        (F.size(known) == 0) & F.col("max_risk").isin(*C.AGENT_RISKS)
        & F.col("require_approval_above").isin(*C.AGENT_RISKS))


def latest_profiles(registrations: DataFrame, agent: str = "agent_id") -> DataFrame:
    """The last registration per agent; an aggregate, so a busy agent is combined map-side."""
    rest = [c for c in registrations.columns if c not in (agent, "registered_at", "registration_id")]
    last = F.max_by(F.struct(*rest), F.struct("registered_at", "registration_id")).alias("p")
    return registrations.groupBy(agent).agg(last).select(agent, "p.*")


def _registry(pick, unknown: str) -> str:
    cases = " ".join(
        f"WHEN tool_name RLIKE {literal(PLAIN + regex)} THEN {pick(perms, risk, escalate)}"
        for regex, perms, risk, escalate in C.TOOL_REGISTRY)
    return f"CASE {cases} ELSE {unknown} END"


def with_tool_risk(calls: DataFrame) -> DataFrame:
    """Append what the registry requires of a tool; unknown tools are high risk and need approval."""
    return calls.select(
        "*",
        F.expr(_registry(lambda p, r, e: array_text(p), "CAST(array() AS array<string>)")).alias("required_permissions"),
        F.expr(_registry(lambda p, r, e: literal(r), literal(C.UNKNOWN_TOOL[1]))).alias("tool_risk"),
        F.expr(_registry(lambda p, r, e: literal(e), literal(C.UNKNOWN_TOOL[2]))).alias("needs_escalation"))


def rank(risk: Column) -> Column:
    return F.array_position(F.expr(array_text(C.AGENT_RISKS)), risk)


def _named(position: Column) -> Column:
    return F.get(F.expr(array_text(C.AGENT_RISKS)), (position - 1).cast("int"))


def profiles_at(calls: DataFrame, registrations: DataFrame) -> DataFrame:
    """Calls with the profile of their agent that was valid at the time of the call."""
    rest = [c for c in registrations.columns if c not in ("agent_id", "registered_at", "registration_id")]
    return as_of_join(calls, registrations, ["agent_id"], "ts", "registered_at", rest, "registration_id")


def decide_without_limit(calls: DataFrame, profiles: DataFrame, then: bool = False) -> DataFrame:
    """Every check but the rate limit, in order; the first that fails decides.

    With ``then``, ``profiles`` are all registrations and the one valid at the time of a call counts, not the last.
    """
    scanned = with_tool_risk(calls).withColumn("_threats", T.argument_threats(F.col("arguments")))
    j = profiles_at(scanned, profiles) if then else scanned.join(profiles, "agent_id", "left")
    threat_rank = F.coalesce(F.array_max(F.transform("_threats", lambda t: rank(t["risk"]))), F.lit(0))
    staged = j.select(
        *calls.columns, "required_permissions", "needs_escalation", "permissions", "max_risk",
        "require_approval_above", F.coalesce("sandbox_mode", F.lit(False)).alias("sandbox_mode"),
        F.coalesce("is_active", F.lit(False)).alias("_active"),
        F.transform("_threats", lambda t: t["name"]).alias("threats"),
        threat_rank.alias("_threat"), F.greatest(threat_rank, rank(F.col("tool_risk"))).alias("_rank"),
        F.array_except("required_permissions", F.coalesce("permissions", F.array().cast("array<string>"))).alias("missing_permissions"))
    critical = len(C.AGENT_RISKS)
    active, risk = F.col("_active"), _named(F.col("_rank"))
    dangerous = F.col("_threat") >= critical
    missing = F.size("missing_permissions") > 0
    above = (F.col("_rank") >= critical) & (F.col("max_risk") != "critical")
    approval = F.col("needs_escalation") | (F.col("_rank") >= rank(F.col("require_approval_above")))
    return staged.select(
        *calls.columns, "required_permissions", "threats", "sandbox_mode", active.alias("_active"),
        F.when(~active | dangerous | missing | above, "deny").when(approval, "escalate")
        .when(F.col("sandbox_mode"), "sandbox").otherwise("allow").alias("decision"),
        F.when(~active | dangerous, "critical").otherwise(risk).alias("risk_level"),
        F.when(~active, "Agent not registered or inactive")
        .when(dangerous, F.concat(F.lit("Dangerous argument detected: "), F.array_join(F.slice("threats", 1, 2), ", ")))
        .when(missing, F.concat(F.lit("Missing permissions: "), F.array_join("missing_permissions", ", ")))
        .when(above, F.concat(F.lit("Tool risk ("), risk, F.lit(") exceeds agent ceiling ("), F.col("max_risk"), F.lit(")")))
        .when(approval, F.concat(F.lit("Human approval required for "), F.col("tool_name"), F.lit(" (risk: "), risk, F.lit(")")))
        .when(F.col("sandbox_mode"), "Permitted in sandbox mode")
        .otherwise(F.concat(F.lit("Permitted: all checks passed (risk: "), risk, F.lit(")"))).alias("reason"),
        F.when(active & ~dangerous & missing, F.col("missing_permissions"))
        .otherwise(F.array().cast("array<string>")).alias("missing_permissions"))


def decide(
    calls: DataFrame, profiles: DataFrame, limit: int = C.AGENT_CALLS, window_seconds: int = C.AGENT_WINDOW_SECONDS,
    then: bool = False,
) -> DataFrame:
    """The full decision.  The rate limit is tested first, but only calls that pass everything count."""
    d = decide_without_limit(calls, profiles, then)
    marked = d.withColumn("_counts", F.col("_active") & (F.col("decision") != "deny"))
    folded = L.window_admission(marked, "agent_id", "ts", ["call_id"], "_counts", limit, window_seconds)
    hit = F.col("limited") & F.col("_active")
    return folded.select(
        *calls.columns, "required_permissions", "threats", "sandbox_mode",
        F.when(hit, "deny").otherwise(F.col("decision")).alias("decision"),
        F.when(hit, False).otherwise(F.col("decision").isin("allow", "sandbox")).alias("allowed"),
        F.when(hit, "medium").otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(hit, "Rate limit exceeded").otherwise(F.col("reason")).alias("reason"),
        F.when(hit, F.array().cast("array<string>")).otherwise(F.col("missing_permissions")).alias("missing_permissions"),
        (~hit & (F.col("decision") == "escalate")).alias("requires_approval"))


def approval_queue(decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Escalated calls with their approval, pending where there is none."""
    waiting = decisions.where("requires_approval").join(approvals, "call_id", "left")
    return waiting.withColumn("approval_status", F.when(F.col("approved_by").isNull(), "pending")
                              .when(F.col("approved"), "approved").otherwise("rejected"))


def newest(df: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The newest rows of a log, as a top-k."""
    return df.orderBy(*order).limit(limit)
