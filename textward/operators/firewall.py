"""Composite decisions over conversations and model outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import detect as D
from ..functions import scoring as S
from ..functions.masking import content_hash
from ..functions.spans import replace_each
from . import policy as P
from . import redact as R
from . import sessions as H
from . import threats as T


def _redacted_messages(messages: DataFrame, decided: DataFrame, keys, overlaps: str) -> DataFrame:
    """Messages of the decided sessions, non-system ones masked one by one.

    The join carries each text once; masking is a map over the joined rows, so
    messages of sessions that were not let through are never masked.
    """
    joined = messages.select(*keys, "turn", "role", "content").join(decided, list(keys))
    masked = R.redact(joined, "content", "mask", overlaps)
    change = (F.col("role") != "system") & F.col("_has_entities")
    return masked.select(
        *keys, "turn", "role",
        F.when(change, F.col("redacted_text")).otherwise(F.col("content")).alias("content"),
        F.when(change, F.col("redaction_count")).otherwise(0).alias("redactions"))


def prompt_decisions(
    messages: DataFrame, rules: Sequence[P.Rule], keys=H.SESSION,
    max_messages: int = C.MAX_HISTORY_MESSAGES, system_prompt: str | None = None, context: DataFrame | None = None,
) -> DataFrame:
    """One decision per session over its bounded history.

    ``context`` has the request context of sessions (role, department, model, region, ...) that rules may test; it is
    joined after the texts have been reduced to features.
    """
    bounded = H.bound_history(H.truncate_messages(messages), keys, max_messages)
    texts = H.assemble(bounded, keys, system_prompt).select(
        *keys, T.hard_block(F.col("text")).alias("hard_block"),
        content_hash(F.col("text"), 16).alias("content_hash"), "text")
    features = P.text_features(texts, rules)
    e = P.evaluate(features if context is None else features.join(context, list(keys), "left"), rules)
    ordered = P.evaluation_order(rules)
    names = S.injection_names()
    injected = S.detected("injection")
    risk, policy = F.col("risk_score"), F.col("policy_action")
    hard = F.col("hard_block").isNotNull()
    blocking = "array_min(array_intersect(fired, " + P._positions(ordered, "block") + "))"
    policy_id = F.expr(f"{P.array_text([r.policy_id for r in ordered])}[{blocking}]")
    staged = e.select(
        *keys, "hard_block", "content_hash", "evidence", "triggered_rule_names",
        names.alias("_names"), S.entity_types().alias("_types"),
        F.when(hard, F.lit(1.0)).otherwise(risk).alias("risk_score"),
        F.when(hard | injected | (policy == "block") | (risk >= 0.9), "block")
        .when((risk >= 0.7) | (policy == "redact"), "redact")
        .when((risk >= 0.4) | (policy == "alert"), "alert").otherwise("allow").alias("action"),
        F.when(hard | injected | (policy == "block") | (risk >= 0.9), "critical")
        .when((risk >= 0.7) | (policy == "redact"), "high")
        .when((risk >= 0.4) | (policy == "alert"), "medium")
        .when(risk >= 0.1, "low").otherwise("none").alias("risk_level"),
        F.when(hard, F.concat(F.lit("Hard block: "), F.col("hard_block")))
        .when(injected, F.concat(F.lit("Injection detected: "), F.array_join(F.slice(names, 1, 2), ", ")))
        .when(policy == "block", F.concat(F.lit("Policy block: "), policy_id))
        .when(risk >= 0.9, "Risk score exceeds critical threshold").alias("block_reason"),
        F.when(hard, F.array("hard_block")).when(injected, names)
        .when(policy == "block", F.col("triggered_rule_names"))
        .otherwise(F.array().cast("array<string>")).alias("violations"),
        (F.size(S.entity_types()) > 0).alias("_has_entities"),
    )
    rule_names = F.slice("triggered_rule_names", 1, 3)
    explanation = F.concat_ws(
        " | ",
        F.concat(F.lit("Decision: "), F.upper("action")),
        F.concat(F.lit("Reason: "), F.col("block_reason")),
        F.when(F.size("_types") > 0, F.concat(F.lit("Entities: "), F.array_join(F.slice("_types", 1, 5), ", "))),
        F.when(F.size("_names") > 0, F.concat(
            F.lit("Injections: "), F.size("_names").cast("string"), F.lit(" pattern(s) detected"))),
        F.concat(F.lit("Risk score: "), S.risk_text(".2f")),
        F.when(F.size(rule_names) > 0, F.concat(F.lit("Policy rules triggered: "), F.array_join(rule_names, ", "))),
    )
    return staged.select(
        *keys, "action", "risk_level", "risk_score", (F.col("action") != "block").alias("allowed"),
        "block_reason", "violations",
        F.when(F.col("hard_block").isNotNull(), F.concat(
            F.lit("Request blocked by immutable firewall rule: "), F.col("hard_block")))
        .otherwise(explanation).alias("explanation"),
        "content_hash", "_has_entities")


def prompt_messages(
    messages: DataFrame, decisions: DataFrame, keys=H.SESSION,
    max_messages: int = C.MAX_HISTORY_MESSAGES, overlaps: str = "merge",
) -> DataFrame:
    """The messages forwarded for allowed sessions, masked message by message."""
    bounded = H.bound_history(H.truncate_messages(messages), keys, max_messages)
    allowed = decisions.where("allowed").select(*keys, "_has_entities")
    return _redacted_messages(bounded, allowed, keys, overlaps)


def gateway(
    messages: DataFrame, keys=H.SESSION, max_messages: int | None = None, overlaps: str = "merge",
    system_prompt: str | None = None,
) -> DataFrame:
    """Guarded exchange per session: user turns are the request, assistant turns the reply.

    The request is every message but the replies, after the system prompt if there is one; ``max_messages`` keeps the
    newest only.  Every message is inspected once, and both sides are reduced to counters before they are joined.
    """
    asked = messages.where("role <> 'assistant'")
    if max_messages is not None:
        asked = H.bound_history(asked, keys, max_messages)
    full = H.assemble(asked, keys, system_prompt)
    v = D.with_evidence(full).select(
        *keys, "evidence", S.risk_score().alias("input_risk_score"), H.token_estimate(F.col("text")).alias("_prompt"))
    names, injected = S.injection_names(), S.detected("injection")
    risk, entities = F.col("input_risk_score"), D.any_bit(D.ENTITY_MASK)
    decided = v.select(
        *keys, "input_risk_score", "_prompt", entities.alias("_has_entities"),
        F.when(injected | (risk >= 0.9), "block").when((risk >= 0.5) | entities, "redact")
        .otherwise("allow").alias("input_action"),
        F.when(injected, F.concat(F.lit("Injection detected: "), F.get(names, F.lit(0))))
        .when(risk >= 0.9, "Risk score exceeds critical threshold").alias("block_reason"))
    red = R._redacted(messages.select(*keys, "role", "turn", "content"), "content", "mask", overlaps)
    sides = red.select(
        *keys, "role", F.size("_red.records").alias("_n"), S.risk_score().alias("_risk"),
        F.length("content").alias("_chars"))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    counters = sides.groupBy(*keys).agg(
        F.sum(F.when(user, F.col("_n")).otherwise(0)).alias("_in"),
        F.sum(F.when(reply, F.col("_n")).otherwise(0)).alias("_out"),
        F.max(F.when(reply, F.col("_risk"))).alias("_out_risk"),
        F.sum(F.when(reply, F.col("_chars")).otherwise(0)).alias("_reply_chars"))
    blocked = F.col("input_action") == "block"
    sent = lambda c: F.when(~blocked, c)
    return decided.join(counters, list(keys)).select(
        *keys, "input_action", "input_risk_score", blocked.alias("blocked"), "block_reason",
        F.when(blocked, "n/a").when(F.col("_out") > 0, "redact").otherwise("deliver").alias("output_action"),
        F.when(blocked, F.lit(0.0)).otherwise(F.coalesce("_out_risk", F.lit(0.0))).alias("output_risk_score"),
        F.when(blocked, F.lit(0)).otherwise(
            F.when(F.col("_has_entities"), F.col("_in")).otherwise(0) + F.col("_out")).alias("entities_redacted"),
        sent(F.col("_prompt")).alias("prompt_tokens"),
        sent(F.floor(F.col("_reply_chars") / 4).cast("bigint")).alias("completion_tokens"))


def gateway_messages(messages: DataFrame, decisions: DataFrame, keys=H.SESSION, overlaps: str = "merge") -> DataFrame:
    """What passes the gateway of sessions that are not blocked, message by message.

    Requests are masked where the decision is to redact, replies always; system messages never.  ``decisions`` is
    the result of :func:`gateway`.
    """
    passed = decisions.where(~F.col("blocked")).select(*keys, (F.col("input_action") == "redact").alias("_redact"))
    joined = messages.select(*keys, "turn", "role", "content").join(passed, list(keys))
    masked = R.redact(joined, "content", "mask", overlaps)
    change = (F.col("role") == "assistant") | (F.col("role") != "system") & F.col("_redact")
    return masked.select(
        *keys, "turn", "role", F.when(change, F.col("redacted_text")).otherwise(F.col("content")).alias("content"),
        F.when(change, F.col("redaction_count")).otherwise(0).alias("redactions"))


def output_firewall(
    df: DataFrame, text: str = "content", block_on_hijack: bool = True, block_on_pii: bool = False,
    max_chars: int = C.MAX_OUTPUT_CHARS, overlaps: str = "merge",
) -> DataFrame:
    """Decide and sanitise model outputs; one map-side pipeline per row."""
    keep = [c for c in df.columns if c != text]
    t = F.col(text)
    cut = F.when(F.length(t) > max_chars, F.concat(F.left(t, F.lit(max_chars)), F.lit(C.OUTPUT_CUT_MARK))).otherwise(t)
    checked = df.select(*keep, cut.alias("_text")).select(
        *keep, "_text", T.hijack(F.col("_text")).alias("_hijack"), T.unsafe_urls(F.col("_text")).alias("_urls"))
    values = F.transform("_urls", lambda u: u["value"])
    clean = checked.select(
        *keep, "_hijack", "_urls", content_hash(F.col("_text"), 16).alias("content_hash"),
        replace_each(F.col("_text"), values, "[URL REMOVED]").alias("_clean"))
    found = D.with_evidence(clean, "_clean").select(
        *clean.columns, "evidence", D.hits("_clean").alias("_hits"))
    hits = F.col("_hits") if overlaps == "splice" else R.merged(F.col("_hits"), F.col("_clean"))
    spliced = found.select(
        *keep, "_hijack", "_urls", "content_hash", "evidence",
        F.size("_hits").alias("_n"), R.redaction(F.col("_clean"), hits)["text"].alias("_out"))
    coded = spliced.select("*", T.dangerous_code(F.col("_out")).alias("_code"))
    hijacked = F.col("_hijack").isNotNull() & F.lit(block_on_hijack)
    leaked = (F.col("_n") > 0) & F.lit(block_on_pii)
    sane = replace_each(F.col("_out"), F.transform("_code", lambda m: m["value"]), "[CODE SANITIZED]")
    risk = S.risk_score()
    action = (
        F.when(hijacked | leaked, "block").when(F.size("_code") > 0, "sanitize").when(F.col("_n") > 0, "redact")
        .when(F.size("_urls") > 0, "sanitize").when(risk > 0.5, "alert").otherwise("deliver"))
    names = lambda c: F.transform(c, lambda m: m["name"])
    explanation = F.concat_ws(
        " | ",
        F.concat(F.lit("Output action: "), F.upper(action)),
        F.when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" entity/-ies redacted"))),
        F.when(F.size("_urls") > 0, F.concat(F.lit("Unsafe URLs removed: "), F.size("_urls").cast("string"))),
        F.when(F.size("_code") > 0, F.concat(F.lit("Dangerous code sanitized: "), F.size("_code").cast("string"))),
        F.concat(F.lit("Output risk score: "), S.risk_text(".2f")))
    return coded.select(
        *keep,
        action.alias("action"),
        (action != "block").alias("allowed"),
        F.when(hijacked, "[RESPONSE BLOCKED: Model compromise detected]")
        .when(leaked, "[RESPONSE BLOCKED: PII detected in LLM output]").otherwise(sane).alias("delivered_content"),
        F.when(hijacked, F.lit(1.0)).otherwise(risk).alias("risk_score"),
        F.when(hijacked, 0).otherwise(F.col("_n")).alias("redacted_count"),
        F.when(hijacked, F.concat(F.lit("Model hijack detected: "), F.col("_hijack")))
        .when(leaked, F.concat(F.lit("PII in output: "), F.col("_n").cast("string"), F.lit(" entity/-ies")))
        .alias("block_reason"),
        F.when(hijacked, F.array("_hijack")).otherwise(F.concat(names("_urls"), names("_code"))).alias("violations"),
        F.when(hijacked, F.concat(
            F.lit("Response blocked — model appears to have been successfully jailbroken: "), F.col("_hijack")))
        .otherwise(explanation).alias("explanation"),
        "content_hash")
