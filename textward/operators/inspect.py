"""Text inspection: entities, injections, toxicity, score, action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import detect as D
from ..functions import scoring as S
from ..functions.masking import content_hash, mask_value
from ..functions.spans import literal


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def verdicts(df: DataFrame, text: str = "text", pii_threshold: float = C.PII_THRESHOLD) -> DataFrame:
    """Append risk score, action, block reason and detection flags; one map-side pass."""
    return D.with_evidence(df, text).select(
        *df.columns,
        "evidence",
        S.risk_score().alias("risk_score"),
        S.action(pii_threshold=pii_threshold).alias("action"),
        S.block_reason().alias("block_reason"),
        *[S.detected(k).alias(f"{k}_detected") for k in (*S.CATEGORIES, "injection", "toxicity")],
    )


def entity_rows(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per entity match, values masked.

    The outer generator keeps Catalyst from deriving a size filter that would
    evaluate the match arrays twice.
    """
    found = D.with_evidence(df, text).select(
        *keys, D.hits(text).alias("hits")
    )
    rows = found.select(*keys, F.inline_outer("hits")).where(F.col("det").isNotNull())
    det = F.col("det")
    return rows.select(
        *keys,
        det.alias("det_idx"),
        D.det_type(det).alias("entity_type"),
        D.det_category(det).alias("category"),
        mask_value(F.col("value"), D.det_type(det)).alias("value_masked"),
        F.col("start"),
        F.col("end"),
        D.det_confidence(det).alias("confidence"),
        F.lit("regex").alias("detection_method"),
        D.det_explanation(det).alias("explanation"),
    )


def injection_attempts(counts: str, evidence: str = "evidence") -> Column:
    """``array<struct>`` of injection findings in pattern order."""
    items = []
    for i, (name, severity, explanation, remediation, _) in enumerate(C.INJECTION_PATTERNS):
        confidence = C.UNICODE_CONFIDENCE if name == "unicode_attack" else C.INJECTION_CONFIDENCE
        items.append(f"""CASE WHEN {D.bit_test(1 << (D.INJECTION_BIT + i), evidence)} THEN named_struct(
          'attack_type', {literal(name)}, 'severity', {literal(severity)},
          'pattern_matched', concat({literal(f"Pattern: {name} (")}, {counts}[{i}], ' match(es))'),
          'location', 'prompt', 'confidence', {literal(confidence)},
          'explanation', {literal(explanation)}, 'remediation', {literal(remediation)},
          'match_count', {counts}[{i}]) END""")
    return F.expr("array_compact(array(" + ", ".join(items) + "))")


def injection_rows(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per injection pattern found in a text."""
    found = D.with_evidence(df, text).select(
        *keys, "evidence", D.injection_counts(text).alias("counts")
    )
    attempts = found.select(
        *keys, injection_attempts("counts").alias("attempts")
    )
    return attempts.select(*keys, F.inline_outer("attempts")).where(F.col("attack_type").isNotNull())


def _summary(action: Column, n: dict[str, Column], injections: Column) -> Column:
    parts = F.concat_ws(
        ", ",
        F.when(n["pii"] > 0, F.concat(F.lit("PII ("), n["pii"].cast("string"), F.lit(" entity/ies)"))),
        F.when(n["phi"] > 0, F.concat(F.lit("PHI ("), n["phi"].cast("string"), F.lit(" entity/ies)"))),
        F.when(n["pci"] > 0, F.concat(F.lit("PCI data ("), n["pci"].cast("string"), F.lit(" entity/ies)"))),
        F.when(n["secret"] > 0, F.lit("SECRETS/CREDENTIALS")),
        F.when(injections > 0, F.concat(
            F.lit("INJECTION ATTEMPT ("), injections.cast("string"), F.lit(" pattern(s))"))),
        F.when(S.detected("toxicity"), F.lit("TOXIC/HARMFUL CONTENT")),
    )
    return F.concat(
        F.lit("Scan completed. Action: "), F.upper(action), F.lit(". "),
        F.when(parts == "", F.lit("No threats detected. "))
        .otherwise(F.concat(F.lit("Detected: "), parts, F.lit(". "))),
        F.lit("Overall risk score: "), S.risk_text(".2%"), F.lit("."),
    )


def inspect(
    df: DataFrame, text: str = "text", content_type: str = "prompt",
    pii_threshold: float = C.PII_THRESHOLD,
) -> DataFrame:
    """The full inspection result per row; raw matched values do not appear in it."""
    t = F.col(text)
    found = D.with_evidence(df, text).select(
        *df.columns, "evidence",
        D.hits(text).alias("_hits"), D.injection_counts(text).alias("_counts"),
    )
    entities = F.transform(F.col("_hits"), lambda h: F.struct(
        h["det"].alias("det_idx"),
        D.det_type(h["det"]).alias("entity_type"),
        D.det_category(h["det"]).alias("category"),
        mask_value(h["value"], D.det_type(h["det"])).alias("value_masked"),
        h["start"].alias("start"), h["end"].alias("end"),
        D.det_confidence(h["det"]).alias("confidence"),
        F.lit("regex").alias("detection_method"),
        D.det_explanation(h["det"]).alias("explanation"),
    ))
    staged = found.select(
        *df.columns, "evidence",
        entities.alias("entities"),
        injection_attempts("_counts").alias("injections"),
        S.risk_score().alias("overall_risk_score"),
        S.action(pii_threshold=pii_threshold).alias("action"),
    )
    categories = F.transform("entities", lambda e: e["category"])
    n = {c: F.size(categories) - F.size(F.array_remove(categories, c)) for c in S.CATEGORIES}
    blank = is_blank(t)
    return staged.select(
        *df.columns,
        F.when(blank, F.lit("")).otherwise(content_hash(t)).alias("content_hash"),
        F.lit(content_type).alias("content_type"),
        "entities",
        "injections",
        *[S.detected(k).alias(f"{k}_detected") for k in (*S.CATEGORIES, "injection", "toxicity")],
        "overall_risk_score",
        F.create_map(*[
            x for k in (*S.CATEGORIES, "injection", "toxicity")
            for x in (F.lit("secrets" if k == "secret" else k), S.category_confidence(k))
        ]).alias("confidence_scores"),
        F.when(blank, F.lit(C.EMPTY_SUMMARY)).otherwise(_summary(
            F.col("action"), n, F.size("injections"),
        )).alias("explanation_summary"),
        S.triggered_labels().alias("triggered_rules"),
        S.remediation().alias("remediation_recommendations"),
        "action",
        S.block_reason().alias("block_reason"),
    )
