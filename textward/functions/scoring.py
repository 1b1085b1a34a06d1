"""Scores and decisions as arithmetic on the evidence mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C
from .detect import (
    INJECTION_BIT, INJECTION_MASK, TOXICITY_MASK, any_bit, bit_test, category_mask, entity_bits,
    entity_confidence, injection_bits,
)
from .spans import literal

CATEGORIES = ("pii", "phi", "pci", "secret")


def _injection_confidence(pattern) -> float:
    return C.UNICODE_CONFIDENCE if pattern[0] == "unicode_attack" else C.INJECTION_CONFIDENCE


def risk_levels() -> list[tuple[float, int]]:
    """The reachable risk values, highest first, with the bits that reach each."""
    levels: dict[float, int] = {}
    for i, (kind, _, _) in enumerate(C.ENTITY_PATTERNS):
        value = C.CATEGORY_WEIGHT[C.ENTITY_TYPES[kind][0]] * entity_confidence(kind)
        levels[round(value, 4)] = levels.get(round(value, 4), 0) | (1 << i)
    for i, pattern in enumerate(C.INJECTION_PATTERNS):
        value = round(C.SEVERITY_WEIGHT[pattern[1]] * _injection_confidence(pattern), 4)
        levels[value] = levels.get(value, 0) | (1 << (INJECTION_BIT + i))
    levels[C.TOXICITY_CONFIDENCE] = levels.get(C.TOXICITY_CONFIDENCE, 0) | TOXICITY_MASK
    return sorted(levels.items(), reverse=True)


def _first(evidence: str, cases: list[tuple[int, object]], default) -> Column:
    """CASE over masks: the value of the first mask that intersects the evidence."""
    whens = " ".join(f"WHEN {bit_test(mask, evidence)} THEN {literal(v)}" for mask, v in cases)
    return F.expr(f"CASE {whens} ELSE {literal(default)} END")


def _present(evidence: str, cases: list[tuple[int, str]]) -> Column:
    """The texts whose mask intersects the evidence, in the given order."""
    items = ", ".join(
        f"CASE WHEN {bit_test(mask, evidence)} THEN {literal(v)} END" for mask, v in cases
    )
    return F.expr(f"array_compact(array({items}))")


def risk_score(evidence: str = "evidence") -> Column:
    return _first(evidence, [(m, v) for v, m in risk_levels()], 0.0)


def risk_text(spec: str, evidence: str = "evidence") -> Column:
    """The risk score as text; every reachable value is formatted once, here."""
    return _first(evidence, [(m, format(v, spec)) for v, m in risk_levels()], format(0.0, spec))


def detected(kind: str, evidence: str = "evidence") -> Column:
    """Flag for ``pii phi pci secret injection toxicity``."""
    masks = {"injection": INJECTION_MASK, "toxicity": TOXICITY_MASK}
    return any_bit(masks[kind] if kind in masks else category_mask(kind), evidence)


def category_confidence(kind: str, evidence: str = "evidence") -> Column:
    """Highest confidence within a category, 0 when nothing was detected."""
    if kind == "toxicity":
        return _first(evidence, [(TOXICITY_MASK, C.TOXICITY_CONFIDENCE)], 0.0)
    if kind == "injection":
        unicode_mask = injection_bits(lambda p: p[0] == "unicode_attack")
        return _first(
            evidence,
            [(unicode_mask, C.UNICODE_CONFIDENCE), (INJECTION_MASK, C.INJECTION_CONFIDENCE)], 0.0,
        )
    cases = [
        (entity_bits(lambda t, c=c: C.ENTITY_TYPES[t][0] == kind and entity_confidence(t) == c), c)
        for c in (C.HIGH_CONFIDENCE, C.BASE_CONFIDENCE)
    ]
    return _first(evidence, [x for x in cases if x[0]], 0.0)


def _blocking_cases() -> list[tuple[int, str]]:
    cases = [
        (1 << (INJECTION_BIT + i), f"Critical injection detected: {p[0]}")
        for i, p in enumerate(C.INJECTION_PATTERNS) if p[1] == "critical"
    ]
    cases.append((TOXICITY_MASK, "Harmful/toxic content detected"))
    for i, (kind, _, _) in enumerate(C.ENTITY_PATTERNS):
        secret = C.ENTITY_TYPES[kind][0] == "secret"
        if secret and entity_confidence(kind) >= C.SECRET_BLOCK_CONFIDENCE:
            cases.append((1 << i, f"Sensitive credential detected: {kind}"))
    return cases


def block_reason(evidence: str = "evidence") -> Column:
    return _first(evidence, _blocking_cases(), None)


def action(evidence: str = "evidence", pii_threshold: float = C.PII_THRESHOLD) -> Column:
    """block, redact or allow."""
    blocking = 0
    for mask, _ in _blocking_cases():
        blocking |= mask
    personal = entity_bits(
        lambda t: C.ENTITY_TYPES[t][0] != "secret" and entity_confidence(t) >= pii_threshold
    )
    risky = 0
    for value, mask in risk_levels():
        if value >= C.REDACT_RISK:
            risky |= mask
    return _first(evidence, [(blocking, "block"), (personal | risky, "redact")], "allow")


def triggered_labels(evidence: str = "evidence") -> Column:
    """Sorted distinct rule labels of everything detected."""
    labels: dict[str, int] = {}
    for i, (kind, _, _) in enumerate(C.ENTITY_PATTERNS):
        text = f"{C.ENTITY_TYPES[kind][0].upper()}: {kind}"
        labels[text] = labels.get(text, 0) | (1 << i)
    for i, p in enumerate(C.INJECTION_PATTERNS):
        labels[f"INJECTION: {p[0]} [{p[1]}]"] = 1 << (INJECTION_BIT + i)
    labels["TOXICITY: harmful_content_detected"] = TOXICITY_MASK
    return _present(evidence, [(mask, text) for text, mask in sorted(labels.items())])


def remediation(evidence: str = "evidence") -> Column:
    steps = [(category_mask(c), C.CATEGORY_REMEDIATION[c]) for c in CATEGORIES]
    steps += [(1 << (INJECTION_BIT + i), p[3]) for i, p in enumerate(C.INJECTION_PATTERNS)]
    return _present(evidence, steps)


def injection_names(evidence: str = "evidence") -> Column:
    """Names of the injection patterns found, in pattern order."""
    return _present(
        evidence, [(1 << (INJECTION_BIT + i), p[0]) for i, p in enumerate(C.INJECTION_PATTERNS)]
    )


def entity_types(evidence: str = "evidence") -> Column:
    """Sorted distinct entity types found."""
    kinds = sorted({t for t, _, _ in C.ENTITY_PATTERNS})
    return _present(evidence, [(entity_bits(lambda t, k=k: t == k), k) for k in kinds])


def data_categories(evidence: str = "evidence") -> Column:
    return _present(evidence, [(category_mask(c), c) for c in CATEGORIES])
