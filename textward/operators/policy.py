"""Policy evaluation: every rule becomes boolean expressions folded into one projection.

Rules are configuration and known when the job is planned, so nothing is joined
or shuffled to evaluate them.  Evaluation has two stages, because texts are wide
and request context usually lives in other tables:

* :func:`text_features` runs next to the scan and reduces a text to its evidence
  mask, its risk and the numbers of the text tests (keywords, patterns) it meets;
* :func:`evaluate` needs only those narrow columns plus the context columns, so a
  join that adds context never moves text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import scoring as S
from ..functions.catalog import DEFAULT_MODEL, DEFAULT_ROLE, ENTITY_TYPES
from ..functions.rulebook import (
    DEFAULT_REMEDIATION, ENTITY_ALIASES, ENTITY_CONFIDENCE, FIELD_CONFIDENCE, KEYWORD_CONFIDENCE, POLICIES,
    SEVERITY_RANK,
)
from ..functions.spans import array_text, guarded_rlike, literal


class Rule(NamedTuple):
    """A rule as a conjunction of tests; empty parts test nothing."""

    policy_id: str
    policy_name: str
    framework: str
    version: str
    schema: int
    order: int
    rule_id: str
    name: str
    action: str
    severity: str
    explanation: str
    remediation: str
    types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    risk_above: float | None = None
    injection: bool = False
    enabled: bool = True
    active: bool = True
    tenant_id: str | None = None
    condition: str = ""


def _listed(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


def _entities(names: Sequence[str]) -> dict:
    types, categories = [], []
    for name in names:
        kind, targets = ENTITY_ALIASES.get(name.lower(), ("types", (name.lower(),)))
        (categories if kind == "category" else types).extend(targets)
    return {"types": tuple(types), "categories": tuple(categories)}


def condition_parts(condition: dict) -> dict:
    """Both condition formats as :class:`Rule` parts.

    Schema 1 is ``{condition_type: value}``; schema 2 is ``{"type": ..., ...}``
    with nested lists.
    """
    if "type" not in condition:
        (kind, value), = condition.items()
        if kind == "entity_detected":
            return {"types": _listed(value)}
        if kind == "data_category":
            return {"categories": _listed(value)}
        if kind == "keyword_match":
            return {"keywords": _listed(value)}
        if kind == "risk_score_above":
            return {"risk_above": float(value)}
        if kind == "injection_detected":
            return {"injection": True}
        if kind in ("user_role", "content_type"):
            return {"allowed": ((kind, _listed(value)),)}
        return {"fields": ((kind, _listed(value)),)}
    if condition["type"] == "combined":
        parts: dict = {}
        for item in condition["all"]:
            (kind, body), = item.items()
            parts.update({k: v for k, v in condition_parts({"type": kind, **body}).items() if v})
        return parts
    parts = _entities(condition.get("entity_types", ()))
    parts["keywords"] = tuple(condition.get("keywords", ())) + tuple(condition.get("context_keywords", ()))
    parts["patterns"] = tuple(condition.get("patterns", ()))
    parts["fields"] = tuple(
        ("model_name" if k == "model" else k, _listed(v)) for k, v in condition.get("fields", {}).items()
    )
    return parts


def condition_label(condition: dict) -> str:
    return condition.get("type") or next(iter(condition))


def shipped_rules(schemas: Sequence[int] = (1, 2)) -> list[Rule]:
    """The rules of the shipped policies; ``schemas=(1,)`` are those the engine format accepts."""
    return [
        Rule(p["id"], p["name"], p["framework"], p["version"], p["schema"], i, r[0], r[1], r[3], r[4], r[5],
             r[6] if len(r) > 6 else DEFAULT_REMEDIATION, **condition_parts(r[2]), condition=condition_label(r[2]))
        for p in POLICIES if p["schema"] in schemas for i, r in enumerate(p["rules"])
    ]


def evaluation_order(rules: Sequence[Rule]) -> list[Rule]:
    """Active rules by severity, ties by policy id and rule position."""
    live = [r for r in rules if r.enabled and r.active]
    return sorted(live, key=lambda r: (-SEVERITY_RANK.get(r.severity, 0), r.policy_id, r.order))


def _text_tests(rules: Sequence[Rule]) -> list[tuple[str, tuple[str, ...]]]:
    tests: list[tuple[str, tuple[str, ...]]] = []
    for r in evaluation_order(rules):
        for kind, values in (("keywords", r.keywords), ("patterns", r.patterns)):
            if values and (kind, values) not in tests:
                tests.append((kind, values))
    return tests


def text_features(
    df: DataFrame, rules: Sequence[Rule], text: str = "text", ignore_case: bool = False
) -> DataFrame:
    """Replace the text by ``evidence``, ``risk_score`` and ``text_tests`` (numbers of tests met)."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    keep = [c for c in df.columns if c != text]
    staged = D.with_evidence(df, text).select(
        *keep, "evidence", F.col(text).alias("_text"), F.lower(text).alias("_lower"))
    checks = []
    for number, (kind, values) in enumerate(_text_tests(rules)):
        if kind == "keywords":
            test = " OR ".join(f"contains(_lower, {literal(v.lower())})" for v in values)
        else:
            test = " OR ".join(guarded_rlike("_text", v, flags) for v in values)
        checks.append(f"CASE WHEN {test} THEN {number} END")
    found = f"array_compact(array({', '.join(checks)}))" if checks else "CAST(array() AS array<int>)"
    return staged.select(
        *keep, "evidence", S.risk_score().alias("risk_score"), D.once(F.expr(found)).alias("text_tests"))


def with_context(df: DataFrame) -> DataFrame:
    """Fill the request context with its defaults; absent columns are added."""
    defaults = {"content_type": "prompt", "user_role": DEFAULT_ROLE, "department": "",
                "model_name": DEFAULT_MODEL, "region": "", "intended_audience": "", "tenant_id": None}
    for name, value in defaults.items():
        present = F.col(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(F.nullif(present, F.lit("")), F.lit(value)) if value is not None else present)
    return df


def _rule_test(rule: Rule, tests: list) -> str:
    parts = []
    mask = D.entity_bits(lambda t: t in rule.types or ENTITY_TYPES[t][0] in rule.categories)
    if rule.types or rule.categories:
        parts.append(D.bit_test(mask) if mask else "false")
    if rule.injection:
        parts.append(D.bit_test(D.INJECTION_MASK))
    if rule.risk_above is not None:
        parts.append(f"risk_score >= {literal(float(rule.risk_above))}")
    for kind, values in (("keywords", rule.keywords), ("patterns", rule.patterns)):
        if values:
            parts.append(f"array_contains(text_tests, {tests.index((kind, values))})")
    for name, values in rule.fields:
        parts.append(f"`{name}` IN ({', '.join(map(literal, values))})")
    for name, values in rule.allowed:
        parts.append(f"`{name}` NOT IN ({', '.join(map(literal, values))})")
    if rule.tenant_id is not None:
        parts.append(f"tenant_id = {literal(rule.tenant_id)}")
    return " AND ".join(f"({p})" for p in parts) or "false"


def _confidence(rule: Rule) -> str:
    values = []
    if rule.types or rule.categories:
        values.append(literal(ENTITY_CONFIDENCE))
    if rule.keywords or rule.patterns:
        values.append(literal(KEYWORD_CONFIDENCE))
    if rule.fields or rule.allowed:
        values.append(literal(FIELD_CONFIDENCE))
    if rule.risk_above is not None:
        values.append("risk_score")
    if rule.injection:
        values.append("_injection_confidence")
    return values[0] if len(values) == 1 else f"least({', '.join(values)})"


def triggered(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Append ``fired``: the triggered rules' positions in evaluation order."""
    ordered, tests = evaluation_order(rules), _text_tests(rules)
    cases = ", ".join(f"CASE WHEN {_rule_test(r, tests)} THEN {k} END" for k, r in enumerate(ordered))
    fired = f"array_compact(array({cases}))" if ordered else "CAST(array() AS array<int>)"
    return df.select("*", F.expr(fired).alias("fired"))


def _positions(ordered: list[Rule], action: str) -> str:
    at = [k for k, r in enumerate(ordered) if r.action == action]
    return array_text(at) if at else "CAST(array() AS array<int>)"


def final_action(ordered: list[Rule], fired: str = "fired") -> str:
    """SQL text of the decision: the most restrictive action among the triggered rules."""
    cases = " ".join(
        f"WHEN arrays_overlap({fired}, {_positions(ordered, a)}) THEN '{a}'"
        for a in ("block", "redact", "escalate", "alert"))
    return f"CASE {cases} ELSE 'allow' END"


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Append the policy evaluation of feature rows (see :func:`text_features`).

    ``redact_required`` and ``alert_required`` reflect only rules before the
    first blocking one, since evaluation stops there.
    """
    ordered = evaluation_order(rules)
    staged = triggered(with_context(df), rules)
    first_block = f"coalesce(array_min(array_intersect(fired, {_positions(ordered, 'block')})), {len(ordered)})"

    def before_block(action: str) -> Column:
        return F.expr(
            f"coalesce(array_min(array_intersect(fired, {_positions(ordered, action)})) < {first_block}, false)")

    at = lambda values: F.expr(f"transform(fired, k -> {array_text(values)}[k])") if values else F.array()
    frameworks = F.array_sort(F.array_distinct(at([r.framework for r in ordered])))
    n = F.size("fired")
    evaluated = sum(1 for r in ordered if r.tenant_id is None)
    total, policies = F.lit(evaluated), F.lit(len(shared := {r.policy_id for r in ordered if r.tenant_id is None}))
    for tenant in sorted({r.tenant_id for r in ordered if r.tenant_id is not None}):
        own = [r for r in ordered if r.tenant_id == tenant]
        total = total + F.when(F.col("tenant_id") == tenant, len(own)).otherwise(0)
        policies = policies + F.when(F.col("tenant_id") == tenant, len({r.policy_id for r in own} - shared)).otherwise(0)
    action = F.expr(final_action(ordered))
    top = lambda values: F.expr(f"{array_text(values)}[fired[0]]")
    summary = F.when(n == 0, F.concat(
        F.lit("Policy evaluation: ALLOW. "), total.cast("string"), F.lit(" rules evaluated, none triggered."))
    ).otherwise(F.concat(
        F.lit("Policy evaluation: "), F.upper(action), F.lit(". "), n.cast("string"),
        F.lit(" rule(s) triggered across "), F.size(frameworks).cast("string"), F.lit(" framework(s). "),
        F.lit("Highest severity: "), top([r.severity for r in ordered]),
        F.lit(" ("), top([r.framework.upper() for r in ordered]), F.lit(" — "),
        top([r.name for r in ordered]), F.lit(").")))
    return staged.select(
        "*",
        action.alias("policy_action"),
        F.expr(f"arrays_overlap(fired, {_positions(ordered, 'block')})").alias("blocked"),
        before_block("redact").alias("redact_required"),
        before_block("alert").alias("alert_required"),
        at([r.rule_id for r in ordered]).alias("triggered_rule_ids"),
        at([r.name for r in ordered]).alias("triggered_rule_names"),
        frameworks.alias("frameworks_triggered"),
        F.array_sort(F.array_distinct(at([r.remediation for r in ordered]))).alias("remediation_steps"),
        total.alias("rules_evaluated"),
        policies.alias("policies_evaluated"),
        summary.alias("policy_explanation"),
    )


def rule_results(df: DataFrame, rules: Sequence[Rule], *keys: str, only_triggered: bool = True) -> DataFrame:
    """One row per (text, rule): explanation, action, severity, confidence.

    With ``only_triggered=False`` rules that did not fire stay, as in a policy test.
    """
    ordered, tests = evaluation_order(rules), _text_tests(rules)
    staged = with_context(df).withColumn("_injection_confidence", S.category_confidence("injection"))
    items = []
    for k, r in enumerate(ordered):
        fired = f"coalesce({_rule_test(r, tests)}, false)"
        message = literal(f"[{r.framework.upper()}] {r.name}: {r.explanation}")
        items.append(
            f"named_struct('rule_no', {k}, 'policy_id', {literal(r.policy_id)}, 'rule_id', {literal(r.rule_id)}, "
            f"'framework', {literal(r.framework)}, 'action', {literal(r.action)}, 'severity', {literal(r.severity)}, "
            f"'triggered', {fired}, 'confidence', CASE WHEN {fired} THEN {_confidence(r)} ELSE 0D END, "
            f"'explanation', CASE WHEN {fired} THEN {message} ELSE {literal(r.explanation)} END, "
            f"'remediation', {literal(r.remediation)})")
    results = F.expr("array(" + ", ".join(items) + ")")
    rows = staged.select(*keys, F.inline_outer(F.filter(results, lambda x: x["triggered"]) if only_triggered else results))
    return rows.where("rule_id IS NOT NULL")


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: how many texts were evaluated and how many triggered it.

    One counter per rule in a single aggregate, so nothing is multiplied by the
    rules; rules that never fired stay, and without texts there are no rows.
    """
    ordered, tests = evaluation_order(rules), _text_tests(rules)
    totals = with_context(df).agg(
        F.count("*").alias("n"), *[F.expr(f"count_if({_rule_test(r, tests)})").alias(f"n{k}") for k, r in enumerate(ordered)])
    rows = ", ".join(
        f"named_struct('policy_id', {literal(r.policy_id)}, 'rule_id', {literal(r.rule_id)}, 'rule_name', {literal(r.name)}, "
        f"'action', {literal(r.action)}, 'severity', {literal(r.severity)}, 'n_evaluated', n, 'n_triggered', n{k})"
        for k, r in enumerate(ordered))
    return totals.where("n > 0").select(F.expr(f"inline(array({rows}))"))


def merge_actions(inspection: Column, policy: Column) -> Column:
    """The stricter of two actions: block, redact, alert, allow."""
    order = ("block", "redact", "alert")
    out = None
    for action in order:
        hit = (inspection == action) | (policy == action)
        out = F.when(hit, F.lit(action)) if out is None else out.when(hit, F.lit(action))
    return out.otherwise(F.lit("allow"))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table: one row per rule."""
    rows = [
        (r.policy_id, r.policy_name, r.framework, r.version, r.schema, r.order, r.rule_id, r.name, r.condition,
         list(r.types + r.categories + r.keywords + r.patterns), r.risk_above, r.action, r.severity,
         r.explanation, r.remediation, r.enabled, r.active, r.tenant_id)
        for r in rules
    ]
    return spark.createDataFrame(rows, (
        "policy_id string, policy_name string, framework string, version string, schema_version int, rule_ord int, "
        "rule_id string, name string, condition_type string, cv_list array<string>, cv_num double, action string, "
        "severity string, explanation string, remediation string, enabled boolean, active boolean, tenant_id string"))


def catalogue(rules: DataFrame) -> DataFrame:
    """Per policy: name, version, framework and rule counts."""
    return rules.groupBy("policy_id", "policy_name", "version", "framework").agg(
        F.count("*").alias("rules_count"), F.count_if("enabled").alias("enabled_rules"),
        F.count_if(F.col("severity") == "critical").alias("critical_rules"))


def catalogue_kpis(rules: DataFrame) -> DataFrame:
    return catalogue(rules).agg(
        F.count("*").alias("policies"), F.sum("rules_count").alias("total_rules"),
        F.sum("enabled_rules").alias("enabled_rules"), F.sum("critical_rules").alias("critical_rules"))
