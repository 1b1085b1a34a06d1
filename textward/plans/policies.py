"""Queries over policy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import keywords as K
from ..operators import policy as P
from ..sources.tables import spread
from . import inputs as N
from . import oracle as O
from .oracle import lit

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


RULES = P.shipped_rules()
ENGINE_RULES = P.shipped_rules((1,))

# ------------------------------------------------------------------ oracle side
CONTEXT = """x AS (
  SELECT d.doc_id, coalesce(CASE WHEN r_name = 'EUROPE' THEN 'EU' ELSE r_name END, '') AS region,
    coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'Sales' WHEN 'HOUSEHOLD' THEN 'Advisory' ELSE c_mktsegment END, '') AS department,
    (['gpt-4o', 'gemini-1.5-pro', 'local-model'])[d.doc_id % 3 + 1] AS model_name,
    CASE WHEN d.doc_id % 2 = 0 THEN 'press' ELSE 'internal' END AS intended_audience
  FROM documents d LEFT JOIN customer ON c_custkey = d.doc_id
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""


def _fires(r: P.Rule) -> str:
    parts = []
    if r.types or r.categories:
        tests = []
        if r.types:
            tests.append(f"list_has_any(types, {list(r.types)})")
        if r.categories:
            tests.append(f"list_has_any(cats, {list(r.categories)})")
        parts.append("(" + " OR ".join(tests) + ")")
    if r.injection:
        parts.append("n_injections > 0")
    if r.risk_above is not None:
        parts.append(f"risk_score >= {r.risk_above}")
    if r.keywords:
        parts.append("(" + " OR ".join(f"contains(lower(text), {lit(k.lower())})" for k in r.keywords) + ")")
    if r.patterns:
        parts.append(O.any_of("text", r.patterns, ""))
    for name, values in r.fields:
        parts.append(f"{name} IN ({', '.join(map(lit, values))})")
    return " AND ".join(parts)


def _confidence(r: P.Rule) -> str:
    if r.risk_above is not None:
        return "risk_score"
    if r.injection:
        return "c_injection"
    values = ([0.9] if r.types or r.categories else []) + ([0.85] if r.keywords or r.patterns else []) + \
        ([1.0] if r.fields else [])
    return f"{min(values)}::DOUBLE"


def _evaluated(rules) -> str:
    ordered = P.evaluation_order(rules)
    rows = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rule_no, {lit(r.policy_id)} AS policy_id, {lit(r.rule_id)} AS rule_id, "
        f"{lit(r.framework)} AS framework, {lit(r.action)} AS action, {lit(r.severity)} AS severity, "
        f"coalesce({_fires(r)}, false) AS triggered, {_confidence(r)} AS conf, {lit(r.name)} AS rule_name, "
        f"{lit(r.explanation)} AS explanation, {lit(r.remediation)} AS remediation FROM f"
        for k, r in enumerate(ordered))
    return f"""{O.INSPECTED}, {CONTEXT},
f AS MATERIALIZED (SELECT s.*, x.* EXCLUDE (doc_id), coalesce(types, []) AS types, coalesce(cats, []) AS cats
  FROM s JOIN x USING (doc_id)
  LEFT JOIN (SELECT doc_id, list(DISTINCT entity_type) AS types, list(DISTINCT category) AS cats FROM e GROUP BY ALL) USING (doc_id)),
rr AS MATERIALIZED ({rows})"""


def _decided(rules) -> str:
    return _evaluated(rules) + """,
pd AS (
  SELECT doc_id, count(*) FILTER (triggered) AS n_triggered,
    bool_or(triggered AND action = 'block') AS blocked, bool_or(triggered AND action = 'redact') AS any_redact,
    bool_or(triggered AND action = 'escalate') AS any_escalate, bool_or(triggered AND action = 'alert') AS any_alert,
    coalesce(min(rule_no) FILTER (triggered AND action = 'block'), 9999) AS first_block,
    coalesce(min(rule_no) FILTER (triggered AND action = 'redact'), 9999) AS first_redact,
    coalesce(min(rule_no) FILTER (triggered AND action = 'alert'), 9999) AS first_alert,
    count(DISTINCT framework) FILTER (triggered) AS n_frameworks, count(*) AS rules_evaluated,
    coalesce(string_agg(rule_id, ',' ORDER BY rule_no) FILTER (triggered), '') AS triggered_rules,
    min_by(severity, rule_no) FILTER (triggered) AS top_severity,
    min_by(upper(framework) || ' — ' || rule_name, rule_no) FILTER (triggered) AS top_rule
  FROM rr GROUP BY doc_id),
pe AS (SELECT *, CASE WHEN blocked THEN 'block' WHEN any_redact THEN 'redact' WHEN any_escalate THEN 'escalate'
    WHEN any_alert THEN 'alert' ELSE 'allow' END AS policy_action FROM pd)"""


_DECISION_COLUMNS = """doc_id, policy_action, blocked, first_redact < first_block AS redact_required,
  first_alert < first_block AS alert_required, triggered_rules, n_frameworks, rules_evaluated,
  CASE WHEN n_triggered = 0 THEN 'Policy evaluation: ALLOW. ' || rules_evaluated || ' rules evaluated, none triggered.'
    ELSE 'Policy evaluation: ' || upper(policy_action) || '. ' || n_triggered || ' rule(s) triggered across ' ||
      n_frameworks || ' framework(s). Highest severity: ' || top_severity || ' (' || top_rule || ').' END AS explanation"""


# ------------------------------------------------------------------ Spark side
def context(spark, sf):
    """Request context per document: region and department of the customer, model, audience."""
    d = N.table(spark, sf, "documents").select("doc_id")
    c = N.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = N.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = N.table(spark, sf, "region").select("r_regionkey", "r_name")
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    joined = d.join(c, d.doc_id == c.c_custkey, "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    segment = F.col("c_mktsegment")
    return joined.select(
        "doc_id",
        F.when(F.col("r_name") == "EUROPE", "EU").otherwise(F.col("r_name")).alias("region"),
        F.when(segment == "BUILDING", "Sales").when(segment == "HOUSEHOLD", "Advisory").otherwise(segment).alias("department"),
        N.by_index(("gpt-4o", "gemini-1.5-pro", "local-model"), F.col("doc_id")).alias("model_name"),
        F.when(F.col("doc_id") % 2 == 0, "press").otherwise("internal").alias("intended_audience"))


def features(spark, sf, rules):
    """Narrow policy features of the documents, with their context."""
    return P.text_features(N.documents(spark, sf), rules).join(context(spark, sf), "doc_id")


def decisions(spark, sf, rules):
    e = P.evaluate(features(spark, sf, rules), rules)
    return e.select(
        "doc_id", "policy_action", "blocked", "redact_required", "alert_required",
        F.array_join("triggered_rule_ids", ",").alias("triggered_rules"),
        F.size("frameworks_triggered").alias("n_frameworks"), "rules_evaluated",
        F.col("policy_explanation").alias("explanation"))


@query(f"WITH {CONTEXT} SELECT * FROM x")
def policy_context(spark, sf):
    return P.with_context(context(spark, sf)).drop("content_type", "user_role", "tenant_id")


@query(_evaluated(RULES) + """
SELECT doc_id, policy_id, rule_id, action, severity, conf AS confidence,
  '[' || upper(framework) || '] ' || rule_name || ': ' || explanation AS explanation
FROM rr WHERE triggered""")
def policy_rule_triggers(spark, sf):
    rows = P.rule_results(features(spark, sf, RULES), RULES, "doc_id")
    return rows.select("doc_id", "policy_id", "rule_id", "action", "severity", "confidence", "explanation")


@query(_decided(ENGINE_RULES) + f" SELECT {_DECISION_COLUMNS} FROM pe")
def policy_decisions(spark, sf):
    return decisions(spark, sf, ENGINE_RULES)


@query(_decided(RULES) + f" SELECT {_DECISION_COLUMNS} FROM pe")
def policy_decisions_all_rules(spark, sf):
    return decisions(spark, sf, RULES)


@query(_decided(ENGINE_RULES) + """, rem AS (
  SELECT doc_id, string_agg(remediation, ' ; ' ORDER BY encode(remediation)) AS steps,
    string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks
  FROM (SELECT DISTINCT doc_id, remediation, framework FROM rr WHERE triggered) GROUP BY doc_id)
SELECT doc_id, coalesce(steps, '') AS remediation_steps, coalesce(frameworks, '') AS frameworks
FROM pe LEFT JOIN rem USING (doc_id)""")
def policy_remediation(spark, sf):
    e = P.evaluate(features(spark, sf, ENGINE_RULES), ENGINE_RULES)
    return e.select("doc_id", F.array_join("remediation_steps", " ; ").alias("remediation_steps"),
                    F.array_join("frameworks_triggered", ",").alias("frameworks"))


@query(_decided(ENGINE_RULES) + """
SELECT s.action AS inspection_action, policy_action,
  CASE WHEN 'block' IN (s.action, policy_action) THEN 'block' WHEN 'redact' IN (s.action, policy_action) THEN 'redact'
       WHEN 'alert' IN (s.action, policy_action) THEN 'alert' ELSE 'allow' END AS final_action,
  count(*) AS n_docs
FROM pe JOIN s USING (doc_id) GROUP BY ALL""")
def final_actions(spark, sf):
    e = P.evaluate(features(spark, sf, ENGINE_RULES), ENGINE_RULES).select(
        S.action().alias("inspection_action"), "policy_action")
    merged = e.withColumn("final_action", P.merge_actions(F.col("inspection_action"), F.col("policy_action")))
    return merged.groupBy("inspection_action", "policy_action", "final_action").agg(F.count("*").alias("n_docs"))


_FINRA = [r for r in RULES if r.policy_id == "finra_v1"]


@query(_evaluated(_FINRA) + """
SELECT rule_id, rule_name, action, severity, triggered, count(*) AS n_docs FROM (
  SELECT rule_id, rule_name, action, severity, triggered FROM rr) GROUP BY ALL""")
def policy_test(spark, sf):
    counts = P.rule_counts(features(spark, sf, _FINRA), _FINRA)
    missed = F.col("n_evaluated") - F.col("n_triggered")
    both = F.array(F.struct(F.lit(True).alias("triggered"), F.col("n_triggered").alias("n_docs")),
                   F.struct(F.lit(False).alias("triggered"), missed.alias("n_docs")))
    return counts.select("rule_id", "rule_name", "action", "severity", F.inline(both)).where("n_docs > 0")


@query(_decided(_FINRA) + f"""
SELECT doc_id, policy_action, rules_evaluated, {len({r.policy_id for r in _FINRA})} AS policies_evaluated, triggered_rules FROM pe""")
def policy_test_actions(spark, sf):
    """The overall action of a policy test for every text, with what was evaluated."""
    e = P.evaluate(features(spark, sf, _FINRA), _FINRA)
    return e.select("doc_id", "policy_action", "rules_evaluated", "policies_evaluated",
                    F.array_join("triggered_rule_ids", ",").alias("triggered_rules"))


@query(_evaluated(RULES) + """
SELECT policy_id, rule_id, action, count(*) FILTER (triggered) AS n_triggered,
  round(count(*) FILTER (triggered) / count(*), 6) AS share FROM rr GROUP BY ALL""")
def rule_coverage(spark, sf):
    """How often each rule fired; rules that never fired stay."""
    return P.rule_counts(features(spark, sf, RULES), RULES).select(
        "policy_id", "rule_id", "action", "n_triggered",
        F.round(F.col("n_triggered") / F.col("n_evaluated"), 6).alias("share"))


@query(_evaluated(RULES) + """
SELECT framework, count(*) AS evaluated, count(*) FILTER (hit) AS failed, count(*) FILTER (NOT hit) AS passed,
  round(100.0 * count(*) FILTER (NOT hit) / count(*), 4)::DOUBLE AS coverage_percent
FROM (SELECT doc_id, framework, bool_or(triggered) AS hit FROM rr GROUP BY ALL) GROUP BY ALL""")
def framework_compliance(spark, sf):
    """Pass and fail counts per framework, from one counter per framework and row."""
    fired = P.evaluate(features(spark, sf, RULES), RULES).select("frameworks_triggered")
    names = sorted({r.framework for r in RULES})
    flags = F.array(*[
        F.struct(F.lit(n).alias("framework"), F.array_contains("frameworks_triggered", n).alias("hit")) for n in names])
    rows = fired.select(F.inline_outer(flags))
    return rows.groupBy("framework").agg(
        F.count("*").alias("evaluated"), F.count_if("hit").alias("failed"), F.count_if(~F.col("hit")).alias("passed"),
        F.round(100.0 * F.count_if(~F.col("hit")) / F.count("*"), 4).alias("coverage_percent"))


@query("""WITH k AS (
  SELECT 'k' || item_id || '-' || n AS rule_id, CASE WHEN item_id % 7 > 0 THEN 't' || item_id % 7 END AS tenant_id, keyword,
    (['block', 'redact', 'alert'])[item_id % 3 + 1] AS action
  FROM (SELECT item_id, unnest(string_split(text, ' ')) AS keyword, unnest(range(len(string_split(text, ' ')))) AS n FROM benchmark)
  WHERE len(keyword) > 0),
h AS (SELECT DISTINCT doc_id, rule_id, action FROM documents d JOIN k
  ON (tenant_id IS NULL OR tenant_id = 't' || doc_id % 7) AND contains(lower(text), lower(keyword)))
SELECT d.doc_id, count(rule_id) AS fired, coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') AS rules,
  CASE WHEN bool_or(action = 'block') THEN 'block' WHEN bool_or(action = 'redact') THEN 'redact'
    WHEN bool_or(action = 'alert') THEN 'alert' ELSE 'allow' END AS keyword_action
FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def tenant_keyword_rules(spark, sf):
    """Every word of a benchmark item as a keyword rule of the item's tenant, over all documents."""
    words = N.table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("n", "keyword"))
    item = F.col("item_id")
    rules = words.select(
        F.concat(F.lit("k"), item.cast("string"), F.lit("-"), F.col("n").cast("string")).alias("rule_id"),
        F.when(item % 7 > 0, F.concat(F.lit("t"), (item % 7).cast("string"))).alias("tenant_id"), "keyword",
        N.by_index(("block", "redact", "alert"), item).alias("action"))
    docs = spread(N.table(spark, sf, "documents").select("doc_id", "text")) \
        .withColumn("tenant_id", F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")))
    return K.keyword_rules(docs, rules).select(
        "doc_id", F.size("fired").cast("bigint").alias("fired"), F.array_join("fired.rule_id", ",").alias("rules"),
        "keyword_action")
