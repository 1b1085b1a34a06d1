"""Queries over documents and pages: detection, scoring, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import detect as D
from ..functions import scoring as S
from ..functions.masking import content_hash
from ..operators import inspect as I
from ..operators import redact as R
from ..operators import threats as T
from . import inputs as N
from . import oracle as O
from .oracle import lit

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


# ------------------------------------------------------------------ entities
@query(O.INSPECTED + f"""
SELECT doc_id, det AS det_idx, entity_type, category, {O.MASK} AS value_masked, "start" AS start_pos,
  "end" AS end_pos, confidence, {O.EXPLANATION} AS explanation FROM e""")
def entity_spans(spark, sf):
    rows = I.entity_rows(N.documents(spark, sf), "doc_id")
    return rows.select("doc_id", "det_idx", "entity_type", "category", "value_masked",
                       F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
                       "confidence", "explanation")


@query(O.INSPECTED + """
SELECT source, entity_type, category, count(*) AS n_entities, count(DISTINCT doc_id) AS n_docs
FROM e JOIN d USING (doc_id) GROUP BY ALL""")
def entities_by_source(spark, sf):
    rows = I.entity_rows(N.documents(spark, sf), "doc_id", "source")
    per_doc = rows.groupBy("source", "entity_type", "category", "doc_id").count()
    return per_doc.groupBy("source", "entity_type", "category").agg(
        F.sum("count").alias("n_entities"), F.count("*").alias("n_docs"))


@query(f"""WITH {O.DOCUMENTS} SELECT doc_id, sha256(text) AS content_hash,
  left(sha256(text), 16) AS short_hash FROM d""")
def content_hashes(spark, sf):
    t = F.col("text")
    return N.documents(spark, sf).select(
        "doc_id", content_hash(t).alias("content_hash"), content_hash(t, 16).alias("short_hash"))


# ------------------------------------------------------------------ threats
@query(O.INSPECTED + """
SELECT doc_id, attack_type, severity, confidence, match_count,
  'Pattern: ' || attack_type || ' (' || match_count || ' match(es))' AS pattern_matched FROM j""")
def injection_attempts(spark, sf):
    return I.injection_rows(N.documents(spark, sf), "doc_id").select(
        "doc_id", "attack_type", "severity", "confidence", "match_count", "pattern_matched")


@query(O.INSPECTED + "SELECT doc_id, toxic, CASE WHEN toxic THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM s")
def toxicity_flags(spark, sf):
    return D.with_evidence(N.documents(spark, sf)).select(
        "doc_id", S.detected("toxicity").alias("toxic"),
        S.category_confidence("toxicity").alias("confidence"))


@query(f"""WITH {O.DOCUMENTS}
SELECT coalesce(rule, 'none') AS rule, count(*) AS n_docs
FROM (SELECT {O.first_of('text', C.HARD_BLOCKS, '(?is)')} AS rule FROM d) GROUP BY ALL""")
def hard_blocks(spark, sf):
    d = N.documents(spark, sf).select(T.hard_block(F.col("text")).alias("rule"))
    return d.groupBy(F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n_docs"))


def _named(source, key, text, table):
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, {lit(n)} AS name, unnest(regexp_extract_all({text}, {O.re2(p)})) AS value FROM {source}"
        for i, (n, p) in enumerate(table))


@query(f"""WITH {O.PAGES}, u AS ({_named('p', 'page_id', 'html', C.UNSAFE_URLS)})
SELECT page_id, name, count(*) AS n, min(value) AS first_value FROM u GROUP BY ALL""")
def unsafe_urls(spark, sf):
    found = N.pages(spark, sf).select("page_id", T.unsafe_urls(F.col("html")).alias("u"))
    return found.select("page_id", F.inline_outer("u")).where("name IS NOT NULL").groupBy("page_id", "name").agg(
        F.count("*").alias("n"), F.min("value").alias("first_value"))


_CODE = f"""code AS (SELECT doc_id, array_to_string(regexp_extract_all(text, {O.re2(C.CODE_FENCE, '(?s)')}, 1), chr(10)) AS code
  FROM d)"""


@query(f"""WITH {O.DOCUMENTS}, {_CODE}, u AS ({_named('code', 'doc_id', 'code', C.DANGEROUS_CODE)})
SELECT doc_id, name, value FROM u""")
def dangerous_code(spark, sf):
    found = N.documents(spark, sf).select("doc_id", T.dangerous_code(F.col("text")).alias("u"))
    return found.select("doc_id", F.inline_outer("u")).where("name IS NOT NULL")


def _poison(source, key, text):
    return " UNION ALL ".join(
        O.spans_of(source, key, text, O.re2(p, "(?is)"),
                   f"{i} AS ord, {lit(n)} AS threat_type, {lit(s)} AS severity")
        for i, (n, s, p) in enumerate(C.POISONING_PATTERNS))


_THREATS = """t AS (
  SELECT {key}, ord, threat_type, severity, count(*) AS n, left(min_by(value, "start"), 100) AS snippet,
    array_to_string(list(("start" || '-' || "end") ORDER BY "start")[1:3], ',') AS positions
  FROM ps GROUP BY ALL)"""
_POISON_RISK = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE"


@query(f"""WITH {O.PAGES}, ps AS ({_poison('p', 'page_id', 'html')}), {_THREATS.format(key='page_id')}
SELECT page_id, threat_type, severity, n, snippet, positions FROM t""")
def poisoning_threats(spark, sf):
    scanned = T.poisoning_scan(N.pages(spark, sf), "page_id", text="html")
    rows = scanned.select("page_id", F.inline_outer("threats")).where("threat_type IS NOT NULL")
    spots = F.array_join(F.transform("positions", lambda x: F.concat_ws(
        "-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("page_id", "threat_type", "severity", F.col("count").alias("n"),
                       F.col("payload_snippet").alias("snippet"), spots.alias("positions"))


@query(f"""WITH {O.DOCUMENTS}, ps AS ({_poison('d', 'doc_id', 'text')}), {_THREATS.format(key='doc_id')},
g AS (SELECT doc_id, count(*) AS k, max({_POISON_RISK}) AS risk,
        array_to_string(list(threat_type ORDER BY ord)[1:3], ', ') AS names FROM t GROUP BY ALL)
SELECT d.doc_id, k IS NOT NULL AS is_poisoned, coalesce(risk, 0)::DOUBLE AS risk_score,
  CASE WHEN k IS NULL THEN 'Document passed poisoning scan'
       ELSE 'Document contains ' || k || ' threat(s): ' || names END AS explanation,
  CASE WHEN k IS NULL THEN 'allow' ELSE 'quarantine' END AS action
FROM d LEFT JOIN g USING (doc_id)""")
def poisoning_verdicts(spark, sf):
    return T.poisoning_scan(N.documents(spark, sf), "doc_id").drop("threats")


# ------------------------------------------------------------------ inspection
def _pick(pairs, sep):
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(t)} END' for c, t in pairs)}], lambda x: x IS NOT NULL), {lit(sep)})"


_LABELS = sorted({f"{C.ENTITY_TYPES[t][0].upper()}: {t}" for t, _, _ in C.ENTITY_PATTERNS})
_INSPECT_SQL = f"""{O.INSPECTED},
labels AS (
  SELECT doc_id, string_agg(label, ' ; ' ORDER BY encode(label)) AS labels FROM (
    SELECT DISTINCT doc_id, upper(category) || ': ' || entity_type AS label FROM e
    UNION SELECT doc_id, 'INJECTION: ' || attack_type || ' [' || severity || ']' FROM j
    UNION SELECT doc_id, 'TOXICITY: harmful_content_detected' FROM s WHERE toxic) GROUP BY doc_id),
rem AS (
  SELECT doc_id, string_agg(CASE attack_type {' '.join(f"WHEN {lit(p[0])} THEN {lit(p[3])}" for p in C.INJECTION_PATTERNS)} END,
    ' ; ' ORDER BY ord) AS steps FROM j GROUP BY doc_id)
SELECT s.doc_id, sha256(text) AS content_hash, risk_score, action, block_reason,
  n_pii > 0 AS pii, n_phi > 0 AS phi, n_pci > 0 AS pci, n_secret > 0 AS secrets, n_injections > 0 AS injection, toxic,
  c_pii, c_phi, c_pci, c_secret, c_injection, n_entities, n_injections,
  coalesce(labels, '') AS triggered_rules,
  concat_ws(' ; ', CASE WHEN n_pii > 0 THEN {lit(C.CATEGORY_REMEDIATION['pii'])} END,
    CASE WHEN n_phi > 0 THEN {lit(C.CATEGORY_REMEDIATION['phi'])} END,
    CASE WHEN n_pci > 0 THEN {lit(C.CATEGORY_REMEDIATION['pci'])} END,
    CASE WHEN n_secret > 0 THEN {lit(C.CATEGORY_REMEDIATION['secret'])} END, steps) AS remediation,
  'Scan completed. Action: ' || upper(action) || '. ' ||
  CASE WHEN n_entities + n_injections = 0 AND NOT toxic THEN 'No threats detected. ' ELSE 'Detected: ' ||
    concat_ws(', ', CASE WHEN n_pii > 0 THEN 'PII (' || n_pii || ' entity/ies)' END,
      CASE WHEN n_phi > 0 THEN 'PHI (' || n_phi || ' entity/ies)' END,
      CASE WHEN n_pci > 0 THEN 'PCI data (' || n_pci || ' entity/ies)' END,
      CASE WHEN n_secret > 0 THEN 'SECRETS/CREDENTIALS' END,
      CASE WHEN n_injections > 0 THEN 'INJECTION ATTEMPT (' || n_injections || ' pattern(s))' END,
      CASE WHEN toxic THEN 'TOXIC/HARMFUL CONTENT' END) || '. ' END ||
  'Overall risk score: ' || printf('%.2f', risk_score * 100) || '%.' AS summary
FROM s LEFT JOIN labels USING (doc_id) LEFT JOIN rem USING (doc_id)"""


@query(_INSPECT_SQL)
def inspection_results(spark, sf):
    r = I.inspect(N.documents(spark, sf))
    conf = F.col("confidence_scores")
    return r.select(
        "doc_id", "content_hash", F.col("overall_risk_score").alias("risk_score"), "action", "block_reason",
        F.col("pii_detected").alias("pii"), F.col("phi_detected").alias("phi"), F.col("pci_detected").alias("pci"),
        F.col("secret_detected").alias("secrets"), F.col("injection_detected").alias("injection"),
        F.col("toxicity_detected").alias("toxic"),
        *[conf[k].alias(f"c_{n}") for k, n in (("pii", "pii"), ("phi", "phi"), ("pci", "pci"),
                                               ("secrets", "secret"), ("injection", "injection"))],
        F.size("entities").alias("n_entities"), F.size("injections").alias("n_injections"),
        F.array_join("triggered_rules", " ; ").alias("triggered_rules"),
        F.array_join("remediation_recommendations", " ; ").alias("remediation"),
        F.col("explanation_summary").alias("summary"))


@query(O.INSPECTED + """
SELECT s.source, action, count(*) AS n_docs, max(risk_score) AS max_risk,
  sum(round(risk_score * 10000)::BIGINT)::DOUBLE / count(*) / 10000 AS avg_risk
FROM (SELECT s.*, d.source FROM s JOIN d USING (doc_id)) s GROUP BY ALL""")
def actions_by_source(spark, sf):
    v = I.verdicts(N.documents(spark, sf))
    return v.groupBy("source", "action").agg(
        F.count("*").alias("n_docs"), F.max("risk_score").alias("max_risk"),
        (F.sum(F.round(F.col("risk_score") * 10000).cast("bigint")) / F.count("*") / 10000).alias("avg_risk"))


@query(O.INSPECTED + """
SELECT toxic_label, quality, action, count(*) AS n_docs, count(*) FILTER (toxic) AS n_flagged
FROM (SELECT s.action, s.toxic, l.toxic::BIGINT AS toxic_label, l.quality::BIGINT AS quality FROM s JOIN labels l USING (doc_id)) GROUP BY ALL""")
def detector_evaluation(spark, sf):
    labels = N.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("toxic_label"), "quality")
    v = I.verdicts(N.documents(spark, sf)).select("doc_id", "action", "toxicity_detected")
    return v.join(labels, "doc_id").groupBy("toxic_label", "quality", "action").agg(
        F.count("*").alias("n_docs"), F.count_if("toxicity_detected").alias("n_flagged"))


# ------------------------------------------------------------------ profiles
_FILE_HITS = " UNION ALL ".join(
    O.spans_of("d", "doc_id", "text", O.re2(p), f"{i} AS ord, {lit(label)} AS label, {lit(sev)} AS severity")
    for i, (label, _, sev, p) in enumerate(C.FILE_PROFILE))
_FILE_SQL = f"""WITH RECURSIVE {O.DOCUMENTS}, fh AS MATERIALIZED ({_FILE_HITS}),
fs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, "start") AS step FROM fh),
ff AS (SELECT doc_id, 0::BIGINT AS step, text AS out FROM d UNION ALL
  SELECT ff.doc_id, fs.step, replace(ff.out, fs.value, '[' || upper(replace(fs.label, ' ', '_')) || ']')
  FROM ff JOIN fs ON ff.doc_id = fs.doc_id AND fs.step = ff.step + 1),
fr AS (SELECT doc_id, max_by(out, step) AS redacted FROM ff GROUP BY ALL),
fa AS (SELECT doc_id, count(*) AS n, max(CASE severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.75
   WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE) AS risk FROM fh GROUP BY ALL),
fx AS (SELECT d.doc_id, coalesce(n, 0) AS n_entities, redacted,
   {' + '.join(f"regexp_matches(text, {O.re2(p)})::BIGINT" for _, p in C.FILE_PROFILE_INJECTIONS)} AS n_injections,
   coalesce(risk, 0)::DOUBLE AS erisk FROM d LEFT JOIN fa USING (doc_id) LEFT JOIN fr USING (doc_id)),
fy AS (SELECT *, greatest(erisk, CASE WHEN n_injections > 0 THEN 0.95 ELSE 0 END::DOUBLE) AS risk_score FROM fx)
"""


@query(_FILE_SQL + """SELECT doc_id, n_entities, n_injections, risk_score, sha256(redacted) AS redacted_hash,
  CASE WHEN risk_score > 0.7 THEN 'Block and review' WHEN risk_score > 0.3 THEN 'Review recommended'
       ELSE 'Safe to proceed' END AS recommendation,
  CASE WHEN risk_score > 0.7 THEN 'CRITICAL' WHEN risk_score > 0.5 THEN 'HIGH' WHEN risk_score > 0.3 THEN 'MEDIUM'
       ELSE 'CLEAN' END AS severity_label FROM fy""")
def file_scan_profile(spark, sf):
    return T.file_profile(N.documents(spark, sf), "doc_id").select(
        "doc_id", F.size("entities").alias("n_entities"), F.size("injections").alias("n_injections"),
        "risk_score", content_hash(F.col("redacted")).alias("redacted_hash"), "recommendation", "severity_label")


@query(_FILE_SQL + """SELECT count(*) AS files, sum(n_entities)::BIGINT AS entities, sum(n_injections)::BIGINT AS injections,
  count(*) FILTER (risk_score > 0.7) AS high_risk_files FROM fy""")
def file_scan_kpis(spark, sf):
    return T.file_profile(N.documents(spark, sf), "doc_id").agg(
        F.count("*").alias("files"), F.sum(F.size("entities")).alias("entities"),
        F.sum(F.size("injections")).alias("injections"),
        F.count_if(F.col("risk_score") > 0.7).alias("high_risk_files"))


def _quick_sql():
    out = "text"
    for label, _, p in C.QUICK_PROFILE:
        out = f"regexp_replace({out}, {O.re2(p)}, {lit('[' + label.upper().replace(' ', '_') + ']')}, 'g')"
    labels = _pick([(f"regexp_matches(text, {O.re2(p)})", n) for n, _, p in C.QUICK_PROFILE], ",")
    risks = ", ".join(
        f"CASE WHEN regexp_matches(text, {O.re2(p)}) THEN {C.PROFILE_RISK[s]} ELSE 0 END::DOUBLE"
        for _, s, p in C.QUICK_PROFILE)
    inj = " + ".join(f"regexp_matches(text, {O.re2(p)})::BIGINT" for p in C.QUICK_INJECTIONS)
    return f"""WITH {O.DOCUMENTS}, q AS (SELECT doc_id, {labels} AS labels, {inj} AS injections,
      greatest({risks}) AS erisk, {out} AS redacted FROM d),
    q2 AS (SELECT *, greatest(erisk, CASE WHEN injections > 0 THEN 0.97 ELSE 0 END::DOUBLE) AS risk_score FROM q)
    SELECT doc_id, labels, injections, risk_score, risk_score > 0.7 OR injections > 0 AS blocked,
      sha256(redacted) AS redacted_hash FROM q2"""


@query(_quick_sql())
def gateway_quick_scan(spark, sf):
    q = T.quick_scan(N.documents(spark, sf), "doc_id")
    return q.select("doc_id", F.array_join("labels", ",").alias("labels"), "injections", "risk_score", "blocked",
                    content_hash(F.col("redacted")).alias("redacted_hash"))


_HEAD_CUT = """v AS (SELECT doc_id, det, label, entity_type, category, confidence, "start", "end", value FROM e WHERE "start" < 2000),
hd AS (SELECT doc_id, left(text, 2000) AS text FROM d)"""


@query("WITH RECURSIVE" + O.INSPECTED[4:] + f""", {_HEAD_CUT}, {O.redaction(source='v', texts='hd')}
SELECT s.doc_id, action, risk_score,
  'File scan complete. Risk: ' || printf('%.1f', risk_score * 100) || '%. ' ||
  CASE WHEN n_entities + n_injections = 0 THEN 'No threats detected.' ELSE 'Detected: ' ||
    concat_ws(', ', CASE WHEN n_pii > 0 THEN 'PII' END, CASE WHEN n_phi > 0 THEN 'PHI' END,
      CASE WHEN n_pci > 0 THEN 'PCI data' END, CASE WHEN n_secret > 0 THEN 'credentials/secrets' END,
      CASE WHEN n_injections > 0 THEN 'injection attempts' END) || '.' END AS summary,
  CASE WHEN n_entities > 0 THEN sha256(r.redacted_text) END AS preview_hash
FROM s LEFT JOIN r USING (doc_id)""")
def file_scan_summaries(spark, sf):
    parts = F.concat_ws(", ", *[
        F.when(S.detected(k), F.lit(text)) for k, text in (
            ("pii", "PII"), ("phi", "PHI"), ("pci", "PCI data"), ("secret", "credentials/secrets"),
            ("injection", "injection attempts"))])
    return R.preview(N.documents(spark, sf)).select(
        "doc_id", S.action().alias("action"), S.risk_score().alias("risk_score"),
        F.concat(F.lit("File scan complete. Risk: "), S.risk_text(".1%"), F.lit(". "),
                 F.when(parts == "", F.lit("No threats detected."))
                 .otherwise(F.concat(F.lit("Detected: "), parts, F.lit(".")))).alias("summary"),
        content_hash(F.col("redacted_preview")).alias("preview_hash"))


# ------------------------------------------------------------------ redaction
_REDACT = "WITH RECURSIVE" + O.INSPECTED[4:]


@query(_REDACT + f", {O.redaction()} SELECT doc_id, sha256(redacted_text) AS redacted_hash, "
       "length(redacted_text) AS redacted_chars, redaction_count FROM r")
def redact_mask(spark, sf):
    r = R.redact(N.documents(spark, sf), mode="mask", overlaps="splice")
    return r.select("doc_id", content_hash(F.col("redacted_text")).alias("redacted_hash"),
                    F.length("redacted_text").alias("redacted_chars"), "redaction_count")


_HASH_TOKEN = "'[' || label || ':HASH:' || left(sha256(value), 12) || ']'"


@query(_REDACT + f", {O.redaction(token=_HASH_TOKEN)} SELECT doc_id, sha256(redacted_text) AS redacted_hash, "
       "redaction_count FROM r")
def redact_hash(spark, sf):
    r = R.redact(N.documents(spark, sf), mode="hash", overlaps="splice")
    return r.select("doc_id", content_hash(F.col("redacted_text")).alias("redacted_hash"), "redaction_count")


MERGED = f"""islands AS (
  SELECT *, sum(CASE WHEN "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end", det) AS island
  FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", det
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM e)),
mu AS (SELECT doc_id, min("start") AS "start", max("end") AS "end",
    arg_max(det, confidence * 1e9 + ("end" - "start") * 1e2 - det) AS det
  FROM islands GROUP BY doc_id, island),
m AS MATERIALIZED (SELECT mu.*, {O.LABEL} AS label, {O.TYPE} AS entity_type, {O.CATEGORY} AS category,
    substr(d.text, mu."start" + 1, mu."end" - mu."start") AS value FROM mu JOIN d USING (doc_id))"""


@query(_REDACT + f", {MERGED}, {O.redaction(source='m')} SELECT doc_id, sha256(redacted_text) AS redacted_hash, "
       "redaction_count FROM r")
def redact_merged(spark, sf):
    r = R.redact(N.documents(spark, sf), mode="mask", overlaps="merge")
    return r.select("doc_id", content_hash(F.col("redacted_text")).alias("redacted_hash"), "redaction_count")


@query(_REDACT + f""", {O.redaction()}
SELECT doc_id, token, entity_type, "start" AS original_start, "end" AS original_end, sha256(value) AS original_hash,
  false AS reversible FROM rt""")
def redaction_records(spark, sf):
    return R.redaction_records(N.documents(spark, sf), "doc_id", overlaps="splice").drop("category")


@query(_REDACT + f""", {O.redaction()}
SELECT category, entity_type, count(*) AS redactions, count(DISTINCT doc_id) AS documents
FROM rt GROUP BY ROLLUP (category, entity_type)""")
def redaction_report(spark, sf):
    records = R.redaction_records(N.documents(spark, sf), "doc_id", overlaps="splice")
    per_doc = records.groupBy("category", "entity_type", "doc_id").count()
    return per_doc.rollup("category", "entity_type").agg(
        F.sum("count").alias("redactions"), F.countDistinct("doc_id").alias("documents"))


@query(_REDACT + f""", {O.redaction()}, ty AS (
  SELECT doc_id, string_agg(entity_type, ',' ORDER BY step) AS applied FROM rt GROUP BY ALL)
SELECT doc_id, sha256(redacted_text) AS redacted_hash, coalesce(applied, '') AS applied FROM r LEFT JOIN ty USING (doc_id)""")
def industry_redaction(spark, sf):
    r = R.redact_for_industry(N.documents(spark, sf), industry="healthcare")
    return r.select("doc_id", content_hash(F.col("redacted_text")).alias("redacted_hash"),
                    F.array_join("entity_types", ",").alias("applied"))


@query(_REDACT + f""", {MERGED}, {O.redaction(source='m')}
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(redacted_text,
  {O.re2(C.TOKEN_PATTERN, '')}, 1)) AS token FROM r) GROUP BY ALL""")
def token_highlights(spark, sf):
    r = R.redact(N.documents(spark, sf), overlaps="merge")
    tokens = r.select(F.explode_outer(R.highlighted_tokens(F.col("redacted_text"))).alias("token"))
    return tokens.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ vault
VAULT_KEY = "0123456789abcdef"  # test key; deployments pass their own column
AS_OF = "2024-06-01 00:00:00"


def _sessions(df):
    return df.select(
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"),
        F.col("source").alias("session_id"), "doc_id", "text")


def _vault(df):
    return R.tokenize(df, F.lit(VAULT_KEY), F.to_timestamp(F.lit(AS_OF)))


@query(_REDACT + f""", {MERGED}, {O.redaction(source='m')}
SELECT 't' || (doc_id % 3) AS tenant_id, d.source AS session_id, doc_id, token, rt.entity_type,
  sha256(rt.value) AS value_hash, '2024-06-02 00:00:00' AS expires_at FROM rt JOIN d USING (doc_id)""")
def vault_entries(spark, sf):
    v = _vault(_sessions(N.documents(spark, sf)))
    value = F.decode(F.aes_decrypt("encrypted_value", F.lit(VAULT_KEY), F.lit("GCM")), "UTF-8")
    return v.select("tenant_id", "session_id", "doc_id", "token", "entity_type",
                    content_hash(value).alias("value_hash"),
                    F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query(f"WITH {O.DOCUMENTS} SELECT doc_id, sha256(text) AS restored_hash FROM d")
def vault_restore(spark, sf):
    docs = _sessions(N.documents(spark, sf))
    redacted, vault = R.redact_to_vault(docs, F.lit(VAULT_KEY), F.to_timestamp(F.lit(AS_OF)))
    restored = R.restore(redacted, vault, F.lit(VAULT_KEY), F.to_timestamp(F.lit("2024-06-01 12:00:00")))
    return restored.select("doc_id", content_hash(F.col("restored_text")).alias("restored_hash"))


@query(_REDACT + f""", {MERGED}, {O.redaction(source='m')}
SELECT doc_id, doc_id % 48 > 6 AND doc_id % 48 <= 30 AS valid,
  sha256(CASE WHEN doc_id % 48 > 6 AND doc_id % 48 <= 30 THEN d.text ELSE redacted_text END) AS restored_hash FROM d JOIN r USING (doc_id)""")
def vault_restore_then(spark, sf):
    """Texts tokenised over two days, all asked for after 30 hours: entries of later and of expired hours do not count."""
    docs = _sessions(N.documents(spark, sf))
    hour = (F.col("doc_id") % 48).cast("int")
    created = F.to_timestamp(F.lit(AS_OF)) + F.make_dt_interval(hours=hour)
    redacted, vault = R.redact_to_vault(docs, F.lit(VAULT_KEY), created)
    asked = redacted.withColumn("asked_at", F.to_timestamp(F.lit("2024-06-02 06:00:00")))
    return R.restore_then(asked, vault, F.lit(VAULT_KEY)).select(
        "doc_id", ((hour > 6) & (hour <= 30)).alias("valid"), content_hash(F.col("restored_text")).alias("restored_hash"))


@query(_REDACT + f""", {MERGED},
vv AS (SELECT 't' || (doc_id % 3) AS tenant_id, d.source AS session_id, doc_id FROM m JOIN d USING (doc_id)),
gone AS (SELECT DISTINCT 't' || (doc_id % 3) AS tenant_id, source AS session_id FROM documents WHERE doc_id % 5 = 0)
SELECT tenant_id, count(*) AS entries, count(*) FILTER ((tenant_id, session_id) IN (SELECT (tenant_id, session_id) FROM gone))
  AS invalidated FROM vv GROUP BY ALL""")
def vault_invalidation(spark, sf):
    v = _vault(_sessions(N.documents(spark, sf))).select("tenant_id", "session_id", "doc_id", "token")
    raw = N.table(spark, sf, "documents").where("doc_id % 5 = 0").select(
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"),
        F.col("source").alias("session_id")).distinct()
    kept = R.invalidate_sessions(v, raw).groupBy("tenant_id").agg(F.count("*").alias("kept"))
    total = v.groupBy("tenant_id").agg(F.count("*").alias("entries"))
    return total.join(kept, "tenant_id", "left").select(
        "tenant_id", "entries", (F.col("entries") - F.coalesce("kept", F.lit(0))).alias("invalidated"))


@query(_REDACT + f""", {MERGED} SELECT 't' || (doc_id % 3) AS tenant_id, count(*) AS entries FROM m GROUP BY ALL""")
def vault_gauge(spark, sf):
    v = _vault(_sessions(N.documents(spark, sf)))
    live = v.where(F.col("expires_at") > F.to_timestamp(F.lit("2024-06-01 12:00:00")))
    return live.groupBy("tenant_id").agg(F.count("*").alias("entries"))
