"""DuckDB SQL building blocks: the same inputs and detectors, recomputed from the tables."""

from __future__ import annotations

import re

from ..functions import catalog as C
from . import seeds as X

lit = X.literal


def re2(regex: str, flags: str = "(?i)") -> str:
    """A catalogue pattern as an SQL literal for RE2."""
    return lit(flags + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", regex))


# ------------------------------------------------------------------ inputs
DOCUMENTS = f"""d AS (
  SELECT doc_id, source, lang,
         text || {X.chosen_sql(X.DOCUMENT_SEEDS, 'doc_id', X.N_DOCUMENT_SEEDS)} AS text
  FROM documents)"""

TURNS = f"""c AS (
  SELECT 't' || (conv_id % 3) AS tenant_id, conv_id AS session_id, turn, role,
         text || {X.chosen_sql(X.TURN_SEEDS, '(conv_id * 7 + turn)', X.N_TURN_SEEDS)} AS content
  FROM conversations)"""

PAGES = f"""p AS (
  SELECT page_id, html || {X.chosen_sql(X.DOCUMENT_SEEDS, 'page_id', X.N_DOCUMENT_SEEDS)} AS html
  FROM pages)"""

AUDIT = """a AS (
  SELECT event_id, ts, user_id, event_type, 't' || (user_id % 5) AS tenant_id,
         CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'redact'
              WHEN 'view' THEN 'alert' ELSE 'allow' END AS action,
         least(floor(value) / 200, 1.0::DOUBLE) AS risk_score,
         CASE WHEN least(floor(value) / 200, 1.0::DOUBLE) >= 0.9 THEN 'critical' WHEN least(floor(value) / 200, 1.0::DOUBLE) >= 0.7 THEN 'high'
              WHEN least(floor(value) / 200, 1.0::DOUBLE) >= 0.4 THEN 'medium' WHEN least(floor(value) / 200, 1.0::DOUBLE) >= 0.1 THEN 'low'
              ELSE 'none' END AS risk_level,
         CASE WHEN event_type IN ('error', 'purchase')
              THEN (['hipaa_v1', 'gdpr_v1', 'pci_dss_v1'])[event_id % 3 + 1] END AS policy_id,
         (['Sales', 'Engineering', 'Legal', 'Finance'])[user_id % 4 + 1] AS department,
         floor(value)::BIGINT AS processing_ms, 's' || (event_id % 97) AS session_id
  FROM events)"""

TOOL_CALLS = f"""calls AS (
  SELECT event_id AS call_id, user_id AS agent_id, ts,
         ({[t for t in X.TOOLS]})[event_id % {len(X.TOOLS)} + 1] AS tool_name,
         coalesce(nullif({X.chosen_sql(X.ARGUMENT_SEEDS, 'event_id', X.N_ARGUMENT_SEEDS)}, ''), props) AS arguments
  FROM events)"""

_ALL = list(C.AGENT_PERMISSIONS)
AGENTS = f"""agents AS (
  SELECT user_id AS agent_id, ts AS registered_at, event_id AS registration_id,
         CASE event_id % 6 WHEN 0 THEN ['read_files']
              WHEN 1 THEN ['read_files', 'write_files', 'database_read'] ELSE {_ALL} END AS permissions,
         CASE WHEN event_id % 6 = 5 THEN 'critical' ELSE 'high' END AS max_risk,
         CASE event_id % 6 WHEN 2 THEN 'medium' WHEN 3 THEN 'critical' ELSE 'high' END AS require_approval_above,
         event_id % 6 = 4 AS sandbox_mode, event_id % 11 <> 0 AS is_active
  FROM events WHERE event_type = 'signup'),
profiles AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY registered_at DESC, registration_id DESC) AS rn
    FROM agents) WHERE rn = 1)"""

META = """m AS (
  SELECT doc_id, source AS store_id, 'Document ' || doc_id AS title,
         (['public', 'internal', 'confidential', 'restricted'])[doc_id % 4 + 1] AS classification,
         doc_id % 17 = 0 AS is_quarantined
  FROM documents)"""


# ------------------------------------------------------------------ detectors
def spans_of(source: str, keys: str, text: str, regex: str, extra: str, where: str = "TRUE") -> str:
    """Rows (keys, extra, start, end, value) for every match of one pattern."""
    return f"""
  SELECT {keys}, {extra}, s AS "start", s + length(v) AS "end", v AS value FROM (
    SELECT {keys}, mm[k] AS v,
           (list_sum(list_transform(gg[1:k], lambda x: length(x)))
            + coalesce(list_sum(list_transform(mm[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT {keys}, mm, gg, unnest(range(1, len(mm) + 1)) AS k FROM (
      SELECT {keys}, regexp_extract_all({text}, {regex}) AS mm, string_split_regex({text}, {regex}) AS gg
      FROM {source} WHERE regexp_matches({text}, {regex}))))
  WHERE {where}"""


_SSN = {
    5: (r"\b\d{3}-\d{2}-\d{4}\b", "left(v, 3) NOT IN ('000', '666') AND v[1] <> '9' "
        "AND substr(v, 5, 2) <> '00' AND right(v, 4) <> '0000'"),
    6: (r"\b\d{9}\b", "left(v, 3) NOT IN ('000', '666') AND v[1] <> '9' "
        "AND substr(v, 4, 2) <> '00' AND right(v, 4) <> '0000'"),
}


def hits(source: str = "d", keys: str = "doc_id", text: str = "text", name: str = "h") -> str:
    """CTE of all entity matches.  RE2 has no look-ahead, so SSN candidates are filtered after."""
    parts = []
    for i, (_, _, regex) in enumerate(C.ENTITY_PATTERNS):
        pattern, where = _SSN.get(i, (regex, "TRUE"))
        parts.append(spans_of(source, keys, text, re2(pattern), f"{i}::BIGINT AS det", where))
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def _case(values, column: str, quote=lit) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


TYPE = _case([t for t, _, _ in C.ENTITY_PATTERNS], "det")
CATEGORY = _case([C.ENTITY_TYPES[t][0] for t, _, _ in C.ENTITY_PATTERNS], "det")
LABEL = _case([C.ENTITY_TYPES[t][1] for t, _, _ in C.ENTITY_PATTERNS], "det")
CONFIDENCE = _case(
    [0.9 if t in C.HIGH_CONFIDENCE_TYPES else 0.8 for t, _, _ in C.ENTITY_PATTERNS], "det", repr
)
EXPLANATION = _case(["Detected via " + x for _, x, _ in C.ENTITY_PATTERNS], "det")
TYPED = f"""e AS (SELECT *, {TYPE} AS entity_type, {CATEGORY} AS category, {LABEL} AS label,
  ({CONFIDENCE})::DOUBLE AS confidence FROM h)"""

MASK = """CASE
  WHEN entity_type IN ('credit_card', 'bank_account')
    THEN CASE WHEN length(value) >= 4 THEN '****-****-****-' || right(value, 4) ELSE '****' END
  WHEN entity_type = 'ssn'
    THEN CASE WHEN length(value) >= 4 THEN '***-**-' || right(value, 4) ELSE '***-**-****' END
  WHEN entity_type = 'email'
    THEN CASE WHEN len(string_split(value, '@')) = 2
      THEN left(split_part(value, '@', 1), 2) || '***@' || split_part(value, '@', 2) ELSE '***@***' END
  WHEN entity_type IN ('api_key', 'jwt_token', 'aws_key')
    THEN CASE WHEN length(value) > 12 THEN left(value, 8) || '...' || right(value, 4) ELSE '****' END
  WHEN entity_type = 'phone'
    THEN CASE WHEN length(value) > 5 THEN left(value, 3) || '***' || right(value, 2) ELSE '***' END
  ELSE CASE WHEN length(value) > 3 THEN left(value, 3) || repeat('*', length(value) - 3) ELSE '***' END END"""


def injections(source: str = "d", keys: str = "doc_id", text: str = "text", name: str = "j") -> str:
    """CTE of injection findings with their match counts."""
    parts = []
    for i, (kind, severity, _, _, regex) in enumerate(C.INJECTION_PATTERNS):
        conf = 0.99 if kind == "unicode_attack" else 0.85
        parts.append(
            f"SELECT {keys}, {i} AS ord, {lit(kind)} AS attack_type, {lit(severity)} AS severity, "
            f"{conf}::DOUBLE AS confidence, len(regexp_extract_all({text}, {re2(regex)}))::BIGINT AS match_count "
            f"FROM {source} WHERE regexp_matches({text}, {re2(regex)})"
        )
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def any_of(text: str, patterns, flags: str = "(?i)") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {re2(p, flags)})" for p in patterns) + ")"


def first_of(text: str, table, flags: str = "(?i)") -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {re2(p, flags)}) THEN {lit(n)}" for n, p in table)
    return f"CASE {whens} END"


def scored(keys: str = "doc_id", source: str = "d", text: str = "text", name: str = "s") -> str:
    """CTE: one row per text with counts, flags, risk and action (needs e and j)."""
    keyset = [k.strip() for k in keys.split(",")]
    on = lambda t: " AND ".join(f"x.{k} = {t}.{k}" for k in keyset)
    weights = "CASE category WHEN 'secret' THEN 0.95 WHEN 'pii' THEN 0.65 ELSE 0.85 END"
    key_list = ", ".join(keyset)
    xkeys = ", ".join(f"x.{k}" for k in keyset)
    return f"""ea AS (
  SELECT {key_list}, count(*) FILTER (category = 'pii') AS n_pii, count(*) FILTER (category = 'phi') AS n_phi,
    count(*) FILTER (category = 'pci') AS n_pci, count(*) FILTER (category = 'secret') AS n_secret,
    count(*) AS n_entities, max({weights}::DOUBLE * confidence) AS erisk,
    coalesce(max(confidence) FILTER (category = 'pii'), 0) AS c_pii,
    coalesce(max(confidence) FILTER (category = 'phi'), 0) AS c_phi,
    coalesce(max(confidence) FILTER (category = 'pci'), 0) AS c_pci,
    coalesce(max(confidence) FILTER (category = 'secret'), 0) AS c_secret,
    min(det) FILTER (category = 'secret' AND confidence >= 0.85) AS key_det
  FROM e GROUP BY ALL),
ja AS (
  SELECT {key_list}, count(*) AS n_injections, max(confidence) AS c_injection,
    max(CASE severity WHEN 'critical' THEN 1.0 ELSE 0.85 END::DOUBLE * confidence) AS jrisk,
    min_by(attack_type, ord) FILTER (severity = 'critical') AS critical_attack,
    string_agg(attack_type, ', ' ORDER BY ord) AS attack_names, min_by(attack_type, ord) AS first_attack
  FROM j GROUP BY ALL),
sx AS (
  SELECT {xkeys}, x.{text} AS text, coalesce(n_pii, 0) AS n_pii, coalesce(n_phi, 0) AS n_phi,
    coalesce(n_pci, 0) AS n_pci, coalesce(n_secret, 0) AS n_secret, coalesce(n_entities, 0) AS n_entities,
    coalesce(n_injections, 0) AS n_injections, critical_attack, attack_names, first_attack, key_det,
    coalesce(c_pii, 0)::DOUBLE AS c_pii, coalesce(c_phi, 0)::DOUBLE AS c_phi, coalesce(c_pci, 0)::DOUBLE AS c_pci,
    coalesce(c_secret, 0)::DOUBLE AS c_secret, coalesce(c_injection, 0)::DOUBLE AS c_injection,
    {any_of('x.' + text, C.TOXICITY_PATTERNS)} AS toxic, coalesce(erisk, 0) AS erisk, coalesce(jrisk, 0) AS jrisk
  FROM {source} x LEFT JOIN ea ON {on('ea')} LEFT JOIN ja ON {on('ja')}),
{name} AS (
  SELECT *, CASE WHEN critical_attack IS NOT NULL OR toxic OR key_det IS NOT NULL THEN 'block'
      WHEN n_pii + n_phi + n_pci > 0 OR risk_score >= 0.70 THEN 'redact' ELSE 'allow' END AS action,
    CASE WHEN critical_attack IS NOT NULL THEN 'Critical injection detected: ' || critical_attack
      WHEN toxic THEN 'Harmful/toxic content detected'
      WHEN key_det IS NOT NULL THEN 'Sensitive credential detected: ' || {_case([t for t, _, _ in C.ENTITY_PATTERNS], 'key_det')}
      END AS block_reason
  FROM (SELECT *, round(greatest(erisk, jrisk, CASE WHEN toxic THEN 0.9 ELSE 0 END::DOUBLE), 4) AS risk_score FROM sx))"""


def inspection(source: str = "d", keys: str = "doc_id", text: str = "text") -> str:
    """CTEs h, e, j, s over a source that is already defined."""
    return ",\n".join([
        hits(source, keys, text), TYPED, injections(source, keys, text), scored(keys, source, text),
    ])


INSPECTED = f"WITH {DOCUMENTS},\n{inspection()}"


def redaction(keys: str = "doc_id", token: str | None = None, source: str = "e", texts: str = "d",
              text: str = "text", name: str = "r") -> str:
    """CTEs numbering the hits right to left and splicing them into the text one by one."""
    keyset = [k.strip() for k in keys.split(",")]
    token = token or "'[' || label || '_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') || ']'"
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keyset)
    kl = ", ".join(keyset)
    bkeys = ", ".join(f"b.{k}" for k in keyset)
    return f"""{name}n AS (
  SELECT *, row_number() OVER (PARTITION BY {kl} ORDER BY "start" DESC, det) AS step,
    row_number() OVER (PARTITION BY {kl}, label ORDER BY "start" DESC, det) AS n FROM {source}),
{name}t AS MATERIALIZED (SELECT *, {token} AS token FROM {name}n),
{name}f AS (
  SELECT {kl}, 0::BIGINT AS step, {text} AS out FROM {texts}
  UNION ALL
  SELECT {bkeys}, t.step, left(b.out, t."start") || t.token || substr(b.out, t."end" + 1)
  FROM {name}f b JOIN {name}t t ON {on('b', 't')} AND t.step = b.step + 1),
{name} AS (SELECT {kl}, max_by(out, step) AS redacted_text, max(step) AS redaction_count FROM {name}f GROUP BY ALL)"""
