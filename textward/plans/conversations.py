"""Queries over conversations: history, context windows, firewalls, session lifecycle.

Limits are lowered by argument where the driver's short conversations would
never reach the defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.masking import content_hash
from ..operators import firewall as W
from ..operators import redact as R
from ..operators import sessions as H
from ..operators import threats as T
from . import inputs as N
from . import oracle as O
from .oracle import lit
from .policies import RULES, _fires
from ..operators import policy as P

QUERIES: dict = {}
KEYS = "tenant_id, session_id"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


_CUT = """CASE WHEN length(content) > {n} THEN left(content, {n}) || ' [TRUNCATED]' ELSE content END"""


@query(f"""WITH {O.TURNS} SELECT session_id, turn, sha256({_CUT.format(n=300)}) AS content_hash,
  length(content) > 300 AS truncated FROM c""")
def message_truncation(spark, sf):
    t = N.turns(spark, sf)
    cut = H.truncate_messages(t.withColumn("truncated", F.length("content") > 300), limit=300)
    return cut.select("session_id", "turn", content_hash(F.col("content")).alias("content_hash"), "truncated")


def bounded_sql(limit: int, source: str = "c", name: str = "b") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (total, n_system, back, fwd) FROM (
  SELECT *, count(*) OVER w AS total, count(*) FILTER (role = 'system') OVER w AS n_system,
    row_number() OVER (PARTITION BY {KEYS}, role = 'system' ORDER BY turn DESC) AS back,
    row_number() OVER (PARTITION BY {KEYS}, role = 'system' ORDER BY turn) AS fwd
  FROM {source} WINDOW w AS (PARTITION BY {KEYS}))
  WHERE total <= {limit} OR role = 'system' OR n_system = {limit}
    OR (n_system < {limit} AND back <= {limit} - n_system) OR (n_system > {limit} AND fwd > n_system - {limit}))"""


@query(f"WITH {O.TURNS}, {bounded_sql(4)} SELECT session_id, turn, role FROM b")
def history_bound(spark, sf):
    return H.bound_history(N.turns(spark, sf), limit=4).select("session_id", "turn", "role")


_JOINED = """full_text AS (SELECT tenant_id, session_id, string_agg(content, chr(10) ORDER BY turn) AS text
  FROM {source} WHERE role <> 'system' GROUP BY ALL)"""


@query(f"""WITH {O.TURNS}, {bounded_sql(50)}, {_JOINED.format(source='b')}
SELECT session_id, sha256(text) AS text_hash, length(text) AS chars FROM full_text""")
def assembled_text(spark, sf):
    a = H.assemble(H.bound_history(N.turns(spark, sf)))
    return a.select("session_id", content_hash(F.col("text")).alias("text_hash"), F.length("text").alias("chars"))


@query(f"WITH {O.TURNS} SELECT {O.any_of('content', C.MEMORY_POISON, '(?is)')} AS poisoned, role, count(*) AS n FROM c GROUP BY ALL")
def memory_poison(spark, sf):
    t = N.turns(spark, sf).select(T.memory_poison(F.col("content")).alias("poisoned"), "role")
    return t.groupBy("poisoned", "role").agg(F.count("*").alias("n"))


_LIMITS = {"max_messages": 3, "max_chars": 1500}
_TRIM = f"""w AS (
  SELECT *, coalesce(sum(clean) OVER p, 0) AS kept_before, coalesce(sum(clean * len) OVER p, 0) AS chars_before
  FROM (SELECT *, length(content) AS len, {O.any_of('content', C.MEMORY_POISON, '(?is)')} AS poisoned,
          (NOT {O.any_of('content', C.MEMORY_POISON, '(?is)')})::INT AS clean FROM c)
  WINDOW p AS (PARTITION BY {KEYS} ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN kept_before >= 3 THEN 'messages' WHEN chars_before + len > 1500 THEN 'chars' END AS why FROM w),
st AS (SELECT {KEYS}, max(turn) AS stop_turn, max_by(why, turn) AS why FROM x WHERE why IS NOT NULL GROUP BY ALL)"""


def _features(spark, sf):
    return H.context_features(N.turns(spark, sf))


@query(f"""WITH {O.TURNS}, {_TRIM} SELECT x.session_id, x.turn, role, sha256(content) AS content_hash FROM x
  LEFT JOIN st USING (tenant_id, session_id) WHERE NOT poisoned AND (stop_turn IS NULL OR turn > stop_turn)""")
def context_trim(spark, sf):
    t = N.turns(spark, sf)
    kept = H.trim_context(t, H.context_stops(H.context_features(t), **_LIMITS))
    return kept.select("session_id", "turn", "role", content_hash(F.col("content")).alias("content_hash"))


@query(f"""WITH {O.TURNS}, {_TRIM}
SELECT session_id, stop_turn AS turn, CASE why WHEN 'messages' THEN 'Message history truncated at 3 messages'
  ELSE 'Message history truncated due to context window limit' END AS warning FROM st
UNION ALL SELECT x.session_id, turn, 'Poisoned message detected and removed: message_id=' || x.session_id || ':' || turn
FROM x LEFT JOIN st USING (tenant_id, session_id) WHERE poisoned AND (stop_turn IS NULL OR turn > stop_turn)""")
def trim_warnings(spark, sf):
    f = _features(spark, sf)
    return H.trim_warnings(f, H.context_stops(f, **_LIMITS), max_messages=3).drop("tenant_id")


# ------------------------------------------------------------------ firewalls
_MSG = f"WITH RECURSIVE {O.TURNS}, {O.inspection('c', 'session_id, turn', 'content')}"


@query(_MSG + f""", {O.redaction('session_id, turn', texts='c', text='content')}
SELECT session_id, turn, CASE WHEN role = 'system' THEN sha256(content) ELSE sha256(redacted_text) END AS content_hash,
  CASE WHEN role = 'system' THEN 0 ELSE redaction_count END AS redactions
FROM r JOIN c USING (session_id, turn)""")
def message_redaction(spark, sf):
    r = R.redact(N.turns(spark, sf), "content", "mask", "splice")
    system = F.col("role") == "system"
    return r.select(
        "session_id", "turn",
        content_hash(F.when(system, F.col("content")).otherwise(F.col("redacted_text"))).alias("content_hash"),
        F.when(system, 0).otherwise(F.col("redaction_count")).alias("redactions"))


def _prompt_sql() -> str:
    ordered = P.evaluation_order(RULES)
    rows = " UNION ALL ".join(
        f"SELECT session_id, {k} AS rule_no, {lit(r.policy_id)} AS policy_id, {lit(r.action)} AS action, "
        f"{lit(r.name)} AS rule_name FROM f WHERE {_fires(r)}" for k, r in enumerate(ordered))
    return f"""WITH {O.TURNS}, cc AS (SELECT * REPLACE ({_CUT.format(n=32000)} AS content) FROM c),
{bounded_sql(50, 'cc')}, {_JOINED.format(source='b')}, {O.inspection('full_text', 'session_id', 'text')},
f AS (SELECT s.*, '' AS region, '' AS department, 'gpt-4o' AS model_name, '' AS intended_audience,
    coalesce(types, []) AS types, coalesce(cats, []) AS cats FROM s LEFT JOIN (
    SELECT session_id, list(DISTINCT entity_type) AS types, list(DISTINCT category) AS cats FROM e GROUP BY ALL) USING (session_id)),
rr AS ({rows}),
pa AS (SELECT session_id, bool_or(action = 'block') AS pblock, bool_or(action = 'redact') AS predact,
    bool_or(action = 'escalate') AS pesc, bool_or(action = 'alert') AS palert,
    min_by(policy_id, rule_no) FILTER (action = 'block') AS block_policy,
    list(rule_name ORDER BY rule_no) AS rule_names FROM rr GROUP BY ALL),
z AS (SELECT f.*, pa.* EXCLUDE (session_id), {O.first_of('f.text', C.HARD_BLOCKS, '(?is)')} AS hard,
    CASE WHEN pblock THEN 'block' WHEN predact THEN 'redact' WHEN pesc THEN 'escalate' WHEN palert THEN 'alert' ELSE 'allow' END AS pact
  FROM f LEFT JOIN pa USING (session_id)),
y AS (SELECT *, hard IS NOT NULL OR n_injections > 0 OR pact = 'block' OR risk_score >= 0.9 AS stop FROM z),
q AS (SELECT *, CASE WHEN stop THEN 'block' WHEN risk_score >= 0.7 OR pact = 'redact' THEN 'redact'
      WHEN risk_score >= 0.4 OR pact = 'alert' THEN 'alert' ELSE 'allow' END AS decision,
    CASE WHEN stop THEN 'critical' WHEN risk_score >= 0.7 OR pact = 'redact' THEN 'high'
      WHEN risk_score >= 0.4 OR pact = 'alert' THEN 'medium' WHEN risk_score >= 0.1 THEN 'low' ELSE 'none' END AS risk_level,
    CASE WHEN hard IS NOT NULL THEN 'Hard block: ' || hard
      WHEN n_injections > 0 THEN 'Injection detected: ' || array_to_string(string_split(attack_names, ', ')[1:2], ', ')
      WHEN pact = 'block' THEN 'Policy block: ' || block_policy
      WHEN risk_score >= 0.9 THEN 'Risk score exceeds critical threshold' END AS reason FROM y)"""


@query(_prompt_sql() + """
SELECT session_id, decision AS action, risk_level, CASE WHEN hard IS NOT NULL THEN 1 ELSE risk_score END::DOUBLE AS risk_score,
  decision <> 'block' AS allowed, reason AS block_reason,
  CASE WHEN hard IS NOT NULL THEN hard WHEN n_injections > 0 THEN replace(attack_names, ', ', ';')
    WHEN pact = 'block' THEN array_to_string(rule_names, ';') ELSE '' END AS violations,
  CASE WHEN hard IS NOT NULL THEN 'Request blocked by immutable firewall rule: ' || hard ELSE
    concat_ws(' | ', 'Decision: ' || upper(decision), 'Reason: ' || reason,
      CASE WHEN len(types) > 0 THEN 'Entities: ' || array_to_string(list_sort(types)[1:5], ', ') END,
      CASE WHEN n_injections > 0 THEN 'Injections: ' || n_injections || ' pattern(s) detected' END,
      'Risk score: ' || printf('%.2f', risk_score),
      CASE WHEN len(rule_names) > 0 THEN 'Policy rules triggered: ' || array_to_string(rule_names[1:3], ', ') END) END AS explanation,
  left(sha256(text), 16) AS content_hash FROM q""")
def prompt_firewall(spark, sf):
    d = W.prompt_decisions(N.turns(spark, sf), RULES)
    return d.drop("tenant_id", "_has_entities").withColumn("violations", F.array_join("violations", ";"))


@query("WITH RECURSIVE" + _prompt_sql()[4:] + f""",
{O.hits('b', 'session_id, turn', 'content', 'mh')}, me AS (SELECT mh.*, {O.LABEL} AS label FROM mh),
{O.redaction('session_id, turn', source='me', texts='b', text='content')}
SELECT session_id, turn, b.role, CASE WHEN b.role <> 'system' AND n_entities > 0 THEN redaction_count ELSE 0 END AS redactions,
  sha256(CASE WHEN b.role <> 'system' AND n_entities > 0 THEN redacted_text ELSE content END) AS content_hash
FROM b JOIN r USING (session_id, turn) JOIN q USING (session_id) WHERE decision <> 'block'""")
def forwarded_messages(spark, sf):
    t = N.turns(spark, sf)
    m = W.prompt_messages(t, W.prompt_decisions(t, RULES), overlaps="splice")
    return m.select("session_id", "turn", "role", "redactions", content_hash(F.col("content")).alias("content_hash"))


@query(f"""WITH {O.TURNS}, asked AS (SELECT * FROM c WHERE role <> 'assistant'),
{_JOINED.format(source='asked')}, {O.inspection('full_text', 'session_id', 'text')},
{O.hits('c', 'session_id, turn', 'content', 'mh')},
{O.injections('c', 'session_id, turn', 'content', 'mj')},
me AS (SELECT session_id, turn, count(*) AS n, max(CASE {O.CATEGORY} WHEN 'secret' THEN 0.95 WHEN 'pii' THEN 0.65 ELSE 0.85 END::DOUBLE * ({O.CONFIDENCE})::DOUBLE) AS er
  FROM mh GROUP BY ALL),
ms AS (SELECT session_id, turn, max(CASE severity WHEN 'critical' THEN 1.0 ELSE 0.85 END::DOUBLE * confidence) AS jr FROM mj GROUP BY ALL),
cnt AS (SELECT session_id, coalesce(sum(n) FILTER (role = 'user'), 0) AS n_in, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS n_out,
    max(greatest(coalesce(er, 0), coalesce(jr, 0), CASE WHEN {O.any_of('content', C.TOXICITY_PATTERNS)} THEN 0.9 ELSE 0 END)) FILTER (role = 'assistant') AS out_risk,
    coalesce(sum(length(content)) FILTER (role = 'assistant'), 0) AS reply
  FROM c LEFT JOIN me USING (session_id, turn) LEFT JOIN ms USING (session_id, turn) GROUP BY ALL),
g AS (SELECT *, n_injections > 0 OR risk_score >= 0.9 AS stop FROM s JOIN cnt USING (session_id))
SELECT session_id, CASE WHEN stop THEN 'block' WHEN risk_score >= 0.5 OR n_entities > 0 THEN 'redact' ELSE 'allow' END AS input_action,
  risk_score AS input_risk_score, stop AS blocked,
  CASE WHEN n_injections > 0 THEN 'Injection detected: ' || first_attack
       WHEN risk_score >= 0.9 THEN 'Risk score exceeds critical threshold' END AS block_reason,
  CASE WHEN stop THEN 'n/a' WHEN n_out > 0 THEN 'redact' ELSE 'deliver' END AS output_action,
  round(CASE WHEN stop THEN 0 ELSE coalesce(out_risk, 0) END, 4)::DOUBLE AS output_risk_score,
  (CASE WHEN stop THEN 0 ELSE CASE WHEN n_entities > 0 THEN n_in ELSE 0 END + n_out END)::BIGINT AS entities_redacted,
  CASE WHEN NOT stop THEN length(text) // 4 END AS prompt_tokens,
  CASE WHEN NOT stop THEN (reply // 4)::BIGINT END AS completion_tokens FROM g""")
def conversation_gateway(spark, sf):
    return W.gateway(N.turns(spark, sf), overlaps="splice").drop("tenant_id")


def _chain(source: str, keys: str, items: str, text: str, token: str, name: str, texts: str) -> str:
    """CTEs replacing each listed value in turn everywhere in its text."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}f AS (SELECT {keys}, 0::BIGINT AS step, {text} AS out FROM {texts} UNION ALL
  SELECT {ak}, b.step, replace(a.out, b.value, {lit(token)}) FROM {name}f a JOIN {items} b ON {on} AND b.step = a.step + 1),
{name} AS (SELECT {keys}, max_by(out, step) AS out, max(step) AS n FROM {name}f GROUP BY ALL)"""


def _named(source, keys, text, table):
    parts = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS ord, {lit(n)} AS name, unnest(regexp_extract_all({text}, {O.re2(p)})) AS value, "
        f"generate_subscripts(regexp_extract_all({text}, {O.re2(p)}), 1) AS k FROM {source}"
        for i, (n, p) in enumerate(table))
    return f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ord, k) AS step FROM ({parts}))"


_K = "session_id, turn"
_OUTPUT_SQL = f"""WITH RECURSIVE {O.TURNS},
o AS (SELECT {_K}, CASE WHEN length(content) > 1200 THEN left(content, 1200) || chr(10) || chr(10) || '[OUTPUT TRUNCATED BY FIREWALL]' ELSE content END AS text
  FROM c WHERE role = 'assistant'),
u AS MATERIALIZED {_named('o', _K, 'text', C.UNSAFE_URLS)},
{_chain('o', _K, 'u', 'text', '[URL REMOVED]', 'cl', 'o')},
k AS MATERIALIZED (SELECT {_K}, out AS text FROM cl),
{O.inspection('k', _K, 'text')}, {O.redaction(_K, texts='k')},
kc AS (SELECT {_K}, redacted_text, array_to_string(regexp_extract_all(redacted_text, {O.re2(C.CODE_FENCE, '(?s)')}, 1), chr(10)) AS code FROM r),
v AS MATERIALIZED {_named('kc', _K, 'code', C.DANGEROUS_CODE)},
{_chain('kc', _K, 'v', 'redacted_text', '[CODE SANITIZED]', 'sn', 'kc')},
uu AS (SELECT {_K}, count(*) AS n_urls, string_agg(name, ';' ORDER BY step) AS url_names FROM u GROUP BY ALL),
vv AS (SELECT {_K}, count(*) AS n_code, string_agg(name, ';' ORDER BY step) AS code_names FROM v GROUP BY ALL),
t AS (SELECT s.*, o.text AS original, sn.out AS sane, coalesce(n_urls, 0) AS n_urls, coalesce(n_code, 0) AS n_code, url_names, code_names,
    {O.first_of('o.text', C.HIJACK_INDICATORS, '(?is)')} AS hijack
  FROM s JOIN o USING (session_id, turn) JOIN sn USING (session_id, turn) LEFT JOIN uu USING (session_id, turn) LEFT JOIN vv USING (session_id, turn)),
tt AS (SELECT * EXCLUDE (action), CASE WHEN hijack IS NOT NULL THEN 'block' WHEN n_code > 0 THEN 'sanitize' WHEN n_entities > 0 THEN 'redact'
    WHEN n_urls > 0 THEN 'sanitize' WHEN risk_score > 0.5 THEN 'alert' ELSE 'deliver' END AS action FROM t)
SELECT session_id, turn, action, action <> 'block' AS allowed,
  sha256(CASE WHEN hijack IS NOT NULL THEN '[RESPONSE BLOCKED: Model compromise detected]' ELSE sane END) AS delivered_hash,
  CASE WHEN hijack IS NOT NULL THEN 1 ELSE risk_score END::DOUBLE AS risk_score,
  CASE WHEN hijack IS NOT NULL THEN 0 ELSE n_entities END AS redacted_count,
  'Model hijack detected: ' || hijack AS block_reason,
  coalesce(hijack, concat_ws(';', url_names, code_names)) AS violations,
  CASE WHEN hijack IS NOT NULL THEN 'Response blocked — model appears to have been successfully jailbroken: ' || hijack ELSE
    concat_ws(' | ', 'Output action: ' || upper(action), CASE WHEN n_entities > 0 THEN n_entities || ' entity/-ies redacted' END,
      CASE WHEN n_urls > 0 THEN 'Unsafe URLs removed: ' || n_urls END,
      CASE WHEN n_code > 0 THEN 'Dangerous code sanitized: ' || n_code END, 'Output risk score: ' || printf('%.2f', risk_score)) END AS explanation,
  left(sha256(original), 16) AS content_hash FROM tt"""


@query(_OUTPUT_SQL)
def output_firewall(spark, sf):
    replies = N.turns(spark, sf).where("role = 'assistant'").select("session_id", "turn", "content")
    o = W.output_firewall(replies, max_chars=1200, overlaps="splice")
    return o.withColumn("delivered_hash", content_hash(F.col("delivered_content"))).withColumn(
        "violations", F.array_join("violations", ";")).drop("delivered_content")


@query(f"""WITH {O.TURNS} SELECT coalesce({O.first_of('content', C.HIJACK_INDICATORS, '(?is)')}, 'none') AS indicator,
  role, count(*) AS n FROM c GROUP BY ALL""")
def hijack_checks(spark, sf):
    t = N.turns(spark, sf).select(F.coalesce(T.hijack(F.col("content")), F.lit("none")).alias("indicator"), "role")
    return t.groupBy("indicator", "role").agg(F.count("*").alias("n"))


@query(f"""WITH {O.TURNS} SELECT role, sum(length(content) // 4)::BIGINT AS tokens, count(*) AS messages FROM c GROUP BY ALL""")
def token_usage(spark, sf):
    t = N.turns(spark, sf).select("role", H.token_estimate(F.col("content")).alias("n"))
    return t.groupBy("role").agg(F.sum("n").alias("tokens"), F.count("*").alias("messages"))


# ------------------------------------------------------------------ lifecycle
_META = f"m AS (SELECT {KEYS}, count(*) AS message_count, max(risk_score) AS max_risk_score, min(ts) AS created_at, max(ts) AS last_active_at FROM a GROUP BY ALL)"
_STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"""WITH {O.AUDIT}, {_META} SELECT tenant_id, session_id, message_count, max_risk_score,
  {_STAMP.format(c='created_at')} AS created_at, {_STAMP.format(c='last_active_at')} AS last_active_at FROM m""")
def session_metadata(spark, sf):
    m = H.session_metadata(N.audit_events(spark, sf))
    return m.withColumn("created_at", stamp("created_at")).withColumn("last_active_at", stamp("last_active_at"))


_NOW = "2024-01-30 12:00:00"


@query(f"""WITH {O.AUDIT}, {_META} SELECT tenant_id, count(*) AS sessions,
  count(*) FILTER (last_active_at + INTERVAL 86400 SECOND < TIMESTAMP '{_NOW}') AS expired FROM m GROUP BY ALL""")
def session_expiry(spark, sf):
    m = H.split_expired(H.session_metadata(N.audit_events(spark, sf)), F.to_timestamp(F.lit(_NOW)), 86400)
    return m.groupBy("tenant_id").agg(F.count("*").alias("sessions"), F.count_if("expired").alias("expired"))


@query(f"""WITH {O.AUDIT}, g AS (
  SELECT *, sum(brk) OVER (PARTITION BY {KEYS} ORDER BY ts, event_id) AS grp FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY {KEYS} ORDER BY ts, event_id) + INTERVAL 43200 SECOND THEN 0 ELSE 1 END AS brk FROM a))
SELECT tenant_id, session_id, {_STAMP.format(c='min(ts)')} AS started_at,
  {_STAMP.format(c='max(ts) + INTERVAL 43200 SECOND')} AS expires_at, count(*) AS messages FROM g GROUP BY tenant_id, session_id, grp""")
def session_windows(spark, sf):
    w = H.activity_windows(N.audit_events(spark, sf), ttl_seconds=43200)
    return w.withColumn("started_at", stamp("started_at")).withColumn("expires_at", stamp("expires_at"))


@query(f"""WITH {O.AUDIT}, {_META} SELECT session_id, message_count, max_risk_score FROM m WHERE tenant_id = 't2'""")
def tenant_sessions(spark, sf):
    events = N.audit_events(spark, sf).where("tenant_id = 't2'")
    return H.session_metadata(events).select("session_id", "message_count", "max_risk_score")


@query(f"""WITH {O.TURNS} SELECT tenant_id, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM c
WHERE session_id NOT IN (SELECT session_id FROM c WHERE {O.any_of('content', C.MEMORY_POISON, '(?is)')}) GROUP BY ALL""")
def erased_sessions(spark, sf):
    t = N.turns(spark, sf)
    gone = t.where(T.memory_poison(F.col("content"))).select(*H.SESSION).distinct()
    left = H.erase_sessions(t.select(*H.SESSION, "turn"), gone)
    return left.groupBy("tenant_id").agg(
        F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions"))


@query(f"""WITH {O.AUDIT}, {_META}, fl AS (SELECT {KEYS}, max_by('event ' || event_id, event_id) AS reason
  FROM a WHERE risk_level = 'critical' GROUP BY ALL)
SELECT tenant_id, session_id, message_count, reason IS NOT NULL AS is_flagged, reason AS flag_reason
FROM m LEFT JOIN fl USING (tenant_id, session_id)""")
def flagged_sessions(spark, sf):
    a = N.audit_events(spark, sf)
    flags = a.where("risk_level = 'critical'").select(
        *H.SESSION, F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("reason"),
        F.col("event_id").alias("flagged_at"))
    return H.flag_sessions(H.session_metadata(a), flags).select(
        "tenant_id", "session_id", "message_count", "is_flagged", "flag_reason")
