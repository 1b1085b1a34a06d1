"""Queries over retrieval security, agent tool calls and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..operators import agents as A
from ..operators import limits as L
from ..operators import retrieval as G
from ..operators import threats as T
from ..operators.asof import as_of_join
from . import inputs as N
from . import oracle as O
from .conversations import stamp
from .oracle import lit
from .texts import _POISON_RISK, _poison

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def _map(values, column, unknown):
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in values.items()) + f" ELSE {unknown} END"


_ROLES = list(N.ROLES)
ROLE, CLASS = _map(C.ROLE_CLEARANCE, "user_role", 0), _map(C.CLASSIFICATION_CLEARANCE, "classification", 3)

REQUESTS = f"""{O.TURNS}, q AS (
  SELECT session_id * 100 + turn AS request_id, content AS query, ({_ROLES})[(session_id + turn) % 6 + 1] AS user_role,
    ['src' || (session_id % 20), 'src' || ((session_id + turn * 3) % 20), 'ext' || (turn % 2)] AS store_ids
  FROM c WHERE role = 'user')"""
STORES = """stores AS (
  SELECT source AS store_id, count(*) AS docs,
    (['public', 'internal', 'confidential', 'restricted'])[substr(source, 4)::INT % 4 + 1] AS classification,
    CASE WHEN substr(source, 4)::INT % 5 = 0 THEN 'warning' ELSE 'healthy' END AS status
  FROM documents GROUP BY source)"""


def requests(spark, sf):
    t = N.turns(spark, sf).where("role = 'user'")
    s, n = F.col("session_id"), F.col("turn")
    src = lambda x: F.concat(F.lit("src"), (x % 20).cast("string"))
    return t.select(
        (s * 100 + n).alias("request_id"), F.col("content").alias("query"), N.by_index(N.ROLES, s + n).alias("user_role"),
        F.array(src(s), src(s + n * 3), F.concat(F.lit("ext"), (n % 2).cast("string"))).alias("store_ids"))


def stores(spark, sf):
    number = F.expr("CAST(substr(source, 4) AS INT)")
    counts = N.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    return counts.select(
        F.col("source").alias("store_id"), "docs", N.by_index(N.CLASSES, number).alias("classification"),
        F.when(number % 5 == 0, "warning").otherwise("healthy").alias("status"))


# ------------------------------------------------------------------ retrieval
@query(f"WITH {O.META}, u AS (SELECT *, 'analyst' AS user_role FROM m) SELECT doc_id, CASE WHEN NOT is_quarantined AND {ROLE} >= {CLASS} "
       "THEN 'allowed' ELSE 'denied' END AS access FROM u")
def document_access(spark, sf):
    return G.document_access(N.document_metadata(spark, sf), F.lit("analyst")).select("doc_id", "access")


@query(f"""WITH {O.META}, roles AS (SELECT unnest({list(C.ROLE_CLEARANCE)}) AS user_role)
SELECT user_role AS role, classification, count(*) AS documents, {ROLE} >= {CLASS} AS has_access,
  count(*) FILTER (NOT is_quarantined AND {ROLE} >= {CLASS}) AS readable FROM m, roles GROUP BY ALL""")
def access_matrix(spark, sf):
    return G.access_counts(N.document_metadata(spark, sf))


_RISK = "greatest(0, " + ", ".join(f"CASE WHEN regexp_matches(query, {O.re2(p)}) THEN {s} ELSE 0 END" for s, p in C.QUERY_RISKS) + ")::DOUBLE"
_AUTH = f"""{REQUESTS}, au AS (SELECT *, {O.first_of('query', C.QUERY_INJECTIONS)} AS inj, {_RISK} AS risk FROM q)"""


@query(f"""WITH {_AUTH} SELECT request_id, CASE WHEN inj IS NOT NULL THEN 'deny' WHEN risk < 0.7 THEN 'allow' ELSE 'filter' END AS action,
  inj IS NULL AS query_allowed, CASE WHEN inj IS NOT NULL THEN 0.95 ELSE risk END::DOUBLE AS query_risk_score,
  inj IS NOT NULL AS injection_detected, 'Query injection detected: ' || inj AS block_reason FROM au""")
def query_authorization(spark, sf):
    return G.authorize_queries(requests(spark, sf)).drop("query", "user_role", "store_ids")


_STORE_AUTH = f"""{_AUTH}, {STORES}, ex AS (
  SELECT request_id, inj, user_role, unnest(store_ids) AS store_id, generate_subscripts(store_ids, 1) AS pos FROM au),
ck AS (SELECT request_id, store_id, pos, inj IS NULL AND (classification IS NULL OR {ROLE} >= {CLASS}) AS ok
  FROM ex LEFT JOIN stores USING (store_id)),
ag AS (SELECT request_id, coalesce(string_agg(store_id, ',' ORDER BY pos) FILTER (ok), '') AS authorized,
    coalesce(string_agg(store_id, ',' ORDER BY pos) FILTER (NOT ok), '') AS denied FROM ck GROUP BY ALL),
sa AS (SELECT *, inj IS NULL AND authorized <> '' AS allowed,
    CASE WHEN inj IS NOT NULL THEN 0.95 ELSE risk END::DOUBLE AS query_risk_score FROM au JOIN ag USING (request_id))"""


@query(f"WITH {_STORE_AUTH} SELECT request_id, allowed, query_risk_score, authorized AS authorized_stores, denied AS denied_stores FROM sa")
def store_authorization(spark, sf):
    a = G.authorize_stores(requests(spark, sf), stores(spark, sf))
    return a.select("request_id", "allowed", "query_risk_score", F.array_join("authorized_stores", ",").alias("authorized_stores"),
                    F.array_join("denied_stores", ",").alias("denied_stores"))


@query(f"""WITH {_STORE_AUTH} SELECT count(*) AS retrievals, count(*) FILTER (allowed) AS authorized,
  count(*) FILTER (NOT allowed) AS unauthorized, count(*) FILTER (query_risk_score > 0.7) AS high_risk FROM sa""")
def retrieval_kpis(spark, sf):
    return G.retrieval_kpis(G.authorize_stores(requests(spark, sf), stores(spark, sf)))


@query(f"""WITH {STORES} SELECT count(*) AS stores, sum(docs)::BIGINT AS documents,
  count(*) FILTER (classification = 'restricted') AS restricted, count(*) FILTER (status <> 'healthy') AS unhealthy FROM stores""")
def store_kpis(spark, sf):
    return G.store_kpis(stores(spark, sf))


@query(f"WITH {STORES} SELECT * FROM stores")
def store_registry(spark, sf):
    return stores(spark, sf)


@query(f"""WITH {REQUESTS}, s1 AS (SELECT *, (['public', 'internal', 'confidential', 'restricted'])[request_id % 4 + 1] AS classification FROM q),
s2 AS (SELECT request_id, user_role IN ({', '.join(map(lit, C.ROLE_CLEARANCE))}) AND {ROLE} >= {CLASS} AS authorized,
  NOT {O.any_of('query', C.SIMULATION_INJECTIONS)} AS injection_free,
  NOT regexp_matches(query, {O.re2(C.SIMULATION_PERSONAL_NUMBER, '')}) AS pii_free FROM s1)
SELECT *, authorized AND injection_free AND pii_free AS retrieval_allowed FROM s2""")
def retrieval_simulation(spark, sf):
    r = requests(spark, sf).withColumn("classification", N.by_index(N.CLASSES, F.col("request_id")))
    return G.simulate(r).drop("user_role", "store_ids", "classification")


_K, _MIN = 5, 0.1
_COS = "list_dot_product(v.embedding::DOUBLE[], r.qv::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(r.qv::DOUBLE[], r.qv::DOUBLE[])))"
_TOPK = f"""v AS (SELECT vec_id, embedding, 'store' || label AS store_id,
    (['public', 'internal', 'confidential', 'restricted'])[vec_id % 4 + 1] AS classification FROM embeddings),
r AS (SELECT store_id, min(vec_id) AS request_id, arg_min(embedding, vec_id) AS qv,
    ({_ROLES})[min(vec_id) % 6 + 1] AS user_role FROM v GROUP BY store_id),
tk AS (SELECT * FROM (SELECT request_id, store_id, user_role, vec_id, classification, score,
      row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT r.request_id, store_id, user_role, v.vec_id, classification, {_COS} AS score FROM v JOIN r USING (store_id)
      WHERE {{access}}) WHERE score >= {_MIN}) WHERE rank <= {_K})"""


def _vectors(spark, sf):
    e = N.table(spark, sf, "embeddings")
    v = e.select("vec_id", "embedding", F.concat(F.lit("store"), F.col("label").cast("string")).alias("store_id"),
                 N.by_index(N.CLASSES, F.col("vec_id")).alias("classification"))
    # One request per store: the store's first vector is the query.
    r = v.groupBy("store_id").agg(F.min("vec_id").alias("request_id"), F.min_by("embedding", "vec_id").alias("query_vector"))
    return v, r.withColumn("user_role", N.by_index(N.ROLES, F.col("request_id")))


@query(f"WITH {_TOPK.format(access=f'{ROLE} >= {CLASS}')} SELECT request_id, store_id, vec_id, round(score, 6) AS score, rank FROM tk")
def retrieve_top_k(spark, sf):
    v, r = _vectors(spark, sf)
    return G.retrieve_top_k(r, v, _K, _MIN).withColumn("score", F.round("score", 6))


_CITE = f"""{_TOPK.format(access='TRUE')}, ci AS (SELECT tk.*, rank AS citation_id, vec_id AS doc_id, 'Document ' || vec_id AS title,
   'vector ' || vec_id AS content FROM tk WHERE {ROLE} >= {CLASS})"""


def _cited(spark, sf):
    v, r = _vectors(spark, sf)
    everything = r.withColumn("_role", F.col("user_role")).withColumn("user_role", F.lit("admin"))
    hits = G.retrieve_top_k(everything, v, _K, _MIN)
    roles, classes = r.select("request_id", "user_role"), v.select("vec_id", "classification")
    rows = hits.join(classes, "vec_id").join(roles, "request_id").select(
        "*", F.col("vec_id").alias("doc_id"), F.concat(F.lit("Document "), F.col("vec_id").cast("string")).alias("title"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"))
    return G.citations(rows)


@query(f"WITH {_CITE} SELECT request_id, citation_id, doc_id, title, store_id, classification, round(score, 6) AS score FROM ci")
def source_citations(spark, sf):
    return _cited(spark, sf).select("request_id", "citation_id", "doc_id", "title", "store_id", "classification",
                                    F.round("score", 6).alias("score"))


@query(f"""WITH {_CITE} SELECT request_id, count(*) AS sources, string_agg('[Source ' || citation_id || '] ' || title ||
  ' (doc_id: ' || doc_id || ', relevance: ' || printf('%.2f', score) || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10)
  ORDER BY citation_id) AS context FROM ci GROUP BY ALL""")
def attribution_context(spark, sf):
    return G.attribution_context(_cited(spark, sf))


@query(f"""WITH {O.DOCUMENTS}, {O.META}, ps AS ({_poison('d', 'doc_id', 'text')}),
bad AS (SELECT doc_id, max({_POISON_RISK}) AS risk FROM ps GROUP BY ALL),
z AS (SELECT m.*, bad.doc_id IS NOT NULL AS poisoned, 'admin' AS user_role FROM m LEFT JOIN bad USING (doc_id))
SELECT classification, poisoned, CASE WHEN NOT (is_quarantined OR poisoned) AND {ROLE} >= {CLASS} THEN 'allowed' ELSE 'denied' END AS access,
  count(*) AS n_docs FROM z GROUP BY ALL""")
def quarantine_flow(spark, sf):
    scan = T.poisoning_scan(N.documents(spark, sf), "doc_id").select("doc_id", "is_poisoned")
    meta = N.document_metadata(spark, sf).join(scan, "doc_id")
    held = meta.withColumn("is_quarantined", F.col("is_quarantined") | F.col("is_poisoned"))
    return G.document_access(held, F.lit("admin")).groupBy(
        "classification", F.col("is_poisoned").alias("poisoned"), "access").agg(F.count("*").alias("n_docs"))


# ------------------------------------------------------------------ agents
@query(f"WITH {O.AGENTS} SELECT agent_id, registration_id, array_to_string(permissions, ',') AS permissions, max_risk, require_approval_above, "
       "sandbox_mode, is_active FROM profiles")
def agent_registry(spark, sf):
    rows = A.valid_registrations(N.agents(spark, sf)).withColumn("last_id", F.col("registration_id"))
    return A.latest_profiles(rows).select(
        "agent_id", F.col("last_id").alias("registration_id"), F.array_join("permissions", ",").alias("permissions"),
        "max_risk", "require_approval_above", "sandbox_mode", "is_active")


def _tool(pick, unknown):
    return "CASE " + " ".join(f"WHEN regexp_matches(tool_name, {O.re2(p)}) THEN {pick(perms, risk, esc)}"
                              for p, perms, risk, esc in C.TOOL_REGISTRY) + f" ELSE {unknown} END"


_TOOLED = f"""tc AS (SELECT *, {_tool(lambda p, r, e: list(p), "CAST([] AS VARCHAR[])")} AS required,
    {_tool(lambda p, r, e: lit(r), "'high'")} AS tool_risk, {_tool(lambda p, r, e: str(e).lower(), 'true')} AS escalate,
    list_filter([{', '.join(f"CASE WHEN regexp_matches(arguments, {O.re2(p)}) THEN {lit(n)} END" for n, _, p in C.ARGUMENT_THREATS)}], lambda x: x IS NOT NULL) AS threats,
    greatest({', '.join(f"CASE WHEN regexp_matches(arguments, {O.re2(p)}) THEN {C.AGENT_RISKS.index(r) + 1} ELSE 0 END" for _, r, p in C.ARGUMENT_THREATS)}) AS trank
  FROM calls)"""
_RANK = lambda c: f"list_position({list(C.AGENT_RISKS)}, {c})"
_DECIDED = f"""{O.TOOL_CALLS}, {O.AGENTS}, {_TOOLED},
jn AS (SELECT tc.*, p.* EXCLUDE (agent_id, registered_at, registration_id, sandbox_mode, is_active),
    coalesce(p.sandbox_mode, false) AS sandbox_mode, coalesce(p.is_active, false) AS active,
    greatest(trank, {_RANK('tool_risk')}) AS rk,
    list_filter(required, lambda x: NOT list_contains(coalesce(permissions, []), x)) AS missing
  FROM tc LEFT JOIN profiles p USING (agent_id)),
bd AS (SELECT *, ({list(C.AGENT_RISKS)})[rk] AS risk,
    CASE WHEN NOT active OR trank >= 5 OR len(missing) > 0 OR (rk >= 5 AND max_risk <> 'critical') THEN 'deny'
      WHEN escalate OR rk >= {_RANK('require_approval_above')} THEN 'escalate' WHEN sandbox_mode THEN 'sandbox' ELSE 'allow' END AS base
  FROM jn),
bs AS (SELECT *, CASE WHEN NOT active OR trank >= 5 THEN 'critical' ELSE risk END AS base_risk,
    CASE WHEN NOT active THEN 'Agent not registered or inactive'
      WHEN trank >= 5 THEN 'Dangerous argument detected: ' || array_to_string(threats[1:2], ', ')
      WHEN len(missing) > 0 THEN 'Missing permissions: ' || array_to_string(missing, ', ')
      WHEN rk >= 5 AND max_risk <> 'critical' THEN 'Tool risk (' || risk || ') exceeds agent ceiling (' || max_risk || ')'
      WHEN base = 'escalate' THEN 'Human approval required for ' || tool_name || ' (risk: ' || risk || ')'
      WHEN sandbox_mode THEN 'Permitted in sandbox mode' ELSE 'Permitted: all checks passed (risk: ' || risk || ')' END AS base_reason FROM bd)"""


@query(f"WITH {O.TOOL_CALLS}, {_TOOLED} SELECT tool_name, array_to_string(required, ',') AS required, tool_risk, escalate, count(*) AS calls FROM tc GROUP BY ALL")
def tool_risk(spark, sf):
    t = A.with_tool_risk(N.tool_calls(spark, sf)).select(
        "tool_name", F.array_join("required_permissions", ",").alias("required"), "tool_risk",
        F.col("needs_escalation").alias("escalate"))
    return t.groupBy("tool_name", "required", "tool_risk", "escalate").agg(F.count("*").alias("calls"))


@query(f"WITH {O.TOOL_CALLS}, {_TOOLED} SELECT threat, count(*) AS calls FROM (SELECT unnest(threats) AS threat FROM tc) GROUP BY ALL")
def argument_threats(spark, sf):
    t = N.tool_calls(spark, sf).select(F.explode_outer(T.argument_threats(F.col("arguments"))).alias("t"))
    return t.where("t IS NOT NULL").groupBy(F.col("t.name").alias("threat")).agg(F.count("*").alias("calls"))


_LIMIT, _WINDOW = 2, 259200  # two calls in three days: the driver's agents are slow
_FOLD = f"""ob AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts, call_id) AS n FROM bs),
lf AS (
  SELECT agent_id, n, false AS limited, CASE WHEN base <> 'deny' THEN [epoch_us(ts)] ELSE CAST([] AS BIGINT[]) END AS recent FROM ob WHERE n = 1
  UNION ALL
  SELECT ob.agent_id, ob.n, len(kept) >= {_LIMIT},
    CASE WHEN len(kept) < {_LIMIT} AND ob.base <> 'deny' THEN list_append(kept, epoch_us(ob.ts)) ELSE kept END
  FROM (SELECT lf.agent_id, lf.n, list_filter(lf.recent, lambda x: epoch_us(ob.ts) - x < {_WINDOW}000000::BIGINT) AS kept
        FROM lf JOIN ob ON ob.agent_id = lf.agent_id AND ob.n = lf.n + 1) k JOIN ob ON ob.agent_id = k.agent_id AND ob.n = k.n + 1),
fd AS (SELECT ob.*, limited AND active AS hit FROM ob JOIN lf USING (agent_id, n)),
final AS (SELECT *, CASE WHEN hit THEN 'deny' ELSE base END AS decision, CASE WHEN hit THEN 'medium' ELSE base_risk END AS risk_level,
    CASE WHEN hit THEN 'Rate limit exceeded' ELSE base_reason END AS reason FROM fd)"""


def _decisions(spark, sf):
    profiles = A.latest_profiles(N.agents(spark, sf))
    return A.decide(N.tool_calls(spark, sf), profiles, _LIMIT, _WINDOW)


@query(f"WITH {_DECIDED} SELECT call_id, base AS decision, base_risk AS risk_level, base_reason AS reason FROM bs")
def tool_call_checks(spark, sf):
    d = A.decide_without_limit(N.tool_calls(spark, sf), A.latest_profiles(N.agents(spark, sf)))
    return d.select("call_id", "decision", "risk_level", "reason")


@query(f"WITH RECURSIVE {_DECIDED}, {_FOLD} SELECT call_id, agent_id, decision, risk_level, reason, decision IN ('allow', 'sandbox') AS allowed, "
       "decision = 'escalate' AS requires_approval, array_to_string(required, ',') AS required_permissions FROM final")
def tool_call_decisions(spark, sf):
    return _decisions(spark, sf).select(
        "call_id", "agent_id", "decision", "risk_level", "reason", "allowed", "requires_approval",
        F.array_join("required_permissions", ",").alias("required_permissions"))


_THEN = _DECIDED.replace("FROM tc LEFT JOIN profiles p USING (agent_id)", """FROM tc ASOF LEFT JOIN (
    SELECT * FROM agents QUALIFY row_number() OVER (PARTITION BY agent_id, registered_at ORDER BY registration_id DESC) = 1) p
  ON tc.agent_id = p.agent_id AND tc.ts >= p.registered_at""")


@query(f"WITH RECURSIVE {_THEN}, {_FOLD} SELECT call_id, agent_id, decision, risk_level, reason, decision IN ('allow', 'sandbox') AS allowed FROM final")
def tool_call_decisions_then(spark, sf):
    """Tool calls decided by the profile that was valid when they were made."""
    d = A.decide(N.tool_calls(spark, sf), N.agents(spark, sf), _LIMIT, _WINDOW, then=True)
    return d.select("call_id", "agent_id", "decision", "risk_level", "reason", "allowed")


@query(f"""WITH {O.TOOL_CALLS}, {O.AUDIT}, k AS (SELECT *, 's' || (call_id % 97) AS session_id FROM calls),
w AS (SELECT session_id, ts, max_by(risk_score, event_id) AS risk_score, max_by(action, event_id) AS action, max(event_id) AS event_id
  FROM a WHERE event_type <> 'click' GROUP BY ALL)
SELECT call_id, w.event_id AS risk_event, w.risk_score AS session_risk, w.action AS session_action,
  coalesce(w.risk_score >= 0.7, false) AS risky FROM k ASOF LEFT JOIN w ON k.session_id = w.session_id AND k.ts > w.ts""")
def session_risk_at_call(spark, sf):
    """The risk a session had when one of its tool calls was made: that of its last audited event before the call."""
    calls = N.tool_calls(spark, sf).select(
        "call_id", "ts", F.concat(F.lit("s"), (F.col("call_id") % 97).cast("string")).alias("session_id"))
    audited = N.audit_events(spark, sf).where("event_type <> 'click'").select(
        "session_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("risk_event"), "event_id",
        F.col("risk_score").alias("session_risk"), F.col("action").alias("session_action"))
    j = as_of_join(calls, audited, ["session_id"], "ts", "seen_at", ["risk_event", "session_risk", "session_action"],
                   "event_id", strict=True)
    return j.select("call_id", "risk_event", "session_risk", "session_action",
                    F.coalesce(F.col("session_risk") >= 0.7, F.lit(False)).alias("risky"))


@query(f"WITH RECURSIVE {_DECIDED}, {_FOLD} SELECT agent_id, count(*) AS calls, count(*) FILTER (hit) AS limited FROM final GROUP BY ALL")
def agent_rate_limits(spark, sf):
    d = _decisions(spark, sf)
    return d.groupBy("agent_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("reason") == "Rate limit exceeded").alias("limited"))


@query(f"WITH RECURSIVE {_DECIDED}, {_FOLD} SELECT agent_id, tool_name, decision, count(*) AS calls FROM final GROUP BY ALL")
def agent_call_counters(spark, sf):
    return _decisions(spark, sf).groupBy("agent_id", "tool_name", "decision").agg(F.count("*").alias("calls"))


@query(f"WITH RECURSIVE {_DECIDED}, {_FOLD} SELECT call_id, tool_name, decision, reason FROM final ORDER BY ts DESC, call_id DESC LIMIT 50")
def tool_call_log(spark, sf):
    d = A.newest(_decisions(spark, sf), F.col("ts").desc(), F.col("call_id").desc(), limit=50)
    return d.select("call_id", "tool_name", "decision", "reason")


@query(f"""WITH RECURSIVE {_DECIDED}, {_FOLD}, ap AS (SELECT event_id AS call_id, 'user' || user_id AS approved_by, value > 50 AS approved FROM events WHERE event_id % 3 = 0)
SELECT call_id, tool_name, CASE WHEN approved_by IS NULL THEN 'pending' WHEN approved THEN 'approved' ELSE 'rejected' END AS approval_status, approved_by
FROM final LEFT JOIN ap USING (call_id) WHERE decision = 'escalate'""")
def approval_queue(spark, sf):
    e = N.table(spark, sf, "events").where("event_id % 3 = 0")
    approvals = e.select(F.col("event_id").alias("call_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("approved_by"),
                         (F.col("value") > 50).alias("approved"))
    return A.approval_queue(_decisions(spark, sf), approvals).select("call_id", "tool_name", "approval_status", "approved_by")


# ------------------------------------------------------------------ limits
_RPM, _BURST = 0.002, 3


_TOKEN = round(60_000_000 / _RPM)  # microseconds that refill one token


@query(f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
tb AS (SELECT user_id, n, t, ({_BURST} - 1) * {_TOKEN}::BIGINT AS level, true AS admitted FROM o WHERE n = 1
  UNION ALL SELECT user_id, n, t, CASE WHEN l < {_TOKEN} THEN l ELSE l - {_TOKEN} END, l >= {_TOKEN} FROM (
    SELECT o.user_id, o.n, o.t, least({_BURST} * {_TOKEN}::BIGINT, level + o.t - tb.t) AS l
    FROM tb JOIN o ON o.user_id = tb.user_id AND o.n = tb.n + 1))
SELECT event_id, admitted, level // {_TOKEN} AS remaining FROM tb JOIN o USING (user_id, n)""")
def token_bucket(spark, sf):
    e = N.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return L.token_bucket(e, "user_id", "ts", ["event_id"], _RPM, _BURST).select("event_id", "admitted", "remaining")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000
  RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def trailing_counts(spark, sf):
    e = N.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return L.trailing_counts(e, "user_id", "ts", 7200).select("event_id", "recent")


@query("""SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS requests
FROM events GROUP BY ALL HAVING count(*) > 1""")
def over_limit_minutes(spark, sf):
    e = N.table(spark, sf, "events").select("event_type", "ts")
    return L.over_limit_minutes(e, "event_type", "ts", 1).withColumn("minute", stamp("minute"))
