"""Queries over audit events, metrics, dashboards, dimensions and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import detect as D
from ..functions import scoring as S
from ..functions.masking import content_hash
from ..operators import audit as U
from ..operators import inspect as I
from ..operators import redact as R
from ..operators import rollups as RU
from ..operators import sessions as H
from ..sources import files as FS
from . import access as X
from . import inputs as N
from . import oracle as O
from .conversations import _META, stamp
from .oracle import lit
from .policies import ENGINE_RULES, _evaluated, features
from ..operators import policy as P

QUERIES: dict = {}
AS_OF = "2024-01-30 12:00:00"
T0 = f"TIMESTAMP '{AS_OF}'"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def now():
    return F.to_timestamp(F.lit(AS_OF))


def events(spark, sf):
    return N.audit_events(spark, sf)


# ------------------------------------------------------------------ audit
@query(f"""WITH {O.AUDIT} SELECT event_id, user_id, action, risk_level, count(*) OVER () AS total FROM a
WHERE action = 'block' AND tenant_id = 't1' AND ts >= {T0} - INTERVAL 168 HOUR ORDER BY event_id LIMIT 20 OFFSET 5""")
def audit_list(spark, sf):
    found = U.audit_filter(events(spark, sf), now(), 168, action="block", tenant_id="t1")
    return U.audit_listing(found, 20, 5).select("event_id", "user_id", "action", "risk_level", "total")


@query(f"""WITH {O.AUDIT}, r AS (SELECT * FROM a WHERE ts >= {T0} - INTERVAL 24 HOUR)
SELECT 'action' AS dimension, action AS value, count(*) AS events FROM r GROUP BY ALL
UNION ALL SELECT 'risk_level', risk_level, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'policy', policy_id, count(*) FROM r WHERE policy_id IS NOT NULL GROUP BY ALL""")
def audit_summary(spark, sf):
    return U.summary(U.audit_filter(events(spark, sf), now(), 24))


@query(f"WITH {O.AUDIT} SELECT event_id, action, tenant_id, risk_score FROM a WHERE event_id = 137")
def audit_event(spark, sf):
    return U.event_by_id(events(spark, sf), 137).select("event_id", "action", "tenant_id", "risk_score")


_SEARCH = """(contains(lower(event_type), 'gdpr') OR contains(lower(session_id), 'gdpr') OR contains(lower(department), 'gdpr')
  OR contains(lower(coalesce(policy_id, '')), 'gdpr'))"""


@query(f"""WITH {O.AUDIT} SELECT event_id, department, policy_id, action FROM a WHERE action IN ('block', 'redact')
  AND department IN ('Sales', 'Legal') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND {_SEARCH}""")
def audit_search(spark, sf):
    found = U.audit_search(events(spark, sf), "GDPR", start=F.to_timestamp(F.lit("2024-01-05")),
                           end=F.to_timestamp(F.lit("2024-01-25")), action=("block", "redact"), department=("Sales", "Legal"))
    return found.select("event_id", "department", "policy_id", "action")


_KPI = """count(*) AS total, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'redact') AS redacted,
  count(*) FILTER (risk_level = 'critical') AS critical, (sum(processing_ms) // greatest(count(*), 1))::BIGINT AS avg_ms"""


@query(f"WITH {O.AUDIT} SELECT department, {_KPI} FROM a GROUP BY ALL")
def audit_kpis(spark, sf):
    e = events(spark, sf)
    return e.groupBy("department").agg(
        F.count("*").alias("total"), F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.col("action") == "redact").alias("redacted"),
        F.count_if(F.col("risk_level") == "critical").alias("critical"),
        F.floor(F.sum("processing_ms") / F.count("*")).alias("avg_ms"))


@query(f"WITH {O.AUDIT} SELECT event_id, {'strftime(ts, ' + lit('%Y-%m-%d %H:%M:%S') + ')'} AS ts FROM a ORDER BY a.ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def audit_pages(spark, sf):
    page = U.audit_page(events(spark, sf), 25, 50, (F.col("ts").desc(), F.col("event_id").desc()))
    return page.select("event_id", stamp("ts").alias("ts"))


@query(f"""WITH {O.AUDIT} SELECT count(*) AS total_events, count(*) FILTER (action = 'block') AS blocked_events,
  count(*) FILTER (action = 'redact') AS redacted_events, count(*) FILTER (risk_level = 'critical') AS critical_risk_events,
  'HIPAA, GDPR, PCI-DSS, SOC2' AS compliance_frameworks, '2024-01-30T12:00:00' AS report_generated FROM a""")
def compliance_report(spark, sf):
    return U.compliance_report(events(spark, sf), ("HIPAA", "GDPR", "PCI-DSS", "SOC2"), now())


@query(f"""WITH {O.AUDIT} SELECT event_id, sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '","tenant_id":"' || tenant_id ||
  '","user_id":' || user_id || ',"session_id":"' || session_id || '","action":"' || action || '","risk_score":' || risk_score ||
  ',"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","processing_ms":' || processing_ms || ',"department":"' || department || '"}}') AS line_hash FROM a""")
def event_lines(spark, sf):
    return U.event_lines(events(spark, sf)).select("event_id", content_hash(F.col("line")).alias("line_hash"))


@query(f"""WITH {O.AUDIT} SELECT event_id, tenant_id, action FROM a
WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' AND tenant_id = 't3'""")
def audit_export_rows(spark, sf):
    found = U.audit_search(events(spark, sf), start=F.to_timestamp(F.lit("2024-01-10")), end=F.to_timestamp(F.lit("2024-01-12")))
    return U.audit_filter(found, tenant_id="t3").select("event_id", "tenant_id", "action")


@query(f"WITH {O.AUDIT} SELECT event_id, action FROM a ORDER BY ts DESC, event_id DESC LIMIT 1000")
def event_buffer(spark, sf):
    return U.bounded_buffer(events(spark, sf), C.EVENT_BUFFER).select("event_id", "action")


@query(f"WITH {O.AUDIT} SELECT action, count(*) AS n FROM (SELECT * FROM a ORDER BY ts DESC, event_id DESC LIMIT 10000) GROUP BY ALL")
def audit_buffer(spark, sf):
    return U.bounded_buffer(events(spark, sf), C.AUDIT_BUFFER).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {O.DOCUMENTS} SELECT count(*) AS entries, count(*) AS intact, 0::BIGINT AS orphaned FROM d""")
def audit_integrity(spark, sf):
    d = N.documents(spark, sf)
    log = I.inspect(d).select("doc_id", "content_hash")
    return U.integrity_check(log, d, "doc_id", "content_hash", "text")


_SEALED = ("event_id", "ts", "user_id", "tenant_id", "action", "risk_score", "policy_id")


@query(f"""WITH {O.AUDIT} SELECT event_id, 'removed' AS finding FROM a WHERE event_id % 101 = 0
UNION ALL SELECT event_id, 'altered' FROM a WHERE event_id % 101 <> 0 AND event_id % 103 = 1
UNION ALL SELECT event_id + 1000000000, 'inserted' FROM a WHERE event_id % 107 = 2
UNION ALL SELECT event_id, 'altered' FROM a WHERE event_id % 101 <> 0 AND event_id % 103 <> 1 AND event_id % 109 = 3""")
def audit_tampering(spark, sf):
    """The audit log, sealed as it is, against a copy with entries removed, altered, inserted and moved in time."""
    log = events(spark, sf)
    key = F.col("event_id")
    kept = log.where(key % 101 != 0).withColumn("action", F.when(key % 103 == 1, F.concat("action", F.lit("ed"))).otherwise(F.col("action")))
    late = kept.withColumn("ts", F.when((key % 109 == 3) & (key % 103 != 1), F.col("ts") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts")))
    more = log.where(key % 107 == 2).withColumn("event_id", key + 1_000_000_000)
    now_ = U.entries(late.unionByName(more), _SEALED)
    return U.tampered(now_, U.entries(log, _SEALED)).select(F.col("key").cast("bigint").alias("event_id"), "finding")


# ------------------------------------------------------------------ dashboards
def _change(name, test):
    now_, before = f"count(*) FILTER ({test} AND p = 0)", f"count(*) FILTER ({test} AND p = 1)"
    return f"{now_} AS {name}, {now_} - {before} AS {name}_change"


@query(f"""WITH {O.AUDIT}, z AS (SELECT *, CASE WHEN ts > {T0} - INTERVAL 72 HOUR AND ts <= {T0} THEN 0
    WHEN ts > {T0} - INTERVAL 144 HOUR AND ts <= {T0} - INTERVAL 72 HOUR THEN 1 END AS p FROM a)
SELECT {_change('scans', 'TRUE')}, {_change('blocked', "action = 'block'")}, {_change('redacted', "action = 'redact'")},
  {_change('violations', 'policy_id IS NOT NULL')},
  round(avg(risk_score) FILTER (p = 0), 4) AS avg_risk, round(avg(risk_score) FILTER (p = 0) - avg(risk_score) FILTER (p = 1), 4) AS avg_risk_change,
  round(avg(processing_ms) FILTER (p = 0), 4) AS avg_ms, round(avg(processing_ms) FILTER (p = 0) - avg(processing_ms) FILTER (p = 1), 4) AS avg_ms_change
FROM z WHERE p IS NOT NULL""")
def dashboard_kpis(spark, sf):
    return U.period_kpis(events(spark, sf), now(), 72)


@query(f"""WITH {O.AUDIT}, sp AS (SELECT TIMESTAMP '2024-01-29' + to_hours(i) AS hour FROM range(24) t(i))
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (action IN ('allow', 'alert')) AS allowed,
  count(*) FILTER (action = 'redact') AS redacted, count(*) FILTER (action = 'block') AS blocked
FROM sp LEFT JOIN a ON date_trunc('hour', ts) = hour GROUP BY sp.hour""")
def hourly_trend(spark, sf):
    t = U.hourly_trend(events(spark, sf), F.to_timestamp(F.lit("2024-01-29")), 24)
    return t.withColumn("hour", stamp("hour"))


@query(O.INSPECTED + """, k AS (SELECT 'pii' AS kind, count(*) FILTER (n_pii > 0) AS n FROM s UNION ALL SELECT 'phi', count(*) FILTER (n_phi > 0) FROM s
  UNION ALL SELECT 'pci', count(*) FILTER (n_pci > 0) FROM s UNION ALL SELECT 'secrets', count(*) FILTER (n_secret > 0) FROM s
  UNION ALL SELECT 'injection', count(*) FILTER (n_injections > 0) FROM s UNION ALL SELECT 'toxicity', count(*) FILTER (toxic) FROM s)
SELECT kind, n, round(100.0::DOUBLE * n / greatest(sum(n) OVER (), 1), 2) AS percent FROM k""")
def detection_breakdown(spark, sf):
    kinds = (*S.CATEGORIES, "injection", "toxicity")
    wide = D.with_evidence(N.documents(spark, sf)).select(*[S.detected(k).alias(k) for k in kinds]).agg(
        *[F.count_if(k).alias(k) for k in kinds])
    rows = F.array(*[F.struct(F.lit("secrets" if k == "secret" else k).alias("kind"), F.col(k).alias("n")) for k in kinds])
    return U.share(wide.select(F.inline(rows)))


@query(O.INSPECTED + "SELECT attack_type, severity, count(*) AS n FROM j GROUP BY ALL")
def threat_distribution(spark, sf):
    rows = I.injection_rows(N.documents(spark, sf), "doc_id")
    return rows.groupBy("attack_type", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {O.AUDIT} SELECT event_id, action, risk_level FROM a ORDER BY ts DESC, event_id DESC LIMIT 8")
def recent_events(spark, sf):
    return U.bounded_buffer(events(spark, sf), 8).select("event_id", "action", "risk_level")


@query(f"""WITH {O.AUDIT}, n AS (SELECT * FROM a ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT count(*) FILTER (risk_level = 'critical') AS critical, count(*) FILTER (action = 'block') AS blocked,
  count(*) FILTER (risk_score > 0.7) AS high_risk, count(DISTINCT user_id) AS users FROM n""")
def threat_monitor_kpis(spark, sf):
    return U.recent_kpis(events(spark, sf), 50)


@query(f"""WITH {O.AUDIT}, lv AS (SELECT unnest(['critical', 'high', 'medium', 'low', 'none']) AS risk_level),
k AS (SELECT lv.risk_level, count(a.event_id) AS n FROM lv LEFT JOIN a USING (risk_level) GROUP BY ALL)
SELECT risk_level, n, round(100.0::DOUBLE * n / (SELECT count(*) FROM a), 2) AS percent FROM k""")
def severity_distribution(spark, sf):
    return U.severity_distribution(events(spark, sf))


@query(O.INSPECTED + """, k AS (SELECT attack_type, count(*) AS n, min(doc_id) AS first_seen FROM j GROUP BY ALL ORDER BY n DESC, first_seen LIMIT 5)
SELECT attack_type, n, round(100.0::DOUBLE * n / max(n) OVER (), 2) AS percent_of_top FROM k""")
def top_threats(spark, sf):
    rows = I.injection_rows(N.documents(spark, sf), "doc_id")
    return U.top_types(rows, "attack_type", "doc_id", 5)


@query(f"""WITH {O.AUDIT} SELECT event_id, risk_level, action FROM a WHERE risk_level IN ('critical', 'high') ORDER BY ts DESC, event_id DESC LIMIT 100""")
def severity_feed(spark, sf):
    found = U.audit_search(events(spark, sf), risk_level=("critical", "high"))
    return U.bounded_buffer(found, 100).select("event_id", "risk_level", "action")


@query(f"""{O.INSPECTED} SELECT s.doc_id, action, risk_score, CASE WHEN length(s.text) > 80 THEN left(s.text, 80) || '...' ELSE s.text END AS preview
FROM s ORDER BY doc_id DESC LIMIT 20""")
def scan_history(spark, sf):
    last = N.documents(spark, sf).orderBy(F.col("doc_id").desc()).limit(20)
    preview = F.when(F.length("text") > 80, F.concat(F.left("text", F.lit(80)), F.lit("..."))).otherwise(F.col("text"))
    return I.verdicts(last).select("doc_id", "action", "risk_score", preview.alias("preview"))


@query(O.INSPECTED + """
SELECT d.source || '_' || s.doc_id || '.txt' AS filename, risk_score, n_entities AS entities, n_injections AS injections,
  CASE WHEN risk_score > 0.7 THEN 'Block and review' WHEN risk_score > 0.3 THEN 'Review recommended' ELSE 'Safe to proceed' END AS recommendation
FROM s JOIN d USING (doc_id)""")
def file_report_export(spark, sf):
    r = I.inspect(N.documents(spark, sf))
    risk = F.col("overall_risk_score")
    return r.select(
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        risk.alias("risk_score"), F.size("entities").alias("entities"), F.size("injections").alias("injections"),
        F.when(risk > 0.7, "Block and review").when(risk > 0.3, "Review recommended").otherwise("Safe to proceed").alias("recommendation"))


# ------------------------------------------------------------------ metrics
def scans(spark, sf):
    """Scan outcomes as metric observations."""
    v = I.verdicts(N.documents(spark, sf))
    r = F.col("risk_score")
    return v.select(
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"), "doc_id", "action", "risk_score",
        N.risk_level(r).alias("risk_level"), F.lit("scan").alias("endpoint"), "evidence")


_SCANS = O.INSPECTED + """, m AS (SELECT 't' || (doc_id % 3) AS tenant_id, doc_id, action, risk_score, 'scan' AS endpoint,
  CASE WHEN risk_score >= 0.9 THEN 'critical' WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium'
       WHEN risk_score >= 0.1 THEN 'low' ELSE 'none' END AS risk_level FROM s)"""


@query(_SCANS + "SELECT tenant_id, action, endpoint, count(*) AS total FROM m GROUP BY ALL")
def requests_total(spark, sf):
    return U.counter(scans(spark, sf), "tenant_id", "action", "endpoint")


@query(_SCANS + "SELECT action, risk_level, tenant_id, count(*) AS total FROM m GROUP BY ALL")
def decisions_total(spark, sf):
    return U.counter(scans(spark, sf), "action", "risk_level", "tenant_id")


@query(_SCANS + "SELECT entity_type, category AS severity, 't' || (doc_id % 3) AS tenant_id, count(*) AS total FROM e GROUP BY ALL")
def entities_total(spark, sf):
    rows = I.entity_rows(N.documents(spark, sf), "doc_id").select(
        "entity_type", F.col("category").alias("severity"),
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"))
    return U.counter(rows, "entity_type", "severity", "tenant_id")


@query(_SCANS + "SELECT attack_type AS injection_type, 't' || (doc_id % 3) AS tenant_id, count(*) AS total FROM j GROUP BY ALL")
def injections_total(spark, sf):
    names = scans(spark, sf).select("tenant_id", F.explode_outer(S.injection_names()).alias("injection_type"))
    return U.counter(names.where("injection_type IS NOT NULL"), "injection_type", "tenant_id")


@query(_evaluated(ENGINE_RULES) + "SELECT policy_id, rule_id, action, count(*) AS total FROM rr WHERE triggered GROUP BY ALL")
def policy_violations_total(spark, sf):
    rows = P.rule_results(features(spark, sf, ENGINE_RULES), ENGINE_RULES, "doc_id")
    return U.counter(rows, "policy_id", "rule_id", "action")


@query(_SCANS + """
SELECT 'requests_total' AS metric, tenant_id, action, endpoint, NULL::VARCHAR AS risk_level, count(*) AS total, max(risk_score) AS max_risk FROM m GROUP BY ALL
UNION ALL SELECT 'decisions_total', tenant_id, action, NULL, risk_level, count(*), max(risk_score) FROM m GROUP BY ALL
UNION ALL SELECT 'tenant_scans', tenant_id, NULL, NULL, NULL, count(*), max(risk_score) FROM m GROUP BY ALL""")
def scan_metrics(spark, sf):
    return U.scan_metrics(scans(spark, sf))


def _rounded(histogram):
    return histogram.withColumn("total", F.round(F.col("total").cast("double"), 6))


def _histogram_sql(source, value, buckets, label):
    parts = [f"SELECT {label}, '{b:g}' AS le, count(*) FILTER ({value} <= {b}::DOUBLE) AS cumulative, count({value}) AS observations, round(sum({value})::DOUBLE, 6) AS total FROM {source} GROUP BY ALL"
             for b in buckets]
    parts.append(f"SELECT {label}, '+Inf', count({value}), count({value}), round(sum({value})::DOUBLE, 6) FROM {source} GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query(f"WITH {O.AUDIT} {_histogram_sql('a', 'processing_ms', C.LATENCY_BUCKETS_MS, 'event_type')}")
def latency_histogram(spark, sf):
    return _rounded(U.histogram(events(spark, sf), "processing_ms", C.LATENCY_BUCKETS_MS, "event_type"))


@query(_SCANS + _histogram_sql("m", "risk_score", C.RISK_BUCKETS, "tenant_id"))
def risk_histogram(spark, sf):
    return _rounded(U.histogram(scans(spark, sf), "risk_score", C.RISK_BUCKETS, "tenant_id"))


@query(f"WITH {O.AUDIT}, {_META} SELECT tenant_id, count(*) FILTER (last_active_at + INTERVAL 86400 SECOND >= {T0}) AS active_sessions FROM m GROUP BY ALL")
def active_sessions(spark, sf):
    m = H.split_expired(H.session_metadata(events(spark, sf)), now(), 86400)
    return U.gauges(m)


@query(f"WITH {O.AUDIT} SELECT tenant_id, max_by(processing_ms, ts) AS value FROM a GROUP BY ALL")
def latest_gauges(spark, sf):
    return U.latest_gauge(events(spark, sf), "tenant_id", "processing_ms", "ts")


@query(f"""WITH {X._STORE_AUTH} SELECT store_id, CASE WHEN ok THEN 'allow' ELSE 'deny' END AS action, count(*) AS total FROM ck GROUP BY ALL""")
def retrievals_total(spark, sf):
    a = X.G.authorize_stores(X.requests(spark, sf), X.stores(spark, sf))
    tagged = F.concat(
        F.transform("authorized_stores", lambda s: F.struct(s.alias("store_id"), F.lit("allow").alias("action"))),
        F.transform("denied_stores", lambda s: F.struct(s.alias("store_id"), F.lit("deny").alias("action"))))
    return U.counter(a.select(F.inline_outer(tagged)).where("store_id IS NOT NULL"), "store_id", "action")


@query(f"""WITH {O.AUDIT} SELECT event_type, count(*) AS requests, quantile_disc(processing_ms, 0.5) AS p50,
  quantile_disc(processing_ms, 0.95) AS p95, quantile_disc(processing_ms, 0.99) AS p99, max(processing_ms) AS max_ms FROM a GROUP BY ALL""")
def endpoint_latency(spark, sf):
    return U.endpoint_latency(events(spark, sf), "event_type", "processing_ms")


_PERIOD = ("2024-01-08", "2024-01-22")


def _period(spark, sf, *by):
    """Two weeks of the log, answered from its roll-up by the hour."""
    return RU.period(RU.hourly(events(spark, sf)), *[F.to_timestamp(F.lit(t)) for t in _PERIOD], *by)


@query(f"""WITH {O.AUDIT} SELECT tenant_id, action, count(*) AS events, count(*) FILTER (risk_score > 0.7) AS high_risk,
  (sum(processing_ms) // count(*))::BIGINT AS avg_ms, max(processing_ms) AS max_ms FROM a
WHERE ts >= TIMESTAMP '{_PERIOD[0]}' AND ts < TIMESTAMP '{_PERIOD[1]}' GROUP BY ALL""")
def rollup_counts(spark, sf):
    return _period(spark, sf, "tenant_id", "action").select("tenant_id", "action", "events", "high_risk", "avg_ms", "max_ms")


@query(f"""WITH {O.AUDIT} SELECT event_type, count(*) AS requests, true AS users_within_error, true AS quantiles_within_error FROM a
WHERE ts >= TIMESTAMP '{_PERIOD[0]}' AND ts < TIMESTAMP '{_PERIOD[1]}' GROUP BY ALL""")
def rollup_accuracy(spark, sf):
    """Sketched users and latency quantiles of a period against exact ones, within four times their stated errors."""
    exact = events(spark, sf).where((F.col("ts") >= _PERIOD[0]) & (F.col("ts") < _PERIOD[1]))
    sketched = _period(spark, sf, "event_type")
    j = exact.join(sketched.select("event_type", "users", "p50", "p95", "p99"), "event_type")
    ranks = [f(F.col("processing_ms"), F.col(p)) for p in ("p50", "p95", "p99") for f in (lambda v, q: v < q, lambda v, q: v <= q)]
    counted = j.groupBy("event_type").agg(
        F.count("*").alias("requests"), F.count_distinct("user_id").alias("n"), F.first("users").alias("users"),
        *[F.count_if(t).alias(f"r{i}") for i, t in enumerate(ranks)])
    # The share of values below and up to a quantile must enclose it, give or take the error.
    room = 4 * RU.RANK_ERROR
    share = lambda i: F.col(f"r{i}") / F.col("requests")
    enclosed = [(share(2 * i) <= q + room) & (share(2 * i + 1) >= q - room) for i, q in enumerate((0.5, 0.95, 0.99))]
    return counted.select("event_type", "requests",
                          (F.abs(F.col("users") - F.col("n")) <= 4 * RU.DISTINCT_ERROR * F.col("n") + 1).alias("users_within_error"),
                          (enclosed[0] & enclosed[1] & enclosed[2]).alias("quantiles_within_error"))


# ------------------------------------------------------------------ evidence and joins
@query(f"""WITH RECURSIVE {X._DECIDED}, {X._FOLD}, {O.META}, u AS (SELECT *, 'analyst' AS user_role FROM m)
SELECT 'document' AS kind, doc_id AS subject_id, CASE WHEN NOT is_quarantined AND {X.ROLE} >= {X.CLASS} THEN 'allowed' ELSE 'denied' END AS outcome FROM u
UNION ALL SELECT 'tool_call', call_id, decision FROM final""")
def access_control_log(spark, sf):
    reads = X.G.document_access(N.document_metadata(spark, sf), F.lit("analyst")).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("subject_id"), F.col("access").alias("outcome"))
    calls = X._decisions(spark, sf).select(
        F.lit("tool_call").alias("kind"), F.col("call_id").alias("subject_id"), F.col("decision").alias("outcome"))
    return reads.unionByName(calls)


# ------------------------------------------------------------------ dimensions
_USERS = """u AS (SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@example.com' AS email, n_name AS tenant,
  (['viewer', 'analyst', 'admin'])[c_custkey % 3 + 1] AS role, c_mktsegment AS department, c_acctbal >= 0 AS is_active
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def users(spark, sf):
    c, n = N.table(spark, sf, "customer"), N.table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("tenant"), N.by_index(("viewer", "analyst", "admin"), F.col("c_custkey")).alias("role"),
        F.col("c_mktsegment").alias("department"), (F.col("c_acctbal") >= 0).alias("is_active"))


@query(f"WITH {_USERS} SELECT tenant, count(*) AS users, count(*) FILTER (is_active) AS active_users FROM u GROUP BY ALL")
def tenants(spark, sf):
    return users(spark, sf).groupBy("tenant").agg(F.count("*").alias("users"), F.count_if("is_active").alias("active_users"))


@query(f"""{O.INSPECTED.replace('WITH ', f'WITH {O.AUDIT}, {_USERS}, ', 1)}
SELECT a.tenant_id, u.tenant AS home_tenant, a.action AS audited, s.action AS scanned, count(*) AS n, count(u.user_id) AS known_users
FROM a LEFT JOIN s ON s.doc_id = a.event_id LEFT JOIN u ON u.user_id = a.user_id GROUP BY ALL""")
def audit_scan_join(spark, sf):
    """Every audit event with its scan, if it has one, and the tenant its user belongs to, if the user is known."""
    v = I.verdicts(N.documents(spark, sf)).select("doc_id", F.col("action").alias("scanned"))
    home = users(spark, sf).select("user_id", F.col("tenant").alias("home_tenant"))
    a = events(spark, sf).select("event_id", "tenant_id", "user_id", F.col("action").alias("audited"))
    j = a.join(v, a.event_id == v.doc_id, "left").join(home, "user_id", "left")
    return j.groupBy("tenant_id", "home_tenant", "audited", "scanned").agg(
        F.count("*").alias("n"), F.count("home_tenant").alias("known_users"))


@query(f"""WITH {_USERS}, t AS (SELECT tenant, count(*) AS users, count(*) FILTER (is_active) AS active FROM u GROUP BY ALL)
SELECT count(*) AS tenants, count(*) FILTER (active * 10 >= users * 9) AS active_tenants, sum(users)::BIGINT AS users, sum(active)::BIGINT AS active_users FROM t""")
def admin_overview(spark, sf):
    t = tenants(spark, sf)
    return t.agg(F.count("*").alias("tenants"), F.count_if(F.col("active_users") * 10 >= F.col("users") * 9).alias("active_tenants"),
                 F.sum("users").alias("users"), F.sum("active_users").alias("active_users"))


@query(f"""WITH {_USERS} SELECT user_id, email, role, department FROM u
WHERE (contains(lower(email), 'build') OR contains(lower(role), 'build') OR contains(lower(department), 'build')) AND role IN ('analyst', 'admin')""")
def user_search(spark, sf):
    found = U.audit_search(users(spark, sf), "BUILD", ("email", "role", "department"), role=("analyst", "admin"))
    return found.select("user_id", "email", "role", "department")


# ------------------------------------------------------------------ sources
@query(f"WITH {O.DOCUMENTS} SELECT source, length(text) BETWEEN 1 AND 8000 AS admitted, count(*) AS n FROM d GROUP BY ALL")
def request_admission(spark, sf):
    d = FS.admit_texts(N.documents(spark, sf), max_chars=8000)
    return d.groupBy("source", "admitted").agg(F.count("*").alias("n"))


_EXT = ("pdf", "CSV", "json", "txt", "docx", "eml", "exe", "")
_FILES = f"""f AS (SELECT doc_id, source || '_' || doc_id || CASE WHEN doc_id % 8 = 7 THEN '' ELSE '.' || ({list(_EXT)})[doc_id % 8 + 1] END AS filename,
  octet_length(encode(text)) * 5000 AS size_bytes FROM d)"""


@query(f"""WITH {O.DOCUMENTS}, {_FILES}, g AS (SELECT doc_id, CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) ELSE '' END AS ext, size_bytes FROM f)
SELECT doc_id, ext, CASE WHEN ext NOT IN ('pdf', 'csv', 'json', 'txt', 'docx', 'eml') THEN 'extension' WHEN size_bytes > 52428800 THEN 'size' END AS reject_reason FROM g""")
def file_admission(spark, sf):
    d = N.documents(spark, sf)
    suffix = F.concat(F.lit("."), N.by_index(_EXT, F.col("doc_id")))
    f = d.select(
        "doc_id",
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 8 == 7, "").otherwise(suffix)).alias("filename"),
        (F.octet_length("text") * 5000).alias("size_bytes"))
    return FS.admission(f).select("doc_id", "ext", "reject_reason")


_KINDS = ("txt", "csv", "json", "eml", "eml")
_CSV = """'id,source,text' || chr(10) || CASE WHEN doc_id % 2 = 1 THEN '0,none,' || chr(10) ELSE '' END
  || doc_id || ',' || source || ',"' || replace(text, '"', '""') || '"' || chr(10)"""


def files(spark, sf):
    """Documents as files: plain texts, CSV and JSON files, nested mails in base 64 and mails in quoted-printable."""
    d = N.documents(spark, sf)
    doc = F.col("doc_id").cast("string")
    head = F.concat(F.lit("From: a@x.org\nTo: "), F.col("source"), F.lit("@y.org\nSubject: Document "), doc, F.lit("\n"))
    utf8 = F.encode("text", "UTF-8")
    nested = F.concat(
        head, F.lit('Content-Type: multipart/mixed; boundary="one"\n\n--one\nContent-Type: multipart/alternative; boundary="two"\n\n'
                    "--two\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(utf8),
        F.lit("\n--two\nContent-Type: text/html\n\n<p>not text</p>\n--two--\n--one\nContent-Type: application/pdf\n\n%PDF\n--one--\n"))
    quoted = F.concat(head, F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"),
                      F.regexp_replace(F.hex(utf8), "(..)", "=$1"))
    table = F.concat(F.lit("id,source,text\n"), F.when(F.col("doc_id") % 2 == 1, "0,none,\n").otherwise(""), doc, F.lit(","),
                     "source", F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\n'))
    tree = F.to_json(F.struct("doc_id", F.struct("source", F.array("text").alias("parts")).alias("body")))
    kind = F.col("doc_id") % len(_KINDS)
    content = F.when(kind == 0, F.col("text")).when(kind == 1, table).when(kind == 2, tree).when(kind == 3, nested).otherwise(quoted)
    return d.select("doc_id", N.by_index(_KINDS, F.col("doc_id")).alias("ext"), F.encode(content, "UTF-8").alias("content"))


@query(f"""WITH {O.DOCUMENTS} SELECT doc_id, ({list(_KINDS)})[doc_id % 5 + 1] AS ext,
  sha256(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN {_CSV}
    WHEN 2 THEN json_object('body', json_object('parts', json_array(text), 'source', source), 'doc_id', doc_id)::VARCHAR
    ELSE 'a@x.org' || chr(10) || source || '@y.org' || chr(10) || 'Document ' || doc_id || chr(10) || text END) AS text_hash FROM d""")
def file_texts(spark, sf):
    """Documents as files of every kind that has a reader, through the reader."""
    return FS.extract_text(files(spark, sf), "doc_id").select("doc_id", "ext", content_hash(F.col("text")).alias("text_hash"))


_ROW = "CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END::BIGINT"
_PLACES = [("csv", "0::BIGINT", f"'{c}'", f"'{c}'", "TRUE") for c in ("id", "source", "text")] + [
    ("csv", "1::BIGINT", "'id'", "'0'", "doc_id % 2 = 1"), ("csv", "1::BIGINT", "'source'", "'none'", "doc_id % 2 = 1"),
    ("csv", _ROW, "'id'", "doc_id::VARCHAR", "TRUE"), ("csv", _ROW, "'source'", "source", "TRUE"), ("csv", _ROW, "'text'", "text", "text <> ''"),
    ("json", "NULL::BIGINT", "'$.doc_id'", "doc_id::VARCHAR", "TRUE"), ("json", "NULL::BIGINT", "'$.body.source'", "source", "TRUE"),
    ("json", "NULL::BIGINT", "'$.body.parts[0]'", "text", "TRUE")]
_VALUES = "v AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{ext}' AS ext, {row} AS row, {path} AS path, {value} AS text FROM d WHERE doc_id % 5 = {1 if ext == 'csv' else 2} AND {where}"
    for ext, row, path, value, where in _PLACES) + ")"


@query(f"""WITH {O.DOCUMENTS}, {_VALUES}, {O.hits('v', 'doc_id, ext, row, path')}, {O.TYPED}
SELECT doc_id, ext, row, path, entity_type, count(*) AS n FROM e GROUP BY ALL""")
def file_findings(spark, sf):
    """Entities of JSON and CSV files with the key or the row and column they stand in."""
    found = I.entity_rows(FS.file_values(files(spark, sf), "doc_id"), "doc_id", "ext", "row", "path", text="value")
    return found.groupBy("doc_id", "ext", "row", "path", "entity_type").agg(F.count("*").alias("n"))


@query(f"""{O.INSPECTED} SELECT sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS entities, 0::BIGINT AS leaked FROM e""")
def redaction_leaks(spark, sf):
    """Entities of the original texts that survive in the merged redaction: there must be none.

    Values are looked for in their own row before anything is aggregated.
    """
    d = N.documents(spark, sf)
    clean = R.redact(d, overlaps="merge").select("doc_id", "text", "redacted_text")
    found = D.with_evidence(clean).select(D.hits().alias("hits"), "redacted_text")
    left = D.with_evidence(found, "redacted_text", "evidence").select(
        F.size("hits").alias("n"), F.size(D.hits("redacted_text")).alias("left"))
    return left.agg(F.sum("n").alias("entities"), F.sum("left").alias("leaked"))
