"""Streaming queries: the tables as file streams, run to completion and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limits as L
from ..sources import sinks
from ..streaming import streams as X
from . import inputs as N
from . import oracle as O
from . import seeds
from .conversations import stamp
from .access import _TOKEN
from .policies import RULES, _evaluated, context

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def _events(spark, sf):
    schema = N.table(spark, sf, "events").schema
    e = X.file_stream(spark, f"{sf}/events.parquet", schema)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", N.action_of(F.col("event_type")).alias("action"),
        F.least(F.floor("value") / 200, F.lit(1.0)).alias("risk_score"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"))


def _documents(spark, sf):
    schema = N.table(spark, sf, "documents").schema
    d = X.file_stream(spark, f"{sf}/documents.parquet", schema)
    return d.select("doc_id", "source", F.concat(
        "text", seeds.chosen(seeds.DOCUMENT_SEEDS, F.col("doc_id"), seeds.N_DOCUMENT_SEEDS)).alias("text"))


def _result(spark, out):
    return spark.read.parquet(f"{out}/data")


_WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM a)"


@query(O.INSPECTED + "SELECT doc_id, action, risk_score, block_reason FROM s")
def stream_inspection(spark, sf):
    v = X.inspect_stream(_documents(spark, sf)).select("doc_id", "action", "risk_score", "block_reason")
    return _result(spark, X.run_available(v, "inspection"))


@query(f"""WITH {O.AUDIT} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, action, count(*) AS n FROM a GROUP BY ALL""")
def stream_action_counts(spark, sf):
    t = X.tumbling_counts(_events(spark, sf), "action")
    return _result(spark, X.run_available(t, "actions", "complete")).withColumn("window_start", stamp("window_start"))


@query(f"""WITH {O.AUDIT}, w AS (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s
  FROM a WHERE risk_score > 0.7) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS high_risk FROM w GROUP BY ALL""")
def stream_high_risk(spark, sf):
    t = X.sliding_high_risk(_events(spark, sf), width="6 hours", step="1 hour")
    return _result(spark, X.run_available(t, "risk", "complete")).withColumn("window_start", stamp("window_start"))


@query(f"""WITH {O.AUDIT}, g AS (
  SELECT *, sum(brk) OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS grp FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY tenant_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM a))
SELECT tenant_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS messages, max(risk_score) AS max_risk_score
FROM g GROUP BY tenant_id, grp HAVING max(ts) + INTERVAL 2 HOUR <= {_WATERMARK}""")
def stream_sessions(spark, sf):
    t = X.session_activity(_events(spark, sf), "tenant_id", ttl_seconds=7200)
    out = _result(spark, X.run_available(t, "sessions"))
    return out.select("tenant_id", stamp("started_at").alias("started_at"), "messages", "max_risk_score")


@query(f"WITH {O.AUDIT} SELECT user_id, action, count(*) AS n FROM (SELECT DISTINCT user_id, action FROM a) GROUP BY ALL")
def stream_without_replays(spark, sf):
    t = X.without_replays(_events(spark, sf), "user_id", "action", lateness="1 day")
    return _result(spark, X.run_available(t, "replays")).groupBy("user_id", "action").agg(F.count("*").alias("n"))


@query(f"WITH {O.AUDIT} SELECT 'audit' AS sink, action, count(*) AS n FROM a GROUP BY ALL UNION ALL "
       "SELECT 'alert', action, count(*) FROM a WHERE action IN ('block', 'alert') GROUP BY ALL")
def stream_topic_split(spark, sf):
    out = X.run_available(_events(spark, sf), "topics", writer=lambda o: sinks.split_topics(f"{o}/audit", f"{o}/alert"))
    read = lambda name: spark.read.parquet(f"{out}/{name}").groupBy("action").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("sink"), "action", "n")
    return read("audit").unionByName(read("alert"))


@query(f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
tb AS (SELECT user_id, n, t, 2 * {_TOKEN}::BIGINT AS level, true AS admitted FROM o WHERE n = 1
  UNION ALL SELECT user_id, n, t, CASE WHEN l < {_TOKEN} THEN l ELSE l - {_TOKEN} END, l >= {_TOKEN} FROM (
    SELECT o.user_id, o.n, o.t, least(3 * {_TOKEN}::BIGINT, level + o.t - tb.t) AS l
    FROM tb JOIN o ON o.user_id = tb.user_id AND o.n = tb.n + 1))
SELECT event_id, user_id, admitted FROM tb JOIN o USING (user_id, n)""")
def stream_token_bucket(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts")
    out = X.run_available(e, "bucket", writer=X.limit_writer(L.TokenBucket(0.002, 3), "user_id", "ts", ["event_id"]))
    return _result(spark, out).select("event_id", "user_id", "admitted")


@query(f"""WITH RECURSIVE {O.AUDIT},
ob AS (SELECT event_id, user_id, epoch_us(ts) AS t, action <> 'block' AS counts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM a),
lf AS (SELECT user_id, n, false AS limited, CASE WHEN counts THEN [t] ELSE CAST([] AS BIGINT[]) END AS recent FROM ob WHERE n = 1
  UNION ALL SELECT k.user_id, k.n, len(kept) >= 2, CASE WHEN len(kept) < 2 AND counts THEN list_append(kept, t) ELSE kept END
  FROM (SELECT ob.user_id, ob.n, ob.t, ob.counts, list_filter(lf.recent, lambda x: ob.t - x < 259200000000::BIGINT) AS kept
        FROM lf JOIN ob ON ob.user_id = lf.user_id AND ob.n = lf.n + 1) k)
SELECT event_id, user_id, limited FROM lf JOIN ob USING (user_id, n)""")
def stream_agent_limits(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", (F.col("action") != "block").alias("counts"))
    out = X.run_available(e, "agents", writer=X.limit_writer(L.TrailingWindow(2, 259200), "user_id", "ts", ["event_id"], "counts"))
    return _result(spark, out).select("event_id", "user_id", "limited")


@query(_evaluated(RULES) + "SELECT doc_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_no) FILTER (triggered), '') AS rules FROM rr GROUP BY doc_id")
def stream_policy(spark, sf):
    picked = ("doc_id", F.array_join("triggered_rule_ids", ",").alias("rules"))
    writer = X.policy_writer(lambda: RULES, lambda: context(spark, sf), columns=picked)
    out = X.run_available(_documents(spark, sf).select("doc_id", "text"), "policy", writer=writer)
    return _result(spark, out).select("doc_id", "rules")
