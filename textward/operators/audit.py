"""Audit queries, dashboards and metrics over event tables.

Everything is an aggregate with map-side combination or a top-k; no query ranks
or sorts a whole log.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import catalog as C


# ------------------------------------------------------------------ lists and search
def audit_filter(
    events: DataFrame, as_of: Column | None = None, since_hours: float | None = None, **equal,
) -> DataFrame:
    """Events since a cutoff that equal the given values; nulls among the values mean no filter."""
    tests = [F.col(k) == v for k, v in equal.items() if v is not None]
    if since_hours is not None:
        tests.append(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(since_hours * 3600)))
    return events.where(reduce(lambda a, b: a & b, tests)) if tests else events


def audit_page(events: DataFrame, limit: int = 50, offset: int = 0, order=("event_id",)) -> DataFrame:
    return events.orderBy(*order).offset(offset).limit(limit)


def audit_listing(events: DataFrame, limit: int = 50, offset: int = 0, order=("event_id",)) -> DataFrame:
    """A page, and in ``total`` how many events there are in all: a count of its own, so no log is windowed."""
    total = events.agg(F.count("*")).scalar()
    return audit_page(events, limit, offset, order).withColumn("total", total)


def audit_search(
    events: DataFrame, text: str | None = None, columns=("event_type", "session_id", "department", "policy_id"),
    start: Column | None = None, end: Column | None = None, **any_of,
) -> DataFrame:
    """Time range, IN lists and a case-insensitive substring over several columns."""
    tests = [F.col(k).isin(list(v)) for k, v in any_of.items() if v]
    if start is not None:
        tests.append(F.col("ts") >= start)
    if end is not None:
        tests.append(F.col("ts") <= end)
    if text:
        needle = F.lit(text.lower())
        tests.append(reduce(lambda a, b: a | b, [
            F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle) for c in columns]))
    return events.where(reduce(lambda a, b: a & b, tests)) if tests else events


def event_by_id(events: DataFrame, event_id) -> DataFrame:
    """The latest event with an id (none if absent)."""
    rest = [c for c in events.columns if c != "event_id"]
    return events.where(F.col("event_id") == event_id).groupBy("event_id").agg(
        F.max_by(F.struct(*rest), "ts").alias("e")).select("event_id", "e.*")


def summary(events: DataFrame) -> DataFrame:
    """Counts by action, by risk level and by policy in one pass (null policies are not counted)."""
    named = events.select(
        F.coalesce("action", F.lit("unknown")).alias("action"),
        F.coalesce("risk_level", F.lit("unknown")).alias("risk_level"), "policy_id")
    counted = named.groupingSets(
        [["action"], ["risk_level"], ["policy_id"]], "action", "risk_level", "policy_id"
    ).agg(F.count("*").alias("events"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "action").when(F.col("g") == 5, "risk_level").otherwise("policy")
    value = F.when(F.col("g") == 3, F.col("action")).when(F.col("g") == 5, F.col("risk_level")).otherwise(F.col("policy_id"))
    return counted.select(kind.alias("dimension"), value.alias("value"), "events").where("value IS NOT NULL")


def kpis(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.col("action") == "redact").alias("redacted"),
        F.count_if(F.col("risk_level") == "critical").alias("critical"),
        F.floor(F.coalesce(F.sum("processing_ms"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_ms"))


def compliance_report(events: DataFrame, frameworks, as_of: Column) -> DataFrame:
    k = kpis(events)
    return k.select(
        F.col("total").alias("total_events"), F.col("blocked").alias("blocked_events"),
        F.col("redacted").alias("redacted_events"), F.col("critical").alias("critical_risk_events"),
        F.array_join(F.array(*[F.lit(f) for f in frameworks]), ", ").alias("compliance_frameworks"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("report_generated"))


def event_lines(events: DataFrame, metadata=("processing_ms", "department")) -> DataFrame:
    """One JSON line per event: fixed fields first, then the metadata columns at top level."""
    fixed = F.struct(
        "event_id", "event_type", "tenant_id", "user_id", "session_id", "action",
        F.round("risk_score", 4).alias("risk_score"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *metadata)
    return events.select("event_id", F.to_json(fixed).alias("line"))


# ------------------------------------------------------------------ dashboards
def period_kpis(events: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Current period, previous period and change, as conditional aggregates over one scan."""
    width = F.make_dt_interval(hours=F.lit(hours))
    period = F.when((F.col("ts") > as_of - width) & (F.col("ts") <= as_of), 0).when(
        (F.col("ts") > as_of - width - width) & (F.col("ts") <= as_of - width), 1)
    marked = events.withColumn("_p", period).where("_p IS NOT NULL")
    out = []
    for name, test in (("scans", F.lit(True)), ("blocked", F.col("action") == "block"),
                       ("redacted", F.col("action") == "redact"), ("violations", F.col("policy_id").isNotNull())):
        now, before = F.count_if(test & (F.col("_p") == 0)), F.count_if(test & (F.col("_p") == 1))
        out += [now.alias(name), (now - before).alias(f"{name}_change")]
    for name, value in (("avg_risk", "risk_score"), ("avg_ms", "processing_ms")):
        now = F.avg(F.when(F.col("_p") == 0, F.col(value)))
        before = F.avg(F.when(F.col("_p") == 1, F.col(value)))
        out += [F.round(now, 4).alias(name), F.round(now - before, 4).alias(f"{name}_change")]
    return marked.agg(*out)


def hourly_trend(events: DataFrame, start: Column, hours: int) -> DataFrame:
    """Allowed, redacted and blocked events per hour, zero-filled."""
    end = start + F.make_dt_interval(hours=F.lit(hours))
    inside = events.where((F.col("ts") >= start) & (F.col("ts") < end))
    action = lambda a: F.count_if(F.col("action").isin(*a))
    counted = inside.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        action(("allow", "alert")).alias("allowed"), action(("redact",)).alias("redacted"),
        action(("block",)).alias("blocked"))
    spine = events.sparkSession.range(hours).select(
        (start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))
    filled = spine.join(counted, "hour", "left")
    return filled.select("hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("allowed", "redacted", "blocked")])


def share(counts: DataFrame, value: str = "n") -> DataFrame:
    """Append the percentage of the total; meant for small aggregates."""
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(100 * F.col(value) / F.greatest(total, F.lit(1)), 2))


def severity_distribution(events: DataFrame, levels=("critical", "high", "medium", "low", "none")) -> DataFrame:
    """Counts for every level, absent ones included, from one row of conditional counts."""
    counts = events.agg(*[F.count_if(F.col("risk_level") == x).alias(x) for x in levels], F.count("*").alias("_n"))
    rows = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x).alias("n")) for x in levels])
    return counts.select("_n", F.inline(rows)).select(
        "risk_level", "n", F.round(100 * F.col("n") / F.greatest("_n", F.lit(1)), 2).alias("percent"))


def top_types(events: DataFrame, column: str, first_seen: str, k: int = 5) -> DataFrame:
    """Most frequent values; ties by first appearance, bar length relative to the top."""
    counts = events.groupBy(column).agg(F.count("*").alias("n"), F.min(first_seen).alias("_first"))
    top = counts.orderBy(F.col("n").desc(), "_first").limit(k)
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))
    return top.select(column, "n", F.round(100 * F.col("n") / peak, 2).alias("percent_of_top"))


def recent_kpis(events: DataFrame, newest: int = 50) -> DataFrame:
    last = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(newest)
    return last.agg(
        F.count_if(F.col("risk_level") == "critical").alias("critical"),
        F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.col("risk_score") > 0.7).alias("high_risk"), F.count_distinct("user_id").alias("users"))


# ------------------------------------------------------------------ metrics
def counter(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def scan_metrics(scans: DataFrame) -> DataFrame:
    """Request, decision and per-tenant counters of scans from one aggregation."""
    grouped = scans.groupingSets(
        [["tenant_id", "action", "endpoint"], ["action", "risk_level", "tenant_id"], ["tenant_id"]],
        "tenant_id", "action", "endpoint", "risk_level",
    ).agg(F.count("*").alias("total"), F.max("risk_score").alias("max_risk"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 1, "requests_total").when(F.col("g") == 2, "decisions_total").otherwise("tenant_scans")
    return grouped.select(name.alias("metric"), "tenant_id", "action", "endpoint", "risk_level", "total", "max_risk")


def histogram(events: DataFrame, value: str, buckets, *labels: str) -> DataFrame:
    """Cumulative buckets with ``+Inf``, sum and count per label set, in one aggregation."""
    v = F.col(value)
    bounds = [(f"b{i}", b) for i, b in enumerate(buckets)]
    wide = events.groupBy(*labels).agg(
        *[F.count_if(v <= b).alias(n) for n, b in bounds], F.count(v).alias("_count"), F.sum(v).alias("_sum"))
    rows = F.array(
        *[F.struct(F.lit(f"{b:g}").alias("le"), F.col(n).alias("cumulative")) for n, b in bounds],
        F.struct(F.lit("+Inf").alias("le"), F.col("_count").alias("cumulative")))
    return wide.select(*labels, F.inline(rows), F.col("_count").alias("observations"), F.col("_sum").alias("total"))


def gauges(metadata: DataFrame) -> DataFrame:
    """Active sessions per tenant from session metadata with its ``expired`` flag."""
    return metadata.groupBy("tenant_id").agg(F.count_if(~F.col("expired")).alias("active_sessions"))


def latest_gauge(samples: DataFrame, label: str, value: str, ts: str) -> DataFrame:
    return samples.groupBy(label).agg(F.max_by(value, ts).alias("value"))


def endpoint_latency(log: DataFrame, endpoint: str, value: str) -> DataFrame:
    """Requests and exact latency quantiles per endpoint.

    Latencies are whole milliseconds: requests are counted per (endpoint, value), partially before the shuffle, and
    only the counts are ranked.
    """
    counts = log.groupBy(endpoint, F.col(value).alias("_ms")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(endpoint)
    upto = w.orderBy("_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select("*", F.sum(F.when(F.col("_ms").isNotNull(), F.col("_n")).otherwise(0)).over(upto).alias("_upto"),
                           F.sum(F.when(F.col("_ms").isNotNull(), F.col("_n")).otherwise(0)).over(w).alias("_all"))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_all") * F.lit(q)), F.lit(1)), F.col("_ms")))

    return ranked.groupBy(endpoint).agg(
        F.sum("_n").alias("requests"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"),
        quantile(0.99).alias("p99"), F.max("_ms").alias("max_ms"))


def integrity_check(log: DataFrame, source: DataFrame, key: str, hash_column: str, text: str) -> DataFrame:
    """Compare stored content hashes with the source texts; only hashes are joined."""
    actual = source.select(key, F.sha2(F.encode(text, "UTF-8"), 256).alias("_actual"))
    joined = log.select(key, hash_column).join(actual, key, "left")
    return joined.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col(hash_column) == F.col("_actual")).alias("intact"),
        F.count_if(F.col("_actual").isNull()).alias("orphaned"))


def bounded_buffer(events: DataFrame, size: int = C.AUDIT_BUFFER) -> DataFrame:
    """The newest ``size`` events, as a top-k."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(size)


# ------------------------------------------------------------------ hash chain
#: Parts of a minute's entries, each hashed by one task.
SLOTS = 64


def entries(log: DataFrame, columns: Sequence[str], key: str = "event_id", ts: str = "ts", tenant: str = "tenant_id") -> DataFrame:
    """``tenant_id, minute, slot, key, digest``: what is sealed of every entry; nulls and texts that look like them differ."""
    fields = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
                         F.lit("-")) for c in columns]
    minute = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 60_000_000).cast("bigint")
    return log.select(
        F.col(tenant).alias("tenant_id"), minute.alias("minute"), F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot"),
        F.col(key).cast("string").alias("key"), F.sha2(F.concat_ws(",", *fields), 256).alias("digest"))


def _root(*parts: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*parts)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *(r[p].cast("string") for p in parts))), ","), 256)


def leaves(sealed: DataFrame) -> DataFrame:
    """Root and number of the entries of each tenant, minute and slot."""
    return sealed.groupBy("tenant_id", "minute", "slot").agg(_root("key", "digest").alias("root"), F.count("*").alias("entries"))


def chain(sealed: DataFrame) -> DataFrame:
    """``tenant_id, days, entries, head``: roots of minutes, hours and days, and per tenant the chain over its days.

    Every level hashes the roots of the level below, so no task holds more than a slot's entries, a minute's slots, an
    hour's minutes, a day's hours or a tenant's days.
    """
    level = leaves(sealed).groupBy("tenant_id", "minute").agg(_root("slot", "root").alias("root"), F.sum("entries").alias("entries"))
    for name, below, width in (("hour", "minute", 60), ("day", "hour", 24)):
        level = level.withColumn(name, F.floor(F.col(below) / width).cast("bigint")).groupBy("tenant_id", name).agg(_root(below, "root").alias("root"), F.sum("entries").alias("entries"))
    days = F.array_sort(F.collect_list(F.struct("day", "root")))
    head = F.aggregate(days, F.lit(""), lambda acc, d: F.sha2(F.concat(acc, F.lit("|"), d["day"].cast("string"), F.lit(":"), d["root"]), 256))
    return level.groupBy("tenant_id").agg(F.count("*").alias("days"), F.sum("entries").alias("entries"), head.alias("head"))


def tampered(now: DataFrame, sealed: DataFrame) -> DataFrame:
    """``key, finding`` (altered, removed, inserted) of entries that are not as they were sealed.

    Roots of slots are compared first; only entries of slots that differ are compared one by one.  An entry that is
    moved to another time or tenant, or repeated, is found too (altered; inserted).
    """
    place = ["tenant_id", "minute", "slot"]
    roots = [leaves(x).select(*place, F.concat_ws(":", "root", F.col("entries").cast("string")).alias(n))
             for x, n in ((now, "new"), (sealed, "old"))]
    same = [a.eqNullSafe(b) for a, b in ((roots[0][c], roots[1][c]) for c in place)]
    both = roots[0].join(roots[1], same[0] & same[1] & same[2], "full_outer").filter(~F.col("new").eqNullSafe(F.col("old")))
    changed = both.select(*(F.coalesce(roots[0][c], roots[1][c]).alias(f"_{c}") for c in place)).distinct()

    def of_changed(x: DataFrame, sign: int) -> DataFrame:
        match = [x[c].eqNullSafe(changed[f"_{c}"]) for c in place]
        return x.join(changed, match[0] & match[1] & match[2], "left_semi").select("*", F.lit(sign).alias("_sign"))

    found = of_changed(now, 1).unionByName(of_changed(sealed, -1)) \
        .groupBy("key", "digest", *place).agg(F.sum("_sign").alias("_more")).filter("_more <> 0")
    return found.groupBy("key").agg(F.max("_more").alias("_high"), F.min("_more").alias("_low")).select(
        "key", F.when((F.col("_high") > 0) & (F.col("_low") < 0), "altered").when(F.col("_high") > 0, "inserted")
        .otherwise("removed").alias("finding"))
